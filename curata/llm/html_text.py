"""Main text of web pages, with each host's pages voting on where it stands.

1. Every page is cut into text blocks, each under the path of its containers.
   A path lists tags with their first class; digits are generalised to ``0``.
   Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
   and comments, by tag or by words in class and id, give no blocks.
2. From the root, a page descends into the container that holds most of the
   text until none does, or to an article or main, which stays whole; that
   path is its vote.
3. Spark counts votes per host; the path with most pages wins, then most text.
4. Pages are read again: their text is the blocks at or under the winning path.
   A page without that path uses its own vote.

Votes are pre-aggregated, so a host with a third of all pages is one row per
task.  The winners are broadcast only when there are at most ``MAX_HOSTS``;
beyond that they are joined by host.

Nulls: a null or empty html gives an empty text; a null url is a host of its
own.  Every row gives one row, equal rows too.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import record
from curata.llm.tables import settle

MAX_HOSTS = 50_000
SHARE = 0.6
FAVOURED = 3.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title|math|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_DROPPED_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?s?|banner|sidebar|side|comments?|"
    r"replies|disqus|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|foot|cookies?|consent|gdpr|"
    r"notices?|alert|warning|disclaimer|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|"
    r"related|recommended|widget|toolbar|pagination|pager|tags|hidden|search|login)(?:$|[\s_-])",
    re.I,
)
#: Fixed values of HTML: which tags are void, dropped, containers, and block-level.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = set("nav header footer aside form menu button select dialog fieldset label head".split())
_CONTAINERS = set("html body div section article main center".split())
_BLOCKS = set(
    "address blockquote caption dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr legend li ol p pre "
    "summary table tbody td tfoot th thead tr ul".split()
) | _CONTAINERS | _DROPPED
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


def text_blocks(page: str) -> list[tuple[str, str, int]]:
    """(container path, text, characters of it inside links) of every block kept, in page order."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, bool, str]] = []  # tag, dropped, container path
    pieces: list[str] = []
    links = linked = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append((stack[-1][2] if stack else "", text, linked))
            pieces.clear()
        linked = 0

    def cut(to: int):
        nonlocal links
        flush()
        for tag, _, _ in stack[to:]:
            links -= tag == "a"
        del stack[to:]

    def text(piece: str):
        nonlocal linked
        if piece and not (stack and stack[-1][1]):
            pieces.append(piece)
            linked += len(piece) * (links > 0)

    last = 0
    for token in _TOKEN.finditer(page):
        text(page[last : token.start()])
        last = token.end()
        raw_tag = token[1]
        if raw_tag or token[3] is None:
            continue
        tag, closing = token[3].lower(), bool(token[2])
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img"):
                text(" ")
            continue
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is None:
                if tag == "p":
                    flush()
            elif tag in _BLOCKS:
                cut(at)
            elif all(t not in _BLOCKS for t, _, _ in stack[at + 1 :]):
                links -= sum(t == "a" for t, _, _ in stack[at:])
                del stack[at:]
            continue
        if token[4].endswith("/"):
            continue
        if tag == "body":
            cut(next((i for i, entry in enumerate(stack) if entry[0] == "head"), len(stack)))
        if tag in _BLOCKS:
            flush()
            ends, holds = _ENDS.get(tag, set()), _HOLDS.get(tag, set())
            for i in range(len(stack) - 1, -1, -1):
                open_tag = stack[i][0]
                if open_tag in ends or open_tag == "p":
                    cut(i)
                    if open_tag != "p" or not ends:
                        break
                elif open_tag in holds or open_tag in _CONTAINERS or open_tag in _DROPPED:
                    break
        dropped, path = (stack[-1][1], stack[-1][2]) if stack else (False, "")
        names = {k.lower(): v.strip("\"'") for k, v in _NAME.findall(token[4])} if token[4] else {}
        if not dropped:
            dropped = tag in _DROPPED or (
                tag not in ("html", "body", "article", "main")
                and any(_DROPPED_NAME.search(v) for v in names.values())
            )
        if tag in _CONTAINERS and not dropped:
            first = (names.get("class") or names.get("id") or "").lower().split()[:1]
            path += ">" + re.sub(r"\d+", "0", tag + "".join("." + x for x in first))
        links += tag == "a"
        stack.append((tag, dropped, path))
    text(page[last:])
    flush()
    return out


def best_path(found: list[tuple[str, str, int]]) -> tuple[str, float]:
    """The deepest container that still holds most of the text, none inside article or main, and the weight of its text."""
    weight: dict[str, float] = {}
    for path, text, linked in found:
        steps = path.split(">")[1:]
        value = max(len(text) - linked, 0) + 0.01
        if any(s.split(".")[0] in ("article", "main") for s in steps):
            value *= FAVOURED
        for depth in range(len(steps) + 1):
            key = "".join(">" + s for s in steps[:depth])
            weight[key] = weight.get(key, 0) + value
    path = ""
    while path.rpartition(">")[2].split(".")[0] not in ("article", "main"):
        under = [k for k in weight if k.startswith(path + ">") and k.count(">") == path.count(">") + 1]
        best = max(under, key=lambda k: (weight[k], k), default=None)
        if best is None or weight[best] < SHARE * weight[path]:
            break
        path = best
    return path, weight.get(path, 0.0)


def main_text(page: str | None, path: str | None) -> str:
    """The blocks at or under a path; a page without that path uses its own."""
    found = text_blocks(page or "")
    if not found:
        return ""
    pick = lambda at: [t for p, t, _ in found if p == at or p.startswith(at + ">")]
    kept = pick(path) if path is not None else []
    return "\n".join(kept or pick(best_path(found)[0]))


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the container path that most pages of a host voted for."""
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("weight", pa.float64()), ("pages", pa.int64())])

    def vote(batches):
        for batch in batches:
            count: dict[tuple, list] = {}
            for name, page in zip(batch.column("host"), batch.column("html")):
                found = text_blocks(page.as_py() or "")
                if found:
                    path, weight = best_path(found)
                    entry = count.setdefault((name.as_py(), path), [0.0, 0])
                    entry[0] += weight
                    entry[1] += 1
            if count:
                names, paths = zip(*count)
                weights, numbers = zip(*count.values())
                yield record(schema, list(names), list(paths), list(weights), list(numbers))

    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(
        vote, "host string, path string, weight double, pages long"
    )
    counted = votes.groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.round(F.sum("weight"), 3).alias("weight")
    )
    return counted.groupBy("host").agg(F.max(F.struct("pages", "weight", "path"))["path"].alias("path"))


def extract(pages: DataFrame, max_hosts: int = MAX_HOSTS) -> DataFrame:
    """``page_id, url, text, n_chars`` per page."""
    winners = settle(host_paths(pages), "host-paths")
    small = winners.limit(max_hosts + 1).count() <= max_hosts
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(winners) if small else winners, "host", "left").select(
        "page_id", "url", "html", "path"
    )
    kind = dict(rows.dtypes)["page_id"]

    def read(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                text = [main_text(h.as_py(), p.as_py()) for h, p in zip(part.column("html"), part.column("path"))]
                schema = pa.schema([part.schema.field("page_id"), part.schema.field("url"), ("text", pa.string()), ("n_chars", pa.int64())])
                yield record(schema, part.column("page_id"), part.column("url"), text, [len(t) for t in text])

    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
