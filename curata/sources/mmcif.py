"""mmCIF text to rows, with Spark text functions only.

A file is one row.  Its text is cut into blocks inside that row and a category
is read from its block by item name, so nothing is shuffled.  The categories
this package needs are read; multi-line text fields are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The items read from a file.
RESOLUTION_ITEMS = (
    ("refine", "ls_d_res_high"),
    ("em_3d_reconstruction", "resolution"),
    ("reflns", "d_resolution_high"),
)
DATE_ITEM = ("pdbx_database_status", "recvd_initial_deposition_date")
ATOM_ITEMS = {
    "auth_chain": "auth_asym_id",
    "label_chain": "label_asym_id",
    "seq_id": "label_seq_id",
    "resname": "label_comp_id",
    "alt": "label_alt_id",
    "atom": "label_atom_id",
    "x": "Cartn_x",
    "y": "Cartn_y",
    "z": "Cartn_z",
    "occ": "occupancy",
    "b": "B_iso_or_equiv",
    "model": "pdbx_PDB_model_num",
}
_QUOTED = r"'(?:[^']|'(?=\S))*'(?=\s|$)|\"(?:[^\"]|\"(?=\S))*\"(?=\s|$)|\S+"
_CUT = r"(?m)^(?=loop_)|^#[^\n]*\n?"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``path, content``; ``.gz`` files are decoded by extension."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """The data blocks of ``writers.write_cif_bundles`` as ``path, content, pdb``, one row each."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).filter(F.length("value") > 0)
    return blocks.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("content"),
        F.regexp_extract("value", r"(?m)^_entry\.id (.*)$", 1).alias("pdb"),
    )


def _labelled(refined: bool):
    return lambda spark, location: read_text(spark, location).withColumn("is_refined", F.lit(refined))


#: Readers of structure files by name: functions of the session and a location.
SOURCES = {"deposited": _labelled(False), "refined": _labelled(True)}


def _tokens(line: Column) -> Column:
    """Fields of a line; the quote-aware pattern only runs on lines with quotes."""
    quoted = F.transform(
        F.regexp_extract_all(line, F.lit(_QUOTED), F.lit(0)),
        lambda t: F.when(
            (F.length(t) > 1) & F.substring(t, 1, 1).isin("'", '"'), F.substring(t, F.lit(2), F.length(t) - 2)
        ).otherwise(t),
    )
    return F.when(line.contains("'") | line.contains('"'), quoted).otherwise(
        F.split(F.btrim(line), r"\s+")
    )


def _joined(content: Column) -> Column:
    """Values between lines that begin with ``;`` as one quoted value on the line before."""
    pieces = F.split(content, "\n;")
    quoted = lambda x: F.when(
        x.contains("'"), F.concat(F.lit(' "'), F.translate(x, "\n\"", ""), F.lit('"'))
    ).otherwise(F.concat(F.lit(" '"), F.translate(x, "\n", ""), F.lit("'")))
    one = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, quoted(x)).otherwise(x)), "")
    return F.when(content.contains("\n;"), one).otherwise(content)


def _blocks(content: str = "content") -> Column:
    return F.split(_joined(F.regexp_replace(content, "\r", "")), _CUT)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    Spark merges projections and would repeat an array expression for every
    element of a later ``transform``; it does not merge across a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _with_block(df: DataFrame, category: str) -> DataFrame:
    """Add ``_loop``, the ``_lines`` and the item names ``_heads`` of a category."""
    mark = F.lit(f"\n_{category}.")
    block = F.get(F.filter("_blocks", lambda b: F.contains(F.concat(F.lit("\n"), b), mark)), F.lit(0))
    df = _once(df, _block=block)
    keep = lambda ln: (F.btrim(ln) != "") & ~F.startswith(ln, F.lit("loop_"))
    df = _once(df, _lines=F.filter(F.split("_block", "\n"), keep), _loop=F.startswith("_block", F.lit("loop_")))
    heads = F.filter("_lines", lambda ln: F.startswith(ln, F.lit(f"_{category}.")))
    names = F.transform(heads, lambda ln: F.substring_index(F.regexp_replace(ln, r"\s+", " "), " ", 1))
    return _once(df, _heads=names).drop("_block")


def _place(names: str, category: str, item: str) -> Column:
    """Position of an item counted from 1, 0 when it is absent."""
    return F.array_position(names, F.lit(f"_{category}.{item}")).cast("int")


def _known(value: Column) -> Column:
    """``?`` and ``.`` mean that there is no value."""
    return F.nullif(F.nullif(value, F.lit("?")), F.lit("."))


def _value(category: str, item: str, row: Column) -> Column:
    """A value from ``_words``: by row number (from 1) in a loop, after its name elsewhere."""
    at = _place("_heads", category, item)
    looped = F.get("_words", row * F.size("_heads") + at - 1)
    single = F.get("_words", _place("_words", category, item))
    return _known(F.when(at > 0, F.when(F.col("_loop"), looped).otherwise(single)))


def _row_count() -> Column:
    rows = F.floor(F.size("_words") / F.greatest(F.size("_heads"), F.lit(1))).cast("int") - 1
    return F.when(F.col("_loop"), rows).otherwise(F.lit(1))


def _with_words(df: DataFrame, category: str) -> DataFrame:
    df = _with_block(df, category)
    return _once(df, _words=F.flatten(F.transform("_lines", _tokens))).drop("_lines")


def category_rows(files: DataFrame, category: str, items: dict[str, str], keep=("pdb",)) -> DataFrame:
    """Rows of a small category: ``keep``, ``row_no`` and a column per item.

    The rows of a loop may run over several lines, and the value of a single
    item may stand on the line after its name.
    """
    df = _with_words(files.select(*keep, _blocks().alias("_blocks")), category)
    df = df.filter(_row_count() > 0).select(
        *keep, "_heads", "_words", "_loop", F.explode(F.sequence(F.lit(1), _row_count())).alias("_row")
    )
    fields = [_value(category, item, F.col("_row")).alias(c) for c, item in items.items()]
    return df.select(*keep, (F.col("_row") - 1).alias("row_no"), *fields)


def loop_rows(
    files: DataFrame, category: str, items: dict[str, str], first: str, keep=("pdb",)
) -> DataFrame:
    """Rows of a long loop with one line per row.

    Adds ``first_value``, the value of item ``first`` in the first row.  Lines
    become rows before they are cut into fields.
    """
    df = _with_block(files.select(*keep, _blocks().alias("_blocks")), category)
    df = _once(df, _body=F.filter("_lines", lambda ln: ~F.startswith(ln, F.lit("_"))))
    places = F.array(*[_place("_heads", category, i) - 1 for i in items.values()])
    top = F.get(_tokens(F.get("_body", F.lit(0))), _place("_heads", category, first) - 1)
    df = _once(df, _at=places, first_value=_known(top))
    df = df.select(*keep, "_at", "first_value", F.posexplode("_body").alias("row_no", "_line"))
    df = _once(df, _t=_tokens(F.col("_line")))
    at = lambda i: F.get("_at", F.lit(i))
    fields = [_known(F.when(at(i) >= 0, F.get("_t", at(i)))).alias(c) for i, c in enumerate(items)]
    return df.select(*keep, "row_no", "first_value", *fields)


def entries(files: DataFrame) -> DataFrame:
    """The columns of ``files`` and ``pdb, raw_method, resolution, deposit_date`` per file.

    A file without a resolution gets 0, which the resolution gate rejects.
    """
    df = files.withColumn("_blocks", _blocks())
    items = {"exptl": "method", **dict(RESOLUTION_ITEMS), **dict([DATE_ITEM])}
    for category, item in items.items():
        df = _with_words(df, category)
        found = F.transform(
            F.sequence(F.lit(1), F.greatest(_row_count(), F.lit(1))), lambda i: _value(category, item, i)
        )
        df = _once(df, **{f"_{category}": F.when(F.size("_heads") > 0, found)}).drop("_heads", "_words", "_loop")
    first = lambda category: F.get(f"_{category}", F.lit(0))
    resolution = F.coalesce(*[first(c).try_cast("double") for c, _ in RESOLUTION_ITEMS], F.lit(0.0))
    return df.select(
        *files.columns,
        F.lower(F.regexp_extract("content", r"(?m)^data_(\S+)", 1)).alias("pdb"),
        F.coalesce(F.array_join("_exptl", ", "), F.lit("")).alias("raw_method"),
        resolution.alias("resolution"),
        F.coalesce(first(DATE_ITEM[0]), F.lit("")).alias("deposit_date"),
    )


def atom_rows(files: DataFrame) -> DataFrame:
    """Atoms of the first model: ``pdb, chain, seq_id, resname, alt, atom, x, y, z, occ, b, atom_no``.

    Only polymer atoms have a residue number; others are left out.
    """
    raw = loop_rows(files, "atom_site", ATOM_ITEMS, ATOM_ITEMS["model"])
    return (
        raw.filter(F.equal_null("model", "first_value"))
        .select(
            "pdb",
            F.coalesce("auth_chain", "label_chain").alias("chain"),
            F.col("seq_id").try_cast("int").alias("seq_id"),
            "resname",
            "alt",
            "atom",
            *[F.col(c).try_cast("double").alias(c) for c in ("x", "y", "z")],
            F.coalesce(F.col("occ").try_cast("double"), F.lit(1.0)).alias("occ"),
            F.coalesce(F.col("b").try_cast("double"), F.lit(0.0)).alias("b"),
            F.col("row_no").alias("atom_no"),
        )
        .filter("seq_id is not null and x is not null and y is not null and z is not null")
    )


def generator_rows(files: DataFrame) -> DataFrame:
    """``pdb, asmb_id, gen_id, chains, oper_expression``; generators in file order."""
    rows = category_rows(
        files,
        "pdbx_struct_assembly_gen",
        {"asmb_id": "assembly_id", "oper_expression": "oper_expression", "asym_ids": "asym_id_list"},
    )
    return rows.select(
        "pdb", "asmb_id", F.col("row_no").alias("gen_id"), F.split("asym_ids", r"\s*,\s*").alias("chains"), "oper_expression"
    )


def operator_rows(files: DataFrame) -> DataFrame:
    """``pdb, oper_id, matrix`` with the matrix as 16 row-major numbers."""
    items = {"oper_id": "id"}
    for i in (1, 2, 3):
        items |= {f"m{i}{j}": f"matrix[{i}][{j}]" for j in (1, 2, 3)} | {f"m{i}4": f"vector[{i}]"}
    rows = category_rows(files, "pdbx_struct_oper_list", items)
    top = [F.col(f"m{i}{j}").try_cast("double") for i in (1, 2, 3) for j in (1, 2, 3, 4)]
    return rows.select(
        "pdb", "oper_id", F.array(*top, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("matrix")
    )
