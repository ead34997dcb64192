"""String keys, ids and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.hashing import col

# Forms of an entry id and of a listing prefix.
ENTRY_ID = "[0-9][a-z0-9]{3}"
LISTING_PREFIX = "[0-9a-z]{2}"


def chain_key(pdb="pdb", chain="chain") -> Column:
    return F.concat_ws("_", col(pdb), col(chain))


def full_match(c, pattern: str) -> Column:
    return col(c).rlike(f"^(?:{pattern})$")


def listing_prefix(entry) -> Column:
    """The two middle characters of an id, under which archives file it."""
    return F.substring(F.lower(col(entry)), 2, 2)


def strip_quotes(c) -> Column:
    return F.btrim(col(c), F.lit("'\" "))


def trailing_number(c, sep: str = "/") -> Column:
    """The integer after the last separator."""
    return F.element_at(F.split(col(c), sep), -1).cast("int")


def shard_name(source, number) -> Column:
    """``source/000007``; wider numbers are not cut."""
    n = col(number).cast("string")
    return F.concat_ws("/", col(source), F.lpad(n, F.greatest(F.length(n), F.lit(6)), F.lit("0")))


def to_date(c) -> Column:
    """A date carried as text, where the empty string stands for no date."""
    return F.try_to_date(F.nullif(col(c), F.lit("")), "yyyy-MM-dd")


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, in any session zone."""
    t = col(ts)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def meta_json(*columns) -> Column:
    """Metadata columns as one JSON text."""
    return F.to_json(F.struct(*[col(c) for c in columns]))


def meta_struct(c, schema) -> Column:
    return F.from_json(col(c), schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"})
