"""Labels, residue lookups, first-wins choices, string functions and corruption."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import residues as R
from curata.functions import text as X
from curata.operators import corruption as N
from curata.operators import curate as C
from curata.queries.common import table, uniform_of, wide_table

NAMES = [n for n, _, _ in R.RESIDUES] + ["HOH", "ZZZ"]
SEED = 7
MAX_T = 10


def label_counts(spark, folder):
    """Labels of every character of every document."""
    documents = wide_table(spark, folder, "documents")
    letters = documents.select(F.explode(F.split("text", "")).alias("letter")).groupBy("letter").count()
    return letters.groupBy(R.letter_label("letter").alias("label")).agg(F.sum("count").alias("n"))


def sequence_labels(spark, folder):
    """The label array of every conversation turn, as text."""
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", F.array_join(R.sequence_labels("text"), ",").alias("labels"))


def _named(spark, folder):
    pick = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("l_partkey") % len(NAMES) + 1).cast("int"))
    return table(spark, folder, "lineitem").withColumn("resname", pick)


def residue_lookup(spark, folder):
    """Letter, label, parent and metric name of residue names; unknown names are dropped."""
    known = C.known_residues(_named(spark, folder))
    label = R.letter_label("letter")
    return (
        known.groupBy("resname")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("letter", R.residue_letter("resname"))
        .withColumn("parent", R.residue_parent("resname"))
        .withColumn("label", label)
        .withColumn("name", R.label_name("label"))
        .withColumn("back", R.label_letter("label"))
        .withColumn("cb_slot", R.atom_slot("resname", F.lit("CB")))
    )


ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def best_first_wins(spark, folder):
    """Per order the line with the highest discount, the first of equals."""
    lines = table(spark, folder, "lineitem")
    return C.best_first(lines, ["l_orderkey"], "l_discount", ORDER).select("l_orderkey", "l_discount", *ORDER)


def best_residues(spark, folder):
    """Per order the return flag with the highest mean quantity, then its best line per status."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("pdb"),
        F.lit("A").alias("chain"),
        F.lit(1).alias("seq_id"),
        F.col("l_returnflag").alias("resname"),
        F.col("l_linestatus").alias("atom"),
        F.col("l_quantity").alias("occ"),
        (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("atom_no"),
    )
    return C.best_atoms(C.best_residues(lines)).select("pdb", "resname", "atom", "occ", "atom_no")


def string_functions(spark, folder):
    """Keys, prefixes, quotes, numbers, padding, id forms and dates."""
    c = F.col("c_custkey").cast("string")
    raw = F.concat(F.lit("' \""), F.col("c_name"), F.lit("\"' "))
    day = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.lit("2020-02-29"))
    return table(spark, folder, "customer").select(
        "c_custkey",
        X.chain_key("c_custkey", "c_nationkey").alias("key"),
        X.listing_prefix("c_name").alias("prefix"),
        X.strip_quotes(raw).alias("name"),
        X.shard_name(F.col("c_mktsegment"), F.col("c_custkey")).alias("shard"),
        X.trailing_number(X.shard_name(F.col("c_mktsegment"), F.col("c_custkey"))).alias("number"),
        X.full_match(F.concat(c, F.lit("abc")), X.ENTRY_ID).alias("is_id"),
        F.date_format(X.to_date(day), "yyyy/MM/dd").alias("day"),
    )


def method_gate(spark, folder):
    """Method, resolution and length gates over orders as entries."""
    method = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "'X-RAY DIFFRACTION'")
        .when(F.col("o_orderpriority") == "2-HIGH", "NEUTRON DIFFRACTION; X-RAY DIFFRACTION")
        .when(F.col("o_orderpriority") == "3-MEDIUM", '"ELECTRON MICROSCOPY"')
        .when(F.col("o_orderpriority") == "5-LOW", "SOLUTION NMR")
    )
    entries = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pdb"),
        method.alias("raw_method"),
        F.floor(F.col("o_totalprice") % 6).cast("double").alias("resolution"),
    )
    gated = C.resolution_gate(C.method_gate(entries), 3.5).withColumn("chain", F.lit("A"))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("pdb"), F.lit("A").alias("chain"), "l_partkey")
    return C.long_chains(lines.join(gated, ["pdb", "chain"])).select("pdb", "method", "resolution", "l_partkey")


def _residue_rows(spark, folder):
    turns = wide_table(spark, folder, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("sample_id"), "text"
    )
    return R.label_rows(turns, "text", "sample_id")


def corrupt_labels(spark, folder):
    """Random replacement at a rate that grows with each sample's timestep."""
    noisy = N.corrupt_labels(
        _residue_rows(spark, folder), SEED, "linear", MAX_T, only_mask=F.col("label") < 20, mode="md5"
    )
    return noisy.groupBy("sample_id", "t").agg(
        F.count(F.lit(1)).alias("residues"),
        F.count_if("is_corrupted").alias("corrupted"),
        F.sum("corrupted_label").alias("label_sum"),
        F.sum(F.col("corrupted_label") * F.col("pos")).alias("label_checksum"),
    )


def corrupt_to_mask(spark, folder):
    """Constant rate, mask token instead of random labels, one label always hit."""
    noisy = N.corrupt_labels(
        _residue_rows(spark, folder), SEED, "constant", rate=0.25, also_mask=F.col("label") == 27, random_label=False, mode="md5"
    )
    return noisy.groupBy("sample_id").agg(
        F.count_if(F.col("corrupted_label") == R.MASK).alias("masked"), F.sum("corrupted_label").alias("label_sum")
    )


QUERIES = {
    "tokenise_counts": label_counts,
    "sequence_labels": sequence_labels,
    "residue_lookup": residue_lookup,
    "best_first_wins": best_first_wins,
    "best_residues": best_residues,
    "string_functions": string_functions,
    "entry_gates": method_gate,
    "corrupt_labels": corrupt_labels,
    "corrupt_to_mask": corrupt_to_mask,
}


def label_sql(c: str) -> str:
    """SQL for the label of a single character."""
    return f"(CASE WHEN strpos('{R.LETTERS}', {c}) > 0 THEN strpos('{R.LETTERS}', {c}) - 1 ELSE {R.UNKNOWN} END)"


_names_sql = ", ".join(f"'{n}'" for n in NAMES)
_residues_sql = ", ".join(
    f"('{n}', '{one}', '{parent}', {'NULL' if 'CB' not in R.ATOMS[parent] else R.ATOMS[parent].index('CB')})"
    for n, one, parent in R.RESIDUES
)
_rows_sql = f"""
SELECT sample_id, pos, {label_sql('c')} AS label FROM (
  SELECT conv_id || '_' || turn AS sample_id, unnest(string_split(text, '')) AS c,
         unnest(range(length(text))) AS pos FROM conversations)"""
_t = f"CAST(floor({uniform_of(f'{SEED}:t', 'sample_id')} * {MAX_T}) AS INTEGER)"
_linear = f"""
SELECT *, CASE WHEN hit THEN CAST(floor({uniform_of(f'{SEED}:aa', 'sample_id', 'pos')} * 20) AS INTEGER) ELSE label END AS new
FROM (SELECT *, ({uniform_of(f'{SEED}:hit', 'sample_id', 'pos')} < t / {MAX_T}.0) AND label < 20 AS hit
      FROM (SELECT *, {_t} AS t FROM ({_rows_sql})))"""

SQL = {
    "tokenise_counts": f"""
SELECT CAST({label_sql('c')} AS INTEGER) AS label, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) GROUP BY c) GROUP BY 1""",
    "sequence_labels": f"""
SELECT conv_id, turn, string_agg({label_sql('c')}, ',' ORDER BY i) AS labels FROM (
  SELECT conv_id, turn, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM conversations)
GROUP BY conv_id, turn""",
    "residue_lookup": f"""
SELECT resname, n, letter, parent, CAST({label_sql('letter')} AS INTEGER) AS label, letter AS name, letter AS back,
       CAST(cb_slot AS INTEGER) AS cb_slot
FROM (SELECT resname, count(*) AS n FROM (SELECT [{_names_sql}][l_partkey % {len(NAMES)} + 1] AS resname FROM lineitem)
      GROUP BY resname) JOIN (VALUES {_residues_sql}) AS r(resname, letter, parent, cb_slot) USING (resname)""",
    "best_first_wins": """
SELECT l_orderkey, l_discount, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) = 1""",
    "best_residues": """
WITH atoms AS (SELECT l_orderkey AS pdb, l_returnflag AS resname, l_linestatus AS atom, l_quantity AS occ,
    CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS atom_no FROM lineitem),
best AS (SELECT pdb, resname FROM (SELECT pdb, resname, avg(occ) AS o, min(atom_no) AS f FROM atoms GROUP BY pdb, resname)
  QUALIFY row_number() OVER (PARTITION BY pdb ORDER BY o DESC, f) = 1)
SELECT pdb, resname, atom, occ, atom_no FROM atoms JOIN best USING (pdb, resname)
QUALIFY row_number() OVER (PARTITION BY pdb, resname, atom ORDER BY occ DESC, atom_no) = 1""",
    "string_functions": """
SELECT c_custkey, c_custkey || '_' || c_nationkey AS key, substr(lower(c_name), 2, 2) AS prefix, c_name AS name,
       c_mktsegment || '/' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS shard, CAST(c_custkey AS INTEGER) AS number,
       regexp_full_match(c_custkey || 'abc', '[0-9][a-z0-9]{3}') AS is_id,
       CASE WHEN c_custkey % 3 <> 0 THEN '2020/02/29' END AS day
FROM customer""",
    "entry_gates": """
SELECT pdb, method, resolution, l_partkey FROM (
  SELECT o_orderkey AS pdb, floor(o_totalprice % 6) AS resolution, CASE o_orderpriority
    WHEN '1-URGENT' THEN 'X-RAY DIFFRACTION' WHEN '2-HIGH' THEN 'X-RAY DIFFRACTION'
    WHEN '3-MEDIUM' THEN 'ELECTRON MICROSCOPY' END AS method FROM orders) JOIN lineitem ON l_orderkey = pdb
WHERE method IS NOT NULL AND resolution <> 0 AND resolution <= 3.5
  AND l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 4)""",
    "corrupt_labels": f"""
SELECT sample_id, t, count(*) AS residues, count(*) FILTER (WHERE hit) AS corrupted, CAST(sum(new) AS BIGINT) AS label_sum,
       CAST(sum(new * pos) AS BIGINT) AS label_checksum FROM ({_linear}) GROUP BY sample_id, t""",
    "corrupt_to_mask": f"""
SELECT sample_id, count(*) FILTER (WHERE new = {R.MASK}) AS masked, CAST(sum(new) AS BIGINT) AS label_sum FROM (
  SELECT *, CASE WHEN {uniform_of(f'{SEED}:hit', 'sample_id', 'pos')} < 0.25 OR label = 27 THEN {R.MASK} ELSE label END AS new
  FROM ({_rows_sql})) GROUP BY sample_id""",
}
