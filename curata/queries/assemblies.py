"""Assemblies and samples over conversations: a conversation is a record, a turn a chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import residues as R
from curata.operators import assembly as A
from curata.operators import packing as K
from curata.operators import sampling as P
from curata.queries.common import md5_of, packing_of, table, wide_table
from curata.queries.residues import label_sql
from curata.session import stage

SEED = 11
MAX_SIZE = 400
MIN_SIZE = 60
TURN = [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]


def _chains(spark, folder):
    """Turns with text as chains."""
    return (
        wide_table(spark, folder, "conversations")
        .filter("length(text) > 0")
        .select(
            F.col("conv_id").cast("string").alias("pdb"),
            F.col("turn").cast("string").alias("chain"),
            F.col("turn").alias("chain_idx"),
            F.length("text").cast("bigint").alias("len"),
            "text",
        )
    )


def _members(spark, folder):
    """Assembly 1 has one generator per role, assembly 2 has the user's turns."""
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("pdb"), F.col("turn").cast("string").alias("chain"), "role", "turn"
    )
    first = turns.select(
        "pdb", F.lit("1").alias("asmb_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("gen_id"), "chain"
    )
    second = turns.filter("role = 'user'").select("pdb", F.lit("2").alias("asmb_id"), F.lit(0).alias("gen_id"), "chain")
    return first.unionByName(second)


def _transforms(spark, folder):
    """The user generator has two copies, all others one."""
    records = _members(spark, folder).select("pdb", "asmb_id", "gen_id").distinct()
    turn = F.array(*[F.lit(x) for x in TURN])
    twice = (F.col("asmb_id") == "1") & (F.col("gen_id") == 0)
    copies = F.when(twice, F.array(A.G.identity(), turn)).otherwise(F.array(turn))
    return records.select("pdb", "asmb_id", "gen_id", F.posexplode(copies).alias("copy", "matrix"))


def _targets(spark, folder):
    """One chain per conversation, drawn by hash."""
    chains = _chains(spark, folder)
    sampled = P.epoch_sample(chains.select("pdb", "chain"), "pdb", base_seed=SEED, mode="md5")
    return A.as_targets(sampled, chains)


def _chosen(spark, folder):
    return A.choose_assembly(_targets(spark, folder), _members(spark, folder), SEED, mode="md5")


def assembly_choice(spark, folder):
    """The drawn target of each record and the drawn assembly that lists it."""
    return _chosen(spark, folder)


def _cropped(spark, folder):
    members, transforms = _members(spark, folder), _transforms(spark, folder)
    parts = A.expand_members(_chosen(spark, folder), members, _chains(spark, folder).drop("text"))
    parts = stage(parts, "parts")
    lengths = stage(A.sample_lengths(parts, members, transforms, MAX_SIZE), "lengths")
    return A.crop_chains(parts, lengths, MAX_SIZE, SEED, mode="md5"), lengths


def sample_lengths(spark, folder):
    """Expanded length, fall-back and cropped length per sample."""
    return _cropped(spark, folder)[1]


def asymmetric_lengths(spark, folder):
    """The same without assembly copies."""
    members, transforms = _members(spark, folder), _transforms(spark, folder)
    parts = A.expand_members(_chosen(spark, folder), members, _chains(spark, folder).drop("text"))
    return A.sample_lengths(parts, members, transforms, MAX_SIZE, asymmetric_only=True)


def crop_fallback(spark, folder):
    """Chains of each sample in order, with the residues used of each."""
    return _cropped(spark, folder)[0].select("sample_id", "chain", "chain_no", "used", "keep_assembly")


def _residues(spark, folder):
    """Characters as residues with three atoms each; every ninth lacks an atom."""
    rows = R.label_rows(_chains(spark, folder), "text", "pdb", "chain")
    p = F.col("pos").cast("float")
    atom = lambda a, b, c: F.array(p + a, p / 2 + b, p / 4 + c)
    f = lambda x: F.lit(x).cast("float")
    coords = F.array(atom(f(0), f(0), f(0)), atom(f(1), f(0), f(0.5)), atom(f(1.5), f(1), f(0)))
    return rows.select(
        "pdb",
        "chain",
        "pos",
        "label",
        F.transform(coords, lambda a: F.transform(a, lambda x: x.cast("float"))).alias("coords"),
        F.array(F.lit(True), F.lit(True), F.col("pos") % 9 != 5).alias("atom_mask"),
    )


def _pairs(spark, folder):
    """Directed chain scores within a record: turns of equal parity are alike."""
    turns = _chains(spark, folder).select("pdb", F.col("chain").alias("chain_a"), "chain_idx")
    step = turns.withColumn("chain_b", (F.col("chain_idx") + 2).cast("string"))
    back = turns.withColumn("chain_b", (F.col("chain_idx") - 2).cast("string"))
    return step.unionByName(back).select("pdb", "chain_a", "chain_b", (0.6 + F.col("chain_idx") / 10).alias("score"))


def homolog_sets(spark, folder):
    """Chains that score at least 0.7 with the target; the target itself always."""
    sets = A.homolog_sets(_targets(spark, folder), _pairs(spark, folder), 0.7)
    return sets.select("sample_id", F.array_join("homologs", ",").alias("homologs"))


def _samples(spark, folder):
    parts, _ = _cropped(spark, folder)
    placed = A.place_chains(parts, _members(spark, folder), _transforms(spark, folder))
    homologs = A.homologs(_pairs(spark, folder), 0.7)
    return A.construct_samples(placed, _residues(spark, folder), homologs, MIN_SIZE)


def construct_samples(spark, folder):
    """Whole residue samples, summarised: positions, labels, masks and coordinates."""
    ca, u = F.col("coords_ca"), F.col("coords_cb_unit")
    return _samples(spark, folder).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("residues"),
        F.sum(F.col("idx").cast("bigint") * F.col("label")).alias("label_checksum"),
        F.sum("seq_idx").alias("seq_idx_sum"),
        F.sum("chain_idx").alias("chain_idx_sum"),
        F.count_if("loss_mask").alias("loss_tokens"),
        F.count_if("seq_mask").alias("seq_tokens"),
        F.round(F.sum(ca[0] + 2 * ca[1] + 3 * ca[2]), 2).alias("ca_sum"),
        F.round(F.sum(u[0] + 2 * u[1] + 3 * u[2]), 3).alias("unit_sum"),
    )


def _packed(spark, folder):
    lengths = sample_lengths(spark, folder).select("sample_id", F.col("sample_len").alias("len"))
    plan = P.assign_workers(lengths, ["sample_id"], SEED, 2, mode="md5")
    return K.pack_batches(plan, batch_tokens=2048, buffer_size=8)


def pack_batches(spark, folder):
    """Batch and slot of every sample under a token budget."""
    return _packed(spark, folder)


def pack_documents(spark, folder):
    """Whole documents packed by their length, four workers; one over the budget is a batch of its own."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("sample_id"), F.length("text").cast("bigint").alias("len")
    )
    plan = P.assign_workers(docs, ["sample_id"], SEED, 4, mode="md5")
    packed = K.pack_batches(plan, batch_tokens=65_536 * 4, buffer_size=32, alone=True)
    return K.batch_summary(packed)


def pack_lanes(spark, folder):
    """Documents packed in three lanes per worker, each with a buffer and batches of its own; so has a document over the budget."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("sample_id"), F.length("text").cast("bigint").alias("len")
    )
    plan = P.assign_workers(docs, ["sample_id"], SEED, 4, mode="md5").withColumn("lane", F.col("step") % 3)
    packed = K.pack_batches(plan, batch_tokens=65_536, buffer_size=16, lane="lane", alone=True)
    return packed.select("sample_id", "len", "batch_id", "sample_idx")


def collate(spark, folder):
    """Residue samples joined end to end per batch, with offsets."""
    arrays = _samples(spark, folder).groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "label", "loss_mask"))).alias("_r")
    )
    samples = arrays.select(
        "sample_id", F.col("_r")["label"].alias("labels"), F.col("_r")["loss_mask"].alias("loss_mask")
    )
    rows = K.collate(_packed(spark, folder), samples, ["labels", "loss_mask"])
    return rows.select(
        "batch_id",
        "samples",
        "max_seqlen",
        F.size("labels").alias("tokens"),
        F.size(F.filter("loss_mask", lambda m: m)).alias("loss_tokens"),
        F.array_join("cu_seqlens", ",").alias("cu_seqlens"),
        F.element_at("sample_idx", -1).alias("last_sample_idx"),
    )


QUERIES = {
    "assembly_choice": assembly_choice,
    "sample_lengths": sample_lengths,
    "asymmetric_lengths": asymmetric_lengths,
    "crop_fallback": crop_fallback,
    "homolog_sets": homolog_sets,
    "construct_samples": construct_samples,
    "pack_batches": pack_batches,
    "pack_documents": pack_documents,
    "pack_lanes": pack_lanes,
    "collate_batches": collate,
}

BASE = f"""
WITH chains AS (SELECT CAST(conv_id AS VARCHAR) AS pdb, CAST(turn AS VARCHAR) AS chain, turn AS chain_idx, length(text) AS len, text
  FROM conversations WHERE length(text) > 0),
members AS (
  SELECT CAST(conv_id AS VARCHAR) AS pdb, '1' AS asmb_id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS gen_id, CAST(turn AS VARCHAR) AS chain
  FROM conversations
  UNION ALL SELECT CAST(conv_id AS VARCHAR), '2', 0, CAST(turn AS VARCHAR) FROM conversations WHERE role = 'user'),
copies AS (SELECT pdb, asmb_id, gen_id, chain, CASE WHEN asmb_id = '1' AND gen_id = 0 THEN 2 ELSE 1 END AS n FROM members),
targets AS (SELECT pdb || '_' || chain AS sample_id, pdb, chain AS target FROM chains
  QUALIFY row_number() OVER (PARTITION BY pdb ORDER BY {md5_of(SEED, 'pdb', 'chain')}, pdb, chain) = 1),
chosen AS (SELECT t.sample_id, t.pdb, t.target, m.asmb_id FROM targets t
  LEFT JOIN (SELECT DISTINCT pdb, asmb_id, chain FROM members) m ON m.pdb = t.pdb AND m.chain = t.target
  QUALIFY row_number() OVER (PARTITION BY t.sample_id ORDER BY {md5_of(SEED, 't.sample_id', "coalesce(m.asmb_id, '')")}, m.asmb_id) = 1),
parts AS (SELECT c.sample_id, c.pdb, c.target, c.asmb_id, ch.chain, ch.chain_idx, ch.len FROM chosen c
  LEFT JOIN (SELECT DISTINCT pdb, asmb_id, chain FROM members) m ON m.pdb = c.pdb AND m.asmb_id = c.asmb_id
  JOIN chains ch ON ch.pdb = c.pdb AND ch.chain = coalesce(m.chain, c.target)),
lens AS (SELECT sample_id, CAST(sum(len) AS BIGINT) AS full_len,
  CAST(sum(len * coalesce((SELECT sum(n) FROM copies k WHERE k.pdb = parts.pdb AND k.asmb_id = parts.asmb_id AND k.chain = parts.chain), 0)) AS BIGINT) AS expanded,
  bool_or(asmb_id IS NOT NULL) AS has_assembly FROM parts GROUP BY sample_id),
sized AS (SELECT sample_id, full_len, expanded_len, has_assembly AND expanded_len <= {MAX_SIZE} AS keep_assembly,
  CASE WHEN expanded_len <= {MAX_SIZE} THEN expanded_len ELSE least(full_len, {MAX_SIZE}) END AS sample_len
  FROM (SELECT *, CASE WHEN has_assembly THEN expanded ELSE full_len END AS expanded_len FROM lens)),
cropped AS (SELECT sample_id, pdb, target, asmb_id, chain, chain_idx, chain_no, keep_assembly,
  CASE WHEN expanded_len <= {MAX_SIZE} THEN len ELSE least(len, greatest({MAX_SIZE} - coalesce(before, 0), 0)) END AS used
  FROM (SELECT *, CAST(sum(len) OVER (PARTITION BY sample_id ORDER BY chain_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before
    FROM (SELECT p.*, s.expanded_len, s.keep_assembly, CAST(row_number() OVER (PARTITION BY sample_id
        ORDER BY (chain <> target), {md5_of(SEED, 'p.sample_id', 'chain')}, chain) AS INTEGER) AS chain_no
      FROM parts p JOIN sized s USING (sample_id)))),
pairs AS (SELECT pdb, chain AS target, CAST(chain_idx + d AS VARCHAR) AS chain, 0.6::DOUBLE + chain_idx / 10::DOUBLE AS score
  FROM chains, (VALUES (2), (-2)) AS v(d))"""

_apply = lambda row, p: " + ".join(f"({m}) * {c}" for m, c in zip(TURN[4 * row : 4 * row + 3], p)) + f" + {TURN[4 * row + 3]}"


def _point(name, dx, dy, dz):
    """SQL for an atom of a residue before and after its transform."""
    p = (f"(pos + {dx})", f"(pos / 2.0::DOUBLE + {dy})", f"(pos / 4.0::DOUBLE + {dz})")
    return ", ".join(
        f"CASE WHEN turned THEN {_apply(i, p)} ELSE {p[i]} END AS {name}{a}" for i, a in enumerate("xyz")
    )


_construct = f"""{BASE},
placed AS (
  SELECT c.*, k.gen_id, v.copy, (v.copy = 1 OR k.n = 1) AS turned FROM cropped c
  JOIN copies k ON c.keep_assembly AND k.pdb = c.pdb AND k.asmb_id = c.asmb_id AND k.chain = c.chain
  JOIN (VALUES (0), (1)) AS v(copy) ON v.copy < k.n
  UNION ALL SELECT c.*, 0, 0, false FROM cropped c WHERE NOT keep_assembly),
residues AS (SELECT pdb, chain, {label_sql('ch')} AS label, pos FROM (
  SELECT pdb, chain, unnest(string_split(text, '')) AS ch, unnest(range(len)) AS pos FROM chains) WHERE pos % 9 <> 5),
rows AS (
  SELECT p.sample_id, p.chain = p.target AS trgt, p.chain_idx, r.pos, r.label, p.turned,
    p.chain = p.target OR EXISTS (SELECT 1 FROM pairs q WHERE q.score >= 0.7::DOUBLE AND q.pdb = p.pdb AND q.target = p.target AND q.chain = p.chain) AS homo,
    row_number() OVER (PARTITION BY p.sample_id ORDER BY gen_id, copy, chain_no, r.pos) - 1 AS idx,
    count(*) OVER (PARTITION BY p.sample_id) AS size
  FROM placed p JOIN residues r ON r.pdb = p.pdb AND r.chain = p.chain AND r.pos < p.used),
atoms AS (SELECT *, {_point('n', 0, 0, 0)}, {_point('a', 1, 0, 0.5)}, {_point('c', 1.5, 1, 0)} FROM rows WHERE size >= {MIN_SIZE}),
steps AS (SELECT *, ax - nx AS ix, ay - ny AS iy, az - nz AS iz, cx - ax AS ox, cy - ay AS oy, cz - az AS oz FROM atoms),
cbs AS (SELECT *,
  0.56802827::DOUBLE * ix - 0.58273431::DOUBLE * ox - 0.54067466::DOUBLE * (iy * oz - iz * oy) AS dx,
  0.56802827::DOUBLE * iy - 0.58273431::DOUBLE * oy - 0.54067466::DOUBLE * (iz * ox - ix * oz) AS dy,
  0.56802827::DOUBLE * iz - 0.58273431::DOUBLE * oz - 0.54067466::DOUBLE * (ix * oy - iy * ox) AS dz FROM steps)
SELECT sample_id, count(*) AS residues, CAST(sum(idx * label) AS BIGINT) AS label_checksum, CAST(sum(pos) AS BIGINT) AS seq_idx_sum,
  CAST(sum(chain_idx) AS BIGINT) AS chain_idx_sum, count(*) FILTER (WHERE label < 20 AND trgt) AS loss_tokens,
  count(*) FILTER (WHERE homo AND NOT trgt) AS seq_tokens, round(sum(ax + 2 * ay + 3 * az), 2) AS ca_sum,
  round(sum((dx + 2 * dy + 3 * dz) / greatest(sqrt(dx * dx + dy * dy + dz * dz), 1e-8)), 3) AS unit_sum
FROM cbs GROUP BY sample_id"""



def _dealt(source: str, workers: int) -> str:
    order = f"{md5_of(SEED, 'sample_id')}, sample_id"
    return f"""SELECT CAST(i % {workers} AS INTEGER) AS worker_id, CAST(i // {workers} AS BIGINT) AS step, sample_id, len
FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM ({source}))"""


_base_recursive = BASE.replace("WITH", "WITH RECURSIVE", 1)
_sample_pack = packing_of(_dealt("SELECT sample_id, sample_len AS len FROM sized", 2), 2048, 8)
_document_pack = packing_of(_dealt("SELECT doc_id AS sample_id, length(text) AS len FROM documents", 4), 65_536 * 4, 32)
_lanes = _dealt("SELECT doc_id AS sample_id, length(text) AS len FROM documents", 4)
_lane_pack = packing_of(
    f"SELECT CAST(worker_id * 3 + step % 3 AS INTEGER) AS worker_id, step // 3 AS step, sample_id, len FROM ({_lanes})", 65_536, 16
)
_sample_pack_all = f"{BASE.strip().removeprefix('WITH')}, {_sample_pack}"

SQL = {
    "pack_batches": f"{_base_recursive}, {_sample_pack} SELECT * FROM packed",
    "pack_documents": f"""WITH RECURSIVE {_document_pack}
SELECT batch_id, max(len) AS max_seqlen, count(*) AS samples, CAST(sum(len) AS BIGINT) AS tokens, CAST(sum(len) AS BIGINT) AS loss_tokens
FROM packed GROUP BY batch_id""",
    "pack_lanes": f"""WITH RECURSIVE {_lane_pack}
SELECT sample_id, len, concat_ws('/', worker_id // 3, worker_id % 3, split_part(batch_id, '/', 3)) AS batch_id, sample_idx FROM packed""",
    "collate_batches": f"""WITH RECURSIVE {_sample_pack_all},
built AS MATERIALIZED ({_construct}),
kept AS (SELECT batch_id, sample_idx, residues, loss_tokens,
  sum(residues) OVER (PARTITION BY batch_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING) AS upto
  FROM packed JOIN built USING (sample_id))
SELECT batch_id, CAST(count(*) AS INTEGER) AS samples, CAST(max(residues) AS INTEGER) AS max_seqlen, CAST(sum(residues) AS INTEGER) AS tokens,
  CAST(sum(loss_tokens) AS INTEGER) AS loss_tokens, '0,' || string_agg(CAST(upto AS VARCHAR), ',' ORDER BY sample_idx) AS cu_seqlens,
  CAST(count(*) - 1 AS INTEGER) AS last_sample_idx FROM kept GROUP BY batch_id""",
    "assembly_choice": f"{BASE} SELECT sample_id, pdb, target, asmb_id FROM chosen",
    "sample_lengths": f"{BASE} SELECT * FROM sized",
    "asymmetric_lengths": f"""{BASE}
SELECT sample_id, full_len, full_len AS expanded_len, false AS keep_assembly, least(full_len, {MAX_SIZE}) AS sample_len FROM lens""",
    "crop_fallback": f"{BASE} SELECT sample_id, chain, chain_no, used, keep_assembly FROM cropped WHERE used > 0",
    "homolog_sets": f"""{BASE}
SELECT sample_id, string_agg(chain, ',' ORDER BY chain) AS homologs FROM (
  SELECT sample_id, target AS chain FROM targets
  UNION SELECT t.sample_id, q.chain FROM targets t JOIN pairs q ON q.pdb = t.pdb AND q.target = t.target WHERE q.score >= 0.7::DOUBLE)
GROUP BY sample_id""",
    "construct_samples": _construct,
}
