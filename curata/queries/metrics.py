"""Metric terms over embedding vectors as logits, accumulation and ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions.residues import label_names
from curata.operators import metrics as M
from curata.operators import packing as K
from curata.plans.evaluate import evaluate
from curata.queries.common import table

N_LABELS = 10
BATCH = 64


def predictions(spark, folder):
    """Vectors as tokens: a logit a number and a label, masks, timestep and sequence length."""
    v = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        F.floor(v / BATCH).alias("batch_id"),
        v.alias("pos"),
        F.col("embedding").alias("logits"),
        F.when(v % 3 == 0, F.lit(27)).otherwise(F.col("label")).alias("label"),
        (v % 3 != 0).alias("loss_mask"),
        (v % 2 == 0).alias("is_masked"),
        (v * 7 % 1024).alias("timestep"),
        (v * 37 % 1200).alias("seq_len"),
        F.col("embedding")[20].cast("double").alias("x"),
    )


def _tidy(metrics):
    return metrics.select(
        "batch_id", "key", F.round("value", 6).alias("value"), "n"
    )


def token_values(spark, folder):
    """Per-token values of every metric function."""
    values = {name: fn() for name, fn in M.METRICS.items() if name not in M.ARRAYS}
    return predictions(spark, folder).filter("loss_mask").select(
        "pos", *[F.round(c, 6).alias(n) for n, c in values.items()]
    )


def token_metrics(spark, folder):
    return _tidy(M.with_total(M.batch_metrics(predictions(spark, folder), M.sequence_terms())))


PER_LABEL = M.Mask("per_label_masks", {"n_labels": N_LABELS})
LENGTHS = M.Mask("binned_masks", {"max_seq_len": 1024, "num_bins": 4})
TIMES = M.Mask("timestep_binned_masks", {"max_timestep": 1024, "num_bins": 4})
PASS = M.Mask("pass_mask")


def _by(*masks):
    def run(spark, folder):
        return _tidy(M.batch_metrics(predictions(spark, folder), M.sequence_terms(*masks)))

    return run


def all_reductions(spark, folder):
    """Every reduction of an identity and a focal term, with and without a flag mask."""
    terms = [
        M.Term("watch", "identity", M.REDUCTIONS, 0.0, (PASS,)),
        M.Term("focal", "focal_loss", ("sum", "max", "min"), 0.5, (), {"alpha": 0.25, "gamma": 2.0}),
    ]
    return _tidy(M.with_total(M.batch_metrics(predictions(spark, folder), terms, order="pos")))


def accumulated_metrics(spark, folder):
    """Batches folded into one value per key."""
    terms = [
        M.Term("seq_cel", "cel", ("mean", "sum", "max", "min"), 1.0, (LENGTHS,)),
        M.Term("watch", "identity", ("last",)),
    ]
    metrics = M.with_total(M.batch_metrics(predictions(spark, folder), terms, order="pos"))
    return M.accumulate(metrics).select("key", "reduction", F.round("value", 6).alias("value"))


def event_reductions(spark, folder):
    """Masked sum, mean, maximum and minimum of event values per hour, empty masks included."""
    hours = table(spark, folder, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    masked = F.col("event_type") == "error"
    aggregates = []
    for r in ("sum", "mean", "max", "min"):
        value, n = M.masked_reduction("value", masked, r)
        aggregates += [F.round(value, 6).alias(f"{r}_value"), n.alias(f"{r}_n")]
    return hours.groupBy("hour").agg(*aggregates)


def _batches(spark, folder):
    """Events as batches: tokens, loss tokens, samples."""
    e = table(spark, folder, "events")
    return e.select(
        "event_type",
        F.floor(F.col("value") * 10).alias("tokens"),
        F.floor(F.col("value") * 3).alias("loss_tokens"),
        (F.col("event_id") % 5).alias("samples"),
    )


def data_ratios(spark, folder):
    data = M.data_metrics(_batches(spark, folder), ["event_type"])
    ratios = M.ratio_metrics(data, 3600.0, accumulation_steps=4, steps=0, keep=["event_type"])
    names = [c for c in ratios.columns if c != "event_type"]
    return ratios.select("event_type", *[F.round(c, 6).alias(c) for c in names])


def label_magnitudes(spark, folder):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    params = table(spark, folder, "embeddings").select("label", (total / F.size("embedding")).alias("mag"))
    return M.label_magnitudes(params).select("label", "name", F.round("value", 7).alias("value"))


def preset_metrics(spark, folder):
    """Three presets together: two mask groups on each term, extremes of all logits, magnitudes of labels."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    sizes = table(spark, folder, "embeddings").select("label", (total / F.size("embedding")).alias("mag"))
    found = evaluate(predictions(spark, folder), "masked_timestep_binned+outliers+magnitudes", magnitudes=sizes)
    return found.select("key", "reduction", F.round("value", 6).alias("value"))


def batch_summary(spark, folder):
    """Batch descriptors of documents, ten to a batch, with labels as loss mask."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    samples = docs.select(
        F.floor(F.col("doc_id") / 10).alias("batch_id"),
        (F.col("doc_id") % 10).cast("int").alias("sample_idx"),
        F.col("n_chars").alias("len"),
        F.when(F.col("quality") == 1, F.col("n_chars")).otherwise(0).alias("loss"),
    )
    return K.batch_summary(samples, loss_tokens="loss")


def prefix_lengths(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / 10).alias("batch_id"),
        (F.col("doc_id") % 10).cast("int").alias("sample_idx"),
        F.col("n_chars").alias("len"),
    )
    return K.prefix_lengths(docs)


QUERIES = {
    "token_values": token_values,
    "token_metrics": token_metrics,
    "per_label_metrics": _by(PER_LABEL),
    "length_binned_metrics": _by(LENGTHS),
    "timestep_binned_metrics": _by(TIMES),
    "masked_metrics": _by(PASS),
    "combined_mask_metrics": _by(PER_LABEL, LENGTHS, TIMES, PASS),
    "all_reductions": all_reductions,
    "accumulated_metrics": accumulated_metrics,
    "event_reductions": event_reductions,
    "data_ratios": data_ratios,
    "label_magnitudes": label_magnitudes,
    "preset_metrics": preset_metrics,
    "batch_summary": batch_summary,
    "prefix_lengths": prefix_lengths,
}

_labels = label_names(N_LABELS)
_label_case = "CASE label " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_labels)) + " END"


def _bins(column, prefix):
    edges = [256 * i for i in range(5)]
    cases = " ".join(
        f"WHEN {column} >= {a} AND {column} < {b} THEN '{prefix}{a}-{b}'" for a, b in zip(edges, edges[1:])
    )
    return f"CASE {cases} END"


MEMBERS = {
    "per_label": (_label_case, _labels),
    "lengths": (_bins("seq_len", ""), [f"{a}-{a + 256}" for a in range(0, 1024, 256)]),
    "times": (_bins("timestep", "t"), [f"t{a}-{a + 256}" for a in range(0, 1024, 256)]),
    "pass": ("CASE WHEN is_masked THEN 'masked' END", ["masked"]),
}

TOKENS = f"""
SELECT *, exp(-cel) AS probs, (1 - exp(-cel)) ** 2 * cel AS focal_loss FROM (
  SELECT *, ln(list_sum(list_transform(lg, lambda v: exp(v - list_max(lg))))) + list_max(lg)
            - lg[(CASE WHEN loss_mask THEN label ELSE 0 END) + 1] AS cel,
         CASE WHEN list_position(lg, list_max(lg)) - 1 = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS matches
  FROM (SELECT vec_id // {BATCH} AS batch_id, vec_id AS pos, list_transform(embedding, lambda v: v::DOUBLE) AS lg,
          CASE WHEN vec_id % 3 = 0 THEN 27 ELSE label END AS label, vec_id % 3 <> 0 AS loss_mask,
          vec_id % 2 = 0 AS is_masked, vec_id * 7 % 1024 AS timestep, vec_id * 37 % 1200 AS seq_len,
          embedding[21]::DOUBLE AS x FROM embeddings))"""


def _stats(groups, values):
    """SQL for the sums of values per batch and mask, every mask of every batch present."""
    sums = ", ".join(
        f"sum({v}) AS {v}_sum, max({v}) AS {v}_max, min({v}) AS {v}_min, arg_max({v}, pos) AS {v}_last" for v in values
    )
    parts = [f"SELECT batch_id, '' AS sub, count(*) AS c, {sums} FROM tok WHERE loss_mask GROUP BY batch_id"]
    names = [""]
    for g in groups:
        member, subs = MEMBERS[g]
        names += subs
        parts.append(
            f"SELECT batch_id, {member} AS sub, count(*) AS c, {sums} FROM tok "
            f"WHERE loss_mask AND {member} IS NOT NULL GROUP BY 1, 2"
        )
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""
WITH tok AS ({TOKENS}), st AS ({' UNION ALL '.join(parts)}),
ev AS (SELECT DISTINCT batch_id, s.sub FROM tok, (SELECT unnest([{listed}]) AS sub) s),
fl AS (SELECT ev.batch_id, ev.sub, coalesce(c, 0) AS c, st.* EXCLUDE (batch_id, sub, c) FROM ev LEFT JOIN st
       ON ev.batch_id = st.batch_id AND ev.sub = st.sub)"""


def _row(term, column, reduction, where="true"):
    value = {
        "sum": f"coalesce({column}_sum, 0)",
        "mean": f"coalesce({column}_sum, 0)",
        "max": f"coalesce({column}_max, '-inf'::DOUBLE)",
        "min": f"coalesce({column}_min, 'inf'::DOUBLE)",
        "last": f"{column}_last",
    }[reduction]
    n = "c" if reduction == "mean" else "1"
    return (
        f"SELECT batch_id, '{term}' AS term, '{reduction}' AS reduction, sub, "
        f"'{term}/{reduction}' || CASE WHEN sub = '' THEN '' ELSE '/' || sub END AS key, "
        f"{value} AS value, CAST({n} AS BIGINT) AS n FROM fl WHERE {where}"
    )


USUAL = [("seq_cel", "cel", "mean"), ("seq_cel", "cel", "sum"), ("seq_probs", "probs", "mean"), ("seq_acc", "matches", "mean")]


def _usual(*groups):
    rows = " UNION ALL ".join(_row(*r) for r in USUAL)
    return f"{_stats(groups, ['cel', 'probs', 'matches'])} SELECT batch_id, key, round(value, 6) AS value, n FROM ({rows})"


_plain_rows = " UNION ALL ".join(_row(*r) for r in USUAL)
_watch = [_row("watch", "x", r) for r in M.REDUCTIONS] + [
    _row("focal", "foc", r, "sub = ''") for r in ("sum", "max", "min")
]
_acc = [_row("seq_cel", "cel", r) for r in ("mean", "sum", "max", "min")] + [_row("watch", "x", "last", "sub = ''")]

SQL = {
    "token_values": f"""
SELECT pos, round(cel, 6) AS cel, round(focal_loss, 6) AS focal_loss, matches, round(probs, 6) AS probs,
       round(x, 6) AS identity FROM ({TOKENS}) WHERE loss_mask""",
    "token_metrics": f"""{_stats([], ['cel', 'probs', 'matches'])}
SELECT batch_id, key, round(value, 6) AS value, n FROM ({_plain_rows}
  UNION ALL SELECT batch_id, '', '', '', 'full_loss/sum', coalesce(cel_sum, 0) / greatest(1, c), 1 FROM fl)""",
    "per_label_metrics": _usual("per_label"),
    "length_binned_metrics": _usual("lengths"),
    "timestep_binned_metrics": _usual("times"),
    "masked_metrics": _usual("pass"),
    "combined_mask_metrics": _usual("per_label", "lengths", "times", "pass"),
    "all_reductions": f"""{_stats(['pass'], ['x', 'foc']).replace('focal_loss FROM (', 'focal_loss, 0.25 * (1 - exp(-cel)) ** 2 * cel AS foc FROM (', 1)}
SELECT batch_id, key, round(value, 6) AS value, n FROM ({' UNION ALL '.join(_watch)}
  UNION ALL SELECT batch_id, '', '', '', 'full_loss/sum', 0.5 * coalesce(foc_sum, 0), 1 FROM fl WHERE sub = '')""",
    "accumulated_metrics": f"""{_stats(['lengths'], ['cel', 'x'])}
SELECT key, reduction, round(CASE reduction WHEN 'max' THEN max(value) WHEN 'min' THEN min(value)
  WHEN 'last' THEN arg_max(value, batch_id) ELSE sum(value) / greatest(1, sum(n)) END, 6) AS value
FROM ({' UNION ALL '.join(_acc)}
  UNION ALL SELECT batch_id, '', 'sum', '', 'full_loss/sum', coalesce(cel_sum, 0) / greatest(1, c), 1 FROM fl WHERE sub = '')
GROUP BY key, reduction""",
    "preset_metrics": f"""{_stats(['pass', 'times'], ['cel', 'probs', 'matches', 'hi', 'lo']).replace('focal_loss FROM (', 'focal_loss, list_max(lg) AS hi, list_min(lg) AS lo FROM (', 1)}
SELECT key, reduction, round(CASE reduction WHEN 'max' THEN max(value) WHEN 'min' THEN min(value) ELSE sum(value) / greatest(1, sum(n)) END, 6) AS value
FROM ({_plain_rows} UNION ALL {_row("logits", "hi", "max", "sub = ''")} UNION ALL {_row("logits", "lo", "min", "sub = ''")}
  UNION ALL SELECT batch_id, '', 'sum', '', 'full_loss/sum', coalesce(cel_sum, 0) / greatest(1, c), 1 FROM fl WHERE sub = '')
GROUP BY key, reduction
UNION ALL SELECT 'label_magnitudes/last/' || {_label_case}, 'last', round(avg(list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / len(embedding)), 6)
FROM embeddings GROUP BY label""",
    "event_reductions": """
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, round(coalesce(sum(value) FILTER (WHERE m), 0), 6) AS sum_value, CAST(1 AS BIGINT) AS sum_n,
  round(coalesce(sum(value) FILTER (WHERE m), 0), 6) AS mean_value, count(*) FILTER (WHERE m) AS mean_n,
  coalesce(max(value) FILTER (WHERE m), '-inf'::DOUBLE) AS max_value, CAST(1 AS BIGINT) AS max_n,
  coalesce(min(value) FILTER (WHERE m), 'inf'::DOUBLE) AS min_value, CAST(1 AS BIGINT) AS min_n
FROM (SELECT *, event_type = 'error' AS m FROM events) GROUP BY 1""",
    "data_ratios": """
SELECT event_type, round(t / greatest(1, b / 4), 6) AS toks_per_batch, round(l / greatest(1, b / 4), 6) AS loss_toks_per_batch,
  round(l / greatest(1, s), 6) AS loss_toks_per_sample, round(l / greatest(1, t), 6) AS loss_toks_pct,
  round(s / greatest(1, b / 4), 6) AS samples_per_batch, round(t / greatest(1, s), 6) AS toks_per_sample,
  round(t / 3600.0::DOUBLE, 6) AS toks_per_sec, round(b / 3600.0::DOUBLE, 6) AS fwd_bwd_per_sec,
  round(l / 3600.0::DOUBLE, 6) AS loss_toks_per_sec, round(1 / 3600.0::DOUBLE, 6) AS updates_per_sec
FROM (SELECT event_type, sum(floor(value * 10)) AS t, sum(floor(value * 3)) AS l, CAST(sum(event_id % 5) AS DOUBLE) AS s,
  CAST(count(*) AS DOUBLE) AS b FROM events GROUP BY event_type)""",
    "label_magnitudes": f"""
SELECT label, {_label_case} AS name, round(avg(list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / len(embedding)), 7) AS value FROM embeddings GROUP BY label""",
    "batch_summary": """
SELECT d.doc_id // 10 AS batch_id, max(n_chars) AS max_seqlen, count(*) AS samples, CAST(sum(n_chars) AS BIGINT) AS tokens,
  CAST(sum(CASE WHEN quality = 1 THEN n_chars ELSE 0 END) AS BIGINT) AS loss_tokens
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
    "prefix_lengths": """
SELECT batch_id, sample_idx, len, cu_end, cu_end - len AS cu_start FROM (
  SELECT doc_id // 10 AS batch_id, CAST(doc_id % 10 AS INTEGER) AS sample_idx, n_chars AS len,
    CAST(sum(n_chars) OVER (PARTITION BY doc_id // 10 ORDER BY doc_id % 10 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cu_end
  FROM documents)""",
}
