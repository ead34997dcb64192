"""Backbone geometry, rigid copies and wave features over embedding vectors as coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.functions import geometry as G
from curata.operators import wave as V
from curata.queries.common import table

#: A vector of 64 numbers is 21 points and a number, or seven backbones and a number.
POINTS = 21
BACKBONES = 7
WAVES = 3
LABELS = 10
WAVENUMBERS = G.wavenumbers(WAVES)
MAGNITUDES = [[(k + 1) * 0.25 + label * 0.125 for label in range(LABELS)] for k in range(WAVES)]
QUARTER_TURN = [0.0, -1.0, 0.0, 1.5, 1.0, 0.0, 0.0, -2.0, 0.0, 0.0, 1.0, 0.25, 0.0, 0.0, 0.0, 1.0]


def virtual_cb(spark, folder):
    """Seven backbones of three points per vector: virtual CB, unit direction, squashed norm; the last number scales the norm."""
    residues = table(spark, folder, "embeddings").select(
        "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(BACKBONES - 1))).alias("residue")
    )
    framed = residues.withColumn("frame", F.slice("embedding", F.col("residue") * 9 + 1, 9))
    n, ca, c = (G.point("frame", 3 * i) for i in range(3))
    cb, u = G.virtual_cb(n, ca, c), G.cb_direction(n, ca, c)
    values = {f"cb_{a}": v for a, v in zip("xyz", cb)} | {f"u_{a}": v for a, v in zip("xyz", u)}
    values["norm"] = G.squash(G.norm(cb) * (F.element_at("embedding", -1).cast("double") + 20))
    return framed.select("vec_id", "residue", *[F.round(v, 7).alias(k) for k, v in values.items()])


def affine_expand(spark, folder):
    """Two rigid copies of the points of every vector, NaN replaced by 0; the last number is a point on the diagonal."""
    whole = F.concat("embedding", F.array_repeat(F.element_at("embedding", -1), 2))
    points = F.transform(F.sequence(F.lit(0), F.lit(POINTS)), lambda i: F.slice(whole, i * 3 + 1, 3))
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        G.zero_nan(points).alias("atoms"),
        F.posexplode(F.array(G.identity(), F.array(*[F.lit(x) for x in QUARTER_TURN]))).alias("copy", "matrix"),
    )
    moved = rows.select("vec_id", "copy", F.posexplode(G.transform_atoms("matrix", "atoms")).alias("atom", "p"))
    return moved.select(
        "vec_id", "copy", "atom", *[F.round(F.col("p")[i], 6).alias(a) for i, a in enumerate("xyz")]
    )


def wave_features(spark, folder):
    """A residue for each point of a vector: CA from the first numbers, CB from the last, labels by position."""
    samples = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.transform(F.slice("embedding", 1, POINTS * 3), lambda x: x.cast("double") * 30).alias("ca"),
        F.transform(F.slice("embedding", 2, POINTS * 3), lambda x: x.cast("double")).alias("cb_unit"),
        F.transform(
            F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: ((F.col("label") + i) % LABELS).cast("int")
        ).alias("labels"),
    )
    rows = V.wave_features(samples, WAVENUMBERS, MAGNITUDES)
    return rows.select("sample_id", "pos", F.posexplode("features").alias("f", "value")).select(
        "sample_id", "pos", "f", F.round("value", 5).alias("value")
    )


QUERIES = {"virtual_cb": virtual_cb, "affine_expand": affine_expand, "wave_features": wave_features}

_e = lambda i: f"CAST(embedding[9 * residue + {i}] AS DOUBLE)"
_cb = f"""
SELECT vec_id, residue, last, ca_x, ca_y, ca_z,
  ca_x + {G.CB_FROM_N_CA} * ix - {G.CB_FROM_CA_C} * ox - {G.CB_FROM_CROSS} * (iy * oz - iz * oy) AS cb_x,
  ca_y + {G.CB_FROM_N_CA} * iy - {G.CB_FROM_CA_C} * oy - {G.CB_FROM_CROSS} * (iz * ox - ix * oz) AS cb_y,
  ca_z + {G.CB_FROM_N_CA} * iz - {G.CB_FROM_CA_C} * oz - {G.CB_FROM_CROSS} * (ix * oy - iy * ox) AS cb_z
FROM (SELECT vec_id, residue, CAST(embedding[64] AS DOUBLE) AS last, {_e(4)} AS ca_x, {_e(5)} AS ca_y, {_e(6)} AS ca_z,
  {_e(4)} - {_e(1)} AS ix, {_e(5)} - {_e(2)} AS iy, {_e(6)} - {_e(3)} AS iz,
  {_e(7)} - {_e(4)} AS ox, {_e(8)} - {_e(5)} AS oy, {_e(9)} - {_e(6)} AS oz FROM embeddings, range({BACKBONES}) AS r(residue))"""
_len = "greatest(sqrt((cb_x - ca_x) ** 2 + (cb_y - ca_y) ** 2 + (cb_z - ca_z) ** 2), 1e-8)"
_norm = "sqrt(cb_x ** 2 + cb_y ** 2 + cb_z ** 2) * (last + 20)"


def _moved(axis: int) -> str:
    m = QUARTER_TURN[4 * axis : 4 * axis + 4]
    own = "xyz"[axis]
    return f"round(CASE copy WHEN 0 THEN {own} ELSE {m[0]} * x + {m[1]} * y + {m[2]} * z + {m[3]} END, 6) AS {own}"


_sum = lambda fn: " UNION ALL ".join(
    f"SELECT sample_id, pos, {2 * k + (fn == 'sin')} AS f, sum({fn}((d - proj * ({(k + 1) * 0.25} + label * 0.125)) * {WAVENUMBERS[k]!r}) / d) AS value FROM pairs GROUP BY sample_id, pos"
    for k in range(WAVES)
)

SQL = {
    "virtual_cb": "SELECT vec_id, CAST(residue AS INTEGER) AS residue, "
    + ", ".join(f"round(cb_{a}, 7) AS cb_{a}, round((cb_{a} - ca_{a}) / {_len}, 7) AS u_{a}" for a in "xyz")
    + f", round(tanh(({_norm}) / 10) * 10, 7) AS norm FROM ({_cb})",
    "affine_expand": f"""
SELECT vec_id, CAST(copy AS INTEGER) AS copy, CAST(atom AS INTEGER) AS atom, {_moved(0)}, {_moved(1)}, {_moved(2)}
FROM (SELECT vec_id, atom, copy, CAST(embedding[3 * atom + 1] AS DOUBLE) AS x, CAST(embedding[least(3 * atom + 2, 64)] AS DOUBLE) AS y,
        CAST(embedding[least(3 * atom + 3, 64)] AS DOUBLE) AS z FROM embeddings, range({POINTS + 1}) AS r(atom), range(2) AS c(copy))""",
    "wave_features": f"""
WITH points AS (
  SELECT vec_id AS sample_id, i AS pos, (label + i) % {LABELS} AS label,
    {', '.join(f"CAST(embedding[3 * i + {j + 1}] AS DOUBLE) * 30 AS {a}, CAST(embedding[3 * i + {j + 2}] AS DOUBLE) AS q{a}" for j, a in enumerate('xyz'))}
  FROM embeddings, range({POINTS}) AS r(i)),
pairs AS (
  SELECT *, ((ax - x) * qx + (ay - y) * qy + (az - z) * qz) / d AS proj FROM (
    SELECT a.sample_id, a.pos, a.x AS ax, a.y AS ay, a.z AS az, b.x, b.y, b.z, b.qx, b.qy, b.qz, b.label,
      sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
    FROM points a JOIN points b ON a.sample_id = b.sample_id) WHERE d > 0)
SELECT sample_id, CAST(pos AS INTEGER) AS pos, CAST(f AS INTEGER) AS f, round(value, 5) AS value FROM ({_sum('cos')} UNION ALL {_sum('sin')})""",
}
