"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries c become integers floor(256 c).  The fit list is each distinct vector
once.  With X the fit list less its mean, one row a vector, every step makes
one column of  X V = U B,  B upper bidiagonal:

    w = X v_j - beta u_(j-1), cleared of u_1 .. u_(j-1);  alpha = |w|;  u_j = w / alpha
    z = X' u_j - alpha v_j,   cleared of v_1 .. v_j;      beta = |z|;   v_(j+1) = z / beta

Both products run over the rows of X in Spark, in one pass a step.  A left
vector is as long as the fit list and is never stored: it lies in the range of
X, so u_j = X p_j with p_j as long as one vector, and U'w = P X'w.  A pass gives
|w|^2 and X'w; clearing w of U, its new norm and X'u_j follow from these on
the driver.  Where clearing removes much of w (over a tenth of its norm), a
second pass clears again, so both sides stay orthogonal to working precision.
If alpha or beta vanishes the chain goes on with a new direction; it ends when
V spans the space, so equal eigenvalues are all found.  ``steps`` ends it
earlier, for wide vectors.

The singular values of B are the roots of n times the eigenvalues; V times
its right vectors are the components.  The driver holds a few matrices of one vector's
width, and gets one row a number of a pass, added up in Spark.

Nulls: rows whose vector is null or holds null or non-finite entries take no
part and are not returned; a null id stays null.  Vectors of another length
than the most frequent one (ties: the longest) are left out likewise.  An
empty table, empty vectors, or one distinct vector alone give no rows, and so
do components without variance: at most ``rank`` components exist.  Repeated
rows are returned once for each.  Entries beyond a long's range are held at
it.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import record
from curata.llm.tables import settle

SCALE = 256
#: Vectors of the fit list in one row of the staged blocks.
BLOCK = 4096
#: Share of w that clearing may remove before it is cleared again.
AGAIN = 0.1
#: Norms below this share of the first one count as zero.
TINY = 1e-13


def integers(column: str = "embedding") -> Column:
    """floor(256 c) of each entry as long, or null where the vector takes no part."""
    c = F.col(column)
    usable = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(c, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows that take part, staged."""
    made = vectors.select("vec_id", integers().alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    made = settle(made, "whiten-rows")
    widths = made.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    best = widths.orderBy(F.desc("n"), F.desc("width")).first()
    return made.filter(F.size("x") == (best.width if best else 0))


def _matrix(column, width: int) -> np.ndarray:
    """A list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).reshape(-1, width)


def blocked(rows: DataFrame, width: int) -> DataFrame:
    """The fit list, ``block`` (rows of 64-bit integers) and ``n``, staged."""
    schema = pa.schema([("n", pa.int64()), ("block", pa.binary())])

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), width).astype("<i8")
            for first in range(0, len(x), BLOCK):
                part = x[first : first + BLOCK]
                yield record(schema, [len(part)], [part.tobytes()])

    return settle(rows.select("x").distinct().mapInArrow(run, "n long, block binary"), "whiten-fit")


def _blocks(batches, width: int):
    for batch in batches:
        for one in batch.column("block"):
            yield np.frombuffer(one.as_buffer(), "<i8").reshape(-1, width)


def reduced(fit: DataFrame, width: int, size: int, kernel, kind: str = "double") -> list:
    """The sum over all blocks of ``kernel(x)``, ``size`` numbers; each task adds up its own first."""
    kinds = {"double": (np.float64, pa.float64()), "long": (np.int64, pa.int64())}
    dtype, arrow = kinds[kind]
    schema = pa.schema([("i", pa.int64()), ("value", arrow)])

    def run(batches):
        total = np.zeros(size, dtype)
        for x in _blocks(batches, width):
            total += kernel(x)
        yield record(schema, np.arange(size), total)

    rows = fit.select("block").mapInArrow(run, f"i long, value {kind}").groupBy("i").agg(F.sum("value").alias("value"))
    out = [0] * size
    for row in rows.collect():
        out[row.i] = row.value
    return out


@dataclass
class Fit:
    """n, the exact sums S, eigenvalues of the covariance, components as rows, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _clear(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The vector less its part in the span of the rows of ``basis``, cleared twice."""
    for _ in range(2):
        vector = vector - basis.T @ (basis @ vector)
    return vector


def _fresh(basis: np.ndarray, rng) -> np.ndarray:
    """A unit vector across all rows of ``basis``."""
    while True:
        vector = rng.standard_normal(basis.shape[1])
        rest = _clear(vector, basis)
        if np.linalg.norm(rest) > 1e-6 * np.linalg.norm(vector):
            rest = _clear(rest / np.linalg.norm(rest), basis)
            return rest / np.linalg.norm(rest)


def bidiagonalise(products, width: int, steps: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """``V`` (a right vector a row) and ``B`` after ``steps`` steps.

    ``products(q)`` gives ``w'w`` and ``X'w`` for ``w = X q`` in one pass over
    the rows.  ``scale`` is the size of X.
    """
    rng = np.random.default_rng(7)
    right = np.zeros((0, width))
    left = np.zeros((0, width))
    images = np.zeros((0, width))
    b = np.zeros((steps, steps))
    v, beta = _fresh(right, rng), 0.0
    for j in range(steps):
        right = np.vstack([right, v])
        q = v - (beta * left[-1] if j and beta else 0.0)
        for _ in range(3):
            square, image = products(q)
            inner = left @ image
            q = q - left.T @ inner
            image = image - images.T @ inner
            norm = float(np.sqrt(max(square - float(inner @ inner), 0.0)))
            if np.linalg.norm(inner) <= AGAIN * np.sqrt(square):
                break
        alpha = norm if norm > TINY * scale else 0.0
        p, z = (q / alpha, image / alpha) if alpha else (np.zeros(width), np.zeros(width))
        left, images = np.vstack([left, p]), np.vstack([images, z])
        b[j, j] = alpha
        if j + 1 == steps:
            break
        rest = _clear(z - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        if beta > TINY * scale:
            v = _clear(rest / beta, right)
            v /= np.linalg.norm(v)
            b[j, j + 1] = beta
        else:
            v, beta = _fresh(right, rng), 0.0
    return right, b


def fit(rows: DataFrame, components: int = 4, steps: int | None = None) -> tuple[Fit | None, DataFrame]:
    """The fit of ``prepared`` rows and their staged blocks; no fit where nothing varies.

    ``steps``: steps of the bidiagonalisation, by default as many as a vector
    has numbers, which is exact; fewer give the leading components as closely
    as that many steps bring them.
    """
    one = rows.select(F.size("x").alias("width")).first()
    width = one.width if one else 1
    blocks = blocked(rows, width)
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    if n < 2:
        return None, blocks
    # Sums of the high and low halves cannot overflow, whatever the entries are.
    halves = reduced(blocks, width, 2 * width, lambda x: np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]), "long")
    sums = [(int(h) << 32) + int(l) for h, l in zip(halves[:width], halves[width:])]
    mean = np.array([s / n for s in sums])
    total = reduced(blocks, width, 1, lambda x: np.array([((x - mean) ** 2).sum()]))[0]
    if not total:
        return None, blocks

    def products(q):
        def kernel(x):
            centred = x - mean
            w = centred @ q
            return np.concatenate([[w @ w], w @ centred])

        found = np.array(reduced(blocks, width, 1 + width, kernel))
        return float(found[0]), found[1:]

    right, b = bidiagonalise(products, width, min(steps or width, width), float(np.sqrt(total)))
    _, singular, turned = np.linalg.svd(b)
    values = singular**2 / n
    kept = [i for i in range(min(components, len(values))) if singular[i] > 1e-9 * singular[0]]
    found = turned[kept] @ right
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    return Fit(n, sums, values[kept], found, total / n), blocks


def identity_error(blocks: DataFrame, model: Fit) -> float:
    """How far the covariance of the whitened fit list is from the identity, at most."""
    k, width, mean = len(model.values), model.components.shape[1], model.mean()
    axes = (model.components / np.sqrt(model.values)[:, None]).T
    moved = np.array(reduced(blocks, width, k, lambda x: ((x - mean) @ axes).sum(0))) / model.n

    def kernel(x):
        y = (x - mean) @ axes - moved
        return (y.T @ y).reshape(-1)

    covariance = np.array(reduced(blocks, width, k * k, kernel)).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum of (n x - S)^2 over the entries of each row, exact."""
    most = max(int(np.abs(x).max(initial=0)) if len(x) else 0, int(-x.min(initial=0)) if len(x) else 0)
    bound = n * most + max(map(abs, sums), default=0)
    if x.shape[1] * bound * bound < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    return [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]


def whiten(vectors: DataFrame, components: int = 4, steps: int | None = None) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is null where it is beyond a long's range.
    """
    rows = prepared(vectors)
    model, blocks = fit(rows, components, steps)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    error = identity_error(blocks, model)
    k, width, mean = len(model.values), model.components.shape[1], model.mean()
    axes = (model.components / np.sqrt(model.values)[:, None]).T
    explained = model.values / model.trace
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip([part.split()[0] for part in out.split(", ")], kinds)))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            y = (x - mean) @ axes
            far = [d if d < 1 << 63 else None for d in deviations(x, model.n, model.sums)]
            at = np.repeat(np.arange(len(x)), k)
            yield record(
                schema,
                batch.column("vec_id").take(pa.array(at)),
                np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                np.full(len(at), model.n),
                [far[i] for i in at],
                y.reshape(-1),
                np.tile(explained, len(x)),
                np.full(len(at), error),
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, out)
