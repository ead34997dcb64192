"""Wave features: each residue sums the waves that its neighbours send."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wave_kernel(wavenumbers, magnitudes, block: int = 64):
    """An Arrow function from one block of residues to its interleaved features.

    ``magnitudes`` is one row per wavenumber with one value per label.  For
    residue i and wavenumber k the feature is the sum over other residues j of
    ``exp(i phase) / d`` with phase ``(d - r.b_j mag[k, label_j]) w_k``, where
    ``r`` is the unit vector from j to i.
    """
    w = np.asarray(wavenumbers, dtype=np.float64)
    mags = np.asarray(magnitudes, dtype=np.float64)

    def one(ca, cb, labels, start, stop):
        x = np.asarray(ca, dtype=np.float64).reshape(-1, 3)
        b = np.asarray(cb, dtype=np.float64).reshape(-1, 3)
        send = mags[:, np.asarray(labels, dtype=np.int64)]  # wavenumber x residue
        out = np.empty((stop - start, len(w), 2))
        for lo in range(start, stop, block):
            hi = min(lo + block, stop)
            r = x[lo:hi, None] - x[None]
            d = np.linalg.norm(r, axis=2)
            other = d > 0
            inverse = np.divide(1.0, d, out=np.zeros_like(d), where=other)
            along = np.einsum("ijc,jc->ij", r, b) * inverse
            for k, wk in enumerate(w):
                phase = (d - along * send[k]) * wk
                out[lo - start : hi - start, k, 0] = (np.cos(phase) * inverse).sum(axis=1)
                out[lo - start : hi - start, k, 1] = (np.sin(phase) * inverse).sum(axis=1)
        return out.reshape(stop - start, -1).tolist()

    @F.pandas_udf("array<array<double>>")
    def features(ca: pd.Series, cb: pd.Series, labels: pd.Series, start: pd.Series, stop: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(ca, cb, labels, start, stop)])

    return features


def wave_features(
    samples: DataFrame, wavenumbers, magnitudes, sample: str = "sample_id", rows_per_task: int = 1024
) -> DataFrame:
    """``sample, pos, features`` for samples with flat ``ca`` and ``cb_unit`` and ``labels``.

    The sum runs over all residue pairs of a sample, whose length the crop
    bounds.  Long samples are cut into blocks of residues that compute in
    different tasks; the pairs themselves are never rows.
    """
    n = F.size("labels")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(rows_per_task))
    blocks = samples.filter(n > 0).select(sample, "ca", "cb_unit", "labels", F.explode(starts).alias("start"))
    blocks = blocks.withColumn("stop", F.least(F.col("start") + rows_per_task, F.size("labels")))
    blocks = blocks.repartition(sample, "start")
    kernel = wave_kernel(wavenumbers, magnitudes)
    done = blocks.select(
        sample, "start", F.posexplode(kernel("ca", "cb_unit", "labels", "start", "stop")).alias("_i", "features")
    )
    return done.select(sample, (F.col("start") + F.col("_i")).alias("pos"), "features")
