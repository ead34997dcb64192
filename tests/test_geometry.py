from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.functions import geometry as G
from curata.functions import residues as R
from curata.operators import wave as V


@pytest.mark.parametrize("lengths", [[1], [1, 2, 3], [31, 32, 33], [128, 70]])
@pytest.mark.parametrize("classes", [1, 2, 20])
def test_wave_features_against_plain_loops(spark, lengths, classes):
    rng = np.random.default_rng(len(lengths) + classes)
    w, mags = np.array(G.wavenumbers(4)), rng.normal(size=(4, classes))
    rows, want = [], {}
    for s, n in enumerate(lengths):
        ca, cb, labels = rng.normal(size=(n, 3)) * 8, rng.normal(size=(n, 3)), rng.integers(0, classes, n)
        rows.append((s, ca.ravel().tolist(), cb.ravel().tolist(), labels.tolist()))
        for i in range(n):
            f = np.zeros((4, 2))
            for j in range(n):
                r = ca[i] - ca[j]
                d = np.linalg.norm(r)
                if d > 0:
                    phase = (d - (r / d) @ cb[j] * mags[:, labels[j]]) * w
                    f += np.stack([np.cos(phase), np.sin(phase)], 1) / d
            want[s, i] = f.ravel()
    df = spark.createDataFrame(rows, "sample_id int, ca array<double>, cb_unit array<double>, labels array<int>")
    got = V.wave_features(df, w.tolist(), mags.tolist(), rows_per_task=32).collect()
    assert len(got) == sum(lengths)
    for r in got:
        np.testing.assert_allclose(r.features, want[r.sample_id, r.pos], atol=1e-9)


def test_wavenumbers_span_the_wavelengths():
    w = G.wavenumbers(5)
    assert w[0] == pytest.approx(2 * np.pi / 3.0) and w[-1] == pytest.approx(2 * np.pi / 25.0)


def test_transforms_and_virtual_cb(spark):
    m = [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    matrix = F.array(*[F.lit(x) for x in m])
    n, ca, c = (1.0, 2.0, 3.0), (2.0, 2.5, 3.0), (2.5, 2.0, 4.0)
    cols = [tuple(F.lit(x) for x in p) for p in (n, ca, c)]
    row = spark.range(1).select(
        G.pack(G.apply_transform(matrix, cols[0])).alias("moved"),
        G.pack(G.virtual_cb(*cols)).alias("cb"),
        G.pack(G.unit((F.lit(0.0),) * 3)).alias("zero"),
        G.compose(matrix, matrix).alias("twice"),
        G.zero_nan(F.array(F.array(F.lit(float("nan")).cast("float"), F.lit(1.0).cast("float")))).alias("clean"),
        G.squash(F.lit(1000.0), 10).alias("bounded"),
    ).first()
    assert row.moved == [-1.0, 3.0, 6.0] and row.zero == [0.0] * 3 and row.clean == [[0.0, 1.0]]
    b1, b2 = np.subtract(ca, n), np.subtract(c, ca)
    want = np.array(ca) + 0.56802827 * b1 - 0.58273431 * b2 - 0.54067466 * np.cross(b1, b2)
    np.testing.assert_allclose(row.cb, want, atol=1e-12)
    np.testing.assert_allclose(np.reshape(row.twice, (4, 4)), np.linalg.matrix_power(np.reshape(m, (4, 4)), 2))
    assert row.bounded == pytest.approx(10.0)


def test_labels_and_names(spark):
    row = spark.range(1).select(
        R.sequence_labels(F.lit("AYX06?a")).alias("labels"),
        F.transform(F.array(*[F.lit(i) for i in (0, 19, 20, 27, 28, 99)]), R.label_letter).alias("letters"),
        R.label_name(F.lit(28)).alias("mask"),
        R.letter_label(F.lit("<mask>")).alias("mask_label"),
        R.residue_letter(F.lit("MSE")).alias("mse"),
        R.residue_letter(F.lit("HOH")).alias("water"),
        R.atom_slot(F.lit("MSE"), F.lit("SD")).alias("sd"),
    ).first()
    assert row.labels == [0, 19, 27, 20, 26, 27, 27] and row.letters == ["A", "Y", "0", "X", "<mask>", "X"]
    assert (row.mask, row.mask_label, row.mse, row.water, row.sd) == ("mask", 28, "0", None, 6)
    assert all(atoms[:4] == ["N", "CA", "C", "O"] and len(atoms) <= 14 for atoms in R.ATOMS.values())
    assert R.residue_table(spark).count() == 28 and R.atom_table(spark).groupBy("parent").count().count() == 20
