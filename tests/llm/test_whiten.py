import math
from fractions import Fraction

import numpy as np
import pytest
from kinsheet.llm import queries, whiten


def brute(rows, components=16):
    """Rows with their integers, deviation and whitened values, from plain NumPy."""
    used = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in used]
    fit = sorted({x for _, x in xs})
    n = len(fit)
    sums = [sum(col) for col in zip(*fit)]
    d = len(sums)
    cov = np.array(
        [
            [float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3)) for b in range(d)]
            for a in range(d)
        ]
    ).reshape(d, d)
    values, vectors = np.linalg.eigh(cov) if d else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum())) if d else 0
    out = {}
    for i, x in xs:
        far = [n * a - s for a, s in zip(x, sums)]
        y = (np.array(far, dtype=float) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        out.setdefault(i, []).append((sum(f * f for f in far), y))
    return n, out, values[:k] / np.trace(cov) if d else [], len(xs) * k


def check(rows, found, components=16):
    n, expected, explained, count = brute(rows, components)
    assert len(found) == count
    sign = {}
    for r in found:
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
        ok = False
        for far, y in expected[r["vec_id"]]:
            value = y[r["component"] - 1]
            if far == r["deviation"] and abs(abs(value) - abs(r["whitened"])) < 1e-6 * max(1, abs(value)):
                if abs(value) > 1e-3:
                    sign.setdefault(r["component"], set()).add((value > 0) == (r["whitened"] > 0))
                ok = True
        assert ok
    assert all(len(s) == 1 for s in sign.values())


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(120)
    found = whiten.whitened(rows).collect()
    check([(r["vec_id"], r["embedding"]) for r in rows.collect()], found)
    whole = queries.op12_whitening(spark, sf_dir)
    assert whole.count() == 16 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


SCHEMA = "vec_id long, embedding array<float>, x string, n int, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).astype("float32").tolist()) for i in range(40)]
    rows += [rows[0], rows[1], (None, rows[2][1]), (50, rows[3][1])]
    rows += [(60, None), (61, []), (62, [1.0, None, 0.0, 0.0, 0.0]), (63, [float("nan")] * 5)]
    rows += [(64, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (65, [-1e5, 1e5, 3.5, 0.0, -0.01])]
    check(rows, whiten.whitened(table(spark, rows)).collect())


def test_components_without_variance(spark):
    same = [(1, [0.5, 0.25]), (2, [0.5, 0.25])]
    assert whiten.whitened(table(spark, same)).count() == 0
    assert whiten.whitened(table(spark, [])).count() == 0
    line = [(i, [i / 8, i / 4, 1.0]) for i in range(9)]  # one direction only
    found = whiten.whitened(table(spark, line)).collect()
    check(line, found)
    assert {r["component"] for r in found} == {1}


def test_lengths_differ(spark):
    with pytest.raises(ValueError):
        whiten.whitened(table(spark, [(1, [0.5, 0.25]), (2, [0.5])]))


@pytest.mark.parametrize("high", [1, 2, 1000, 1 << 40])
def test_planes_are_exact(high):
    rng = np.random.default_rng(high)
    x = rng.integers(-high, high, size=(333, 7))
    n, sums, products = whiten.scatter(x)
    wide = x.astype(object)
    assert n == 333 and (sums == wide.sum(axis=0)).all() and (products == wide.T.dot(wide)).all()


def test_deviation_beyond_a_long(spark):
    rows = [(1, [3e7, 0.0]), (2, [-3e7, 1.0]), (3, [1.0, 2.0])]
    far = {r["vec_id"]: r["deviation"] for r in whiten.whitened(table(spark, rows)).collect()}
    assert far[1] is None and far[2] is None and far[3] is not None
