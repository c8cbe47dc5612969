"""Hard negatives and whitening against brute force, with the hard cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from symptra.llm import rnsgemm, whitening

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute_negatives(rows):
    whole = []
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(v is None or not np.isfinite(v) for v in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        whole.append((vec_id, label, [int(np.floor(256 * float(np.float32(v)))) for v in vector]))
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))
    out = []
    for a, label, x in whole:
        if a is None or a % 50:
            continue
        others = sorted(((-dot(x, v), float("inf") if i is None else i, k) for i, k, v in whole if i != a), key=lambda t: t[:2])
        for minus, positive, _ in [t for t in others if t[2] == label][:5]:
            fits = [t for t in others if t[2] != label and -50 * minus <= -100 * t[0] <= -95 * minus][:3]
            out += [(a, positive, k + 1, t[1], -minus, -t[0]) for k, t in enumerate(fits)]
    none = lambda v: None if v == float("inf") else v
    return sorted(((a, none(p), k, none(n), s, t) for a, p, k, n, s, t in out), key=str)


def mined(df):
    return sorted(map(tuple, rnsgemm.hard_negatives(df).collect()), key=str)


def vectors(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, d))
    return [
        (i, int(rng.integers(0, 4)), (scale * (centres[i % 4] + 0.7 * rng.normal(size=d))).astype(np.float32).tolist())
        for i in range(n)
    ]


def test_residue_products_are_exact():
    rng = np.random.default_rng(3)
    for size, d in ((300, 64), (1 << 20, 200), (1 << 30, 65)):
        a, b = rng.integers(-size, size, (5, d)), rng.integers(-size, size, (7, d))
        exact = np.array([[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a], dtype=object)
        primes = rnsgemm.primes_for(int(d * size * size))
        if abs(exact).max() >= 1 << 63:
            continue
        got = rnsgemm.exact_product(rnsgemm.residues(a, primes), [r.T.copy() for r in rnsgemm.residues(b, primes)], primes)
        assert (got == exact.astype(np.int64)).all()
    assert all(rnsgemm.SEGMENT * (p // 2) ** 2 < 1 << 24 for p in primes)


def test_best_takes_the_leftmost_of_equal_scores():
    scores = np.array([[5, 5, 5, 5, 9, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5], [1] * 20, [0] * 20])
    allowed = np.ones_like(scores, bool)
    allowed[2] = False
    allowed[1, 0] = False
    r, c, v = rnsgemm.best(scores, allowed, 3)
    assert list(zip(r, c, v)) == [(0, 4, 9), (0, 0, 5), (0, 1, 5), (1, 1, 1), (1, 2, 1), (1, 3, 1)]


@pytest.mark.parametrize("scale", [0.05, 1.0, 3000.0])
def test_hard_negatives_equal_brute_force(spark, scale):
    rows = vectors(900, 70, 5, scale)
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute_negatives(rows)


def test_hard_negatives_with_one_label_for_most_rows(spark):
    rows = [(i, 0 if i % 10 else k % 9 + 1, v) for i, k, v in vectors(1500, 8, 6)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute_negatives(rows)


def test_hard_negatives_cases(spark):
    rows = vectors(400, 6, 7)
    same = rows[3][2]
    rows += [(1000 + i, i % 2, same) for i in range(300)]  # ties
    rows += [(50, 1, same), (None, 0, same), (None, 1, same), (451, None, same), (452, 1, None)]
    rows += [(453, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (454, 1, [float("nan")] * 6), (455, 1, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "bucket", "tie", "g", "kind", "x", "high", "score", "slot"):
        df = df.withColumn(name, F.lit("clash"))
    # rows with one id are not each other's partners
    assert mined(df) == brute_negatives(rows)
    short = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [1.0]), (3, 2, []), (4, 1, [2.0, 0.5])]
    padded = [(i, k, v + [0.0] * (2 - len(v))) for i, k, v in short]
    assert mined(spark.createDataFrame(short, SCHEMA)) == brute_negatives(padded)
    empty = rnsgemm.hard_negatives(df.limit(0))
    assert empty.collect() == [] and "negative_score" in empty.columns
    assert mined(spark.createDataFrame([(0, 1, [1.0])], SCHEMA)) == []


def check_whitened(df, rows):
    got = df.toPandas()
    whole = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(v) for _, v in whole)
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (d - len(v)) for _, v in whole])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1][: min(4, d)]
    assert len(got) == len(whole) * min(4, d)
    assert set(got.n) == {n}
    exact = sorted(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x)
    assert sorted(got[got.component == 1].deviation) == exact
    varied = values > values[0] * d * 1e-15
    for k in range(min(4, d)):
        part = got[got.component == k + 1].sort_values("vec_id")
        assert np.allclose(part.explained, values[k] / np.trace(cov), rtol=1e-9, atol=1e-15)
        assert part.whitened.isna().all() == (not varied[k])
    return got, x, fit, cov, values


def test_whitening_equals_a_dense_solution(spark):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(12, 12)) * np.linspace(2, 0.2, 12)[:, None]
    rows = [(i, (rng.normal(size=12) @ mix).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got, x, fit, cov, values = check_whitened(whitening.whiten(df), rows)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    vectors = np.linalg.eigh(cov)[1][:, ::-1]
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    wanted = (x - fit.mean(axis=0)) @ vectors[:, :4] / np.sqrt(values[:4])
    for k in range(4):
        assert min(abs(table[:, k] - wanted[:, k]).max(), abs(table[:, k] + wanted[:, k]).max()) < 1e-9


def test_whitening_cases(spark):
    schema = "vec_id long, embedding array<float>, index int, x string, values string, whitened int"
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0, 0.5]), (None, [0.0, 1.0, 3.0]), (3, [2.0, -1.0, 0.0]), (3, [2.0]), (4, [])]
    rows += [(5, None), (6, [1.0, None, 2.0]), (7, [float("nan"), 0.0, 0.0]), (8, [0.0, float("-inf"), 0.0])]
    df = spark.createDataFrame([(*r, 1, "a", "b", 2) for r in rows], schema)
    out = whitening.whiten(df)
    check_whitened(out, rows)
    assert out.filter("vec_id IS NULL").count() == 3
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.filter("vec_id = 4")).collect() == []
    alone = whitening.whiten(df.filter("vec_id IN (1, 2)")).collect()  # one distinct vector
    assert len(alone) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in alone)
    large = [(i, [1e13 * (i % 3), float(i)]) for i in range(9)]
    big = whitening.whiten(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()
    assert len(big) == 18 and any(r["deviation"] is None for r in big)
