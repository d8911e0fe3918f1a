"""Whitening against covariances of exact fractions and products."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import whiten
from postmill.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def brute(vectors, scale=whiten.SCALE, offset=whiten.OFFSET):
    """(x, sums, covariance) by exact products of centred values."""
    x = [[math.floor(scale * float(c)) + offset for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    sums = [sum(row[d] for row in x) for d in range(width)]
    centred = [[Fraction(row[d]) - Fraction(sums[d], n) for d in range(width)] for row in x]
    matrix = [[sum(r[i] * r[j] for r in centred) / n for j in range(width)] for i in range(width)]
    return x, sums, np.array([[float(c) for c in row] for row in matrix])


def checked(out, vectors, components):
    x, sums, matrix = brute(vectors)
    n, width = len(x), len(sums)
    values = np.linalg.eigvalsh(matrix)[::-1]
    by = {}
    for r in out:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(out) == n * min(width, components)
    want = {i: sum((n * row[d] - sums[d]) ** 2 for d in range(width)) for i, row in enumerate(x)}
    assert {r.vec_id: r.deviation for r in out} == want and {r.n for r in out} == {n}
    white = np.array([[by[i][k].whitened for k in range(1, min(width, components) + 1)] for i in range(n)])
    assert np.abs(white.T @ white / n - np.outer(white.mean(0), white.mean(0)) - np.eye(white.shape[1])).max() < 1e-8
    centred = np.array(x, float) - np.array(sums) / n
    for k in range(white.shape[1]):
        direction = centred.T @ white[:, k] / n / math.sqrt(values[k])  # V u / e = u
        assert np.allclose(matrix @ direction, values[k] * direction, atol=1e-8 * values[0])
        assert np.isclose(by[0][k + 1].explained, values[k] / values.sum(), rtol=1e-9)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-8


def test_query_equals_exact_products(spark):
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    checked(QUERIES["op13_whitening"](spark, SF).collect(), vectors, 32)


def test_polarisation_is_exact_for_large_values():
    random = np.random.default_rng(3)
    x = random.integers(-2 ** 40, 2 ** 40, (50, 4)) + 2 ** 41
    centres = np.array([int(x[:, d].sum()) // 50 for d in range(4)])
    remainders = [int(x[:, d].sum()) - 50 * int(centres[d]) for d in range(4)]
    got = whiten.covariance(whiten.pair_sums(x, centres), remainders, 50)
    rows = [[int(v) for v in row] for row in x]
    means = [Fraction(sum(r[d] for r in rows), 50) for d in range(4)]
    want = [[float(sum((r[i] - means[i]) * (r[j] - means[j]) for r in rows) / 50) for j in range(4)] for i in range(4)]
    assert got.tolist() == want


def test_dropped_rows_keys_and_clashing_columns(spark):
    random = np.random.default_rng(1)
    good = random.normal(size=(60, 5)).round(4).tolist()
    rows = [(i, v, 7, "x", 1) for i, v in enumerate(good)]
    rows += [(100, None, 1, None, None), (101, [1.0, None, 1.0, 1.0, 1.0], 1, None, None),
             (102, [float("nan")] * 5, 1, None, None), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1, None, None)]
    schema = "vec_id long, embedding array<double>, component int, whitened string, n int"
    df = spark.createDataFrame(rows, schema).repartition(7)
    checked(whiten.whiten(df, ["vec_id", "component", "n"]).collect(), good, 32)
    few = whiten.whiten(df, components=2).collect()
    checked(few, good, 2)
    twice = [(None, v, 0, "", 0) for v in good] + [(1, v, 0, "", 0) for v in good]
    out = whiten.whiten(spark.createDataFrame(twice, schema), components=3)
    assert out.count() == 360 and out.where("vec_id IS NULL").count() == 180
    assert out.select("n").distinct().collect()[0][0] == 120


def test_no_rows_and_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    out = whiten.whiten(spark.createDataFrame([(i, [0.5, 0.25]) for i in range(3)], schema)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in out] == [(0, None, None, None)] * 6
    flat = whiten.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    assert {r.explained for r in flat if r.component == 1} == {1.0}


def test_lengths_that_differ_and_entries_out_of_range_are_errors(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e300])]):
        with pytest.raises(Exception, match="differ in length|range of a long"):
            whiten.whiten(spark.createDataFrame(rows, schema)).collect()


def test_large_deviations_stay_exact(spark):
    rows = [(i, [float((-1) ** i) * 2.0 ** 45, float(i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x, sums, _ = brute([v for _, v in rows])
    got = {r.vec_id: int(r.deviation) for r in whiten.whiten(df).collect()}
    assert got == {i: sum((5 * x[i][d] - sums[d]) ** 2 for d in range(2)) for i in range(5)}


def test_layout_does_not_matter(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    cols = ["vec_id", "component", "deviation", F.round("whitened", 9).alias("w")]
    one, many = (sorted(map(tuple, whiten.whiten(df.repartition(k)).select(*cols).collect())) for k in (1, 13))
    assert one == many
