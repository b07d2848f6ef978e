import math
import os

import numpy as np
import pytest

from kinweave.llm.whitening import op12_whitening, triangle, whiten

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=4):
    """{(vec_id, place among rows): (deviation, x, n)} and the covariance's eigenvalues, from a dense covariance in Python integers."""
    own = [(i, [math.floor(256 * float(c)) for c in e]) for i, e in rows if e is not None and len(e) and all(c is not None and math.isfinite(c) for c in e)]
    lists = sorted({tuple(x) for _, x in own})
    n = len(lists)
    s = [sum(c) for c in zip(*lists, strict=True)]
    y = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for x in lists])
    values, ways = np.linalg.eigh(y.T @ y / n)
    out = []
    for i, x in own:
        off = [n * a - b for a, b in zip(x, s, strict=True)]
        out.append((i, sum(v * v for v in off), np.array([v / n for v in off]) @ ways[:, ::-1][:, :k] / np.sqrt(np.maximum(values[::-1][:k], 1e-300))))
    return n, out, values[::-1]


def check(rows, got, k=4):
    n, want, values = plain(rows, k)
    assert len(got) == len(want) * k
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    for i, deviation, z in want:
        mine = sorted(by[i], key=lambda r: r["component"])[:k]
        assert [r["component"] for r in mine] == list(range(1, k + 1))
        assert {(r["n"], int(r["deviation"])) for r in mine} == {(n, deviation)}
        np.testing.assert_allclose(np.abs([r["whitened"] for r in mine]), np.abs(z), rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose([r["explained"] for r in mine], values[:k] / values.sum(), rtol=1e-9)
        assert all(r["identity_error"] < 1e-9 for r in mine)
    for c in range(1, k + 1):  # one sign for all rows
        ratio = {round(next(r["whitened"] for r in by[i] if r["component"] == c) / z[c - 1]) for i, _, z in want if abs(z[c - 1]) > 1e-6}
        assert ratio in ({1}, {-1})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_over_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(rows, op12_whitening(spark, DATA).collect())


def test_triangle():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(9000, 5))
    r = triangle(iter([y[:2], y[2:7000], y[7000:7000], y[7000:]]))
    np.testing.assert_allclose(r.T @ r, y.T @ y, rtol=1e-10)
    assert triangle(iter([])) is None


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=6).astype(np.float32)]) for i in range(300)]
    odd = [(None, None), (900, [1.0, None] + [0.0] * 4), (901, [float("nan")] * 6), (902, [float("inf")] * 6), (903, [1.0]), (904, []), (905, [3e38] * 6)]
    same = [(500 + i, rows[0][1]) for i in range(200)]  # copies count once in the fit
    df = spark.createDataFrame(rows + odd + same, SCHEMA).withColumnRenamed("vec_id", "vec_id").selectExpr("*", "1 as component", "vec_id as `a.b`", "2 as x")
    got = whiten(df.repartition(23)).collect()
    check(rows + same, got)
    # the same id twice: each row gives its rows
    twice = whiten(df.unionAll(df.where("vec_id = 7"))).where("vec_id = 7").collect()
    assert len(twice) == 8


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e9 + i, -3e8 * i]) for i in range(40)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, want, _ = plain(rows, 2)
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == {i: d for i, d, _ in want}
    assert any(d > 2**63 for _, d, _ in want)


def test_small_and_empty(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    one = whiten(spark.createDataFrame([(1, [0.5, 0.5]), (None, [0.5, 0.5])], SCHEMA)).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, None)] * 4
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(50)], SCHEMA)).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert all(r["identity_error"] < 1e-9 for r in line)
    assert abs(line[0]["explained"] - 1) < 1e-12
