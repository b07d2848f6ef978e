import os

import numpy as np
import pytest

from kinweave.llm import embeddings
from kinweave.llm.embeddings import OP1_SQL, PairFinder, near_vectors, op1_embeddings


def brute(rows, cosine=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links, at = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    u = [np.array(np.float32(v), float) / np.linalg.norm(np.array(np.float32(v), float)) if k else None for (_, v), k in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine:
                links[i] += 1
                links[j] += 1
                at[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, links[i], low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for n in [1] * 150 + [2] * 20 + [5] * 6 + [90]:
        base = rng.standard_normal(64)
        for _ in range(n):
            v = (base + rng.standard_normal(64) * 0.17).astype(np.float32).tolist()
            rows.append((int(len(rows) * 37 % 5003), v))
    rows += [(6000 + k, rows[3][1]) for k in range(4)]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 64), (7003, [float("nan")] * 64), (7004, [float("inf")] + [1.0] * 63), (7005, [None] + [1.0] * 63), (7006, [1.0, 0.0]), (7007, [2.0, 0.01]), (7008, [3.0]), (7009, [-3.0])]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<float>, n int")
    for tile in (40, 3000):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, tile=tile).collect())
        assert got == brute(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_tiles_are_fitted_and_pruned(spark, monkeypatch):
    """Far apart groups of vectors: tiles out of reach never meet, every link is found."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(12):
        centre = rng.standard_normal(16) * 3
        for _ in range(40):
            v = (centre + rng.standard_normal(16) * 0.3).astype(np.float32)
            rows.append((len(rows), v.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same = df.selectExpr("vec_id as key", "1L as n", "embedding", "size(embedding) as d")
    _, meets, tasks = embeddings.tiled(same, 0.95, 8, 30)
    assert tasks < meets.count() * (meets.count() + 1) // 2
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, tile=30).collect())
    assert got == brute(rows)


def test_pairs_once_each():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 24))
    x = np.vstack([x, x[:30] + rng.standard_normal((30, 24)) * 0.2, x[:9]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if x[i] @ x[j] >= 0.95}
    for leaf in (1, 5, 1000):
        finder = PairFinder(x, 0.95, 8, leaf)
        got = [tuple(sorted(p)) for i, j in finder.pairs(np.arange(len(x))) for p in zip(i.tolist(), j.tolist())]
        assert sorted(got) == sorted(want)
        left, right = np.arange(0, len(x), 2), np.arange(1, len(x), 2)
        got = [tuple(sorted(p)) for i, j in finder.pairs(left, right) for p in zip(i.tolist(), j.tolist())]
        assert sorted(got) == sorted(p for p in want if (p[0] + p[1]) % 2)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_query_equals_brute_force_on_a_whole_table(spark, tmp_path):
    """sf0.01 has no pair at 0.95, so near copies of its own vectors are planted beside them."""
    import duckdb
    import pyarrow.parquet as pq

    rng = np.random.default_rng(4)
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()]
    for k in range(120):
        v = np.array(rows[k % 40][1], np.float32)
        v = v + rng.standard_normal(len(v)).astype(np.float32) * np.float32(rng.choice([0, 0.1, 0.2, 0.3]) * v.std())
        rows.append((10_000 + k, v.astype(np.float32).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in op1_embeddings(spark, str(tmp_path)).collect())
    want = brute(rows)
    assert got == want
    assert sum(r[1] for r in want) > 100
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(OP1_SQL).fetchall()) == want
