"""Dense pairs by blocks and tiles, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import evaluation as ev
from kinweave.operators import similarity as sim
from kinweave.queries import _rounded

N = 1_300  # three blocks of several tiles, the last ones cut


@pytest.fixture(scope="module")
def dense(spark):
    x = np.random.default_rng(5).normal(size=(N, 6)).astype(np.float32)
    x[7] = 0
    ids = [3 * k + 1 for k in range(N)]
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "seq_idx long, embedding array<float>")
    unit = x.astype(float) / (np.linalg.norm(x.astype(float), axis=1, keepdims=True) + 1e-8)
    return ids, vectors, np.clip(unit @ unit.T, 0, 1)


def test_cosine_by_tiles(spark, dense, monkeypatch):
    ids, vectors, want = dense
    monkeypatch.setattr(sim, "TILE", 200)
    got = sim.cosine_similarity(vectors).toPandas()
    assert len(got) == N * (N - 1) // 2 and (got.i < got.j).all() and not got.duplicated(["i", "j"]).any()
    at = {i: k for k, i in enumerate(ids)}
    s = want[got.i.map(at), got.j.map(at)]
    assert np.abs(got.s - s).max() < 1e-6


def test_copies_of_vectors_are_few():
    """Of many vectors the blocks are wide: those of 512 dealt each of 600,000 vectors 1,172 times."""
    assert -(-600_000 // sim._block_size(600_000)) <= 147 and sim._block_size(2_000) == 512


def test_rounded_as_round(spark):
    """All ties at the fifth decimal, their neighbours as floats, and not a number."""
    ties = (np.arange(10_000) + 0.5).astype(np.float64) / 10_000
    f = ties.astype(np.float32)
    values = np.r_[f, np.nextafter(f, np.float32(0)), np.nextafter(f, np.float32(2)), np.arange(0, 1, 2**-12, dtype=np.float32), np.float32([0, 1, "nan"])]
    edges = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(values)], "i long, j long, s float")
    both = _rounded(edges).join(edges.select("j", F.round(F.col("s").cast("double"), 4).alias("r")), "j")
    assert both.where("not s <=> r").count() == 0
    assert "round(" not in _rounded(edges)._jdf.queryExecution().optimizedPlan().toString()


def test_blend_as_join(spark, dense, monkeypatch):
    """Motif edges within and across blocks, some with an end without a vector, give what the join of both edge tables gives; dense pairs are in no shuffle."""
    ids, vectors, _ = dense
    monkeypatch.setattr(sim, "TILE", 200)
    rng = np.random.default_rng(6)
    ends = {tuple(sorted(map(int, rng.choice([*ids, 2, 5, 8], 2, replace=False)))) for _ in range(3_000)} | {(2, 5)}
    motif = spark.createDataFrame([(i, j, float(rng.random())) for i, j in sorted(ends)], "i long, j long, s float")
    got = sim.blended_similarity(motif, vectors, 0.3)
    want = sim.hybrid_similarity(motif, sim.cosine_similarity(vectors), 0.3)
    both = got.join(want.withColumnRenamed("s", "t"), ["i", "j"], "full")
    assert both.count() == want.count() == got.count() and both.where("not s <=> t").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan
    few = sim.blended_similarity(motif.where("false"), vectors)
    assert few.count() == N * (N - 1) // 2
    assert sim.blended_similarity(motif, vectors.where("false")).count() == len(ends)


def test_silhouette_by_blocks(spark, dense):
    """Sums by label within pairs of blocks give what the silhouette over all pairs gives; no pair leaves its task."""
    ids, vectors, want = dense
    labels = spark.createDataFrame([(i, "one" if i == ids[3] else f"l{i * 7 % 5}") for i in ids], "seq_idx long, predicted string")
    plain = ev.silhouette(labels, sim.cosine_similarity(vectors)).first()[0]
    near = sim.cosine_sums(vectors.join(labels, "seq_idx"))
    assert abs(ev.silhouette_of_sums(labels, near).first()[0] - plain) < 1e-7
    assert near.count() <= N * 6 * 3
    own = {i: f"l{i * 7 % 5}" if i != ids[3] else "one" for i in ids}
    for r in near.groupBy("a", "predicted").agg(F.sum("s").alias("s")).where("a % 100 = 1").collect():
        k = ids.index(r["a"])
        assert abs(r["s"] - sum(want[k, m] for m in range(N) if m != k and own[ids[m]] == r["predicted"])) < 1e-9


def written(spark, df) -> int:
    """Bytes of shuffle files that running df leaves."""
    def files() -> dict:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        out = {}
        while found.hasNext():
            f = found.next()
            out[f.getPath()] = f.length()
        return out

    before = files()
    df.write.format("noop").mode("overwrite").save()
    return sum(size for path, size in files().items() if path not in before)


@pytest.fixture(scope="module")
def wide(spark):
    x = np.random.default_rng(8).normal(size=(800, 64)).astype(np.float32)
    return spark.createDataFrame([(2 * k, [float(v) for v in r], f"l{k % 3}") for k, r in enumerate(x)], "seq_idx long, embedding array<float>, predicted string")


def some_edges(spark, n: int):
    rng = np.random.default_rng(9)
    ends = {tuple(sorted(map(int, rng.choice(1_650, 2, replace=False)))) for _ in range(n)}  # odd ids have no vector
    return spark.createDataFrame([(i, j, float(rng.random())) for i, j in sorted(ends)], "i long, j long, s float")


def sized(monkeypatch, size: int) -> None:
    monkeypatch.setattr(sim, "LEAST", size)
    monkeypatch.setattr(sim, "MOST", size)


@pytest.mark.parametrize("of", ["hybrid", "cosine", "sums"])
def test_no_copies_of_vectors_are_written(spark, wide, monkeypatch, of):
    """Twice the blocks, as more vectors would make, write no more: a block is dealt once, not once for each block that it meets."""
    motif = some_edges(spark, 500)
    run = {"hybrid": lambda: sim.blended_similarity(motif, wide), "cosine": lambda: sim.cosine_similarity(wide), "sums": lambda: sim.cosine_sums(wide)}[of]
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, 64)  # in few parts, copies lie side by side and are compressed to one
    try:
        sized(monkeypatch, 50)
        few = written(spark, run())
        sized(monkeypatch, 25)
        many = written(spark, run())
    finally:
        spark.conf.set(name, before)
    assert few < 6 * 800 * 64 * 4 and many < 1.5 * few, (few, many)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_blend_over_many_blocks(spark, wide, monkeypatch, most):
    """Edges reach the tiles of their blocks, whether a task holds those of one pair of blocks or of several."""
    motif = some_edges(spark, 20_000)
    want = sim.hybrid_similarity(motif, sim.cosine_similarity(wide), 0.4)
    sized(monkeypatch, 48)
    monkeypatch.setattr(sim, "TILE", 20)
    monkeypatch.setattr(sim, "EDGES", most)
    got = sim.blended_similarity(motif, wide, 0.4)
    both = got.join(want.withColumnRenamed("s", "t"), ["i", "j"], "full")
    assert both.count() == want.count() == got.count() and both.where("not s <=> t").count() == 0


def test_equal_ids_over_blocks(spark, monkeypatch):
    """Rows that share an id make no pair with each other, also where they fill more than a block; all others do."""
    sized(monkeypatch, 16)
    monkeypatch.setattr(sim, "TILE", 10)
    ids = sorted([k // 3 for k in range(150)] + [20] * 100)
    x = np.random.default_rng(10).normal(size=(len(ids), 4))
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "seq_idx long, embedding array<double>")
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    s = np.clip(unit @ unit.T, 0, 1).astype(np.float32)
    want = sorted((ids[a], ids[b], float(s[a, b])) for a in range(len(ids)) for b in range(len(ids)) if ids[a] < ids[b])
    got = sorted(map(tuple, sim.cosine_similarity(vectors).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.abs(np.array(got)[:, 2] - np.array(want)[:, 2]).max() < 1e-6


def test_sums_over_many_blocks(spark, wide, monkeypatch):
    """Summed over the parts, each vector has the same sums by label, its own similarity to itself left out."""
    want = {(r["a"], r["predicted"]): r["s"] for r in sim.cosine_sums(wide).groupBy("a", "predicted").agg(F.sum("s").alias("s")).collect()}
    sized(monkeypatch, 48)
    parts = sim.cosine_sums(wide)
    got = {(r["a"], r["predicted"]): r["s"] for r in parts.groupBy("a", "predicted").agg(F.sum("s").alias("s")).collect()}
    assert got.keys() == want.keys() and len(got) == 2_400 and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert parts.count() <= sim.PARTS * 2_400
