"""Embedding near-duplicates by a subspace pigeonhole join.

cos(u, v) >= c means |u - v|^2 <= 2 - 2c for unit vectors. After a random
rotation the vectors are cut into low-dimensional blocks; two vectors in reach
differ in some block by no more than that block's share of the budget, which is
its share of the dimensions.

The join is pruned at three levels. Vectors are dealt to tiles, the leaves of a
k-d tree over all rotated coordinates; only tiles whose bounding boxes come
within the budget of some block, and within the whole budget, meet in a task. In
a task each block is range-joined: both sides are sorted into the leaves of a
k-d tree over the block's coordinates, and only leaves whose boxes are in reach
have their vectors compared there. Pairs within a block's budget are candidates;
the union over blocks is verified at full dimension in double precision, each
pair in the first block that finds it.

A tile of more than `tile` rows is dealt out in parts, so that no task's work
grows with a dense region. Only link counts and a spanning star of each task's
links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut, node_id, shown_id, table
from kinweave.llm.components import connected_components, settle, unite

COSINE = 0.95
BLOCK = 4
TILE = 32_768
#: Rows of a leaf within a task, and pairs that are verified at a time.
LEAF, CHUNK = 16, 1 << 16
#: Neighbouring leaves that are compared together, and how many of their partners at a time.
GROUP, PARTNERS = 4, 256
#: Coordinates over which a candidate must keep within the whole budget before it is verified.
FIRST = 16
#: Vectors that tiles are fitted on, and tiles at most; they decide who meets where, never the result.
SAMPLE, TILES = 16_384, 1_024
SLACK = 1e-9
TASKS = 8_192


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_601 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def block_edges(d: int, width: int) -> list[int]:
    n = max(1, round(d / width))
    return [d * i // n for i in range(n + 1)]


def budget_of(cosine: float) -> float:
    """Squared distance of unit vectors in reach, with room for rounding."""
    return max(0.0, 2 - 2 * cosine) * (1 + SLACK) + 1e-9


def unit_rows(batch: pa.RecordBatch, d: int, own: np.ndarray | None = None) -> np.ndarray:
    """The embeddings of rows that are d long, as unit vectors in double precision."""
    x = batch.column("embedding")
    flat = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = x.offsets.to_numpy()[:-1]
    rows = flat[(at if own is None else at[own])[:, None] + np.arange(d)]
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit_tiles(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of a k-d tree: for each node of a level, the coordinate it splits and where."""
    groups, levels = [np.arange(len(points))], []
    for _ in range(depth):
        axis, at, below = [], [], []
        for g in groups:
            k = int(np.argmax(points[g].var(axis=0))) if len(g) else 0
            value = float(np.median(points[g, k])) if len(g) else 0.0
            right = points[g, k] > value
            axis.append(k)
            at.append(value)
            below += [g[~right], g[right]]
        levels.append((np.array(axis), np.array(at)))
        groups = below
    return levels


def tile_of(points: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for axis, at in levels:
        node = 2 * node + (points[np.arange(len(points)), axis[node]] > at[node])
    return node


def box_gaps(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Squared gaps by coordinate between one box and each of some others."""
    return np.maximum(0.0, np.maximum(other_lo - hi, lo - other_hi)) ** 2


def tiles_in_reach(lo: np.ndarray, hi: np.ndarray, edge: list[int], budget: float) -> list[np.ndarray]:
    """For each tile the tiles of no smaller number that it has to meet."""
    share = budget * np.diff(edge) / edge[-1]
    out = []
    for p in range(len(lo)):
        gap = box_gaps(lo[p], hi[p], lo[p:], hi[p:])
        by_block = np.add.reduceat(gap, edge[:-1], axis=1)
        out.append(p + np.flatnonzero((by_block <= share).any(axis=1) & (gap.sum(axis=1) <= budget)))
    return out


class Leaves:
    """The rows of some points sorted into the leaves of a k-d tree, with the leaves' bounding boxes."""

    def __init__(self, points: np.ndarray, most: int):
        ready, open_ = [], [np.arange(len(points))]
        while open_:
            own = open_.pop()
            if len(own) <= most:
                ready.append(own)
                continue
            part = points[own]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = np.argpartition(part[:, axis], len(own) // 2)
            open_ += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        self.rows = np.concatenate(ready)
        self.size = np.array([len(x) for x in ready])
        start = np.cumsum(self.size) - self.size
        self.start = start
        self.lo = np.minimum.reduceat(points[self.rows], start, axis=0)
        self.hi = np.maximum.reduceat(points[self.rows], start, axis=0)


class PairFinder:
    """Finds the linked pairs between two sets of rows of one task, each once."""

    def __init__(self, x: np.ndarray, cosine: float, width: int, leaf: int = LEAF):
        self.x, self.cosine, self.leaf = x, cosine, leaf
        self.r = x @ rotation(x.shape[1])
        self.edge = block_edges(x.shape[1], width)
        self.share = budget_of(cosine) * np.diff(self.edge) / self.edge[-1]
        self.total, self.compared = budget_of(cosine), 0

    def _within(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        far = np.zeros(len(i))
        for c in range(self.edge[k], self.edge[k + 1]):
            far += (self.r[i, c] - self.r[j, c]) ** 2
        return far <= self.share[k]

    def _verified(self, b: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates of block b that no earlier block finds and that are linked."""
        keep = self._within(b, i, j)
        i, j = i[keep], j[keep]
        for k in range(b):
            keep = ~self._within(k, i, j)
            i, j = i[keep], j[keep]
        keep = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= self.cosine
        return i[keep], j[keep]

    def pairs(self, left: np.ndarray, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs between the rows left and right, or among left, in pieces of bounded size."""
        if not len(left) or (right is not None and not len(right)):
            return
        for b in range(len(self.edge) - 1):
            cut_ = slice(self.edge[b], self.edge[b + 1])
            first = Leaves(self.r[left, cut_], self.leaf)
            second = first if right is None else Leaves(self.r[right, cut_], self.leaf)
            rows, others = left[first.rows], (left if right is None else right)[second.rows]
            near, near_other = self._factors(rows, cut_)[0], self._factors(others, cut_)[1]
            wide, wide_other = self._factors(rows, slice(0, FIRST))[0], self._factors(others, slice(0, FIRST))[1]
            for u, v in self._meetings(first, second, self.share[b], right is None):
                own, at = self._span(first, u), self._span(second, v)
                self.compared += len(own) * len(at)
                hit = near[own] @ near_other[at].T <= np.float32(self.share[b] + 1e-5)
                if not hit.any():
                    continue
                hit &= wide[own] @ wide_other[at].T <= np.float32(self.total + 1e-5)
                i, j = np.divmod(np.flatnonzero(hit), len(at))
                i, j = own[i], at[j]
                if right is None:
                    keep = i < j
                    i, j = i[keep], j[keep]
                i, j = rows[i], others[j]
                for s in range(0, len(i), CHUNK):
                    yield self._verified(b, i[s : s + CHUNK], j[s : s + CHUNK])

    def _factors(self, rows: np.ndarray, columns: slice) -> tuple[np.ndarray, np.ndarray]:
        """Factors whose product is the squared distance over some columns, in single precision to about 1e-6."""
        y = self.r[rows, columns]
        square, one = (y**2).sum(1, keepdims=True), np.ones((len(y), 1))
        return np.hstack([y, square, one]).astype(np.float32), np.hstack([-2 * y, one, square]).astype(np.float32)

    @staticmethod
    def _span(leaves: Leaves, which: np.ndarray) -> np.ndarray:
        size = leaves.size[which]
        return np.repeat(leaves.start[which] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())

    @staticmethod
    def _meetings(
        first: Leaves, second: Leaves, share: float, alone: bool
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of GROUP neighbouring leaves and the leaves whose boxes any of them can reach, PARTNERS at a time."""
        n = len(first.size)
        for g in range(0, n, GROUP):
            u = np.arange(g, min(n, g + GROUP))
            lo, hi = first.lo[u].min(axis=0), first.hi[u].max(axis=0)
            v = np.flatnonzero(box_gaps(lo, hi, second.lo, second.hi).sum(axis=1) <= share)
            v = v[v >= g] if alone else v
            meets = np.zeros(len(v), bool)
            for k in u:
                meets |= box_gaps(first.lo[k], first.hi[k], second.lo[v], second.hi[v]).sum(axis=1) <= share
            v = v[meets]
            for at in range(0, len(v), PARTNERS):
                yield u, v[at : at + PARTNERS]


PLACES = "key long, n long, embedding array<float>, d int, tile int"


def _tiled(vectors: DataFrame, levels: dict[int, list]) -> DataFrame:
    """Adds the tile of each vector; lengths without levels have one."""
    shared = vectors.sparkSession.sparkContext.broadcast(levels)  # TILES splits a length at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d_of = batch.column("d").to_numpy()
            tile = np.zeros(len(d_of), np.int32)
            for d in np.unique(d_of).tolist():
                if d in shared.value:
                    own = np.flatnonzero(d_of == d)
                    tile[own] = tile_of(unit_rows(batch, d, own) @ rotation(d), shared.value[d])
            columns = [batch.column(c) for c in ("key", "n", "embedding", "d")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tile)], names=["key", "n", "embedding", "d", "tile"])

    return vectors.mapInArrow(run, PLACES)


def _boxes(placed: DataFrame) -> DataFrame:
    """(d, tile, k, lo, hi): bounding boxes of tiles by rotated coordinate, each batch aggregated before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d_of, tile_ = batch.column("d").to_numpy(), batch.column("tile").to_numpy()
            for d in np.unique(d_of).tolist():
                own = np.flatnonzero(d_of == d)
                own = own[np.argsort(tile_[own], kind="stable")]
                y, t = unit_rows(batch, d, own) @ rotation(d), tile_[own]
                new = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                lo, hi = np.minimum.reduceat(y, new, axis=0), np.maximum.reduceat(y, new, axis=0)
                m = len(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m * d, d, np.int32)),
                        pa.array(np.repeat(t[new].astype(np.int32), d)),
                        pa.array(np.tile(np.arange(d, dtype=np.int32), m)),
                        pa.array(lo.ravel()),
                        pa.array(hi.ravel()),
                    ],
                    names=["d", "tile", "k", "lo", "hi"],
                )

    rows = placed.mapInArrow(run, "d int, tile int, k int, lo double, hi double")
    return rows.groupBy("d", "tile", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def tiled(vectors: DataFrame, cosine: float, width: int, tile: int) -> tuple[DataFrame, DataFrame, int]:
    """Vectors (key, n, embedding, d) -> (the same with their tile, (d, tile, parts, meets), number of tasks).

    The driver sees TILES tiles a length at most, and lengths of more than
    `tile` rows only; rows of other lengths share one tile a length.
    """
    sizes = {r["d"]: r["count"] for r in vectors.groupBy("d").count().where(F.col("count") > tile).collect()}
    levels = {}
    for d, count in sizes.items():
        depth = min((TILES - 1).bit_length(), int(np.ceil(np.log2(count / tile))))
        some = vectors.where(F.col("d") == d).orderBy(F.xxhash64("key")).limit(SAMPLE).select("embedding").toArrow()
        levels[d] = fit_tiles(unit_rows(some.combine_chunks().to_batches()[0], d) @ rotation(d), depth)
    placed = cut(_tiled(vectors, levels), "places") if levels else vectors.withColumn("tile", F.lit(0))
    counts = placed.groupBy("d", "tile").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    small = counts if not sizes else counts.where(~F.col("d").isin(list(sizes)))
    meets = small.select("d", "tile", "parts", F.array(F.struct(F.col("tile").alias("q"), "parts")).alias("meets"))
    tasks = 0
    rows = []
    for d in sizes:
        parts = {r["tile"]: r["parts"] for r in counts.where(F.col("d") == d).collect()}
        known = sorted(parts)
        place = {t: k for k, t in enumerate(known)}
        lo, hi = np.zeros((len(known), d)), np.zeros((len(known), d))
        for r in _boxes(placed.where(F.col("d") == d)).collect():
            lo[place[r["tile"]], r["k"]], hi[place[r["tile"]], r["k"]] = r["lo"], r["hi"]
        partners: dict[int, set[int]] = {t: set() for t in known}
        for p, near in enumerate(tiles_in_reach(lo, hi, block_edges(d, width), budget_of(cosine))):
            for q in near.tolist():
                partners[known[p]].add(known[q])
                partners[known[q]].add(known[p])
                a, b = parts[known[p]], parts[known[q]]
                tasks += a * b if p != q else a * (a + 1) // 2
        rows += [(d, t, parts[t], [(q, parts[q]) for q in sorted(partners[t])]) for t in known]
    if rows:
        schema = "d int, tile int, parts int, meets array<struct<q:int,parts:int>>"
        meets = meets.unionByName(vectors.sparkSession.createDataFrame(rows, schema))
    return placed, meets, tasks


FOUND = "key long, links long, root long"


def link_counts(
    vectors: DataFrame, cosine: float = COSINE, width: int = BLOCK, tile: int = TILE
) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (key, n, embedding, d) -> (key, linked rows), (a, b) spanning links of keys."""
    placed, meets, tasks = tiled(vectors, cosine, width, tile)
    dealt = placed.join(meets, ["d", "tile"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.select("key", "n", "embedding", "d", "tile", "part", F.explode("meets").alias("m"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m.parts") - 1)))
    own, far = F.struct("tile", "part"), F.struct(F.col("m.q").alias("tile"), F.col("other").alias("part"))
    dealt = dealt.withColumn("first", F.least(own, far)).withColumn("second", F.greatest(own, far))
    dealt = dealt.select("key", "n", "embedding", "d", (own == F.col("first")).alias("home"), "first", "second")

    def solve(t: pa.Table) -> pa.Table:
        batch = t.combine_chunks().to_batches()[0]
        d = batch.column("d")[0].as_py()
        keys, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
        home = batch.column("home").to_numpy(zero_copy_only=False)
        alone = batch.column("first")[0].as_py() == batch.column("second")[0].as_py()
        finder = PairFinder(unit_rows(batch, d), cosine, width)
        counts, parents = np.zeros(len(keys), np.int64), np.arange(len(keys))
        sides = (np.arange(len(keys)), None) if alone else (np.flatnonzero(home), np.flatnonzero(~home))
        for i, j in finder.pairs(*sides):
            np.add.at(counts, i, n[j])
            np.add.at(counts, j, n[i])
            unite(parents, i, j)
        at = np.flatnonzero(counts > 0)
        return pa.table({"key": keys[at], "links": counts[at], "root": keys[settle(parents)[at]]})

    # work goes with the pairs of parts, not with bytes: their number is set, not left to adaptive execution
    n = max(1, min(TASKS, 3 * tasks) if tasks else int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    grouped = dealt.repartition(n, "d", "first", "second").groupBy("d", "first", "second")
    found = cut(grouped.applyInArrow(solve, FOUND), "links")
    links = found.select(F.col("key").alias("a"), F.col("root").alias("b")).where("a <> b")
    return found.groupBy("key").agg(F.sum("links").alias("links")), links


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, width: int = BLOCK, tile: int = TILE
) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row for each row.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing; vectors of different lengths never link. Equal vectors
    count as rows of their own. Rows that share a vec_id are taken as the same
    node of the components. A null vec_id is shown as null and kept apart from
    other ids. No other column is read. An empty table gives no rows.
    """
    embedding = F.col("embedding").cast("array<float>")
    rows = vectors.select(node_id("vec_id").alias("vec_id"), embedding.alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = (
        F.col("embedding").isNotNull()
        & ~F.coalesce(F.exists("embedding", bad), F.lit(True))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    # grouped by a hash as well, so that later joins carry 8 bytes instead of the vector
    rows = rows.withColumn("h", F.when(fine, F.xxhash64("embedding")))
    same = rows.where("h is not null").groupBy("h", "embedding")
    same = same.agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    same = same.withColumn("key", F.monotonically_increasing_id()).withColumn("d", F.size("embedding"))
    same = cut(same, "vectors")
    counts, links = link_counts(same.select("key", "n", "embedding", "d"), cosine, width, tile)
    reps = same.select("key", "rep")
    links = links.join(reps, F.col("a") == F.col("key")).select(F.col("rep").alias("a"), "b")
    links = links.join(reps, F.col("b") == F.col("key")).select("a", F.col("rep").alias("b"))
    named = same.join(counts, "key", "left")
    named = named.select("h", "embedding", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    shared = named.groupBy("h").agg(F.count("*").alias("kinds"), F.first("rep").alias("rep"), F.first("n_links").alias("n_links"))
    # one vector a hash, but for collisions: only those are told apart by their components
    plain = rows.join(shared.where("kinds = 1"), "h").select("vec_id", "rep", "n_links")
    clash = named.join(shared.where("kinds > 1").select("h"), "h", "left_semi")
    apart = rows.join(clash, ["h", "embedding"]).select("vec_id", "rep", "n_links")
    none = rows.where("h is null").select("vec_id", F.col("vec_id").alias("rep"), F.lit(0).cast("long").alias("n_links"))
    out = cut(plain.unionAll(apart).unionAll(none), "linked")
    alike = out.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    classes = connected_components(links.unionAll(alike))
    out = out.join(classes, out["vec_id"] == classes["node"], "left")
    out = out.withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select(
        shown_id("vec_id").alias("vec_id"),
        F.col("n_links").cast("long").alias("n_links"),
        shown_id("component_id").alias("component_id"),
        (F.col("vec_id") == F.col("component_id")).alias("kept"),
    )


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP1_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE FALSE END),
reach AS (
  SELECT a, b FROM near
  UNION
  SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
  vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN links ON links.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
