"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints of 64 bits link at `radius` or fewer differing bits. Equal
fingerprints first collapse to one row each. Cut into radius + 1 bit blocks (or
more, for many fingerprints), two fingerprints in reach agree on some whole
block, so every fingerprint is dealt once per block by that block's value. In
each task the fingerprints of equal blocks are sorted by Gray rank and stacked
into an index: a node holds the bits that all below it share; bits shared with
the parent count there and not again. Pairs of nodes descend together, adding up the
differing bits; a pair of groups falls as a whole once the sum is past the
radius, or once all below both are in one class already. Only a spanning star
per class leaves a task, never all pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut, node_id, place_of, placed, renamed, shown_id, table, text_of
from kinweave.llm.components import connected_components, roots, settle, unite

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
FAN = 8
CHUNK = 1 << 17
#: Levels of the index up to which nodes are asked whether they are one class already.
ASKED = 2
#: Codes that should share a mask's bits, and codes of one such group that meet in one task.
SHARING, TILE = 512, 65_536
#: Tables up to this many rows are broadcast; larger ones are joined by shuffling.
SMALL = 200_000
#: Fingerprints that more than one in HOT documents have are broadcast: fewer than HOT, whatever the corpus.
HOT = 1_000
BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str, n: int = 4) -> int:
    """Majority bits over the XXH64 of the word n-grams, repeats included.

    A-Z are lower-cased, words end at ASCII white space, fewer than n words
    form one shingle, none give zero.
    """
    from xxhash import xxh64_intdigest as h

    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return h(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    ones, total = np.zeros(64, np.int64), len(words) - n + 1
    for at in range(0, total, CHUNK):
        to = min(total, at + CHUNK)
        s, e = start[at:to].tolist(), end[at + n - 1 : to + n - 1].tolist()
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(s, e, strict=True)], np.uint64)
        digests = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * byte : 8 * byte + 8] += np.bincount(digests[:, byte], minlength=256) @ BITS
    return sum(1 << b for b in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp long: the 64 bits as a signed number). Null text: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), n) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(node_id("doc_id").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence: the prefix parity of its bits."""
    out = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """The index over codes that are sorted by (group, Gray rank); nodes never cross a group."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        n = len(codes)
        self.codes = codes
        every, any_ = codes, codes
        first, group = np.arange(n), groups
        self.first, self.size, self.leaf = [first], [np.zeros(n, np.int64)], [np.arange(n + 1)]
        self.mask, self.value = [np.full(n, ~np.uint64(0))], [codes]
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(new, np.diff(np.r_[new, len(group)]))
            at = np.flatnonzero(place % FAN == 0)
            every, any_ = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(any_, at)
            mask = ~(every ^ any_)
            self.first.append(at)
            self.size.append(np.diff(np.r_[at, len(group)]))
            self.mask.append(mask)
            self.value.append(every & mask)
            self.leaf.append(np.r_[self.leaf[-1][at], n])
            group = group[at]

    def link(self, radius: int, parents: np.ndarray) -> None:
        """Unite in parents all codes of a group in reach of each other, directly or by others."""
        top = len(self.first) - 1
        for at in range(0, len(self.first[top]), CHUNK):
            x = np.arange(at, min(len(self.first[top]), at + CHUNK))
            self._descend(top, x, x, np.zeros(len(x), np.int64), np.zeros(len(x), np.uint64), radius, parents)

    def _descend(
        self,
        level: int,
        x: np.ndarray,
        y: np.ndarray,
        far: np.ndarray,
        seen: np.ndarray,
        radius: int,
        parents: np.ndarray,
    ) -> None:
        """far: differing bits so far; seen: the bits they were counted over."""
        both = self.mask[level][x] & self.mask[level][y]
        far = far + np.bitwise_count((self.value[level][x] ^ self.value[level][y]) & both & ~seen)
        keep = far <= radius
        if level == 0:
            keep &= x != y
            unite(parents, x[keep], y[keep])
            return
        x, y, far, both = x[keep], y[keep], far[keep], both[keep]
        keep = self._open(level, x, y, parents)
        x, y, far, both = x[keep], y[keep], far[keep], both[keep]
        step = max(1, CHUNK // (FAN * FAN))
        for at in range(0, len(x), step):
            s = slice(at, at + step)
            a, b = x[s], y[s]
            if at:  # what the chunks before have joined
                keep = self._open(level, a, b, parents)
                if not keep.any():
                    continue
            pairs = self.size[level][a] * self.size[level][b]
            k = np.repeat(np.arange(len(a)), pairs)
            within = np.arange(len(k)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            wide = self.size[level][b][k]
            cx, cy = self.first[level][a][k] + within // wide, self.first[level][b][k] + within % wide
            keep = cx <= cy
            self._descend(level - 1, cx[keep], cy[keep], far[s][k][keep], both[s][k][keep], radius, parents)

    def _open(self, level: int, x: np.ndarray, y: np.ndarray, parents: np.ndarray) -> np.ndarray:
        """Whether the nodes' codes are not yet all in one class; asked of small nodes only, and of these nodes' codes."""
        if level > ASKED:
            return np.ones(len(x), bool)
        out = np.ones(len(x), bool)
        first = self.leaf[level]
        ask = np.flatnonzero(roots(parents, first[x]) == roots(parents, first[y]))
        if not len(ask):
            return out
        nodes, at = np.unique(np.r_[x[ask], y[ask]], return_inverse=True)
        size = first[nodes + 1] - first[nodes]
        start = np.cumsum(size) - size
        codes = np.repeat(first[nodes] - start, size) + np.arange(size.sum())
        top = roots(parents, codes)
        one = np.minimum.reduceat(top, start) == np.maximum.reduceat(top, start)
        out[ask] = ~(one[at[: len(ask)]] & one[at[len(ask) :]])
        return out


def blocks(radius: int, n: int = 0) -> list[int]:
    """Bit masks such that codes within radius agree on one of them, for n distinct codes.

    64 bits are cut into m blocks; codes within radius agree on m - radius of
    them, whichever these are. As n grows, m does, so that a mask's bits keep
    the codes that share them few.
    """
    m = radius + 1
    while m < radius + 8 and n / 2 ** (64 * (m - radius) / m) > SHARING:
        m += 1
    edge = [64 * i // m for i in range(m + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(c) for c in itertools.combinations(own, m - radius)]


def star_links(codes: np.ndarray, groups: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of a spanning star of each class within each group of codes that agree on the mask."""
    order = np.lexsort((gray_rank(codes & ~np.uint64(mask)), groups))
    parents = np.arange(len(codes))
    GrayIndex(codes[order], groups[order]).link(radius, parents)
    top = settle(parents)
    i = np.flatnonzero(top != np.arange(len(codes)))
    return order[i], order[top[i]]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """distinct (fp, rep) -> (a, b): links between reps that span each class of fingerprints.

    Codes that share a mask's bits meet in one task; more than `tile` of them
    are dealt out as pairs of parts.
    """
    n = distinct.count()
    masks = blocks(radius, n)
    key = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])
    keyed = distinct.select("fp", "rep", F.posexplode(key).alias("mask", "key"))
    if n > tile:
        parts = F.ceil(F.col("count") / tile).cast("int")
        large = keyed.groupBy("mask", "key").count().where(F.col("count") > tile).select("mask", "key", parts.alias("parts"))
        large = cut(large, "largekeys")  # no more than len(masks) * n / tile rows
        joined = keyed.join(F.broadcast(large) if large.count() <= SMALL else large, ["mask", "key"], "left")
        parts = F.coalesce("parts", F.lit(1))
        mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
        pair = lambda t: F.struct(F.least(t, mine).alias("p"), F.greatest(t, mine).alias("q"))
        keyed = joined.select("fp", "rep", "mask", "key", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), pair)).alias("t"))
        keyed = keyed.select("fp", "rep", "mask", "key", "t.p", "t.q")
    else:
        keyed = keyed.withColumn("p", F.lit(0)).withColumn("q", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        codes, reps, mask, key, p, q = (got.column(c).to_numpy() for c in ("fp", "rep", "mask", "key", "p", "q"))
        for b, m in enumerate(masks):
            own = np.flatnonzero(mask == b)
            if len(own):
                order = own[np.lexsort((q[own], p[own], key[own]))]
                same = np.r_[True, (np.diff(key[order]) != 0) | (np.diff(p[order]) != 0) | (np.diff(q[order]) != 0)]
                i, j = star_links(codes[order].view(np.uint64), np.cumsum(same), m, radius)
                yield pa.RecordBatch.from_arrays([pa.array(reps[order][i]), pa.array(reps[order][j])], names=["a", "b"])

    return keyed.repartition("mask", "key", "p", "q").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, n: int = 4, radius: int = 4) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp, component_id), a row for each row of docs.

    Null texts count as empty; texts without words have fingerprint zero and
    link like others; a null doc_id takes part and is shown as null (it is the
    smallest of its class). Rows that repeat give rows that repeat. No other
    column is read. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, n), "simhash")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simprints")
    classes = connected_components(fingerprint_links(distinct.select("fp", "rep"), radius))
    named = distinct.join(classes, distinct["rep"] == classes["node"], "left")
    named = cut(named.select("fp", "n", F.coalesce("component", "rep").alias("component_id")), "simclasses")
    # fingerprints of many documents, HOT at most as each has its share of all rows, go to the rows; the others meet them
    least = fps.count() // HOT
    often = F.broadcast(named.where(F.col("n") > least).select("fp", F.col("component_id").alias("often")))
    marked = fps.join(often, "fp", "left")
    hot = marked.where("often is not null").select("doc_id", "fp", F.col("often").alias("component_id"))
    rest = marked.where("often is null").select("doc_id", "fp")
    rest = rest.join(named.where(F.col("n") <= least).select("fp", "component_id"), "fp")
    return hot.unionByName(rest.select("doc_id", "fp", "component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 4, radius: int = 4) -> DataFrame:
    """The documents, one row of each near-duplicate class, columns unchanged whatever their names and types.

    Of a class the row of smallest doc_id (null first) stays; of rows that
    share it, the smallest text, then the smallest row as JSON. Null and empty
    texts form one class. An empty table gives no rows.
    """
    rows = placed(docs)
    doc_id, text = place_of(docs, "doc_id"), place_of(docs, "text")
    groups = near_groups(rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), n, radius)
    heads = cut(groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count(), "simheads")
    heads = heads.withColumnRenamed("doc_id", "node")
    marked = rows.withColumn("node", node_id(doc_id))
    single = marked.join(heads.where("count = 1"), "node", "left_semi")
    several = marked.join(heads.where("count > 1"), "node", "left_semi")
    row = F.struct(*rows.columns)
    first = several.groupBy("node").agg(F.min_by(row, F.struct(text_of(text), F.to_json(row))).alias("r"))
    return renamed(single.select(*rows.columns).unionAll(first.select(*[F.col(f"r.{c}") for c in rows.columns])), docs)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        shown_id("doc_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        shown_id("component_id").alias("component_id"),
    )
