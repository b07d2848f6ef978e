"""SpotSigs fingerprints of documents, and of their edited texts.

A signature is a common word (the anchor) with the next `CHAIN` content words
after it; the set of a text's signatures is its fingerprint, written as sorted
hexadecimal hashes. Likeness is the Jaccard index of two sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut, cut_at, node_id, removed, shown_id, table, text_of
from kinweave.llm.components import connected_components

CHAIN = 3
#: Signatures are counted by ranges; those of ranges over the HEAVY-th part of all come last in the order of meeting.
BUCKETS, HEAVY = 1 << 20, 1 << 16
#: Each set is first compared with one that shares so many least signatures with it, under hashes of their own; pairs to one copy of a set.
BANDS, SALT = (2, 2, 4, 4, 8, 8), 2_000
ANCHORS = frozenset(
    w.encode()
    for w in (
        "the of and to in is was that it with "
        "le la les des et est une que dans pour "
        "der die das und ist ein eine den zu von "
        "el los las que una es con por se para"
    ).split()
)


def signatures(text: str, chain: int = CHAIN) -> frozenset[int]:
    """32-bit hashes of anchor chains, case ignored for A-Z.

    Without any anchor that has enough content words after it, every word
    anchors a chain of the words after it; fewer words form one signature; a
    text without words has its own hash.
    """
    from xxhash import xxh32_intdigest as h

    words = text.encode().lower().split()
    content = [w for w in words if w not in ANCHORS]
    out, at, n = set(), 0, len(content) - chain
    for w in words:
        if w in ANCHORS:
            if at > n:
                break
            out.add(h(b" ".join((w, *content[at : at + chain]))))
        else:
            at += 1
    if not out and words:
        out = {h(b" ".join(words[i : i + chain + 1])) for i in range(max(1, len(words) - chain))}
    return frozenset(out or (h(text.encode()),))


def fingerprint(sigs: frozenset[int]) -> str:
    return "".join(f"{s:08x}" for s in sorted(sigs))


def likeness(a: frozenset[int], b: frozenset[int], least: float = 0.0) -> float:
    """Jaccard index; 0 as soon as it must be below `least`, for which the set sizes often suffice."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return 0.0
    both = len(a & b)
    j = both / (small + large - both)
    return j if j >= least else 0.0


def edited(text: str, other: str) -> str:
    """The last half of the text, rounded down, gives way to as much of the other's beginning."""
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


def _beside(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, donor, doc_id, text): every bucket holds a range of ids and, as donor, the row that follows it.

    One shuffle of the texts. The driver sees one id a bucket.
    """
    rows = docs.select(node_id("doc_id").alias("doc_id"), text_of().alias("text"))
    edges = sorted(set(rows.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets)))
    if edges:  # a binary search a row; ids that are one as doubles share a bucket, so buckets keep the order of ids
        split = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="at", outputCol="bucket")
        rows = split.transform(rows.withColumn("at", F.col("doc_id").cast("double"))).drop("at")
    rows = rows.withColumn("bucket", F.col("bucket").cast("int") if edges else F.lit(0))
    tops = [tuple(r) for r in rows.groupBy("bucket").agg(F.max("doc_id")).orderBy(F.desc("bucket")).collect()]
    goes = [(tops[i - 1][0], tops[i][1]) for i in range(len(tops))]
    if not goes:
        return rows.withColumn("donor", F.lit(0)).select("bucket", "donor", "doc_id", "text")
    after = docs.sparkSession.createDataFrame(goes, "bucket int, doc_id long")
    donors = rows.drop("bucket").join(F.broadcast(after), "doc_id").withColumn("donor", F.lit(1))  # one row a bucket
    return rows.withColumn("donor", F.lit(0)).unionByName(donors).select("bucket", "donor", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """docs (doc_id, text) -> fingerprints of each text and its edited text, and how like they and the next text are.

    Next goes by falling doc_id, then text, and from the last row to the first;
    a single row is its own next. Null texts count as empty, a null doc_id comes
    last and is shown as null, repeated rows follow each other. An empty table
    gives no rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, own = None, None
        for batch in batches:
            out = []
            for bucket, donor, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "donor", "doc_id", "text")), strict=True):
                if donor and (open_ is None or open_[0] != bucket):
                    continue
                sigs = signatures(text, chain)
                if open_ is not None:
                    changed = edited(open_[2], text)
                    new, digest = signatures(changed, chain), hashlib.sha256(changed.encode()).hexdigest()
                    shown = (fingerprint(own), fingerprint(new), likeness(own, new), likeness(own, sigs))
                    out.append((open_[1], len(open_[2]), digest, *shown))
                open_, own = (None, None) if donor else ((bucket, doc, text), sigs)
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _beside(docs, 4 * n)
    sorted_ = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "donor", F.desc("doc_id"), "text")
    return sorted_.mapInArrow(run, SCHEMA).withColumn("doc_id", shown_id("doc_id"))


def _sets(docs: DataFrame, chain: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, sigs, mark): sorted signatures, four bytes each, and their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.sort(np.fromiter(signatures(t.as_py(), chain), "<u4")).tobytes() for t in batch.column("text")]
            marks = [hashlib.sha256(x).digest() for x in sigs]
            columns = [batch.column("doc_id"), pa.array(sigs, pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sigs", "mark"])

    rows = docs.select(node_id("doc_id").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, sigs binary, mark binary")


def _commonness(sets: DataFrame) -> np.ndarray:
    """How often signatures of each of BUCKETS ranges occur, where that is over the HEAVY-th part of all; else 0.

    Counts cover all sets. The driver sees at most HEAVY rows, as no more ranges can hold so large a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column("sigs"):
                np.add.at(counts, np.frombuffer(x.as_py(), "<u4") // (2**32 // BUCKETS), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["range", "n"])

    counts = cut(sets.select("sigs").mapInArrow(run, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")), "spotcounts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.where(F.col("n") > total / HEAVY).collect():
        out[r["range"]] = r["n"]
    return out


def _spots(sets: DataFrame, classes: DataFrame, common: np.ndarray, least: float) -> DataFrame:
    """(id, class, n, sig, pos): of each set, in one order for all, rare signatures first, as many as a set in reach must share one of.

    Sets that classes (id, class) lacks are classes of their own.
    """
    common = sets.sparkSession.sparkContext.broadcast(common)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, sizes, sigs, places = [], [], [], [], []
            for i, kind, x in zip(*(batch.column(c).to_pylist() for c in ("id", "class", "sigs")), strict=True):
                own = np.frombuffer(x, "<u4")
                n = len(own)
                first = np.argsort(common.value[own // (2**32 // BUCKETS)], kind="stable")[: n - math.ceil(n * least - 1e-9) + 1]
                ids.append(np.full(len(first), i))
                kinds.append(np.full(len(first), kind))
                sizes.append(np.full(len(first), n))
                sigs.append(own[first].astype(np.int64))
                places.append(np.arange(len(first)))
            if ids:
                columns = [pa.array(np.concatenate(c), pa.int64()) for c in (ids, kinds, sizes, sigs, places)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "n", "sig", "pos"])

    classed = sets.select("id", "sigs").join(classes, "id", "left")  # sets travel before they are taken apart
    classed = classed.select("id", F.coalesce("class", "id").alias("class"), "sigs")
    return classed.mapInArrow(run, "id long, class long, n long, sig long, pos long")


def _leaders(sets: DataFrame, least: float) -> DataFrame:
    """(a, b): each set beside the first set of its partition of lengths that has the same least signatures under the hashes of one of BANDS."""
    starts = np.cumsum([0, *BANDS[:-1]])
    tags = np.arange(len(BANDS), dtype=np.uint64)
    rate = math.log(1 / least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = np.random.default_rng(5).integers(0, 2**31, sum(BANDS), np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            keys = []
            for x in batch.column("sigs"):
                own = np.frombuffer(x.as_py(), "<u4").astype(np.uint64)
                low = ((own[None, :] * turns[:, None]) & np.uint64(2**32 - 1)).min(1)
                part = np.uint64(math.log(len(own)) / rate + 1e-9) * turns[-1]
                mixed = (np.add.reduceat((low + np.uint64(1)) * turns, starts) + part) * np.uint64(len(BANDS)) + tags
                keys.append(mixed.view(np.int64))
            if keys:
                ids = np.repeat(batch.column("id").to_numpy(), len(BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(keys))], names=["a", "key"])

    keys = cut(sets.select("id", "sigs").mapInArrow(run, "a long, key long"), "spotstars")
    first = keys.groupBy("key").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(first, "key").where("a != b").select("a", "b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose sets have a Jaccard index of `least` or more.

    The set of an id that many pairs name is dealt out in copies, one to SALT pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                jaccard(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4"), least) >= least - 1e-12
                for x, y in zip(batch.column("sigs_a"), batch.column("sigs_b"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], names=["a", "b"])

    out = cut(pairs, "spotpairs")
    for side, other in (("a", "b"), ("b", "a")):
        often = out.groupBy(side).agg(F.ceil(F.count("*") / SALT).alias("copies"))
        dealt = sets.select(F.col("id").alias(side), F.col("sigs").alias(f"sigs_{side}")).join(often, side)
        dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        out = out.join(often, side).withColumn("salt", F.pmod(F.xxhash64(other), F.col("copies"))).drop("copies")
        out = out.join(dealt, [side, "salt"]).drop("salt")
    return out.select("a", "b", "sigs_a", "sigs_b").mapInArrow(run, "a long, b long")


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """As `likeness`, of sorted arrays."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _in_reach(spots: DataFrame, least: float, once: bool = False) -> DataFrame:
    """spots (id, n, sig, pos, class) -> (a, b): sets of different classes that can reach `least`, by length and by place of a shared signature.

    Sets are partitioned by length, so that those in reach are in the same
    partition or the next. Classes meet before their members do: a signature
    that one class alone has, however large, brings nothing, and members of one
    class are never paired. With `once`, of a set's pairs with another class one
    is given, of nearest lengths.
    """
    mixed = spots.groupBy("sig").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("sig")
    part = F.floor(F.log("n") / math.log(1 / least) + 1e-9)
    spots = cut(spots.join(mixed, "sig", "left_semi").withColumn("part", part), "spots")
    longer = spots.toDF(*(c if c in ("sig", "part") else f"{c}_a" for c in spots.columns))
    shorter = spots.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    shorter = shorter.toDF(*(c if c in ("sig", "part") else f"{c}_b" for c in spots.columns))
    held = [
        x.groupBy("sig", "part", f"class_{s}").agg(F.min(f"n_{s}").alias(f"low_{s}"), F.max(f"n_{s}").alias(f"high_{s}"))
        for x, s in ((longer, "a"), (shorter, "b"))
    ]
    meets = held[0].join(held[1], ["sig", "part"]).where("class_a != class_b and low_b <= high_a")
    meets = meets.where(F.col("high_b") >= F.col("low_a") * least - 1e-9).select("sig", "part", "class_a", "class_b")
    both = meets.join(longer, ["sig", "part", "class_a"]).join(shorter, ["sig", "part", "class_b"])
    both = both.where("n_b < n_a or (n_b = n_a and id_b < id_a)").where(F.col("n_b") >= F.col("n_a") * least - 1e-9)
    most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    both = both.where(most >= (F.col("n_a") + F.col("n_b")) * (least / (1 + least)) - 1e-9)
    if once:
        nearest = F.min(F.struct(F.col("n_a") - F.col("n_b"), F.col("id_b")))["id_b"]
        both = both.groupBy("id_a", "class_b").agg(nearest.alias("id_b"))
    return both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _classes(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("class"))


def near_groups(docs: DataFrame, least: float = 0.8, chain: int = CHAIN) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, component_id): classes of documents linked by a likeness of `least` or more.

    Equal sets collapse first. Then each set is compared with the first one of
    its least signatures under a few hashes, which joins most of a large group at
    one comparison a set. Then sets of different classes are partitioned by
    length, meet by the rarest of their signatures, as many as a set in reach
    must share one of, and are compared through pruned Jaccard: first each with
    one of another class, then, between the classes that are left, each with
    all, so that no link is lost.
    Ids travel, and sets only to pairs that length and places leave.
    Null texts count as empty, and empty texts are one class (texts of blanks
    alone are by their own hash); a null doc_id is shown as null (it is the
    smallest of its class), rows that repeat give rows that repeat, rows that
    share an id share its class. No other column is read; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    whole, path = cut_at(_sets(docs, chain), "spotrows")
    one = whole.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.first("sigs").alias("sigs"))
    sets = cut(one.withColumn("id", F.monotonically_increasing_id()), "spotsets")
    rows = cut(whole.select("doc_id", "mark"), "spotmarks")
    removed(spark, path)
    common = _commonness(sets)
    links = cut(_linked(_leaders(sets, least), sets, least), "spotlinks")
    for once in (True, False):
        spots = _spots(sets, _classes(links), common, least)
        links = cut(links.unionAll(_linked(_in_reach(spots, least, once), sets, least)), "spotlinks")
    for side in "ab":
        named = sets.select(F.col("id").alias(side), F.col("rep").alias(f"rep_{side}"))
        links = links.join(named, side)
    links = links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    copies = rows.select("doc_id", "mark").join(sets.select("mark", "rep"), "mark").where("doc_id != rep")
    ends = connected_components(links.unionAll(copies.select("doc_id", "rep")))
    out = rows.select("doc_id").join(ends, F.col("doc_id") == F.col("node"), "left")
    return out.select(shown_id("doc_id").alias("doc_id"), shown_id(F.coalesce("component", "doc_id")).alias("component_id"))


def op9_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
