"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the exponential key -ln(u) / quality, u from a hash of its
id, so that sorting by key is weighted sampling without replacement. A source
whose target passes its size first gives whole epochs; for the rest, documents
are taken in key order until their prefix sum of words fills it.

No source is sorted as a whole. Keys fall into bins; bin sums give the one bin
where a source's budget ends, which is split into finer bins as long as it holds
too many rows. Only the last is sorted, and its cut key then decides for every
row by a lookup of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import cut, node_id, place_of, placed, renamed, table, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BINS = 1024
#: Bins are split again while the one where a source's budget ends holds more rows; only that one is sorted.
SORTED = 100
#: Bins are equal steps of the key's logarithm between these; keys below 1e-17 or above 20,000 cannot be drawn.
LOWEST, HIGHEST = -40.0, 10.0
DEEPEST = 5
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffling.
SMALL = 50_000
NAMES = ("size", "source_size", "target", "times")


def quality(text: Column) -> Column:
    """Share of lines that are not repeats, one tenth at least."""
    lines = F.split(text, "\n")
    return F.greatest(F.lit(0.1), F.size(F.array_distinct(lines)) / F.size(lines))


def _measured(rows: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Adds __id, __source, __size, __key and __at, the key's place in 0..1, of which bins are the leading digits."""
    hashed = F.conv(F.substring(F.md5(F.col("__id").cast("string")), 1, 13), 16, 10).cast("double")
    u = (hashed + 0.5) / float(2**52)
    at = (F.log("__key") - LOWEST) / (HIGHEST - LOWEST)
    return (
        rows.withColumn("__id", node_id(doc_id))
        .withColumn("__source", F.col(source))
        .withColumn("__size", F.regexp_count(text_of(text), F.lit(WORD)).cast("long"))
        .withColumn("__key", -F.log(u) / quality(text_of(text)))
        .withColumn("__at", F.greatest(F.lit(0.0), F.least(at, F.lit(1 - 2.0**-50))))
    )


def _bin(level: int) -> Column:
    """Of this level; scaling by a power of two is exact, so the bins of a level lie within those of the level before."""
    return F.floor(F.col("__at") * float(BINS**level))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) -> the same plus `target`: weights share the total, none above most times its size.

    One row a source goes through an unpartitioned window here, never documents.
    """
    named = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy(F.lit(0))
    by = W.partitionBy(F.lit(0)).orderBy((F.lit(float(most)) * F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(all_) - float(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    fits = F.col("level") * F.col("weight") <= float(most) * F.col("source_size")
    rows = rows.withColumn("level", F.max(F.when(fits, F.col("level"))).over(all_))
    full = float(most) * F.col("source_size")
    return rows.select("source", "source_size", F.least(full, F.coalesce(F.col("level") * F.col("weight"), full)).alias("target"))


def _lookup(rows: DataFrame, small: DataFrame, n: int) -> DataFrame:
    """Left join of rows' __source on `small`'s source, nulls alike; `small` has n rows."""
    right = F.broadcast(small) if n <= SMALL else small
    return rows.join(right, rows["__source"].eqNullSafe(small["source"]), "left").drop("source")


PLACE = ("__key", "__id", "__size")


def plan(
    slim: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, at_once: int = SORTED
) -> tuple[DataFrame, int]:
    """Measured rows -> one row a source: source_size, target, whole epochs, and the place where the fraction ends.

    `whole` says that the fraction takes the source to its end; else `last` is
    the place of the last row taken, null if none is.
    """
    bins = cut(slim.groupBy("__source", _bin(1).alias("bin")).agg(F.sum("__size").alias("s"), F.count("*").alias("n")), "mixbins")
    goal = targets(bins.groupBy(F.col("__source").alias("source")).agg(F.sum("s").alias("source_size")), weights, share, most)
    times = F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, times).otherwise(0).cast("int"))
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mixgoal")
    n = goal.count()
    edge = _edge(_lookup(bins, goal.select("source", "rest", F.lit(0).cast("long").alias("base")), n))
    level = 1
    while level < DEEPEST and (edge.agg(F.max("n")).first()[0] or 0) > at_once:
        inside = _lookup(slim, edge.select("source", "bin", "rest", "base"), n).where(_bin(level) == F.col("bin"))
        level += 1
        finer = inside.groupBy("__source", "rest", "base", _bin(level).alias("bin"))
        edge = _edge(finer.agg(F.sum("__size").alias("s"), F.count("*").alias("n")))
    inside = _lookup(slim, edge.select("source", "bin", "rest", "base"), n).where(_bin(level) == F.col("bin"))
    # rows of one place, however many, are one row here: equal rows are taken alike
    inside = inside.groupBy("__source", "rest", "base", *PLACE).agg(F.sum("__size").alias("s"))
    order = W.partitionBy("__source").orderBy(*PLACE).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("s").over(order), F.lit(0))
    fits = inside.withColumn("before", before).where(F.col("before") + F.col("__size") / 2 <= F.col("rest"))
    last = fits.groupBy(F.col("__source").alias("s")).agg(F.max(F.struct(*PLACE)).alias("last"))
    ends = edge.select(F.col("source").alias("e"), "bin")
    out = goal.join(ends, goal["source"].eqNullSafe(ends["e"]), "left")
    out = out.join(last, out["source"].eqNullSafe(last["s"]), "left")
    lots = out.select("source", "source_size", "target", "epochs", "bin", F.col("bin").isNull().alias("whole"), "last")
    return cut(lots.withColumn("level", F.lit(level)), "mixplan"), n


def _edge(bins: DataFrame) -> DataFrame:
    """bins (__source, bin, s, n, rest, base) -> the one of each source in which rest ends, with what comes before it."""
    end = F.col("base") + F.sum("s").over(W.partitionBy("__source").orderBy("bin"))
    past = bins.withColumn("end", end).where(F.col("end") > F.col("rest"))
    first = F.min(F.struct("bin", (F.col("end") - F.col("s")).alias("base"), "rest", "n")).alias("e")
    return cut(past.groupBy(F.col("__source").alias("source")).agg(first).select("source", "e.*"), "mixedge")


def _decided(rows: DataFrame, lots: DataFrame, n: int, most: int) -> DataFrame:
    """Measured rows plus the columns of their source's lot and __times: how often the mix takes each."""
    level = (lots.agg(F.max("level")).first()[0]) or 1
    names = ("source_size", "target", "epochs", "bin", "whole", "last")
    rows = _lookup(rows, lots.select("source", *[F.col(c).alias(f"__{c}") for c in names]), n)
    at_edge = (_bin(level) == F.col("__bin")) & F.coalesce(F.struct(*PLACE) <= F.col("__last"), F.lit(False))
    some = F.col("__whole") | (_bin(level) < F.col("__bin")) | at_edge
    return rows.withColumn("__times", F.col("__epochs") + (some & (F.col("__epochs") < most)).cast("int"))


def _slim(rows: DataFrame, *more: str) -> DataFrame:
    return cut(rows.select(*more, "__source", "__id", "__size", "__key", "__at"), "mix")


def times_taken(docs: DataFrame, names: tuple[str, str, str, str] = NAMES, most: int = MOST, **how) -> DataFrame:
    """Rows of docs without their text, plus, under `names`, size, source_size, target, and how often the mix takes them.

    Sources go by code point, null last. Null text has size 0 and is in every
    selection without weight; a null doc_id draws a key of its own. Rows that
    repeat an id share its key if their quality is the same, and are told apart
    by size; equal rows are taken alike. Of the document where a source's budget
    ends, the whole is taken if half or more of it fits. Other columns pass
    through whatever their names and types, but for those of the added names,
    which are replaced. An empty table gives no rows.
    """
    rows, (doc_id, text, source) = placed(docs), (place_of(docs, c) for c in ("doc_id", "text", "source"))
    shown = docs.drop("text")
    slim = _slim(_measured(rows, doc_id, text, source), *[c for c in rows.columns if c != text])
    lots, n = plan(slim, most=most, **how)
    out = _decided(slim, lots, n, most)
    added = [F.col(c).alias(x) for c, x in zip(("__size", "__source_size", "__target", "__times"), names, strict=True)]
    own = [F.col(c).alias(f"c{k}") for k, c in enumerate(c for c in rows.columns if c != text)]
    return renamed(out.select(*own, *added), shown, names)


def mix(docs: DataFrame, most: int = MOST, **how) -> DataFrame:
    """The mix itself: each row of docs as often as `times_taken` says, columns unchanged whatever their names and types."""
    rows, (doc_id, text, source) = placed(docs), (place_of(docs, c) for c in ("doc_id", "text", "source"))
    measured = _measured(rows, doc_id, text, source)
    lots, n = plan(_slim(measured), most=most, **how)
    taken = _decided(measured, lots, n, most).where(F.col("__times") > 0)
    copies = F.explode(F.sequence(F.lit(1), F.col("__times")))
    return renamed(taken.select(*rows.columns, copies.alias("__copy")), docs)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("size") * F.col("times")).alias("taken")
    return times_taken(docs).select("doc_id", "size", "source_size", "target", taken)


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    -ln((('0x' || md5(doc_id::VARCHAR)[1:13])::BIGINT::DOUBLE + 0.5) / {float(2**52)}) /
      greatest(0.1, len(list_distinct(string_split(coalesce(text, ''), chr(10)))) / len(string_split(coalesce(text, ''), chr(10)))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
l AS (
  SELECT *, ({SHARE} * sum(source_size) OVER () - {MOST}.0 * coalesce(sum(source_size) OVER w, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM s
  WINDOW w AS (ORDER BY {MOST}.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, weight, max(level) FILTER (level * weight <= {MOST}.0 * source_size) OVER () AS level FROM l),
t AS (
  SELECT source, source_size, least({MOST}.0 * source_size, coalesce(level * weight, {MOST}.0 * source_size))::DOUBLE AS target FROM g),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least({MOST}, floor(target / source_size))::INT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN epochs < {MOST} AND upto - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
