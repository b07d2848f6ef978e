"""Line dedup by content-defined chunks, in DataFrame functions only.

A rolling hash over the hashes of a line and the one before it ends a chunk
where it is divisible by `every`; a line put in or taken out moves no boundary
but those beside it. Of chunks of two or more lines that occur again anywhere,
the first occurrence stays (smallest doc_id, then text, then place) and the
others go. Chunks meet by hash first, and whole texts are grouped byte by byte
before any is removed.

A passage whose ends fall within chunks can escape that rule. `dedup_passages`
unites it with a comparison of every two neighbouring lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import cut, node_id, own_columns, place_of, placed, renamed, table, text_of

EVERY = 3
LEAST_LINES = 2
ID = ["__id", "__sum"]
CHUNK_NAMES = ("n_lines", "n_removed", "n_chunks")
PASSAGE_NAMES = ("n_lines", "n_removed", "n_passages")


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _named(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds __id, __text and __sum, which tells texts of one id apart."""
    rows = docs.withColumn("__id", node_id(doc_id)).withColumn("__text", text_of(text))
    return rows.withColumn("__sum", F.unhex(F.md5(F.col("__text").cast("binary"))))


def _chunked(docs: DataFrame, every: int) -> DataFrame:
    """Adds __lines, and __chunks: (first line, number of lines), both from 1."""
    rows = docs.withColumn("__lines", F.split(F.col("__text"), "\n"))
    rows = rows.withColumn("__hashes", F.transform("__lines", _line_hash))
    n = F.size("__lines")

    def roll(i: Column) -> Column:
        before = F.when(i > 1, F.element_at("__hashes", F.greatest(i - 1, F.lit(1)))).otherwise(0)
        return (F.element_at("__hashes", i) + 31 * before) % (1 << 32)

    def end_before(k: Column) -> Column:
        return F.when(k > 0, F.element_at("__ends", F.greatest(k, F.lit(1)))).otherwise(0)

    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (roll(i) % every == 0))
    chunk = lambda e, k: F.struct((end_before(k) + 1).alias("at"), (e - end_before(k)).alias("n"))
    return rows.withColumn("__ends", ends).withColumn("__chunks", F.transform("__ends", chunk))


def _body(chunk: Column) -> Column:
    return F.array_join(F.slice("__lines", chunk["at"], chunk["n"]), "\n")


def _repeats(rows: DataFrame, keys: DataFrame, body: Callable[[Column], Column], name: str) -> DataFrame:
    """keys (__id, __sum, k, key) of parts of rows, `body(k)` their text -> (__id, __sum, k, first).

    These are the parts that repeat an earlier one byte for byte, and the place of the first.
    """
    again = cut(keys.groupBy("key").count().where("count > 1").select("key"), f"{name}again")
    marked = cut(keys.join(again, "key", "left_semi"), f"{name}marked")
    # bytes of the marked parts only: the documents that hold any, by their list of places
    places = marked.groupBy(*ID).agg(F.collect_set(F.struct("k", "key")).alias("marks"))
    part = lambda m: F.struct(m["k"].alias("k"), m["key"].alias("key"), body(m["k"]).alias("body"))
    bodies = rows.join(places.hint("shuffle_hash"), ID)
    bodies = bodies.select(*ID, F.explode(F.transform("marks", part)).alias("c"))
    bodies = bodies.select(*ID, "c.k", "c.key", "c.body")
    place = F.struct(*ID, "k")
    groups = cut(bodies.groupBy("key", "body").agg(F.min(place).alias("first")), f"{name}groups")
    per_key = groups.groupBy("key").agg(F.count("*").alias("bodies"), F.min("first").alias("first"))
    same = per_key.where("bodies = 1").select("key", "first")
    out = marked.join(same, "key").where(place != F.col("first")).select(*ID, "k", "first")
    clash = groups.join(per_key.where("bodies > 1").select("key"), "key", "left_semi")
    apart = bodies.join(clash.select("key", "body", "first"), ["key", "body"])
    apart = apart.where(place != F.col("first")).select(*ID, "k", "first")
    if not clash.isEmpty():
        out = out.unionAll(apart)
    return out


def repeated_chunks(rows: DataFrame, every: int = EVERY, least: int = LEAST_LINES) -> DataFrame:
    """Named rows -> (__id, __sum, gone): the chunks, counted from 0, that each document loses."""
    rows = _chunked(rows, every)
    numbered = lambda c, k: F.struct(k.alias("k"), c["at"].alias("at"), c["n"].alias("n"))
    wide = F.filter(F.transform("__chunks", numbered), lambda c: c["n"] >= least)
    key = lambda c: F.struct(c["k"].alias("k"), F.unhex(F.md5(_body(c).cast("binary"))).alias("key"))
    keys = rows.select(*ID, F.explode(F.transform(wide, key)).alias("c")).select(*ID, "c.k", "c.key")
    lines = rows.select(*ID, "__lines", "__chunks")
    out = _repeats(lines, cut(keys, "chunkkeys"), lambda k: _body(F.element_at("__chunks", k + 1)), "chunk")
    return out.groupBy(*ID).agg(F.collect_set("k").alias("gone"))


def dedup_lines(
    docs: DataFrame, every: int = EVERY, least: int = LEAST_LINES, names: tuple[str, str, str] = CHUNK_NAMES
) -> DataFrame:
    """Rows of docs with `text` reduced, plus, under `names`, its lines, lines removed and chunks removed.

    Lines end at a line feed only. Null text stays null and has no lines to
    lose. Rows that repeat both id and text are one document: their chunks stay
    or go alike. A null doc_id comes first in order. Other columns pass through
    whatever their names and types, but for those of the added names, which are
    replaced; an empty table gives no rows.
    """
    plain, doc_id, text = placed(docs, names), place_of(docs, "doc_id"), place_of(docs, "text")
    gone = repeated_chunks(_named(plain.select(doc_id, text), doc_id, text), every, least)
    gone = gone.withColumnRenamed("gone", "__gone")
    rows = _chunked(_named(plain, doc_id, text).join(gone.hint("shuffle_hash"), ID, "left"), every)
    stay = F.array_except(_numbers(0, F.size("__chunks") - 1), F.coalesce("__gone", F.array().cast("array<int>")))
    rows = rows.withColumn("__stay", stay).withColumn("__kept", F.transform("__stay", lambda k: F.get("__chunks", k)))
    left = F.aggregate("__kept", F.lit(0), lambda a, c: a + c["n"])
    parts = F.flatten(F.transform("__kept", lambda c: F.slice("__lines", c["at"], c["n"])))
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(parts, "\n"))
    n = F.size("__lines")
    chunks = F.coalesce(F.greatest(F.size("__gone"), F.lit(0)), F.lit(0))
    added = [x.cast("long").alias(c) for x, c in zip((n, n - left, chunks), names, strict=True)]
    own = [new.alias(c) if c == text else F.col(c) for c in own_columns(docs, names)]
    return renamed(rows.select(*own, *added), docs, names)


def _numbers(start: Column | int, stop: Column) -> Column:
    """start, ..., stop; none where stop is less."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))


def repeated_lines(rows: DataFrame, every: int = EVERY, least: int = LEAST_LINES) -> DataFrame:
    """Named rows -> (__id, __sum, gone): the lines, counted from 1, that each document loses to `dedup_passages`."""
    gone = repeated_chunks(rows, every, least)
    spots = _chunked(rows, every).select(*ID, "__chunks", F.transform("__lines", lambda x: F.xxhash64(x)).alias("spots"))
    taken = F.transform("gone", lambda k: F.element_at("__chunks", k + 1))
    none = F.array().cast("array<struct<at:int,n:int>>")
    spots = spots.join(gone.hint("shuffle_hash"), ID, "left").withColumn("taken", F.coalesce(taken, none))
    upto = lambda c, less: _numbers(c["at"], c["at"] + c["n"] - less)
    spots = spots.select(
        *ID,
        "spots",
        F.flatten(F.transform("taken", lambda c: upto(c, 1))).alias("lines"),
        F.flatten(F.transform("taken", lambda c: upto(c, 2))).alias("inner"),
    )
    spots = cut(spots, "linespots")
    # the first of equal pairs lies in no chunk that went, so pairs inside those need no comparison
    pairs = F.array_except(_numbers(1, F.size("spots") - 1), "inner")
    key = lambda i: F.xxhash64(F.element_at("spots", i), F.element_at("spots", i + 1))
    keyed = F.transform(pairs, lambda i: F.struct(i.alias("k"), key(i).alias("key")))
    keys = cut(spots.select(*ID, F.explode(keyed).alias("c")).select(*ID, "c.k", "c.key"), "pairkeys")
    lines = rows.select(*ID, F.split("__text", "\n").alias("__lines"))
    again = _repeats(lines, keys, lambda k: F.array_join(F.slice("__lines", k, 2), "\n"), "pair")
    first = F.col("first")
    apart = (first["__id"] != F.col("__id")) | (first["__sum"] != F.col("__sum")) | (F.col("k") > first["k"] + 1)
    found = again.where(apart).select(*ID, F.array("k", F.col("k") + 1).alias("lines"))
    found = found.unionAll(spots.where(F.size("lines") > 0).select(*ID, "lines"))
    return found.groupBy(*ID).agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("gone"))


def dedup_passages(
    docs: DataFrame, every: int = EVERY, least: int = LEAST_LINES, names: tuple[str, str, str] = PASSAGE_NAMES
) -> DataFrame:
    """Rows of docs with `text` without passages of two or more lines that came before.

    Adds, under `names`, its lines, lines removed and runs of removed lines.
    The chunks that `dedup_lines` removes go, and so does each pair of
    neighbouring lines that an earlier pair equals byte for byte: no passage
    stays because of where chunk boundaries fall, and its lines go up to its
    very ends. Earlier is by doc_id, then text, then place; pairs that share a
    line do not count as repeats of each other. The first occurrence of every
    line stays. All else is as in `dedup_lines`.
    """
    plain, doc_id, text = placed(docs, names), place_of(docs, "doc_id"), place_of(docs, "text")
    gone = repeated_lines(_named(plain.select(doc_id, text), doc_id, text), every, least)
    gone = gone.withColumnRenamed("gone", "__gone")
    rows = _named(plain, doc_id, text).join(gone.hint("shuffle_hash"), ID, "left")
    rows = rows.withColumn("__lines", F.split("__text", "\n"))
    lost = F.coalesce("__gone", F.array().cast("array<int>"))
    rows = rows.withColumn("__kept", F.array_except(_numbers(1, F.size("__lines")), lost))
    parts = F.transform("__kept", lambda i: F.element_at("__lines", i))
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(parts, "\n"))
    n = F.size("__lines")
    runs = F.size(F.array_except("__gone", F.transform("__gone", lambda i: i + 1)))
    counts = (n, n - F.size("__kept"), F.when(F.col("__gone").isNull(), 0).otherwise(runs))
    added = [x.cast("long").alias(c) for x, c in zip(counts, names, strict=True)]
    own = [new.alias(c) if c == text else F.col(c) for c in own_columns(docs, names)]
    return renamed(rows.select(*own, *added), docs, names)


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *PASSAGE_NAMES, F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *CHUNK_NAMES, F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, md5(text) AS s, string_split(text, chr(10)) AS lines FROM d),
h AS (
  SELECT *, list_transform(lines, lambda x: ('0x' || md5(x)[1:8])::BIGINT) AS hashes FROM l),
e AS (
  SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines)
    OR (hashes[i] + 31 * CASE WHEN i > 1 THEN hashes[i - 1] ELSE 0 END) % 4294967296 % {EVERY} = 0) AS ends FROM h),
c AS (SELECT doc_id, s, lines, ends, unnest(range(0, len(ends))) AS k FROM e),
b AS (
  SELECT doc_id, s, k, CASE WHEN k > 0 THEN ends[k] ELSE 0 END AS before, ends[k + 1] AS upto,
    array_to_string(lines[(CASE WHEN k > 0 THEN ends[k] ELSE 0 END) + 1 : ends[k + 1]], chr(10)) AS body FROM c),
r AS (
  SELECT *, upto - before >= {LEAST_LINES} AND row_number() OVER (
    PARTITION BY upto - before >= {LEAST_LINES}, body ORDER BY doc_id NULLS FIRST, s, k) > 1 AS gone FROM b),
o AS (
  SELECT doc_id, s, sum(upto - before)::BIGINT AS n_lines, coalesce(sum(upto - before) FILTER (gone), 0)::BIGINT AS n_removed,
    count(*) FILTER (gone)::BIGINT AS n_chunks, sha256(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
  FROM r GROUP BY doc_id, s)
SELECT o.doc_id, n_lines, n_removed, n_chunks, kept_sha256
FROM documents t JOIN o ON t.doc_id IS NOT DISTINCT FROM o.doc_id AND md5(coalesce(t.text, '')) = o.s
"""

OP4_PASSAGES_SQL = """
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, md5(text) AS s, string_split(text, chr(10)) AS lines FROM d),
u AS (SELECT doc_id, s, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM l),
p AS (
  SELECT a.doc_id, a.s, a.i, a.line AS a, b.line AS b
  FROM u a JOIN u b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.s = b.s AND a.i + 1 = b.i),
f AS (
  SELECT *, first_value(doc_id) OVER w AS doc_1, first_value(s) OVER w AS s_1, first_value(i) OVER w AS i_1
  FROM p WINDOW w AS (PARTITION BY a, b ORDER BY doc_id NULLS FIRST, s, i)),
g AS (
  SELECT DISTINCT doc_id, s, unnest([i, i + 1]) AS i FROM f
  WHERE doc_id IS DISTINCT FROM doc_1 OR s <> s_1 OR i > i_1 + 1),
k AS (
  SELECT u.*, g.i IS NOT NULL AS gone
  FROM u LEFT JOIN g ON u.doc_id IS NOT DISTINCT FROM g.doc_id AND u.s = g.s AND u.i = g.i),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id, s ORDER BY i), false) AS opens FROM k),
o AS (
  SELECT doc_id, s, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed, count(*) FILTER (opens)::BIGINT AS n_passages,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM r GROUP BY doc_id, s)
SELECT o.doc_id, n_lines, n_removed, n_passages, kept_sha256
FROM documents t JOIN o ON t.doc_id IS NOT DISTINCT FROM o.doc_id AND md5(coalesce(t.text, '')) = o.s
"""
