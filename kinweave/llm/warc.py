"""WARC archives with a globally ordered capture index.

Each task writes one archive of gzip members, one a record, under a temporary
name that is moved into place when whole, and gives its capture index, sorted
by (URL key, timestamp, page): one local run. Runs are dealt out by range of
that key and, in each range, merged by a loser tree; the order of the merged
index gives each capture its rank and the capture of its URL before it.

Of records with equal payloads of `least` bytes or more, the one of the largest
page_id is a response and the others revisit it; revisit records keep the HTTP
header block, so the payload's size, and its digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.common import cut, node_id, scratch, shown_id, table

LEAST = 1000
#: Duplicate tables up to this many rows are broadcast; larger ones are joined by shuffling.
SMALL = 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
CRLF = b"\r\n"
INDEX = "urlkey string, ts string, page_id long, digest string, record_type string, file string, offset long, length long, run int"
NAMES = [x.split()[0] for x in INDEX.split(", ")]
KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
MERGED_KINDS = [*KINDS, pa.int32(), pa.int64(), pa.int64()]
#: Index rows of a run that are decoded at a time, and records that are handed on together.
DECODED, READ_AT_ONCE = 256, 256


def url_key(url: str | None) -> str:
    """Host parts from the right, then path and query, lower case; no scheme, fragment, www or port."""
    try:
        at = urlsplit((url or "").strip().lower())
        host = (at.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    return ",".join(reversed(host.split("."))) + ")" + (at.path or "/") + (f"?{at.query}" if at.query else "")


def capture_time(page_id: int) -> datetime:
    """Pages bear no time; the id stands for seconds of a year, so that reruns agree."""
    return EPOCH + timedelta(seconds=page_id % (365 * 86_400))


def record(page_id: int, url: str | None, payload: bytes, sha1: str, response: int | None) -> bytes:
    """One record; `response` is the page that a revisit refers to."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http + (payload if response is None else b"")
    uri = " ".join((url or "").split()) or "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if response is not None:
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{response}>"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse(raw: bytes) -> dict:
    """Headers of a record, its payload (None for revisits) and the payload's size by the HTTP header."""
    head, _, rest = raw.partition(CRLF * 2)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF * 2)
    sizes = [int(x[16:]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length: ")]
    return fields | {"payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": sizes[0]}


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def with_responses(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) plus `sha1` and `response`: the page each revisit refers to, else null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(node_id("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = keyed.withColumn("sha", F.sha2("html", 256))
    sums = cut(keyed.where(F.octet_length("html") >= least).select("page_id", "sha"), "digests")
    same = sums.groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    # rows may share a page_id: a revisit is known by its page and its payload
    revisits = cut(sums.join(same, "sha").where("page_id <> response").select("page_id", "sha", "response").distinct(), "revisits")
    n = revisits.count()
    rows = keyed.join(F.broadcast(revisits) if n <= SMALL else revisits, ["page_id", "sha"], "left")
    return rows.drop("sha").withColumn("sha1", F.sha1(F.col("html").cast("binary")))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write one archive a task under `folder` (shared by all executors); returns the local index runs.

    Null html counts as empty and a null url as none; repeated rows are written
    each; of rows that share the largest page_id of a payload all are responses.
    Rows of one page_id with other payloads are records of their own: each is a
    response or a revisit by its own payload.
    An empty table writes empty archives and gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _fs(folder)
        k = TaskContext.get().partitionId()
        name, draft = f"{at}/part-{k:06d}.warc.gz", f"{at}/.draft-{k:06d}-{uuid.uuid4().hex}"
        store.create_dir(at, recursive=True)
        rows, offset = [], 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                for page, url, html, response, sha1 in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "response", "sha1")), strict=True):
                    member = gzip.compress(record(page, url, html.encode(), sha1, response), 6, mtime=0)
                    out.write(member)
                    rows.append((url_key(url), f"{capture_time(page):%Y%m%d%H%M%S}", page, sha1, "response" if response is None else "revisit", os.path.basename(name), offset, len(member), k))
                    offset += len(member)
        store.move(draft, name)
        rows.sort()
        for i in range(0, len(rows), 10_000):
            yield _batch(rows[i : i + 10_000])

    return cut(with_responses(pages, least).select("page_id", "url", "html", "response", "sha1").mapInArrow(run, INDEX), "runs")


def _batch(rows: list[tuple], kinds: list = KINDS, names: list | None = None) -> pa.RecordBatch:
    names = names or [*NAMES, "part", "place", "previous"][: len(kinds)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, the winner is replayed along one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = k = max(1, len(runs))
        self.heads: list = [next(r, None) for r in runs] or [None]
        self.tree = [0] * k
        winner = [0] * (2 * k)
        for i in range(k):
            winner[k + i] = i
        for i in range(k - 1, 0, -1):
            a, b = winner[2 * i], winner[2 * i + 1]
            winner[i], self.tree[i] = (a, b) if self._wins(a, b) else (b, a)
        self.tree[0] = winner[1] if k > 1 else 0

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator:
        while (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            i = (w + self.k) // 2
            while i:
                if not self._wins(w, self.tree[i]):
                    w, self.tree[i] = self.tree[i], w
                i //= 2
            self.tree[0] = w


MERGED = INDEX + ", part int, place long, previous long"


def pieces(index: pa.Table) -> list[tuple[int, int]]:
    """Ascending pieces of a fetched range, as (start, end): a run may arrive in several, one after another."""
    cuts, before = [0], None
    for at in range(0, index.num_rows, DECODED):
        keys = zip(*(index.column(c).slice(at, DECODED).to_pylist() for c in NAMES[:3]), strict=True)
        for k, key in enumerate(keys, at):
            if before is not None and key < before:
                cuts.append(k)
            before = key
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], index.num_rows], strict=True) if a < b]


def _decoded(index: pa.Table, start: int, end: int) -> Iterator[tuple]:
    """Rows of a piece, a few at a time."""
    for at in range(start, end, DECODED):
        part = index.slice(at, min(DECODED, end - at))
        yield from zip(*(part.column(c).to_pylist() for c in NAMES), strict=True)


def merge_runs(index: DataFrame) -> DataFrame:
    """Local runs -> the index in global order of (urlkey, ts, page_id), with `capture_rank` and `previous_page_id`.

    capture_rank counts captures from 1 in that order; previous_page_id is the
    capture of the same URL key just before, or null. Ranges end between keys,
    so a URL of any weight is spread by time and page. A task holds one range of
    index rows in Arrow form and decodes a few of each run at a time as the
    loser tree asks for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        rows, part = pa.Table.from_batches(got), TaskContext.get().partitionId()
        key, page = None, None
        out: list = []
        for place, row in enumerate(LoserTree([_decoded(rows, a, b) for a, b in pieces(rows)])):
            out.append((*row, part, place, page if row[0] == key else None))
            key, page = row[0], row[2]
            if len(out) == 10_000:
                yield _batch(out, MERGED_KINDS)
                out = []
        if out:
            yield _batch(out, MERGED_KINDS)

    ranged = index.select(*NAMES).repartitionByRange("urlkey", "ts", "page_id")
    merged = cut(ranged.mapInArrow(run, MERGED), "history")
    # a row a range: where it starts, and which capture comes before its first
    last = F.max_by(F.struct("urlkey", "page_id"), "place").alias("last")
    order = W.orderBy("part")
    ranges = merged.groupBy("part").agg(F.count("*").alias("n"), last)
    ranges = ranges.select(
        "part",
        (F.sum("n").over(order) - F.col("n")).alias("base"),
        F.lag("last").over(order).alias("before"),
    )
    rows = merged.join(F.broadcast(ranges), "part")
    crosses = (F.col("place") == 0) & (F.col("before.urlkey") == F.col("urlkey"))
    previous = F.when(crosses, F.col("before.page_id")).otherwise(F.col("previous"))
    return rows.select(*NAMES, (F.col("base") + F.col("place") + 1).alias("capture_rank"), previous.alias("previous_page_id"))


READ = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "payload binary, capture_rank long, previous_page_id long"
)
READ_NAMES = [x.split()[0] for x in READ.split(", ")]
READ_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that an index names, by offset, with their place in the history; one task or more an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _fs(folder)
        name, file, rows = None, None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "offset", "length", "capture_rank", "previous_page_id"))
            for own, offset, length, rank, previous in zip(*columns, strict=True):
                if own != name:
                    name, file = own, store.open_input_file(f"{at}/{own}")
                r = parse(gzip.decompress(file.read_at(length, offset)))
                claimed = base64.b32decode(r["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                payload = r["payload"]
                if payload is not None:
                    if hashlib.sha1(payload).hexdigest() != claimed or len(payload) != r["payload_bytes"]:
                        raise ValueError(f"damaged record in {own} at {offset}")
                page, to = int(r["WARC-Record-ID"][10:-1]), r.get("WARC-Refers-To")
                to = int(to[10:-1]) if to else None
                rows.append((page, r["WARC-Target-URI"], r["payload_bytes"], claimed, r["WARC-Type"], to, payload, rank, previous))
                if len(rows) == READ_AT_ONCE:
                    yield _batch(rows, READ_KINDS, READ_NAMES)
                    rows = []
        if rows:
            yield _batch(rows, READ_KINDS, READ_NAMES)

    # the index is small beside the archives, so the number of tasks is set, not left to its size
    n = max(1, index.select("file").distinct().count())
    dealt = index.select("file", "offset", "length", "capture_rank", "previous_page_id").repartition(n, "file")
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, READ)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = merge_runs(write_archives(table(spark, sf_dir, "pages"), folder))
    columns = ("payload_bytes", "payload_digest", "record_type", "refers_to", "capture_rank")
    out = read_archives(index, folder)
    return out.select(shown_id("page_id").alias("page_id"), *columns, shown_id("previous_page_id").alias("previous_page_id"))


OP6_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
u AS (
  SELECT page_id, lower(trim(coalesce(url, ''))) AS url FROM pages),
k AS (
  SELECT page_id, make_timestamp(1704067200000000 + page_id % 31536000 * 1000000) AS ts,
    array_to_string(list_reverse(string_split(
      regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www[.]', ''), '.')), ',') || ')' ||
    CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
      ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END ||
    CASE WHEN regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) = '' THEN ''
      ELSE '?' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) END AS urlkey FROM u),
h AS (
  SELECT page_id, row_number() OVER (ORDER BY urlkey, ts, page_id) AS capture_rank,
    lag(page_id) OVER (PARTITION BY urlkey ORDER BY ts, page_id) AS previous_page_id FROM k),
q AS (
  SELECT p.*, h.capture_rank, h.previous_page_id, octet_length(payload) AS n,
    max(page_id) OVER (PARTITION BY payload) AS top FROM p JOIN h USING (page_id))
SELECT page_id, capture_rank, previous_page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN n >= {LEAST} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND page_id <> top THEN top END AS refers_to
FROM q
"""
