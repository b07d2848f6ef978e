import gzip
import hashlib
import random

from kinweave.llm.common import scratch
from kinweave.llm.warc import LoserTree, capture_time, merge_runs, parse, read_archives, record, url_key, write_archives


def test_loser_tree():
    rng = random.Random(1)
    for k in range(0, 12):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_record():
    body = "é\r\n\r\nWARC/1.1".encode()
    r = parse(record(5, "http://a/ b", body, hashlib.sha1(body).hexdigest(), None))
    assert r["payload"] == body and r["payload_bytes"] == len(body) and r["WARC-Type"] == "response"
    r = parse(record(5, None, body, hashlib.sha1(body).hexdigest(), 9))
    assert r["payload"] is None and r["payload_bytes"] == len(body) and r["WARC-Refers-To"] == "<urn:page:9>"
    assert url_key("HTTPS://www.B.example.com:80/X?q#f") == "com,example,b)/x?q"


def test_archives(spark):
    big = "x" * 1000
    rows = [(i, f"http://h{i % 3}.example/{i}", [big, "small", None, "é" * 600, f"{i}" * 400][i % 5], 1) for i in range(60)] + [(61, None, "", 2), (62, "http://[bad", big, 2), (None, "u", big, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(5)
    folder = scratch(spark, "warc")
    index = merge_runs(write_archives(df, folder))
    order = [(r["urlkey"], r["ts"], r["page_id"]) for r in index.orderBy("capture_rank").collect()]
    assert order == sorted(order) and len(order) == len(rows)
    got = {r["page_id"]: r for r in read_archives(index, folder).collect()}
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        r = got[page if page is not None else -(2**63)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        top = max((p for p, _, h, _ in rows if p is not None and (h or "") == (html or "")), default=None)
        if len(payload) >= 1000 and page != top:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", top, None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, payload)
    empty = scratch(spark, "warc")
    assert merge_runs(write_archives(df.limit(0), empty)).count() == 0
    import glob

    for f in glob.glob(f"{folder}/*.warc.gz"):
        assert gzip.open(f).read().count(b"WARC-Record-ID") >= 0


def test_history(spark):
    """Ranks and earlier captures over few URLs, many captures of one, in many small runs and ranges."""
    rng = random.Random(4)
    pages = rng.sample(range(100_000_000), 600)
    url = lambda p: f"http://h.example/{p % 7}" if p % 3 else "http://hot.example/"
    df = spark.createDataFrame([(p, url(p), "t", 0, None) for p in pages], "page_id long, url string, html string, place int, `a.b` int").repartition(9)
    folder = scratch(spark, "warc")
    got = {r["page_id"]: r for r in read_archives(merge_runs(write_archives(df, folder)), folder).collect()}
    order = sorted(pages, key=lambda p: (url_key(url(p)), capture_time(p), p))
    assert [got[p]["capture_rank"] for p in order] == list(range(1, 601))
    for a, b in zip([None, *order], order):
        same = a is not None and url_key(url(a)) == url_key(url(b))
        assert got[b]["previous_page_id"] == (a if same else None)


def test_very_long_and_repeated_pages(spark):
    rows = [(1, "http://a/", "y" * 3_000_000), (2, "http://a/", "y" * 3_000_000), (2, "http://a/", "y" * 3_000_000)]
    folder = scratch(spark, "warc")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = read_archives(merge_runs(write_archives(df, folder)), folder).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["capture_rank"]) for r in got) == [
        (1, "revisit", 2, 1),
        (2, "response", None, 2),
        (2, "response", None, 3),
    ]


def test_rows_that_share_a_page_id(spark):
    """Each row has one record by its own payload, and every payload can be read back."""
    rng = random.Random(6)
    a, b, c, z = ("A" * 1200, "B" * 1100, "C" * 1000, "Z" * 3000)
    cases = [
        [(5, a), (5, b), (9, a)],
        [(7, c), (7, z), (12, c), (13, z), (7, b), (7, b), (12, a)],
        [(rng.choice([None, 1, 2, 3, 4]), rng.choice([a, b, c, z, None, "small"])) for _ in range(80)],
    ]
    for rows in cases:
        df = spark.createDataFrame([(p, f"http://h/{p}", t) for p, t in rows], "page_id long, url string, html string").repartition(3)
        folder = scratch(spark, "warc")
        got = read_archives(merge_runs(write_archives(df, folder)), folder).collect()
        page = lambda p: -(2**63) if p is None else p
        top = {}
        for p, t in rows:
            top[t or ""] = max(top.get(t or "", page(None)), page(p))
        want = []
        for p, t in rows:
            again = len(t or "") >= 1000 and page(p) != top[t or ""]
            want.append((page(p), hashlib.sha1((t or "").encode()).hexdigest(), "revisit" if again else "response", top[t or ""] if again else None))
        assert sorted(map(repr, want)) == sorted(repr((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
        kept = {bytes(r["payload"]) for r in got if r["record_type"] == "response"}
        assert kept == {(t or "").encode() for _, t in rows}
