"""Passages of any length go, wherever chunk boundaries fall."""

import hashlib
import random

import corpus_pipeline as cp
from kinweave.llm import lines as module
from kinweave.llm.lines import dedup_lines, dedup_passages


def plain(rows):
    """(doc_id, text) -> {(doc_id, text): text without repeated pairs of lines}."""
    first, out = {}, {}
    for d, text in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0], hashlib.md5(r[1].encode()).digest())):
        lines, gone = text.split("\n"), set()
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            at = first.setdefault(pair, (d, text, i))
            if at[:2] != (d, text) or i > at[2] + 1:
                gone |= {i, i + 1}
        out[d, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_planted_passages_go_whole(spark):
    rows = []
    for n in range(2, 9):
        for case in range(25):
            passage = [f"line {i} of the passage {case} of length {n}" for i in range(n)]
            for copy in range(2):
                rows.append((len(rows), "\n".join([f"before {n} {case} {copy}", *passage, f"after {n} {case} {copy}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in dedup_passages(df).collect()}
    chunks = {r["doc_id"]: r["text"] for r in dedup_lines(df).collect()}
    assert len(left) == len(rows)
    for d, text in rows:
        assert left[d] == (text if d % 2 == 0 else "\n".join(text.split("\n")[:: text.count("\n")]))
    assert any("passage" in chunks[d] for d in chunks if d % 2)  # boundaries let some through


def _rows():
    rng = random.Random(4)
    rows = [(rng.randrange(60), "\n".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, 14)))) for _ in range(120)]
    return rows + [(None, "p\nq\nr"), (70, "p\nq\nr"), (71, None), (72, ""), (73, "\n"), (74, "z z\nz z\nz z"), (75, "y\ny\ny\ny"), (76, "one"), (77, "one"), (78, "k\nl"), (78, "k\nl")]


def _held(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dedup_passages(df.withColumn("n_chars", df.doc_id)).collect()
    want = plain(rows)
    assert sorted(((r["doc_id"], r["text"] or "") for r in got), key=repr) == sorted(((d, want[d, t or ""]) for d, t in rows), key=repr)
    assert {r["doc_id"]: r["text"] for r in got}[71] is None
    lines = lambda texts: {x for t in texts for x in (t or "").split("\n")}
    assert lines(t for _, t in rows) <= lines(r["text"] for r in got) | {""}
    assert all((r["n_passages"] > 0) == (r["n_removed"] > 0) for r in got)
    assert dedup_passages(df.limit(0)).count() == 0


def test_equals_brute_force(spark):
    _held(spark, _rows())


def test_equal_keys_do_not_remove(spark, monkeypatch):
    monkeypatch.setattr(module.F, "xxhash64", lambda *c: module.F.lit(7).cast("long"))
    _held(spark, _rows())


def test_stage_is_whole(spark):
    assert dict(cp.STAGES)["line dedup"] is cp.passage_dedup
    rows = [(1, "s\nu\nv\nt", 7), (2, "w\nu\nv\nx", 7)]
    out = cp.passage_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "").collect()
    assert sorted(map(tuple, out)) == [(1, "s\nu\nv\nt", 7), (2, "w\nx", 3)]
