"""The pipeline's stages over whole tables, each held against a plain form of itself."""

import hashlib
import math
import os
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from kinweave.llm.bpe import TreeEncoder, default_vocabulary
from kinweave.llm.common import cut, table
from kinweave.llm.toxicity import Compressor, fit
from tests.llm.test_simhash import brute

DATA = "/root/testdata/sf0.001"


def plain_lines(rows):
    """(doc_id, text) in order -> texts without repeated chunks."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0], hashlib.md5(r[1].encode()).digest())):
        lines, kept, chunk, before = text.split("\n"), [], [], 0
        for i, line in enumerate(lines):
            h = int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
            chunk.append(line)
            if (h + 31 * before) % 2**32 % 3 == 0 or i == len(lines) - 1:
                body = "\n".join(chunk)
                if len(chunk) < 2 or body not in seen:
                    kept += chunk
                if len(chunk) > 1:
                    seen.add(body)
                chunk = []
            before = h
        out[d] = "\n".join(kept)
    return out


def plain_mix(rows):
    """(doc_id, source, text) -> how often each document is taken."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    by = {}
    for d, s, t in rows:
        u = (int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        lines = t.split("\n")
        by.setdefault(s, []).append((-math.log(u) / max(0.1, len(set(lines)) / len(lines)), d, size(t)))
    total = {s: sum(x[2] for x in v) for s, v in by.items()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by))}
    capped = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        w = sum(weight[s] for s in by if s not in capped)
        goal = {s: 2.0 * total[s] if s in capped else left * weight[s] / w for s in by}
        over = {s for s in by if s not in capped and goal[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    out = {}
    for s, v in by.items():
        epochs = min(2, int(goal[s] // total[s])) if total[s] else 0
        rest, upto = goal[s] - epochs * total[s], 0
        for _, d, n in sorted(v):
            upto += n
            out[d] = epochs + (epochs < 2 and upto - n / 2 <= rest)
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark):
    docs = table(spark, DATA, "documents")
    assert [n for n, _ in cp.STAGES] and len(cp.STAGES) == 5
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = cut(cp.toxicity(spark, docs, DATA), "t")
    model = fit(docs, table(spark, DATA, "labels"))
    own = Compressor(model["toxic"], model["ordinary"])
    clean = lambda t: (lambda m: not len(m) or (m >= model["margin"]).mean() / ((m >= model["margin"]).mean() + model["share"]) < 0.5)(own.margins(t))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in before.items() if clean(r["text"])}
    lines = cut(cp.line_dedup(spark, kept, DATA), "t")
    got = {r["doc_id"]: r for r in lines.collect()}
    want = plain_lines([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    single = cut(cp.near_duplicates(spark, lines, DATA), "t")
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, _, c in brute([(d, r["text"]) for d, r in got.items()])})
    mixed = cut(cp.mixture(spark, single, DATA), "t")
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n for d, n in plain_mix([(r["doc_id"], r["source"], r["text"]) for r in single.collect()]).items() if n})
    assert docs.columns == kept.columns == lines.columns == single.columns == mixed.columns
    enc = TreeEncoder(default_vocabulary())
    whole = {r["doc_id"]: r["text"] for r in mixed.collect()}
    last = cp.tokens(spark, mixed, DATA).collect()
    assert len(last) == mixed.count()
    for r in last:
        assert r["decoded"] == whole[r["doc_id"]]
        assert list(r["tokens"]) == enc.tok.encode(whole[r["doc_id"]], add_special_tokens=False).ids


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run(spark):
    assert cp.run(spark, DATA).count() > 0


def test_stages_take_nulls_repeats_empty_tables_and_any_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id string, `a.b` int, n_lines int, is_toxic int, m map<string,int>"
    rest = ("x", 1, 2, 3, {"k": 1})
    rows = [(1, "a b\nc d\ne f", "en", "s", 11, *rest), (2, "q\na b\nc d\ne f", "en", "s", 13, *rest), (2, "q\na b\nc d\ne f", "en", "s", 13, *rest)]
    rows += [(3, None, None, None, None, *rest), (4, "", "en", None, 0, *rest), (None, "w " * 50_000, "en", "t", 100_000, *rest)]
    df = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (df, df.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            docs = cut(stage(spark, docs, str(tmp_path)), "t")
            assert docs.columns == df.columns
            assert [f.dataType for f in docs.schema] == [f.dataType for f in df.schema]
        got = cp.tokens(spark, docs, str(tmp_path))
        assert got.columns == ["doc_id", "source", "lang", "n_tokens", "tokens", "decoded"]
        got.collect()
    kept = cp.passage_dedup(spark, df, "").collect()
    assert sorted(repr((r["doc_id"], r["text"], r["n_chars"])) for r in kept if r["doc_id"] in (1, 2, 3, 4)) == sorted(
        map(repr, [(1, "a b\nc d\ne f", 11), (2, "q", 1), (2, "q", 1), (3, None, None), (4, "", 0)])
    )
    single = cp.near_duplicates(spark, df, "").collect()
    assert sorted(map(repr, (r["doc_id"] for r in single))) == ["1", "2", "3", "None"]
    assert all(r["m"] == {"k": 1} for r in single)
