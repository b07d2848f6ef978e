import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm.suffixes import equal_slices, op8_suffixes, remove_repeats, sort_parts, suffix_array


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 40), rng.randint(1, 5)
        t = [rng.randint(3, 3 + k) for _ in range(n)]
        assert suffix_array(t) == sorted(range(n), key=lambda i: t[i:])
    for t in ([1] * 300, [1, 2] * 200, list(range(200)), list(range(200))[::-1], [1, 1, 2, 1, 1, 2, 1, 1, 3] * 20):
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_sort_parts():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"\0ab") for _ in range(rng.randint(0, 20))) for _ in range(200)]
    rank, far, size = sort_parts(parts, 20)
    own = sorted(set(parts))
    assert len(set(rank.tolist())) == len(own)
    by = {r: p for r, p in zip(rank.tolist(), parts, strict=True)}
    for i in range(1, len(by)):
        a, b = by[i - 1], by[i]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert far[i] == n and size[i] == len(b)


def brute(rows, length):
    seen, out = {}, []
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - length + 1):
            k = (-(2**63) if d is None else d, i)
            w = data[i : i + length]
            seen[w] = min(seen.get(w, k), k)
    for d, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] < (-(2**63) if d is None else d, i):
                gone[i : i + length] = True
        gone = gone[:-1]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((-1 if d is None else d, len(data), int(gone.sum()), runs, bytes(np.frombuffer(data, np.uint8)[~gone])))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    for length, gram, alphabet in ((12, 4, "abcdefgh é"), (9, 3, "ab"), (20, 12, "abcdefghijklmnop"), (100, 12, "abcdefghijklmnopqrst ")):
        stock = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 4 * length))) for _ in range(12)]
        rows = []
        for i in range(60):
            text = "".join(rng.choice(stock)[rng.randint(0, 4) :] if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, length))) for _ in range(rng.randint(1, 6)))
            rows.append((i * 7 % 61, text))
        rows += [(70, rows[0][1]), (71, rows[1][1]), (72, None), (73, ""), (74, "a" * 5 * length), (None, rows[2][1]), (75, "x\0" * length), (75, "y" + "x\0" * length), (76, rows[3][1]), (76, rows[3][1])]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = sorted((-1 if r[0] is None else r[0], *r[1:4], bytes(r[4])) for r in remove_repeats(df, length, gram).collect())
        assert got == brute(rows, length)
    assert remove_repeats(df.limit(0)).count() == 0


def test_slices_are_compared_by_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 5000).astype(np.uint8)
    a, b, n = rng.integers(0, 4990, 40_000), rng.integers(0, 4990, 40_000), rng.integers(1, 11, 40_000)
    want = [bytes(data[i : i + k]) == bytes(data[j : j + k]) for i, j, k in zip(a, b, n)]
    assert equal_slices(data, a, b, n).tolist() == want and 0 < sum(want) < len(want)


def test_grams_of_many_contexts_meet_in_parts(spark):
    """More different slices of one gram than meet whole."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghijklmnop") for _ in range(26))
    some = lambda: "".join(rng.choice("qrs") for _ in range(rng.randint(0, 14)))
    rows = [(i, some() + passage[rng.randint(0, 3) :] + some()) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((*r[:4], bytes(r[4])) for r in remove_repeats(df, 20, 8).collect())
    assert got == brute(rows, 20)


def test_different_texts_of_one_id(spark):
    """Rows that share an id, null above all: texts whose 31-bit hashes agree, and passages at the same place."""
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = spark.range(400_000).selectExpr("id", "concat('text number ', id, repeat(' and more', 20)) as t")
    alike = texts.groupBy(F.expr("pmod(xxhash64(t), 2147483647)")).agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").first()["ts"]
    a, b = alike[0] + some(150), alike[1]
    shared, header = some(60), some(40)
    rows = [(1, a), (5, a), (5, b), (None, some(70)), (None, a), (None, b), (2, shared), (9, shared + some(30)), (9, shared + some(30)), (9, shared + some(30))]
    rows += [(None, header + some(rng.randint(0, 40))) for _ in range(30)] + [(None, b)] * 3 + [(3, header), (3, header)]
    for length, gram, parts in ((100, 32, 4), (20, 8, 1), (20, 8, 7)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((-1 if r[0] is None else r[0], *r[1:4], bytes(r[4])) for r in remove_repeats(df, length, gram).collect())
        assert got == brute(rows, length)


def test_very_long_texts_and_other_columns(spark):
    rng = random.Random(10)
    long_ = "".join(rng.choice("abcdefgh \n") for _ in range(1_500_000))
    schema = "doc_id long, text string, spans string, twin int, `a.b` int"
    rows = [(1, long_, "s", 1, 2), (2, "start " + long_, "s", 1, 2), (3, "z" * 300_000, "s", 1, 2)]
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["n_removed"] == 0 and bytes(got[2]["kept"]) == b"start " and got[2]["n_spans"] == 1
    assert bytes(got[3]["kept"]) == b"z" and got[3]["n_removed"] == 299_999


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_equals_brute_force_on_a_whole_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    rows = [(r["doc_id"], r["text"]) for r in table.to_pylist()]
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows, 100)]
    assert sorted(map(tuple, op8_suffixes(spark, "/root/testdata/sf0.001").collect())) == want
    assert sum(r[2] for r in want) > 1_000
