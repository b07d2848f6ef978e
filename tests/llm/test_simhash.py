import itertools
import os
import random

import numpy as np
import pytest
import xxhash

from kinweave.llm.components import settle, unite
from kinweave.llm.simhash import (
    blocks,
    drop_near_duplicates,
    fingerprint,
    fingerprint_links,
    gray_rank,
    near_groups,
    op10_simhash,
    star_links,
)


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    rng = random.Random(1)
    for n in [0, 1, 3, 4, 5, 50, 1000]:
        text = " \x0b".join(rng.choice(["Äb", "THE", "of x", "q", "Zed"]) for _ in range(n))
        assert fingerprint(text) == plain(text)


def test_gray():
    code = np.arange(64, dtype=np.uint64)
    assert (gray_rank(code ^ (code >> np.uint64(1))) == code).all()


def brute(rows):
    fps = [plain(t or "") for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            at[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, fps[i], low[find(i)]) for i, (d, _) in enumerate(rows))


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 400]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            own = base[:]
            for _ in range(rng.choice([0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "The A b C d"), (2004, "the a B c D"), (2004, "the a B c D")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in near_groups(df).collect())
    assert got == brute(rows)
    kept = drop_near_duplicates(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in got})


def test_large_group_of_near_fingerprints():
    rng = random.Random(5)
    base = rng.getrandbits(64)
    codes = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(3000)}) + [rng.getrandbits(64) for _ in range(500)]
    arr = np.array(codes, np.uint64)
    want = np.arange(len(arr))
    for i in range(len(arr)):
        k = np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4)
        unite(want, np.full(len(k), i), k)
    for n in (0, 10**9, 10**12):  # more blocks for more fingerprints
        at = np.arange(len(arr))
        for mask in blocks(4, n):
            key = arr & np.uint64(mask)
            i, j = star_links(arr, np.unique(key, return_inverse=True)[1], mask, 4)
            assert (key[i] == key[j]).all()
            unite(at, i, j)
        assert (settle(at) == settle(want)).all()


def test_masks_cover_all_pairs_in_reach():
    rng = random.Random(8)
    for n in (0, 10**9, 10**12):
        masks = blocks(4, n)
        for _ in range(300):
            far = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not far & m for m in masks)
    assert len(blocks(4, 0)) == 5 < len(blocks(4, 10**9)) < len(blocks(4, 10**12))


def test_hot_keys_are_dealt_as_pairs_of_parts(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    codes = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)})
    df = spark.createDataFrame([(c - 2**64 if c >> 63 else c, k) for k, c in enumerate(codes)], "fp long, rep long")
    at = np.arange(len(codes))
    links = fingerprint_links(df, 4, tile=40).collect()
    unite(at, np.array([r["a"] for r in links]), np.array([r["b"] for r in links]))
    arr, want = np.array(codes, np.uint64), np.arange(len(codes))
    for i in range(len(arr)):
        k = np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4)
        unite(want, np.full(len(k), i), k)
    assert (settle(at) == settle(want)).all()


def test_very_long_and_frequent_texts(spark):
    rng = random.Random(9)
    long_ = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(k, long_ if k % 2 else "one two three four five") for k in range(40)]
    got = {(r["doc_id"], r["component_id"]) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(k, k % 2) for k in range(40)}


def test_columns_of_any_name_and_type_pass(spark):
    schema = "doc_id long, text string, __id string, `a.b` int, fp int, node int, count int, m map<string,int>, c0 int"
    rows = [(3, "x y", "p", 1, 2, 3, 4, {"k": 1}, 5), (3, "x y", "p", 1, 2, 3, 4, {"k": 0}, 5), (4, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = drop_near_duplicates(df)
    assert got.columns == df.columns and got.schema["m"].dataType == df.schema["m"].dataType
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [rows[1], rows[2]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_equals_brute_force_on_a_whole_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    rows = [(r["doc_id"], r["text"]) for r in table.to_pylist()]
    got = sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in op10_simhash(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(None, "x y", 1), (5, "x y", 2)], "doc_id long, text string, fp int")
    assert [r["fp"] for r in drop_near_duplicates(df).collect()] == [1]
    assert near_groups(df.limit(0)).count() == 0
