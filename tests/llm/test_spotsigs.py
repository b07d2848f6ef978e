import hashlib
import os
import random

import pytest
import xxhash

from kinweave.llm.spotsigs import edited, fingerprint, fingerprints, likeness, near_groups, op9_groups, op9_spotsigs, signatures

COMMON = """the of and to in is was that it with le la les des et est une que dans pour
der die das und ist ein eine den zu von el los las que una es con por se para""".split()


def plain_signatures(text):
    """Anchors and the three content words that follow each, straight from the words of a text."""
    words = "".join(c.lower() if c.isascii() else c for c in text).encode()
    words = [w.decode() for w in words.split()]
    chains = set()
    for i, w in enumerate(words):
        if w in COMMON:
            after = [x for x in words[i + 1 :] if x not in COMMON][:3]
            if len(after) == 3:
                chains.add(" ".join([w, *after]))
    if not chains and words:
        chains = {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
    return sorted({xxhash.xxh32(c.encode()).intdigest() for c in chains or {text}})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_equals_plain_signatures_on_a_whole_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    order = sorted(((r["doc_id"], r["text"] or "") for r in table.to_pylist()), reverse=True)
    got = {r["doc_id"]: r for r in op9_spotsigs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(order)
    shown = lambda sigs: "".join(f"{x:08x}" for x in sigs)
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    short = lambda t: len(t) < 2_500
    for (doc, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        k = len(text) // 2
        changed = text[: len(text) - k] + after[:k]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        if short(text) and short(after):
            own, new, other = map(plain_signatures, (text, changed, after))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (shown(own), shown(new))
            assert abs(r["near_edited"] - alike(own, new)) < 1e-12 and abs(r["near_next"] - alike(own, other)) < 1e-12


def test_very_long_texts(spark):
    rng = random.Random(3)
    long_ = " ".join(rng.choice(["the", "of", f"w{rng.randrange(9000)}"]) for _ in range(60_000))
    df = spark.createDataFrame([(1, long_), (2, long_ + " end of it"), (3, "z" * 400_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints(df).collect()}
    assert got[2]["near_next"] > 0.99 and got[3]["near_next"] == 0
    assert {r["doc_id"]: r["component_id"] for r in near_groups(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_signatures():
    a = signatures("The cat of great size sat and the dog barked loud")
    assert a == signatures("the CAT of great size sat and the dog barked loud")
    assert len(a) == 4
    assert signatures("a b") != signatures("b a") and len(signatures("")) == 1
    assert likeness(a, a) == 1.0 and likeness(a, signatures("x y")) == 0.0
    assert likeness(frozenset(range(10)), frozenset(range(5)), 0.8) == 0.0


def test_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["the", "of", "und", "que", "é", "🙂", "cat", "dog", "sat", "\n", "far"]
    rows = [(i * 3 % 101, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "z") for i in range(90)]
    rows += [(500, None, "z"), (501, "", "z"), (7, "again the cat", "z"), (7, "again the cat", "z"), (None, "the last one here", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(7)
    order = sorted(((-(2**63) if d is None else d, t or "") for d, t, _ in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for i, (d, t) in enumerate(order):
        other = order[(i + 1) % len(order)][1]
        e = edited(t, other)
        s, u, o = signatures(t), signatures(e), signatures(other)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(s), fingerprint(u), len(s & u) / len(s | u), len(s & o) / len(s | o)))
    got = [tuple(r) for r in fingerprints(df).collect()]
    got = [((-(2**63) if r[0] is None else r[0]), *r[1:]) for r in got]
    assert sorted(got) == sorted(want)
    assert fingerprints(df.limit(0)).count() == 0
    (one,) = fingerprints(df.where("doc_id = 501")).collect()
    assert one["near_next"] == 1.0


def test_groups_equal_brute_force(spark):
    rng = random.Random(12)
    stock = ["the", "of", "und", "que"] + [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(40):
        base = [rng.choice(stock) for _ in range(rng.choice([4, 60, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            own = base[:]
            for _ in range(rng.choice([0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(stock)
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, " ")]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    sigs = [signatures(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if likeness(sigs[i], sigs[j]) >= 0.8:
                a, b = find(i), find(j)
                at[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_groups(df).collect())
    assert got == sorted((d, rows[find(i)][0]) for i, (d, _) in enumerate(rows))
    assert near_groups(df.limit(0)).count() == 0


def plain_classes(rows):
    """(id, text) rows -> (id, smallest id reachable) by comparing all texts with all, ids that repeat being one."""
    ids, sigs = [d for d, _ in rows], [signatures(t or "") for _, t in rows]
    at = {d: d for d in ids}

    def find(d):
        while at[d] != d:
            d = at[d]
        return d

    for i in range(len(rows)):
        for j in range(i):
            if likeness(sigs[i], sigs[j]) >= 0.8:
                a, b = find(ids[i]), find(ids[j])
                at[max(a, b)] = min(a, b)
    return sorted((d, find(d)) for d in ids)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_groups_query_equals_brute_force_on_a_whole_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    want = plain_classes([(r["doc_id"], r["text"]) for r in table.to_pylist()])
    assert len({c for _, c in want}) < len(want)
    assert sorted(tuple(r) for r in op9_groups(spark, "/root/testdata/sf0.01").collect()) == want


def test_groups_with_a_hot_group_shared_ids_and_a_bridge(spark, monkeypatch):
    """A third of the rows near copies of one text, ids that repeat, and chains that only their links hold together."""
    import kinweave.llm.spotsigs as module

    monkeypatch.setattr(module, "SALT", 7)
    rng = random.Random(4)
    word = lambda: f"the w{rng.randrange(4000)}"
    base = [word() for _ in range(80)]
    rows = []
    for i in range(120):
        own = base[:]
        own[rng.randrange(80)] = word()
        rows.append((i, " ".join(own)))
    for k in range(40):
        own = [word() for _ in range(60)]
        for i in range(5):
            own = own[3:] + [word() for _ in range(3)]
            rows.append((1_000 + 10 * k + i, " ".join(own)))
    rows += [(-5, rows[3][1]), (-5, rows[150][1]), (7_000, rows[0][1]), (7_000, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in near_groups(df).collect()) == plain_classes(rows)


def test_groups_of_null_ids(spark):
    rows = [(None, "the cat sat far away"), (4, "the cat sat far away"), (None, "z"), (9, "z"), (3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_groups(df).collect()), key=repr)
    assert got == [(3, 3), (4, None), (9, None), (None, None), (None, None)]
