import random

from kinweave.llm.mixing import mix, times_taken


def test_targets_and_taking(spark):
    rng = random.Random(4)
    rows = []
    for s, n in [("a", 400), ("b", 30), ("ä", 3000), (None, 50), ("z", 1)]:
        rows += [(len(rows) + i, " ".join("w" for _ in range(rng.randint(0, 60))), s, "x") for i in range(n)]
    rows += [(5, None, "b", "y"), (5, "", "b", "y"), (None, "one two", "b", None), (None, "one two", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    names = ("n_words", "of", "goal", "times")
    text = {(r[0], len((r[1] or "").split())): r for r in rows}
    for how in ({}, {"at_once": 40}):  # bins split again while they hold more
        hold(df, rows, times_taken(df, names, **how).collect(), text)
    assert sorted(map(repr, times_taken(df, names, at_once=40).collect())) == sorted(map(repr, times_taken(df, names).collect()))
    mixed = mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["times"] for r in times_taken(df, names).collect())
    assert times_taken(df.limit(0)).count() == mix(df.limit(0)).count() == 0
    assert times_taken(df.where("text is null")).count() == 1


def hold(df, rows, got, text):
    assert len(got) == len(rows) and "text" not in got[0].asDict() and got[0]["target"] in ("x", "y", None)
    sizes, goal, taken = {}, {}, {}
    for r in got:
        n = r["n_words"]
        assert (r["doc_id"], n) in text and 0 <= r["times"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        taken[r["source"]] = taken.get(r["source"], 0) + n * r["times"]
        goal[r["source"]] = r["goal"]
    weight = dict(zip(["a", "b", "z", "ä", None], [5, 2, 1, 5, 2]))
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in sizes if s not in capped)
        share = {s: 2 * sizes[s] if s in capped else left * weight[s] / w for s in sizes}
        over = {s for s in sizes if share[s] > 2 * sizes[s] + 1e-9} - capped
        if not over:
            break
        capped |= over
    for s in sizes:
        assert abs(goal[s] - share[s]) < 1e-6
        assert abs(taken[s] - goal[s]) <= 31


def test_weights_favour_quality(spark):
    rows = [(i, "\n".join(["a b"] * 20) if i % 2 else "\n".join(f"a {j}" for j in range(20)), "s") for i in range(2000)] + [(9999, "x " * 300_000, "t")]
    got = times_taken(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 9)).where("source = 's'").collect()
    poor = sum(r["times"] for r in got if r["doc_id"] % 2)
    fine = sum(r["times"] for r in got if not r["doc_id"] % 2)
    assert fine > poor or fine == poor == 2000


def test_columns_of_any_name_and_type_pass(spark):
    schema = "doc_id long, text string, source string, __key int, __id string, `a.b` int, size int, times int, bin int, m map<string,int>"
    rows = [(k, "a b c\n" * (k % 5), "s", 1, "p", 2, 3, 4, 5, {"k": k}) for k in range(50)] + [(None,) * 10]
    df = spark.createDataFrame(rows, schema)
    out = mix(df)
    assert out.columns == df.columns
    assert {r["m"]["k"] for r in out.collect() if r["m"]} <= set(range(50)) and {tuple(r)[3:7] for r in out.collect()} <= {(1, "p", 2, 3), (None,) * 4}
    got = times_taken(df)
    assert got.columns == ["doc_id", "source", "__key", "__id", "a.b", "bin", "m", "size", "source_size", "target", "times"]
    assert got.count() == 51


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 400_000, "s"), (2, "w", "s")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["size"]) for r in times_taken(df).collect()} == {(1, 400_000), (2, 1)}
