from kinweave.llm.lines import dedup_lines, dedup_passages


def test_repeated_passages_go(spark):
    passage = "\n".join(f"shared line {i} of the passage" for i in range(30))
    rows = [(k, f"own start {k}\n{passage}\nown end {k}\nlast {k}", "x") for k in range(6)]
    rows += [(20, None, "n"), (21, "", "n"), (22, "a\nb", "n"), (22, "a\nb", "n"), (23, "one line", "n"), (24, "one line", "n"), (None, "p\nq\nr", "n"), (25, "p\nq\nr", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    out = dedup_lines(df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["text"] == rows[0][1]
    for k in range(1, 6):
        text = by[k][0]["text"]
        assert text.startswith(f"own start {k}") and text.endswith(f"last {k}")
        assert text.count("shared line") <= 12 and by[k][0]["n_removed"] >= 18
    assert by[20][0]["text"] is None and by[21][0]["text"] == ""
    assert [r["text"] for r in by[22]] == ["a\nb", "a\nb"]
    assert by[23][0]["text"] == by[24][0]["text"] == "one line"
    assert by[None][0]["text"] == "p\nq\nr" and by[25][0]["n_chunks"] >= 1
    assert dedup_lines(df.limit(0)).count() == 0


def test_columns_of_any_name_and_type_pass(spark):
    schema = "doc_id long, text string, __id string, __text string, `a.b` int, gone int, n_lines string, m map<string,int>"
    rows = [(1, "a\nb\nc", "p", "q", 1, 2, "r", {"k": 1}), (2, "a\nb\nc", "p", "q", 1, 2, "r", {"k": 2}), (None,) * 8]
    df = spark.createDataFrame(rows, schema)
    for dedup in (dedup_lines, dedup_passages):
        out = dedup(df, names=("x", "y", "z"))
        assert out.columns == [*df.columns, "x", "y", "z"]
        got = {r["doc_id"]: tuple(r) for r in out.collect()}
        assert got[1][:8] == rows[0] and got[2][2:8] == rows[1][2:] and got[None][:8] == rows[2]
        assert dedup(df).columns == ["doc_id", "text", "__id", "__text", "a.b", "gone", "m", *dedup(df).columns[-3:]]
    assert {r["doc_id"]: r["text"] for r in dedup_passages(df).collect()}[2] == ""


def test_very_long_texts(spark):
    body = "\n".join(f"line {i} of a long text" for i in range(60_000))
    df = spark.createDataFrame([(1, body), (2, "start\n" + body), (3, "x" * 500_000), (4, "x" * 500_000)], "doc_id long, text string")
    for dedup, most in ((dedup_lines, len(body) // 5), (dedup_passages, 10)):  # chunks of one line stay
        left = {r["doc_id"]: r["text"] for r in dedup(df).collect()}
        assert left[1] == body and len(left[2]) < most and left[3] == left[4] == "x" * 500_000
