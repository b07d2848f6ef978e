import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinweave.llm.common import table
from kinweave.llm.toxicity import fit, held_out, op7_toxicity, score


def test_held_out_accuracy(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "the", "er", "on", "re", "st", "in", "sh"]) for _ in range(rng.randint(1, 4)))
    bad = ["blaggard", "snivel", "oafish", "dunce", "wretch"]
    rows, labels = [], []
    for i in range(900):
        text = [word() for _ in range(rng.choice([30, 200, 900]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(text) // 80)):
                text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    rows += [(None, "", "x"), (9000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = score(docs, model).withColumn("held", held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    truth = dict(labels)
    own = [(truth[r["doc_id"]], r["predicted"]) for r in out if r["doc_id"] in truth and r["held"]]
    assert len(own) > 100 and sum(a == b for a, b in own) / len(own) > 0.97
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert all(r["score"] == 0 for r in out if not r["text"])
    assert score(docs.limit(0), model).count() == 0


def plain_score(text, model):
    """The score by compressing every window anew, word by word, without the operator's own code."""
    import zstandard as z

    how = z.ZstdCompressionParameters(
        window_log=17, hash_log=14, chain_log=14, search_log=6, min_match=3, target_length=32,
        strategy=z.STRATEGY_BTULTRA2, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    size = lambda d, w: len(
        z.ZstdCompressor(
            dict_data=z.ZstdCompressionDict(model[d], dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how
        ).compress(w)
    )
    head = bytes([*range(1, 9), *range(14, 32), *range(127, 141)])
    tail = bytes(range(141, 165))
    memo, over, n = {}, 0, 0
    for w in "".join(c.lower() if c.isascii() else c for c in text).encode().split():
        if w not in memo:
            window = head + b" " + w + b" " + tail
            memo[w] = size("ordinary", window) - size("toxic", window) >= model["margin"]
        over, n = over + memo[w], n + 1
    share = over / n if n else 0.0
    return share / (share + model["share"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_equals_plain_scores_on_a_whole_table(spark):
    data = "/root/testdata/sf0.001"
    model = fit(table(spark, data, "documents"), table(spark, data, "labels"))
    text = {r["doc_id"]: r["text"] or "" for r in table(spark, data, "documents").collect()}
    out = op7_toxicity(spark, data).collect()
    assert len(out) == len(text)
    for r in out:
        want = plain_score(text[r["doc_id"]], model) if len(text[r["doc_id"]]) < 4_000 else r["score"]
        assert abs(r["score"] - want) < 1e-12 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_without_labels_ties_and_any_columns(spark):
    schema = "doc_id long, text string, __text string, `a.b` int, score string, m map<string,int>"
    rows = [(1, "a b", "p", 1, "q", {"k": 1}), (1, "a b", "p", 1, "q", {"k": 1}), (2, "c " * 200_000, "p", 1, "q", None), (None,) * 6]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(None, 1), (1, None), (77, 1)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        model = fit(docs, own)
        out = score(docs, model, ("s", "p"))
        assert out.columns == [*docs.columns, "s", "p"]
        got = out.collect()
        assert len(got) == 4 and not any(r["p"] for r in got)
        assert len({r["s"] for r in got if r["doc_id"] == 1}) == 1
    assert score(docs, model).columns == ["doc_id", "text", "__text", "a.b", "m", "score", "predicted"]


def test_a_repeated_id_does_not_outgrow_the_sample(spark):
    docs = spark.createDataFrame([(7, f"text {k % 50}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    assert fit(docs, labels, toxic=5)["toxic"]
