"""Both jobs: against SQL over whole tables, run again, over growing input and after a failure."""

import json
import os
import random

import pytest

from jobs import lmer_index, sequence_catalogue
from jobs.queries import JOB_SQL, QUERIES
from jobs.settings import settings
from tests.test_queries import DATA, con, rows_of  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def files_under(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):  # noqa: F811
    df = QUERIES[name](spark, DATA)
    want = con.execute(JOB_SQL[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == sorted(df.columns)
    assert rows_of(df.select(*order).collect()) == rows_of(want.fetchall())


def plain_index(texts, l=4):
    n, seqs = {}, {}
    for t in texts:
        s = "".join(c for c in (t or "").upper() if c.isascii() and c.isalpha() and c not in "BJOUZ")
        if len(s) < 10:
            continue
        own = [s[i : i + l] for i in range(len(s) - l + 1) if "X" not in s[i : i + l]]
        for w in own:
            n[w] = n.get(w, 0) + 1
        for w in set(own):
            seqs[w] = seqs.get(w, 0) + 1
    return sorted((w, n[w], seqs[w]) for w in n)


def made(rng, ids):
    words = ["gene", "family", "Protein", "kinase", "x-ray", "wild type", "é", "acid", "1.0"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) if i % 7 else None, "en", f"s{i % 3}", 0) for i in ids]


def test_index_grows_with_its_input(spark, tmp_path):
    rng = random.Random(1)
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    first, second = made(rng, range(60)), made(rng, range(60, 100))
    spark.createDataFrame(first + first[:5], DOCS).repartition(3).write.mode("append").parquet(docs)
    config = lmer_index.Settings(docs, out, state="memory", files_a_batch=2)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = lmer_index.run(spark, config)
    assert sorted(map(tuple, got.collect())) == plain_index([r[1] for r in first])
    written = files_under(out)
    # nothing new: nothing is written again
    assert sorted(map(tuple, lmer_index.run(spark, config).collect())) == plain_index([r[1] for r in first])
    assert [f for f in files_under(out) if "batch=" in f] == [f for f in written if "batch=" in f]
    # new documents and, again, old ones
    spark.createDataFrame(second + first[10:30], DOCS).repartition(2).write.mode("append").parquet(docs)
    assert sorted(map(tuple, lmer_index.run(spark, config).collect())) == plain_index([r[1] for r in first + second])
    assert set(written) <= set(files_under(out))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_index_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch that fails after it wrote is written again, and counted once."""
    rng = random.Random(2)
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    rows = made(rng, range(40))
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(docs)
    config = lmer_index.Settings(docs, out, str(tmp_path / "mark"), state="memory", files_a_batch=2)
    real = lmer_index.add_batch

    def failing(batch, number, config_):
        real(batch, number, config_)
        if number == 1:
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(lmer_index, "add_batch", failing)
    with pytest.raises(Exception, match="lost after writing"):
        lmer_index.run(spark, config)
    monkeypatch.setattr(lmer_index, "add_batch", real)
    assert sorted(map(tuple, lmer_index.run(spark, config).collect())) == plain_index([r[1] for r in rows])


def test_index_of_nothing(spark, tmp_path):
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(None, None, None, None, None)], DOCS).write.parquet(docs)
    assert lmer_index.run(spark, lmer_index.Settings(docs, str(tmp_path / "out"))).collect() == []


def test_catalogue_is_replaced_whole(spark, tmp_path):
    rng = random.Random(3)
    out = str(tmp_path / "out")
    rows = made(rng, range(30)) + [(None, None, None, None, None), (7, "x", "", "", 1), (7, "MKV" * 20_000, "de", "", 1)]
    for some in (rows, rows[:20], rows):
        docs = str(tmp_path / f"docs{len(some)}")
        spark.createDataFrame(some, DOCS).write.mode("overwrite").parquet(docs)
        got = sequence_catalogue.run(spark, sequence_catalogue.Settings(docs, out)).collect()
        assert len(got) == len(some)
        kept = [r for r in got if r["status"] == "kept"]
        assert abs(sum(r["weight"] for r in kept) - len(kept)) < 1e-9
        assert all((r["reason"] is None) == (r["status"] == "kept") for r in got)
    long = next(r for r in got if r["n_residues"] == 60_000)
    assert (long["organism"], long["lang"], long["self_score"], long["n_lmers"]) == ("Unknown", "de", 20_000 * (5 + 5 + 4), 3)
    organisms = {r["organism"]: r["n_sequences"] for r in spark.read.parquet(f"{out}/organisms").collect()}
    assert sum(organisms.values()) == len(kept) and organisms["Unknown"] == 1


def test_settings(tmp_path):
    at = tmp_path / "c.json"
    at.write_text(json.dumps({"l": 5, "output": "o"}))
    got = settings(lmer_index.Settings, ["--config", str(at), "--documents", "d", "--min-len", "12"], "")
    assert (got.documents, got.output, got.l, got.min_len) == ("d", "o", 5, 12)
    with pytest.raises(SystemExit):
        settings(lmer_index.Settings, ["--config", str(at)], "")
    at.write_text(json.dumps({"odd": 1}))
    with pytest.raises(SystemExit):
        settings(lmer_index.Settings, ["--config", str(at), "--documents", "d"], "")
