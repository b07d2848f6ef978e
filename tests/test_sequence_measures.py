"""Measures of sequences: equal to plain forms; the catalogue takes each text once."""

import random

from pyspark.sql import functions as F

from jobs import sequence_catalogue
from kinweave.functions.residues import protein, total_weight
from kinweave.operators import similarity as sim


def test_measures(spark, monkeypatch):
    monkeypatch.setattr(sim, "LETTERS", 100)
    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWYXXbé😀") for _ in range(rng.choice([0, 1, 4, 30, 150]))) for _ in range(80)]
    df = spark.createDataFrame([(s,) for s in [*seqs, "", None]], "seq string").repartition(3)
    for matrix, l in (("BLOSUM62", 4), ("BLOSUM80", 2), ("BLOSUM45", 20)):
        of = sim.measures(F.col("seq"), matrix, l)
        rows = df.select("seq", of.alias("of"), total_weight(F.col("seq"), matrix).alias("weight")).collect()
        assert len(rows) == 82
        for r in rows:
            s = r["seq"] or ""
            own = {s[i : i + l] for i in range(len(s) - l + 1) if "X" not in s[i : i + l]}
            assert (r["of"]["weight"], r["of"]["n_lmers"]) == (r["weight"], len(own))


def test_catalogue_takes_each_text_once(spark, tmp_path, monkeypatch):
    """However often rows are asked for, to weigh organisms and to write, a text is cleaned once a run."""
    taken = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        taken.add(1)
        return text

    monkeypatch.setattr(sequence_catalogue, "protein", lambda text: protein(noted(text)))
    docs = str(tmp_path / "docs")
    rows = [(i, "MKVLAAGIVC" * (i % 3), "en", f"s{i % 2}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(docs)
    got = sequence_catalogue.run(spark, sequence_catalogue.Settings(docs, str(tmp_path / "out")))
    assert got.count() == 30 and got.where("status = 'kept'").count() == 20
    assert taken.value == 30
