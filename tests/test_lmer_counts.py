"""Counts of l-mers: equal to a plain form for windows of any length and letters, without a row a window."""

import random
import re
from contextlib import redirect_stdout
from io import StringIO

import pytest

from jobs import lmer_index
from kinweave.operators import similarity as sim


def plain(seqs, l):
    n, n_seqs = {}, {}
    for s in seqs:
        own = [s[i : i + l] for i in range(len(s) - l + 1) if "X" not in s[i : i + l]]
        for w in own:
            n[w] = n.get(w, 0) + 1
        for w in set(own):
            n_seqs[w] = n_seqs.get(w, 0) + 1
    return sorted((w, n[w], n_seqs[w]) for w in n)


def made(letters, seed=5):
    rng = random.Random(seed)
    seqs = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 4, 60, 200]))) for _ in range(60)]
    return seqs + seqs[:5] + [""]


@pytest.mark.parametrize("letters", ["ACX", "ACDEFGHIKLMNPQRSTVWYX", "aé😀\0X\n"])
@pytest.mark.parametrize("l", [1, 4, 13, 40])
def test_counts_of_a_block(letters, l):
    got = sim._counted(made(letters), l).to_pydict()
    assert sorted(zip(got["kmer"], got["n"], got["n_seqs"], strict=True)) == plain(made(letters), l)


def test_counts_over_blocks(spark, monkeypatch):
    """Sequences that go in many blocks count once each, null ones not at all."""
    monkeypatch.setattr(sim, "LETTERS", 100)
    assert [len(b) for b in sim._blocks(sim.pa.array(["A" * 60, None, "A" * 60, "A"]))] == [3, 1]
    seqs = made("ACDEFGHIKLMNPQRSTVWYX")
    df = spark.createDataFrame([(s,) for s in [*seqs, None]], "seq string").repartition(3)
    assert sorted(map(tuple, sim.lmer_counts(df).collect())) == plain(seqs, 4)


def test_index_makes_no_row_a_window(spark):
    """Each text is cleaned once, and windows are counted before any row of theirs is made."""
    docs = spark.createDataFrame([(1, "MKVLAAGIV" * 3)], "doc_id long, text string")
    out = StringIO()
    with redirect_stdout(out):
        lmer_index.counts(docs, lmer_index.Settings()).explain()
    assert "Generate" not in out.getvalue()
    assert len(re.findall(r"regexp_replace", out.getvalue())) == 1


def test_index_writes_few_files_a_head(spark, tmp_path):
    """However many partitions counts are shuffled to, a batch writes a few files for each head."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ACDE") for _ in range(300))) for i in range(50)]
    batch = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"]
    before = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set(names[0], "40")
        spark.conf.set(names[1], "false")  # as in a stream
        lmer_index.add_batch(batch, 0, lmer_index.Settings(output=str(tmp_path)))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(list((tmp_path / "counts" / "batch=0" / "head=A").glob("*.parquet"))) <= 8
    assert sorted(map(tuple, lmer_index.index(spark, str(tmp_path)).collect())) == plain([r[1] for r in rows], 4)
