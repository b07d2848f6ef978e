"""Ancestors of all terms and of some, by paths that double, against plain walks; pairs of a tree are made once."""

import random

from kinweave.operators import evaluation as ev


def above(edges, term):
    up, seen = {}, set()
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    todo = list(up.get(term, ()))
    while todo:
        if (t := todo.pop()) not in seen:
            seen.add(t)
            todo += up.get(t, ())
    return seen


def test_chains_branches_and_cycles(spark):
    rng = random.Random(3)
    edges = [(f"c{k}", f"c{k + 1}") for k in range(37)] + [(f"d{rng.randrange(20, 40)}", f"d{rng.randrange(20)}") for _ in range(60)]
    edges += [(f"e{k}", f"e{(k + 1) % 7}") for k in range(7)] + [("e3", "x"), ("y", "e0"), ("s", "s"), ("s", "c5")]
    df = spark.createDataFrame(edges, "child string, parent string")
    terms = {t for e in edges for t in e}
    want = {(t, a) for t in terms for a in above(edges, t)}
    assert {tuple(r) for r in ev.ancestors(df).collect()} == want
    asked = spark.createDataFrame([("c30",), ("e5",), ("y",), ("d25",), ("none",)], "term string")
    some = {tuple(r) for r in ev.ancestors(df, asked).collect()}
    assert some == {(t, a) for t, a in want if t in {"c30", "e5", "y", "d25", "none"}}


def test_each_pair_of_a_tree_once(spark, monkeypatch):
    """Rows written over all rounds of a heap of 1,023 terms: with pairs made anew from each split of their paths they were several times the result."""
    made = []
    steps = ev._steps

    def counted(x, y):
        out = steps(x, y)
        made.append(out.count())
        return out

    monkeypatch.setattr(ev, "_steps", counted)
    edges = spark.createDataFrame([(k, k >> 1) for k in range(2, 1024)], "child long, parent long")
    n = ev.ancestors(edges).count()
    assert n == sum((k.bit_length() - 1) for k in range(2, 1024)) and sum(made) < 1.5 * n
