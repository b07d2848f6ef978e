import os
import random

import pytest
from pyspark.sql import functions as F

from kinweave.llm.common import table
from kinweave.llm.toxicity import Compressor, dictionaries, fit, held_out, score, train

DATA = "/root/testdata/sf0.01"
RNG = random.Random(5)
ORDINARY = ["an", "the", "er", "on", "re", "st", "in", "sh"]


def _word():
    return "".join(RNG.choice(ORDINARY) for _ in range(RNG.randint(1, 4)))


def _texts(n, bad, times):
    texts = []
    for _ in range(n):
        text = [_word() for _ in range(200)]
        for _ in range(times if bad else 0):
            text[RNG.randrange(200)] = RNG.choice(bad)
        texts.append(" ".join(text))
    return texts


def test_toxic_dictionary_holds_all_marks():
    bad = ["".join(RNG.choice("bcdfgjklmpqvwxz") + RNG.choice("aiouy") for _ in range(5)) for _ in range(300)]
    model = train(_texts(1200, bad, 24), _texts(600, [], 0))
    assert sum(w.encode() in model["toxic"] for w in bad) > 280
    own = Compressor(model["toxic"], model["ordinary"])
    assert sum(own.margin(w.encode()) >= model["margin"] for w in bad) > 260


def test_margins_of_ordinary_words_do_not_hang_on_the_number_of_marks():
    stock = ["".join(RNG.choice("bcdfgjklmpqvwxz") + RNG.choice("aiouy") for _ in range(5)) for _ in range(40)]
    usual, fine = ["of", "a", "to", "in", "|", "is", "and"], _texts(200, [], 0)
    for n in (2, 10, 40):
        own = Compressor(*dictionaries(_texts(60, stock[:n], n), fine))
        assert max(own.margin(w.encode()) for w in usual) < 5
        assert min(own.margin(w.encode()) for w in stock[:n]) >= 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_few_labels_do_not_make_all_toxic(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels").select("doc_id", "toxic").distinct()
    held = score(docs.join(labels, "doc_id"), fit(docs, labels)).where(held_out(F.col("doc_id"))).select("toxic", "predicted").collect()
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert len(clean) > 40 and sum(clean) < 0.2 * len(clean)
    found = [r["predicted"] for r in held if r["toxic"] == 1]
    assert sum(found) >= 0.8 * len(found)
