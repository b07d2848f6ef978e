import os
import random
import re

import pytest

from kinweave.llm.license_rules import BASE, KINDS, rules
from kinweave.llm.licenses import Scanner, op11_licenses, scan_documents, words_of

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def samples(regex):
    """A shortest and a longest string that a rule's regex matches, by its parse tree."""
    from re import _constants as C
    from re import _parser as P

    def make(nodes, much):
        out = ""
        for op, av in nodes:
            if op is C.LITERAL:
                out += chr(av)
            elif op is C.NOT_LITERAL:
                out += "q"
            elif op is C.IN:
                out += "q" if av[0][0] is C.NEGATE else chr(av[-1 if much else 0][1])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                lo, hi, inner = av
                out += make(inner, much) * (min(hi, max(lo, 2)) if much else lo)
            elif op is C.SUBPATTERN:
                out += make(av[3], much)
            elif op is C.BRANCH:
                out += make(av[1][-1 if much else 0], much)
            else:
                raise AssertionError(op)
        return out

    tree = P.parse(regex)
    return {make(tree, False), make(tree, True)}


def plain(text):
    """The same by words and by comparing every two detections; no keywords, no staircase."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    line = " ".join(words)
    order = {kind: k for k, kind in enumerate(KINDS)}
    all_rules = [(label, "name", "", phrase) for phrase, label in BASE.items()] + rules()
    found = []
    for k, (_, kind, _, regex) in enumerate(all_rules):
        for m in re.finditer(f"(?<![^ ])(?:{regex})(?![^ ])", line):
            a, b = m.span(1) if m.re.groups else m.span()
            found.append((line.count(" ", 0, a), line.count(" ", 0, b) + 1, order[kind], k))
    kept = []
    for s, e, p, k in found:
        over = [x for x in found if x[0] <= s and e <= x[1] and (x[2], -(x[1] - x[0]), x[3]) < (p, -(e - s), k)]
        if not over:
            kept.append((s, e, p, k))
    if any(p < order["hint"] for _, _, p, _ in kept):
        kept = [x for x in kept if x[2] < order["hint"]]
    places = [i for phrase in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = {label for phrase, label in BASE.items() if f" {phrase} " in f" {line} "}
    labels = base | {all_rules[k][0] for *_, k in kept}
    score = max((list(KINDS.values())[p] for _, _, p, _ in kept), default=0.0)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_rules_and_keywords():
    """Hundreds of rules, and each lets its own matches through its keyword."""
    scanner = Scanner()
    assert len(rules()) > 250 and len({r[3] for r in rules()}) == len(rules())
    for k, (label, kind, keyword, regex) in enumerate(scanner.rules):
        assert kind in KINDS
        for s in samples(regex):
            line = f"zz {s} yy".encode()
            assert keyword in s, (keyword, s)
            assert any(m[2] == k for m in scanner.matches(line)), (regex, s)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_over_the_whole_table(spark):
    want = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op11_licenses(spark, DATA).collect()}
    assert got == want
    assert any(r[1] for r in want.values())


def test_texts_of_rules(spark):
    """Texts put together from the rules' own words, held against the plain form."""
    rng = random.Random(5)
    stock = [s for _, _, _, regex in rules() for s in samples(regex)] + list(BASE) + ["the", "İ", "é", "by", "cc", "gnu", "mit", "license", "2 0", "apache"]
    rows = []
    for i in range(400):
        sep = rng.choice([" ", "\n", "-", ", ", "\x00"])
        text = sep.join(sep.join(rng.choice(stock).split(" ")) for _ in range(rng.randint(1, 25)))
        rows.append((i, text.title() if i % 3 == 0 and text.isascii() else text))
    got = {r["doc_id"]: (r, tuple(",".join(r[c]) if c.endswith("labels") else r[c] for c in COLUMNS)) for r in scan_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i][1] == plain(text), text
    longest = max(rows, key=lambda r: len(got[r[0]][0]["detections"]))
    words = words_of(longest[1].encode())
    for d in got[longest[0]][0]["detections"]:
        line = b" ".join(words[d["first_word"] : d["first_word"] + d["n_words"]])
        if d["kind"] != "tag":  # of a tag only the identifier is shown
            assert re.fullmatch(Scanner().rules[d["rule"]][3], line.decode("latin-1"))


def test_known_lines():
    def labels(text):
        scanner = Scanner()
        _, base, kept = scanner.scan(text.encode())
        return sorted({scanner.rules[k][0] for *_, k in base}), sorted({scanner.rules[k][0] for *_, k in kept})

    assert labels("Released under the MIT License.") == (["mit"], ["mit"])
    assert labels("Licensed under the Apache License, Version 2.0.") == (["apache"], ["apache-2.0"])
    assert labels("This work is licensed under the GNU General Public License, version 3.") == (["gpl"], ["gpl-3.0"])
    assert labels("Licensed under CC BY-NC 4.0.") == (["cc-by"], ["cc-by-nc-4.0"])
    assert labels("// SPDX-License-Identifier: MIT OR Apache-2.0") == ([], ["apache-2.0", "mit"])
    assert labels("GNU Lesser General Public License v2.1") == ([], ["lgpl-2.1"])
    assert labels("committee for permits, a commitment") == ([], [])
    assert labels("see the license file") == ([], ["license-notice"])


def test_odd_rows(spark):
    long = "word MIT License " * 100_000
    df = spark.createDataFrame([(None, None, 1, "k"), (1, "", 2, "k"), (1, "", 2, "k"), (2, long, 3, None)], "doc_id long, text string, n_words int, `a.b` string")
    got = sorted(scan_documents(df).collect(), key=lambda r: r["n_words"])
    assert got[0].asDict().keys() == {"doc_id", "text", "a.b", *COLUMNS, "detections"}
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in got[:3]] == [(0, 0, None, None, [], [], 0.0)] * 3
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["labels"], got[3]["score"]) == (300_000, 100_000, 1, 299_998, ["mit"], 0.7)
    assert scan_documents(df.limit(0)).collect() == []
