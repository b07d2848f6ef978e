"""License scan by ordered signature rules.

A text's words in lower case, one space between them, are searched for the
keywords of all rules at once; only rules whose keyword is there are run, each
over the whole text. Their matches are detections, intervals of words. A
detection goes if one of a stronger kind, or a longer or earlier rule's of its
own kind, contains its interval; hints count only in documents where nothing
stronger is found. The phrases of `license_rules.BASE` are rules as well, and
their labels stay whatever suppresses their detections.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import own_columns, place_of, placed, renamed, table, text_of
from kinweave.llm.license_rules import BASE, KINDS, rules

# Bytes that words are made of, in lower case; all others separate them.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
DETECTION = "label string, kind string, rule int, first_word long, n_words long"
SCANNED = f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, detections array<struct<{', '.join(x.replace(' ', ':') for x in DETECTION.split(', '))}>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Scanner:
    """The rules, compiled once a task."""

    def __init__(self):
        base = [(label, "name", phrase.split()[0], phrase) for phrase, label in BASE.items()]
        self.rules = base + rules()
        self.base = len(base)
        self.kinds = list(KINDS)
        self.level = [self.kinds.index(kind) for _, kind, _, _ in self.rules]
        self.regex = [re.compile(b"(?<![^ ])(?:" + regex.encode() + b")(?![^ ])") for _, _, _, regex in self.rules]
        gates: dict[str, list[int]] = {}
        for k, (_, _, keyword, _) in enumerate(self.rules):
            gates.setdefault(keyword.encode().decode("latin-1"), []).append(k)
        self.gate = ahocorasick.Automaton()
        for keyword, own in gates.items():
            self.gate.add_word(keyword, tuple(own))
        self.gate.make_automaton()

    def matches(self, line: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of every match of every rule, in bytes; of a rule with a group, the group's."""
        open_ = {own for _, own in self.gate.iter(line.decode("latin-1"))}
        return [(*m.span(m.re.groups), k) for k in sorted(k for own in open_ for k in own) for m in self.regex[k].finditer(line)]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(words, base detections, detections that are kept), detections as (first word, word after the last, rule)."""
        words = words_of(text)
        line = b" ".join(words)
        found = self.matches(line)
        at, n, before = {}, 0, 0
        for place in sorted({p for s, e, _ in found for p in (s, e)}):
            n, before = n + line.count(b" ", before, place), place
            at[place] = n
        found = sorted((at[s], at[e] + 1, k) for s, e, k in found)
        return len(words), [x for x in found if x[2] < self.base], self.settle(found)

    def settle(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Detections that none of a stronger kind, nor a longer or earlier one of their kind, contains."""
        kept: list[tuple[int, int, int]] = []
        starts: list[int] = []  # of kept ones, ascending, with the farthest end up to each
        ends: list[int] = []
        for level in range(len(self.kinds)):
            if kept and self.kinds[level] == "hint":
                break
            own, far = [], -1
            for s, e, k in sorted((x for x in found if self.level[x[2]] == level), key=lambda x: (x[0], -x[1], x[2])):
                i = bisect_right(starts, s)
                if e > far and not (i and ends[i - 1] >= e):
                    own.append((s, e, k))
                far = max(far, e)
            kept += own
            starts, ends = [], []
            for s, e, _ in sorted(kept):
                starts.append(s)
                ends.append(max(e, ends[-1] if ends else e))
        return sorted(kept)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Rows of docs plus what the rules find in their whole texts.

    Added: n_words, n_base (places of base phrases), first_word and last_word
    (their smallest and largest start, null for none), base_labels and labels
    (sorted, each once; base labels are among labels), score (confidence of the
    surest detection, 0 for none) and detections. Null text counts as empty and
    has no words. Equal texts get equal results. Other columns pass through
    whatever their names and types, and columns of the added names are replaced.
    An empty table gives no rows.
    """
    added = T._parse_datatype_string(SCANNED)
    names = added.names
    own = own_columns(docs, names)
    source = placed(docs).select(*own, text_of(place_of(docs, "text")).alias("text"))
    schema = T.StructType([f for f in source.schema if f.name != "text"] + added.fields)
    detection = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("rule", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), detection]

    def row(scanner: Scanner, text: bytes) -> tuple:
        n, base, kept = scanner.scan(text)
        starts = [s for s, _, _ in base]
        label = lambda some: {scanner.rules[k][0] for _, _, k in some}
        sure = max((KINDS[scanner.rules[k][1]] for _, _, k in kept), default=0.0)
        shown = [dict(label=scanner.rules[k][0], kind=scanner.rules[k][1], rule=k, first_word=s, n_words=e - s) for s, e, k in kept]
        return n, len(base), min(starts, default=None), max(starts, default=None), sorted(label(base)), sorted(label(base) | label(kept)), sure, shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [row(scanner, t.as_py()) for t in batch.column("text").cast(pa.binary())]
            new = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], names=[*own, *names])

    return renamed(source.mapInArrow(run, schema), docs, names)


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")
