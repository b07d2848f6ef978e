"""Toxicity by compression distance.

Two zstandard dictionaries are put together by hand (zstandard's trainer is not
used), one of toxic and one of ordinary words.
A window is compressed with each; how many bytes fewer the toxic dictionary
needs is its margin. A document's score rises with the share of its windows
whose margin reaches a threshold; threshold and share are calibrated on labelled
documents that the dictionaries have not seen.

Labels hold for whole documents and most of a toxic document is ordinary prose,
so the toxic training text is first narrowed to the words (or word beginnings)
that toxic documents have and ordinary ones hardly ever do. A window is one
word between a head and a tail that both dictionaries hold: they carry the fixed
cost of a compressed block, and zstandard begins no match in a block's last
bytes.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import cut, own_columns, place_of, placed, renamed, table, text_of

#: Bounds of the training sample: documents of either label, and characters of each.
TOXIC, ORDINARY, LONGEST = 1_500, 4_000, 20_000
FOLDS = 5
DICTIONARY = 1_000
#: The ordinary dictionary holds so many times as much, so that common syllables cost least in it.
WIDER = 30
HEAD = bytes(range(1, 9)) + bytes(range(14, 32)) + bytes(range(127, 141))
TAIL = bytes(range(141, 165))
MEMO = 300_000


def held_out(doc_id: Column) -> Column:
    """Whether the label of the document may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _keys(word: bytes) -> set[bytes]:
    """The word without final marks, and its beginnings of 4 to 8 bytes."""
    word = word.strip(b".,;:!?\"'()")
    return {word} | {word[:k] for k in range(4, min(9, len(word)))}


class Compressor:
    """Margins of windows under two raw-content dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        how = z.ZstdCompressionParameters(
            window_log=17,
            hash_log=14,
            chain_log=14,
            search_log=6,
            min_match=3,
            target_length=32,
            strategy=z.STRATEGY_BTULTRA2,
            format=z.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=0,
            write_checksum=0,
            write_dict_id=0,
        )
        raw = [z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT) for d in (toxic, ordinary)]
        self.toxic, self.ordinary = (z.ZstdCompressor(dict_data=d, compression_params=how).compress for d in raw)
        self.memo: dict[bytes, int] = {}

    def margin(self, word: bytes) -> int:
        m = self.memo.get(word)
        if m is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            window = HEAD + b" " + word + b" " + TAIL
            m = self.memo[word] = len(self.ordinary(window)) - len(self.toxic(window))
        return m

    def margins(self, text: str) -> np.ndarray:
        margin = self.margin
        return np.array([margin(w) for w in words(text)], np.int64)


def _dictionary(pieces: list[bytes], size: float = math.inf, least: int = 0) -> bytes:
    """Pieces by falling weight fill the dictionary from its end, where offsets are cheapest; as many as `size` holds.

    What a match costs depends on the dictionary's length: bytes that no text
    has fill it up to `least`, so that margins mean the same with few pieces.
    """
    out, n = [], 0
    for p in pieces:
        if n + len(p) + 1 > size:
            break
        out.append(b" " + p)
        n += len(p) + 1
    filler = bytes(random.Random(9).choices(range(248, 256), k=max(0, least - n)))
    return TAIL + filler + b"".join(reversed(out)) + b" " + HEAD


def dictionaries(toxic: list[str], ordinary: list[str], size: int = DICTIONARY) -> tuple[bytes, bytes]:
    """The contents of both dictionaries.

    The toxic one holds the words and beginnings that more toxic documents have
    than chance allows (log-likelihood ratio against the number of candidates),
    however many; the ordinary one the commonest words of ordinary documents, in
    WIDER times `size` bytes.
    """
    in_toxic: Counter = Counter()
    for x in toxic:
        in_toxic.update(set().union(*map(_keys, set(words(x)))))
    in_toxic = Counter({k: n for k, n in in_toxic.items() if n >= max(3, len(toxic) / 150) and k})
    in_ordinary: Counter = Counter()
    common: Counter = Counter()
    for x in ordinary:
        own = set(words(x))
        common.update(w.strip(b".,;:!?\"'()") for w in own)
        in_ordinary.update(k for k in set().union(*map(_keys, own)) if k in in_toxic)
    part, least = len(toxic) / max(1, len(toxic) + len(ordinary)), 2 * math.log(max(2, len(in_toxic))) + 4

    def strength(k: bytes) -> float:
        a, b = in_toxic[k], in_ordinary[k]
        return 2 * sum(n * math.log(n / ((a + b) * p)) for n, p in ((a, part), (b, 1 - part)) if n)

    marks = {k for k, n in in_toxic.items() if n / len(toxic) > 20 * in_ordinary[k] / max(1, len(ordinary)) and strength(k) > least}
    longer = defaultdict(list)
    for k in marks:
        for n in range(4, len(k)):
            if k[:n] in marks:
                longer[k[:n]].append(k)

    def grown(k: bytes) -> bytes:
        """The longest mark that begins with k and is hardly rarer."""
        while same := [q for q in longer[k] if in_toxic[q] >= 0.9 * in_toxic[k]]:
            k = max(same, key=lambda q: (len(q), q))
        return k

    bad = _dictionary(sorted({grown(k) for k in marks}, key=lambda k: (-in_toxic[k], k)), least=size)
    fine = _dictionary([w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])) if len(w) > 3 and w not in marks], WIDER * size)
    return bad, fine


def train(toxic: list[str], ordinary: list[str], size: int = DICTIONARY) -> dict:
    """Labelled texts -> {toxic, ordinary: dictionaries, margin, share: thresholds}.

    Thresholds are calibrated on a quarter of the texts with dictionaries of the
    other three; the dictionaries are then trained on all. Of thresholds
    with the best F1, the nearest to a margin of 5 and a share of 0.003 are
    taken, at any number of texts.
    """
    toxic, ordinary = toxic[:], ordinary[:]
    random.Random(7).shuffle(toxic)
    random.Random(8).shuffle(ordinary)
    cut_t, cut_o = len(toxic) - len(toxic) // 4, len(ordinary) - len(ordinary) // 4
    own = Compressor(*dictionaries(toxic[:cut_t], ordinary[:cut_o], size))
    judged = [(1, own.margins(x)) for x in toxic[cut_t:]] + [(0, own.margins(x)) for x in ordinary[cut_o:]]
    best = (0.0, 0, 0, 5, 0.003)
    for margin in range(3, 8):
        shares = [(y, (m >= margin).sum() / max(1, len(m))) for y, m in judged]
        for share in (0.001, 0.002, 0.003, 0.005, 0.01):
            hit = sum(y for y, s in shares if s >= share)
            said = sum(s >= share for _, s in shares)
            f1 = 2 * hit / max(1, said + sum(y for y, _ in shares))
            best = max(best, (f1, -abs(margin - 5), -abs(math.log(share / 0.003)), margin, share))
    bad, fine = dictionaries(toxic, ordinary, size)
    return {"toxic": bad, "ordinary": fine, "margin": best[3], "share": best[4]}


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY, longest: int = LONGEST) -> dict:
    """Train on a bounded sample: per label the ids of least hash, none held out; of these, documents up to `longest` characters.

    Null ids and labels are not learnt from; an id with both labels counts for
    both. Without any labelled text of either kind the model finds nothing.
    """
    free = labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    pick = lambda y, n: free.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, toxic).unionAll(pick(0, ordinary))
    rows = placed(docs).select(F.col(place_of(docs, "doc_id")).alias("doc_id"), text_of(place_of(docs, "text")).alias("text"))
    sample = rows.where(F.length("text") <= longest).join(F.broadcast(ids), "doc_id").select("toxic", "text")
    # an id that many rows share counts once a distinct text, and no more texts than the bounds are gathered
    sample = cut(sample.distinct(), "sample")
    first = lambda y, n: sample.where(F.col("toxic") == y).orderBy(F.xxhash64("text"), "text").limit(n)
    got = [tuple(r) for r in first(1, toxic).unionAll(first(0, ordinary)).collect()]
    return train(sorted(t for y, t in got if y == 1), sorted(t for y, t in got if y == 0))


def score(docs: DataFrame, model: dict, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Rows of docs plus a score and a prediction under the given names; only the text counts.

    With s the share of windows at or over the margin, the score is
    s / (s + share): one half just at the calibrated share. Null and empty texts
    score 0; texts of any length are scored whole. Other columns pass through
    whatever their names and types; those of the added names are replaced. An
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the dictionaries of a bounded sample
    own = own_columns(docs, names)
    kept = placed(docs).select(*own, text_of(place_of(docs, "text")).alias("text"))
    fields = [f for f in kept.schema if f.name != "text"]
    schema = T.StructType([*fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        compressor = Compressor(m["toxic"], m["ordinary"])
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                got = compressor.margins(text.as_py())
                part = float((got >= m["margin"]).mean()) if len(got) else 0.0
                scores.append(part / (part + m["share"]))
            s = np.array(scores, float)
            added = [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *added], names=[*own, *names])

    return renamed(kept.mapInArrow(run, schema), docs, names)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
