"""Byte-level BPE over whole texts, long ones by tree concatenation.

Texts over `leaf` characters are halved until the parts fit; the leaves of a
batch are encoded together. Joined bottom-up, a window of tokens around each
join is encoded again and grows until it agrees with the left part at its
start and with the right part after the join; tokens outside stay as they are.

Two kinds of place count as agreement. Either both sides begin a pretoken
there, far enough from the end of what each side has seen that lookahead
cannot change it. Or, within a long run of letters or of digits, both have the
same token: a run's encoding is right exactly when each two neighbouring
tokens encode to themselves, and every such pair is in one of the sides.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kinweave.llm.common import own_columns, place_of, placed, renamed, table, text_of

LEAF = 16_384
SLICE = 128
#: Bytes that lookahead, a contraction or a special token can reach across.
REACH = 64
DEEP = 4


def default_vocabulary() -> str:
    """The vocabulary as text; 1.5 MB, whatever the corpus."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def _kind(c: str) -> str:
    """L or N for letters and digits whose class no Unicode version disputes, else nothing."""
    k = unicodedata.ucd_3_2_0.category(c)[0]
    return k if k in "LN" and unicodedata.category(c)[0] == k else ""


#: Fixed value: how byte-level vocabularies of this kind split text into pretokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(tok):
    """The same vocabulary as ranks, for a faster encoder of equal results; None unless ids go in merge order."""
    import tiktoken

    spec = json.loads(tok.to_str())
    model, pre, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and spec["normalizer"] is None
    level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    exact = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if not (plain and level and exact) or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=special)


class TreeEncoder:
    """Encodes as the vocabulary's own library does on the whole text."""

    def __init__(self, vocabulary: str, leaf: int = LEAF, window: int = 32):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(vocabulary)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf, self.window = max(2, leaf), window
        special = {i: len(t.content.encode()) for i, t in self.tok.get_added_tokens_decoder().items()}
        n = self.tok.get_vocab_size()
        self.quick = _ranked(self.tok)
        self.bytes_of = np.array([special.get(i, len(self.tok.id_to_token(i) or "")) for i in range(n)], np.int64)

    def _short(self, texts: list[str]) -> list[list[int]]:
        if self.quick is not None:
            return [self.quick.encode(t, allowed_special="all") for t in texts]
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        if self.quick is not None:
            return self.quick.decode_bytes(ids).decode("utf-8", "replace")
        return self.tok.decode(ids, skip_special_tokens=False)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        for t in texts:
            at = len(parts)
            if len(t) > self.leaf:
                n = 1 << (-(-len(t) // self.leaf) - 1).bit_length()
                edge = [len(t) * i // n for i in range(n + 1)]
                parts += [t[a:b] for a, b in zip(edge, edge[1:], strict=False)]
            else:
                parts.append(t)
            spans.append((at, len(parts)))
        if len(parts) == len(texts):
            return self._short(parts)
        whole = [k for k, (a, b) in enumerate(spans) if b - a == 1]
        out: list[list[int]] = [[]] * len(texts)
        for k, ids in zip(whole, self._short([texts[k] for k in whole]), strict=True):
            out[k] = ids
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                nodes = [(*self._arrays(e), p.encode()) for e, p in zip(self.tok.encode_batch(parts[a:b], add_special_tokens=False), parts[a:b], strict=True)]
                while len(nodes) > 1:
                    nodes = [self._join(*nodes[i], *nodes[i + 1]) for i in range(0, len(nodes), 2)]
                out[k] = nodes[0][0].tolist()
        return out

    def _arrays(self, e) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and whether each begins a pretoken."""
        ids = np.array(e.ids, np.int64)
        word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        return ids, np.r_[True, (word[1:] != word[:-1]) | (word[1:] < 0)][: len(ids)]

    def _inside(self, text: bytes, at: int) -> bool:
        """Whether `at` lies deep within a run of letters or of digits."""
        if not 0 < at < len(text) or text[at] & 0xC0 == 0x80:
            return False
        before, after = text[max(0, at - 4 * DEEP) : at].decode(errors="ignore")[-DEEP:], text[at : at + 4 * DEEP].decode(errors="ignore")[:DEEP]
        kinds = {_kind(c) for c in before + after}
        return len(before) == len(after) == DEEP and len(kinds) == 1 and "" not in kinds

    def _join(self, a: np.ndarray, wa: np.ndarray, ta: bytes, b: np.ndarray, wb: np.ndarray, tb: bytes):
        text = ta + tb
        if not len(a) or not len(b):
            return np.r_[a, b], np.r_[wa, wb], text
        ea, eb = np.cumsum(self.bytes_of[a]), np.cumsum(self.bytes_of[b])
        sa, sb = ea - self.bytes_of[a], eb - self.bytes_of[b]
        w = self.window
        while True:
            left = self._left(a, wa, sa, ta, w)
            right = len(b) if w >= len(b) else self._clean(sb, tb, w)
            end = len(text) if right == len(b) else len(ta) + int(sb[right])
            begin = int(sa[left]) if left else 0
            e = self.tok.encode(text[begin:end].decode(), add_special_tokens=False)
            ids, starts = self._arrays(e)
            got = self._agree(a, wa, left, b, wb, sb, ids, starts, begin, end, len(ta), text)
            if got is not None:
                q, r = got
                return np.r_[a[:left], ids[:q], b[r:]], np.r_[wa[:left], self._starts(wa, left, starts)[:q], wb[r:]], text
            w *= 2

    @staticmethod
    def _starts(wa: np.ndarray, left: int, starts: np.ndarray) -> np.ndarray:
        out = starts.copy()
        if left:
            out[0] = wa[left]
        return out

    @staticmethod
    def _clean(s: np.ndarray, text: bytes, at: int) -> int:
        while at < len(s) and text[s[at]] & 0xC0 == 0x80:
            at += 1
        return at

    def _left(self, a: np.ndarray, wa: np.ndarray, sa: np.ndarray, ta: bytes, w: int) -> int:
        """Where the window starts: a sure pretoken start, else a place inside a run, else 0."""
        for at in range(len(a) - w, max(0, len(a) - 2 * w), -1):
            if wa[at] and len(ta) - sa[at] > REACH and wa[at + 1 :].sum() >= 4:
                return at
        for at in range(len(a) - w, max(0, len(a) - 2 * w), -1):
            if not wa[at] and len(ta) - sa[at] > REACH and self._inside(ta, int(sa[at])):
                return at
        return 0

    def _agree(self, a, wa, left, b, wb, sb, ids, starts, begin, end, seam, text) -> tuple[int, int] | None:
        """(tokens of the window to take, first token of b to take after them)."""
        if left and not wa[left] and (not len(ids) or ids[0] != a[left]):
            return None
        if end == len(text):
            return len(ids), len(b)
        s = begin + np.cumsum(self.bytes_of[ids]) - self.bytes_of[ids]
        at_b = seam + sb
        first = int(np.searchsorted(s, seam, "left"))
        place = np.searchsorted(at_b, s[first:])
        later = np.cumsum(starts[::-1])[::-1]
        for q, r in zip(range(first, len(ids)), place.tolist(), strict=True):
            if r >= len(b) or at_b[r] != s[q] or (text[s[q]] & 0xC0) == 0x80:
                continue
            if starts[q] and wb[r]:
                if end - s[q] > REACH and later[q] >= 5 and s[q] > seam:
                    return q, r
            elif not starts[q] and not wb[r] and ids[q] == b[r] and s[q] > begin and end - s[q] > REACH and self._inside(text[:end], int(s[q])) and self._inside(text[seam:], int(s[q]) - seam):
                return q, r
        return None


DIGESTS = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
TOKENS = T.StructType().add("n_tokens", "long").add("tokens", T.ArrayType(T.IntegerType()))


def encode_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    leaf: int = LEAF,
    digests: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """Rows of docs plus `n_tokens` and `tokens` (array of ids), and with decoded=True the text `decoded` from them.

    With digests=True the count and SHA-256 digests of both only. Null text
    counts as empty, the empty text has no tokens, texts of any length are
    encoded whole; other columns pass through whatever their names and types,
    and columns of the added names are replaced. An empty table gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # 1.5 MB, fixed
    added = DIGESTS if digests else T.StructType(TOKENS.fields + [T.StructField("decoded", T.StringType())] * decoded)
    names = added.names
    own = own_columns(docs, names)
    source = placed(docs).select(*own, text_of(place_of(docs, "text")).alias("text"))
    schema = T.StructType([f for f in source.schema if f.name != "text"] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(shared.value, leaf)
        digits = [str(i) for i in range(len(encoder.bytes_of))]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = encoder.encode_all(part.column("text").to_pylist())
                count = pa.array([len(x) for x in ids], pa.int64())
                if digests:
                    of_ids = [hashlib.sha256(",".join([digits[i] for i in x]).encode()).hexdigest() for x in ids]
                    back = [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids]
                    new = [count, pa.array(of_ids, pa.string()), pa.array(back, pa.string())]
                else:
                    new = [count, pa.array(ids, pa.list_(pa.int32()))]
                    if decoded:
                        new.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *new], names=[*own, *names])

    return renamed(source.mapInArrow(run, schema), docs, names)


def decode_tokens(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds `decoded` to rows with `tokens`; null tokens decode to the empty text. Columns pass as in `encode_documents`."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary or default_vocabulary())
    kept = placed(df, ["decoded"])
    tokens = place_of(df, "tokens")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(shared.value)
        for batch in batches:
            back = [encoder.decode(x.as_py() or []) for x in batch.column(tokens)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    return renamed(kept.mapInArrow(run, schema), df, ["decoded"])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
