import hashlib
import os
import random

import pytest

from kinweave.llm.bpe import TreeEncoder, decode_tokens, default_vocabulary, encode_documents, op2_bpe

WORDS = ["the", " of", "'s", "'ll", "'re", "  ", "\n", "\n\n\n", "é", "日本語の", "123", "4567890", "!!!", "'", "<|endoftext|>", "<|endof", "text|>", "🙂", "a" * 40, "ABCdef", "\t ", "=====", "xyzzyplugh" * 9, "́", "ß", "²", " 7", "...'s"]


@pytest.mark.parametrize("leaf,window", [(2, 4), (7, 4), (20, 8), (64, 32), (300, 32)])
def test_tree_equals_whole(leaf, window):
    enc = TreeEncoder(default_vocabulary(), leaf, window)
    rng = random.Random(leaf)
    texts = ["".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(1500)), "z" * 900, " " * 700, "a" * 300 + " " * 300 + "b" * 300, "7" * 1000, "日" * 700, "'" * 500, "é" * 600, ""]
    for text, ids in zip(texts, enc.encode_all(texts), strict=True):
        assert list(ids) == enc.tok.encode(text, add_special_tokens=False).ids, repr(text[:200])


def test_rows(spark):
    df = spark.createDataFrame([(1, "a b" * 10_000, "x"), (2, None, "y"), (2, "", None), (None, "<|endoftext|> hi", "z")], "doc_id long, text string, tokens string")
    out = decode_tokens(encode_documents(df)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0, r["decoded"] == (r["text"] or "")) for r in out) == [(0, True, True), (1, True, True), (2, False, True), (2, False, True)]
    both = encode_documents(df, decoded=True).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in both)
    assert encode_documents(df.limit(0)).count() == 0


def test_every_character_as_the_library():
    enc = TreeEncoder(default_vocabulary())
    assert enc.quick is not None
    chars = [chr(i) for i in range(0, 0x110000, 7) if not 0xD800 <= i < 0xE000] + [chr(i) for i in range(0x3000)]
    texts = ["a" + c + "a 1" + c + "1 !" + c + "! " + c + " " + c for c in chars]
    for text, ids, want in zip(texts, enc.encode_all(texts), enc.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert list(ids) == want.ids
        assert enc.decode(ids) == enc.tok.decode(want.ids, skip_special_tokens=False) == text
    assert enc.decode([50256, 170, 50256]) == enc.tok.decode([50256, 170, 50256], skip_special_tokens=False)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_equals_the_library_on_a_whole_table(spark):
    """Digests of a whole table, some texts far over the leaf, by the library alone."""
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want, longest = [], 0
    for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        text = r["text"] or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        longest = max(longest, len(text))
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, op2_bpe(spark, "/root/testdata/sf0.001").collect())) == sorted(want)
    assert longest > 16_384


def test_columns_of_any_name_and_type_pass(spark):
    schema = "doc_id long, text string, __text string, `a.b` int, n_tokens string, m map<string,int>"
    rows = [(1, "a b", "p", 1, "q", {"k": 1}), (None,) * 6]
    df = spark.createDataFrame(rows, schema)
    for digests in (False, True):
        out = encode_documents(df, digests=digests)
        assert out.columns[:5] == ["doc_id", "text", "__text", "a.b", "m"]
        assert {tuple(r)[:4] for r in out.collect()} == {r[:4] for r in rows}
        assert sorted(r["n_tokens"] for r in out.collect()) == [0, 2]
    back = decode_tokens(encode_documents(df))
    assert sorted(r["decoded"] for r in back.collect()) == ["", "a b"]
