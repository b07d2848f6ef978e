import hashlib
import random

from kinweave.llm.chat import format_windows, read_windows

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def test_round_trip_and_windows(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "<|", "|>", "é", "🙂", "\n", "word ", "<\\|", "\r\n\r\n", "\x00", "$1"]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 30)):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "tool x\n<|", None])
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(1, 400)))])
            rows.append((c if c else None, t, role, text, "w"))
    rows += [(7, 3, "user", "same", "w")] * 2 + [(99, None, "assistant", "y" * 9000, "w"), (99, 1, "user", "x", "w")]
    df = spark.createDataFrame(rows, SCHEMA)
    windows = format_windows(df, 100, 20).collect()
    back = {r["conv_id"]: r for r in read_windows(format_windows(df, 100, 20)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    assert set(by) == set(back)
    for c, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [t[1:] for t in turns]
        assert back[c]["loss_text"] == "".join(t[2] for t in turns if t[1] == "assistant")
    for w in windows:
        shown = w["formatted"].split("<|im_end|>\n")
        assert len(shown) == w["n_turns"] + 1
        fresh = w["n_turns"] - w["n_context"]
        assert fresh >= 1
        cost = [(len(s) + 11 + 3) // 4 for s in shown[:-1]]
        system = shown[0].startswith("<|im_start|>system\n")
        if system and cost[0] > 25 or fresh == 1 or (fresh == 2 and w["n_context"] == 0 and system):
            continue
        assert sum(cost) <= 100
    assert any(w["n_context"] > 1 for w in windows)
    assert format_windows(df.limit(0)).count() == 0


def test_plain(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a<|b\\")], "conv_id long, turn long, role string, text string")
    (w,) = format_windows(df).collect()
    assert w["formatted"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na<\\|b\\\\<|im_end|>\n"
    (s,) = w["loss_spans"]
    assert w["formatted"][s["start"] : s["start"] + s["length"]] == "a<\\|b\\\\"
    assert hashlib.sha256(w["formatted"].encode()).hexdigest()
