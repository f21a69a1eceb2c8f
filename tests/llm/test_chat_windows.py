import hashlib
import random

from pyspark.sql import functions as F

from mvtrack.llm import chat_windows as C

HARD = ["\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y</turn>\n", "\\b\\h\\\\", "", None, "a\nb", "ünïcode 🙂", ": : #<>", "\\", "word " * 700]


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rng = random.Random(6)
    rows = [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0]), (None, None, None, None), (None, 1, "assistant", "x"), (5, 0, "role: #<\\", "odd role"), (6, 1, "assistant", "tie"), (6, 1, "assistant", "tie"), (6, 1, "user", "tie")]
    for c in range(10, 25):
        first = [(c, 0, "system", "be " * rng.choice([3, 300]))] if rng.random() < 0.5 else []
        rows += first + [(c, t, "user" if t % 2 else "assistant", rng.choice(HARD) if rng.random() < 0.5 else "w " * rng.randrange(0, 400)) for t in range(1, rng.randrange(2, 40))]
    turns = table(spark, rows).withColumn("span", F.lit(1)).withColumn("tokens", F.lit("x"))
    windows = C.chat_windows(turns, budget=512, history_tokens=64).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(windows).collect()}
    assert got == brute(rows)
    for w in windows.collect():
        own = w.n_turns - w.n_repeated
        assert own >= 1 and (w.tokens <= 512 or (own == 1 and w.n_repeated <= w.formatted.startswith("### system"))), w
        for s in w.loss:
            assert w.formatted[: s.start].endswith("assistant: ") and w.formatted[s.start + s.length :].startswith("</turn>")
    by = {}
    for w in sorted(windows.collect(), key=lambda w: (str(w.conv_id), w.window)):
        by.setdefault(w.conv_id, []).append(w)
    for own in by.values():
        for w in own[1:]:
            assert w.n_repeated <= 3
            if own[0].formatted.startswith("### system"):
                assert w.formatted.startswith("### system")


def test_long_conversation_in_blocks_and_empty_table(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn number {t}") for t in range(1500)]
    windows = C.chat_windows(table(spark, rows), budget=128, history_tokens=16)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(windows).collect()}
    assert got == brute(rows)
    assert max(w.tokens for w in windows.collect()) <= 128
    assert C.read_back(C.chat_windows(table(spark, rows).limit(0))).count() == 0


def test_budget_and_fill(spark):
    """Every window keeps to the budget, and all but the last are filled to 80 % or more by turns of 50 tokens."""
    tokens = F.col("size")
    rows = [(1, t, "user" if t % 2 else "assistant", "x", 50) for t in range(3000)] + [(2, 0, "system", "s", 204), (2, 1, "user", "h", 34), (2, 2, "assistant", "big", 404), (2, 3, "user", "huge", 900), (2, 4, "assistant", "y", 10)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size long")
    for budget in (1024, 512):
        windows = C.chat_windows(turns, budget=budget, history_tokens=256, tokens=tokens).collect()
        for w in windows:
            assert w.tokens <= budget or (w.conv_id, w.n_turns - w.n_repeated, w.n_repeated) == (2, 1, 1)
        first = sorted((w for w in windows if w.conv_id == 1), key=lambda w: w.window)
        low = [w.tokens for w in first[:-1] if w.tokens < 0.8 * budget]
        assert len(low) <= len(first) * 0.1
        assert sum(w.tokens for w in first) >= 0.8 * budget * (len(first) - 1)
    big = next(w for w in windows if w.conv_id == 2 and ": big" in w.formatted and ": h<" not in w.formatted)
    assert big.tokens == 608  # the system turn and a turn of 404: nothing else is repeated


def test_scripts_and_null_numbers(spark):
    rows = [(1, None, "user", "first of all"), (1, -5, "assistant", "second"), (1, 3, "user", "語" * 24_000), (1, 4, "assistant", "last")]
    windows = C.chat_windows(table(spark, rows))
    assert len(windows.collect()) >= 3 and max(w.tokens for w in windows.collect()) > 20_000
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(windows).collect()}
    assert got == brute(rows)
