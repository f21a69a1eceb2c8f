import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from mvtrack.llm import fm_substrings as S


def brute(rows, window=20):
    """rows: distinct (doc_id, text); None comes last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        words = (rows[i][1] or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[rows[i][0]] = (len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["é", "ñandú"]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [text(rng.randrange(20, 90)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, " ".join(["same"] * 70))]
    for i in range(4, n):
        own = text(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 10)
            own[rng.randrange(0, len(own) + 1) : 0] = p[a : a + rng.randrange(15, 90)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(own)))
    rows.append((n, rows[10][1]))
    rows.append((None, rows[11][1]))
    return rows


def test_fm_index_finds_every_window():
    rng = np.random.default_rng(3)
    lengths = rng.integers(20, 60, 30)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    for s, n in zip(starts, lengths, strict=True):
        text[s : s + n] = rng.integers(1, 3, n)
    where = np.arange(len(text))
    index = S.FmIndex(text, where, 6)
    seen = {}
    for s, n in zip(starts, lengths, strict=True):
        for o in range(n - 5):
            seen.setdefault(tuple(text[s + o : s + o + 6]), s + o)
    got = {}
    for which, at, earliest in index.statistics(text, starts, lengths):
        for w, o, e in zip(which, at, earliest, strict=True):
            got[w, o] = e
    want = {(i, o): seen[tuple(text[s + o : s + o + 6])] for i, (s, n) in enumerate(zip(starts, lengths, strict=True)) for o in range(n - 5)}
    assert got == want


def test_equals_brute_force(spark, make_docs, monkeypatch):
    rows = corpus()
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    want = brute(rows)
    for hot in (4096, 3):  # the second sends most windows by themselves
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "SHARD_WORDS", 2000)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.drop_repeats(docs).collect()}
        assert got == want
    assert sum(v[1] for v in want.values()) > 1000


def test_repeated_rows_and_empty_table(spark, make_docs):
    text = " ".join(f"w{k}" for k in range(30))
    docs = make_docs([text, text, text], [1, 1, 2])
    assert sorted((r.doc_id, r.n_removed) for r in S.drop_repeats(docs).collect()) == [(1, 0), (1, 0), (2, 30)]
    assert S.drop_repeats(docs.limit(0)).count() == 0


def test_joins_without_broadcasts_and_clashing_names(spark, make_docs, monkeypatch):
    rows = corpus(60)
    docs = make_docs([t for _, t in rows], [i for i, _ in rows])
    for name in ("dh", "id", "m", "pieces", "copy", "k", "g", "seg"):
        docs = docs.withColumn(name, F.lit("x"))
    monkeypatch.setattr(S, "BROADCAST_TEXTS", 0)
    monkeypatch.setattr(S, "BROADCAST_PIECES", 0)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.drop_repeats(docs).collect()} == brute(rows)


def test_very_long_text(spark, make_docs):
    words = [f"w{k}" for k in range(60_000)]
    words[40_000:40_030] = words[100:130]
    [row] = S.drop_repeats(make_docs([" ".join(words)])).collect()
    assert (row.n_words, row.n_removed) == (60_000, 30)
