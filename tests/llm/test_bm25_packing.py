import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mvtrack.llm import bm25_packing as B

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "It's a DON'T. x... a.b, é. É, 12. 3,4 <|endoftext|> ½. ٣. é. İ. İ, ﬁ. a b, …. ok,", " . , ", "ΑΣ. ΑΣ, naïve. 日本語。 日本語,  x y\x1cz. -. 'll. '. ok'."]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["the", "Thon,", "éanç.", "x", "12,"]) + rng.choice(["", "a", ".", ",", "!,"]) for _ in range(50)) for _ in range(40)]
    for most in (500_000, 3):  # the second keeps nothing
        words = B.WordTokens(PATH, most)
        for _ in range(2):
            for text, got in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
                assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check(rows, docs, tokenizer):
    """Every id in one piece, sequences gapless and full, or of a power of two."""
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in docs.items()}
    pieces, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, own in pieces.items():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) == len(ids[d])
    assert set(pieces) == set(ids)
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        total = sum(own[-1])
        assert total <= 2048 and total & (total - 1) == 0


def test_documents(spark, make_docs, tokenizer):
    rng = random.Random(2)
    docs = {i: " ".join(rng.choice(["tree", "river", "stone", "cloud", "sand"]) for _ in range(rng.randrange(0, 900))) for i in range(60)} | {60: None, 61: "", 62: "word " * 9000, None: "a null id"}
    frame = make_docs(list(docs.values()), list(docs)).withColumn("shard", F.lit("x")).withColumn("ids", F.lit(1))
    for shard_tokens in (B.SHARD_TOKENS, 3_000):
        check(B.pack_documents(frame, PATH, shard_tokens).collect(), docs, tokenizer)
    assert B.pack_documents(frame.limit(0), PATH).count() == 0
    twice = make_docs(["same text"] * 40, [5] * 40)
    rows = B.pack_documents(twice, PATH).collect()
    assert sum(r.length for r in rows) == 40 * rows[0].doc_tokens


def weights_of(docs, vocabulary):
    held = np.zeros(vocabulary, np.int64)
    for d in docs:
        held[np.unique(d)] += 1
    lengths = np.array([len(d) for d in docs])
    return B.Weights(held, len(docs), lengths.mean()), lengths


def test_neighbours_equal_plain_bm25():
    """All terms, scores by the formula, ties in order."""
    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.5, rng.integers(5, 80)).clip(max=199).astype("<u2") for _ in range(60)] + [np.array([7, 7, 9], "<u2")] * 3
    weights, lengths = weights_of(docs, 200)
    index = B.Bm25(docs, lengths, weights, None)
    n, mean = len(docs), lengths.mean()
    held = {t: sum(t in d for d in docs) for t in range(200)}
    for seed in range(n):
        unused = rng.random(n) < 0.8
        scores = {}
        for i, d in enumerate(docs):
            own, total = d.tolist(), 0.0
            for t in set(docs[seed].tolist()) & set(own):
                if held[t] > 1:
                    c = own.count(t)
                    total += np.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(own) / mean))
            if unused[i] and total > 0:
                scores[i] = total
        got = list(index.neighbours(seed, unused))
        assert set(got) == set(scores)
        values = [scores[i] for i in got]
        assert all(a >= b - 1e-4 for a, b in zip(values, values[1:], strict=False))
        twins = [i for i in got if i >= 60]
        assert twins == sorted(twins)


def test_like_units_share_a_shard():
    """Units with rare terms in common stand together in the order that deals them, copies apart by their rows only."""
    rng = np.random.default_rng(6)
    docs = []
    for topic in range(200):
        rare = rng.integers(1000, 40_000, 3)
        docs += [np.concatenate((rng.integers(2, 300, 100), np.repeat(rare, 3))).astype("<u2") for _ in range(5)]
    weights, lengths = weights_of(docs, 40_000)
    place = weights.places(docs, lengths, np.arange(len(docs)))
    rank = np.argsort(np.argsort(place))
    shard = rank * 20 // len(docs)
    same = [shard[5 * t + i] == shard[5 * t + j] for t in range(200) for i in range(5) for j in range(i)]
    assert np.mean(same) > 0.8
    copies = [docs[0]] * 100
    assert len(set((weights.places(copies, np.full(100, len(docs[0])), np.arange(100)) >> np.uint64(16)).tolist())) == 1


def test_neighbours_fill_the_window():
    rng = np.random.default_rng(3)
    topics = [np.arange(k * 50, k * 50 + 50) for k in range(4)]
    docs = [rng.choice(topics[i % 4], 300).astype("<u2") for i in range(40)]
    weights, lengths = weights_of(docs, 200)
    pieces = B.pack([len(d) for d in docs], B.Bm25(docs, lengths, weights))
    same = total = 0
    for q in {p[3] for p in pieces}:
        kinds = [p[0] % 4 for p in sorted(pieces, key=lambda p: (p[3], p[4])) if p[3] == q]
        same += sum(a == b for a, b in zip(kinds, kinds[1:], strict=False))
        total += len(kinds) - 1
    assert same > 0.7 * total
