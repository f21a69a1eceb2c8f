import random

import numpy as np

from mvtrack.llm import hashing as H


def test_equal_words_have_equal_hashes():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))).encode()
    texts = [b" ".join(word() for _ in range(rng.randrange(0, 50))) for _ in range(40)] + [b"", b" \n", b"x" * 700_000 + b" y " + b"x" * 700_000, b"x" * 699_999 + b"z"]
    hashes, starts = H.words(texts, H.UNSPACED)
    words = [w for t in texts for w in t.split()]
    assert np.diff(starts).tolist() == [len(t.split()) for t in texts]
    by = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_shingles_and_distinct_equal_plain_ones():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 3, 5, 30]))).encode() for _ in range(60)]
    hashes, starts = H.words(texts, H.UNSPACED)
    runs, begin = H.shingles(hashes, starts, 5)
    plain = []
    for t in texts:
        own = t.split()
        k = min(5, len(own))
        plain.append([tuple(own[i : i + k]) for i in range(len(own) - k + 1)] if own else [])
    assert np.diff(begin).tolist() == [len(p) for p in plain]
    by = {}
    for s, h in zip((s for p in plain for s in p), runs.tolist(), strict=True):
        assert by.setdefault(s, h) == h
    assert len(set(by.values())) == len(by)
    distinct, first = H.distinct(runs, begin)
    assert np.diff(first).tolist() == [len(set(p)) for p in plain] and len(distinct) == first[-1]


def test_groups_cover_all():
    assert [(g.start, g.stop) for g in H.groups(np.array([5, 5, 20, 1, 1]), 10)] == [(0, 1), (1, 2), (2, 5)]
    assert H.groups(np.zeros(0, np.int64), 10) == []
    for sizes in ([1] * 37, [30, 1, 1], [0, 0, 9]):
        own = H.groups(np.array(sizes), 10)
        assert [k for g in own for k in range(g.start, g.stop)] == list(range(len(sizes)))
