import re
from collections import Counter, defaultdict

import pytest

from mvtrack.llm import source_divergence as S

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    """rows of (text, lang, source); the definition, with Python's integers."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = WORD.findall((text or "").translate(LOWER))
        groups.add((lang or "", source or ""))
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        own = [s for x, s in groups if x == lang]

        def shares(n):
            size = sum(n[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (n[t] + 1) // size for t in kept}

        of = {s: shares(count[lang, s]) for s in own}
        whole = shares(sum((count[lang, s] for s in own), Counter()))
        p = of[source]
        pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), s) for s, q in of.items() if s != source]
        terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[lang, source][t] and p[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


ROWS = [
    ("The cat, the CAT and the dog", "en", "a"), ("the dog's day", "en", "b"), ("the cat day", "en", "b"), ("cat day dog the and", "en", "c"), (None, "en", "d"), ("12 ?! _", "en", None),
    ("été Été ÉTÉ l'été", "fr", "a"), ("été", "fr", "b"), ("l'été", "fr", "b"), ("été", None, "a"), ("one two", "xx", "a"), ("three", "xx", "b"), ("", "xx", ""),
    ("日本 語 日本", "ja", "x"), ("日本", "ja", "y"), ("日本 語", "ja", "y"), ("語 and 語", "ja", "z"), ("the cat, the CAT and the dog", "en", "a"), ("the cat, the CAT and the dog", "en", "a"),
]
ROWS += [(" ".join(f"w{chr(97 + i * j % 23)}{chr(97 + i % 7)}" for i in range(60)), "en", f"s{j % 9}") for j in range(27)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, s, "clash", "clash") for i, (t, l, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n string")


@pytest.mark.parametrize("tiles", [{}, {"dense_share": 0}, {"dense_share": 2}, {"dense_terms": 3, "postings": 5, "side": 2}, {"dense_share": 2, "postings": 7, "side": 3}])
def test_equals_the_definition(spark, tiles):
    """However terms and groups are dealt out, and whatever is heavy."""
    got = [tuple(r) for r in S.divergence(frame(spark, ROWS), **tiles).collect()]
    assert sorted(got) == plain(ROWS)


def test_top_terms_and_ties(spark):
    got = [tuple(r) for r in S.divergence(frame(spark, ROWS), top_terms=2).collect()]
    assert sorted(got) == plain(ROWS, top=2)


def test_without_broadcasts_and_cells(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_GROUPS", 0)
    assert sorted(tuple(r) for r in S.divergence(frame(spark, ROWS)).collect()) == plain(ROWS)


def test_empty_table(spark):
    assert S.divergence(frame(spark, ROWS).limit(0)).collect() == []


def test_slices_and_flushes(monkeypatch):
    """A long text is read by slices; counts are passed on early; cells are bounded."""
    monkeypatch.setattr(S, "_SLICE", 7)
    text = "Alpha beta  gamma_delta été 12 alpha " * 50
    assert [t.decode() for s in S.term_slices(text.encode()) for t in s] == WORD.findall(text.translate(LOWER))


def test_small_tiles_in_numpy(monkeypatch, spark):
    import numpy as np

    rng = np.random.default_rng(3)
    p0, q0 = rng.integers(1, 9, 5), rng.integers(1, 9, 4)
    left = (rng.integers(0, 30, 60), rng.integers(0, 5, 60), rng.integers(1, 10**9, 60))
    right = (rng.integers(0, 30, 50), rng.integers(0, 4, 50), rng.integers(1, 10**9, 50))
    left, right = ([np.array(x) for x in zip(*{(t, g): p for t, g, p in zip(*s)}.items())] for s in (left, right))
    left, right = ((k[:, 0], k[:, 1], p) for k, p in ((np.array(s[0].tolist()).reshape(-1, 2), s[1]) for s in (left, right)))
    f0 = S._f(p0[:, None], q0[None, :])
    sums = []
    for cells in (1, 100, 1 << 20):
        monkeypatch.setattr(S, "_CELLS", cells)
        for kind in (S._dense, S._sparse):
            total = np.zeros_like(f0)
            kind(total, f0, p0, q0, left, right)
            sums.append(total.tolist())
    assert all(s == sums[0] for s in sums)
