import random

from pyspark.sql import functions as F

from mvtrack.llm import decontaminate as D


def test_finds_planted_items_and_no_others(spark, make_docs):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(15, 60))) for i in range(40)] + [(40, "tiny item"), (41, None), (42, " \n"), (None, text(30)), (7, text(25))]
    texts = [text(rng.randrange(0, 300)) for _ in range(80)]
    planted = {}
    for d in range(0, 80, 2):
        i = rng.randrange(40)
        own = items[i][1].split()
        if d % 4:  # a word less at one end
            own = own[1:] if d % 8 == 2 else own[:-1]
        body = texts[d].split()
        at = rng.randrange(0, len(body) + 1)
        texts[d] = " ".join(body[:at] + [", ".join(own).upper() + "."] + body[at:])
        planted[d] = i
    texts += [None, "", items[43][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(texts, [*range(80), 80, 81, None]).withColumn("__found", F.lit(1)).withColumn("item_id", F.lit(5))
    rows = D.leaks(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    exact = set()
    for d, t in zip([*range(80), 80, 81, None], texts, strict=True):  # brute force over all windows
        own = D.words_of(t)
        for i, x in items:
            item = D.words_of(x)
            n, k = len(item), min(5, len(item))
            if item and any(D.similarity(own[s : s + n], item, k) >= 0.8 for s in range(len(own) - n + 1)):
                exact.add((d, i))
    assert got <= exact
    assert len(got) >= 0.99 * len(exact)
    assert {(d, i) for d, i in planted.items() if d % 4 == 0} <= got and (None, None) in got
    left = {r.doc_id for r in D.without_leaks(docs, bench).collect()}
    assert left == {*range(82), None} - {d for d, _ in got}
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.leaks(docs.limit(0), bench).count() == 0
    assert D.without_leaks(docs, bench.limit(0)).count() == 83


def _sized(n, size, radius, vocabulary=50, seed=9):
    rng = random.Random(seed)
    own = D._Sized(size, 5, radius)
    own.words = [[f"w{rng.randrange(vocabulary)}" for _ in range(size)] for _ in range(n)]
    own.items = list(range(n))
    own.close()
    return own, rng


def test_blocks_guarantee_the_radius(monkeypatch):
    for direct in (2048, 0):
        monkeypatch.setattr(D, "DIRECT", direct)
        for radius in (7, 15):
            own, rng = _sized(30, 20, radius)
            prints = D.np.array([int(p) ^ sum(1 << b for b in rng.sample(range(64), radius)) for p in own.prints], D.np.uint64)
            want = {(w, i) for w in range(30) for i in range(30) if (int(prints[w]) ^ int(own.prints[i])).bit_count() <= radius}
            found = list(own.near(prints))
            assert {(i, i) for i in range(30)} <= want and len(found) == len(want) and set(found) == want


def test_many_items_of_one_length():
    """50,000 items of one length in bounded memory."""
    import tracemalloc

    own, rng = _sized(50_000, 12, 15, 3000)
    prints = own.prints[:500].copy()
    tracemalloc.start()
    found = list(own.near(prints))
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert {(i, i) for i in range(500)} <= set(found)
    some = own.prints[:20]
    want = {(w, int(i)) for w in range(20) for i in D.np.flatnonzero(D.np.bitwise_count(some[w] ^ own.prints) <= 15)}
    assert {p for p in found if p[0] < 20} == want


def test_recall_over_lengths_and_edits():
    """Every item of 5 to 200 words with scattered edits that leave a similarity of 0.8 or more."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    pairs = []
    for size in (5, 8, 12, 20, 50, 100, 200):
        for share in (0.01, 0.02, 0.05, 0.1, 0.2):
            for _ in range(30):
                item = [word() for _ in range(size)]
                copy = [word() if rng.random() < share else w for w in item]
                if D.similarity(item, copy, 5) >= 0.8:
                    pairs.append((item, [word() for _ in range(40)] + copy + [word() for _ in range(40)]))
    index = D.Index([(i, " ".join(item)) for i, (item, _) in enumerate(pairs)], 5, D.RADIUS)
    found = index.all_matches([" ".join(text) for _, text in pairs], 0.8)
    assert len(pairs) > 300
    assert sum(i in {m["item"] for m in own} for i, own in enumerate(found)) >= 0.99 * len(pairs)


def test_very_long_text():
    rng = random.Random(10)
    item = [f"w{rng.randrange(40)}" for _ in range(30)]
    words = [f"w{rng.randrange(40)}" for _ in range(60_000)]
    words[50_000:50_000] = item
    index = D.Index([(0, " ".join(item))], 5, D.RADIUS)
    [[m]] = index.all_matches([" ".join(words)], 0.8)
    assert (m["start"], m["similarity"]) == (50_000, 1.0)


def test_repeated_rows(spark, make_docs):
    docs = make_docs(["one two three four five six seven"] * 3, [1, 1, 2])
    bench = spark.createDataFrame([(1, "two three four five six"), (1, "two three four five six")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()) == [(1, 1)] * 4 + [(2, 1)] * 2
