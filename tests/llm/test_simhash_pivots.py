import random

import xxhash
from pyspark.sql import functions as F

from mvtrack.llm import simhash_pivots as S


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_of_odd_texts():
    for text in (None, "", " \t\n", "One", "one TWO", "A b c", "É é x y", "x " * 300, "a b c d"):
        assert S.simhash(text, 3) & (1 << 64) - 1 == brute_print(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_and_components_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {0, *base}
    for b in base[:20]:  # chains of links
        for _ in range(4):
            b ^= 1 << rng.randrange(64)
            prints.add(b)
            prints.add(b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    hot = rng.getrandbits(64)  # a group beyond PAIRWISE
    prints |= {hot ^ 1 << a ^ 1 << b for a in range(0, 40, 2) for b in range(a + 1, 40, 3)}
    prints = sorted(prints)
    found = {}
    edges = S.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    for src, dst in edges.collect():
        assert ((src ^ dst) & (1 << 64) - 1).bit_count() <= 2
    for node, component in S.components(edges).collect():
        found[node] = component
    want = brute_classes(prints)
    got = [found.get(signed(p), signed(p)) for p in prints]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_documents(spark, make_docs):
    texts = ["a b c d e f", "A b c d e f", None, "", "q r s t u v w", "a b c d e f", "q r s t u v w"]
    docs = make_docs(texts, [5, 3, 9, 7, None, 5, 8]).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    rows = S.near_duplicates(docs).collect()
    got = sorted((r["__id"] is None, r["__id"] or 0, r.component_id) for r in rows)
    assert got == [(False, 3, 3), (False, 5, 3), (False, 5, 3), (False, 7, 7), (False, 8, 8), (False, 9, 7), (True, 0, 8)]
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_text_and_pivot_table(spark, make_docs):
    text = " ".join(f"w{k % 977}" for k in range(120_000))
    docs = make_docs([text, text + " end", "other words here"], [2, 1, 3])
    rows = {r["__id"]: (r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert rows[2] == (brute_print(text), 1) and rows[1][1] == 1 and rows[3][1] == 3
    rng = random.Random(3)
    prints = S.np.array([rng.getrandbits(64) for _ in range(50)], S.np.uint64)
    d, keys = S._distances(prints, 16, 2)
    refs = [r & (1 << 64) - 1 for r in S._references(16)]
    assert d.tolist() == [[(int(p) ^ r).bit_count() for r in refs] for p in prints]
    for i in range(50):  # within two bits a pair shares a key, and no coordinate differs by more
        near = prints[i] ^ S.np.uint64(1 << rng.randrange(64)) ^ S.np.uint64(1 << rng.randrange(64))
        e, k = S._distances(S.np.array([near]), 16, 2)
        assert (k[0] == keys[i]).any() and abs(e[0].astype(int) - d[i]).max() <= 2
