import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from mvtrack.llm import simhash_pivots as S


def similarity(a, b):
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    x, y = shingles(a), shingles(b)
    return len(x & y) / max(1, len(x | y))


def copies(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [text(rng.randrange(100, 400)) for _ in range(60)]
    for b in range(0, 60, 3):  # near copies of growing distance
        for edits in (0, 1, 3, 6):
            own = list(texts[b])
            for _ in range(edits):
                own[rng.randrange(len(own))] = "edit" + str(rng.random())
            texts.append(own)
    return [" ".join(t) for t in texts]


def test_similar_documents_against_brute_force(spark, make_docs):
    texts = copies()
    n = len(texts)
    pairs = [(i, j) for j in range(n) for i in range(j) if similarity(texts[i], texts[j]) >= 0.8]
    rows = {r["__id"]: r["class"] for r in S.similar_documents(make_docs(texts)).collect()}
    assert len(rows) == n
    found = sum(rows[i] == rows[j] for i, j in pairs)
    assert found >= 0.95 * len(pairs) > 50
    root = list(range(n))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in pairs:
        root[find(j)] = find(i)
    for i in range(n):
        for j in range(i):
            assert rows[i] != rows[j] or find(i) == find(j)


def test_copies_with_passages_added_cut_and_moved(spark, make_docs):
    """Every pair of a similarity just above 0.8 whose difference is in one place."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for _ in range(40):
        a = text(rng.randrange(150, 300))
        n = len(a)
        part = text(n // 5)
        for b in (a + part[: n // 5 - 3], part[: n // 5 - 3] + a, a[: n - n // 6], a[n // 6 :], a[n // 3 :] + a[: n // 3]):
            base = text(5)  # so that each pair stands for itself
            texts += [" ".join(w + base[0] for w in a), " ".join(w + base[0] for w in b)]
    pairs = [(i, i + 1) for i in range(0, len(texts), 2) if similarity(texts[i], texts[i + 1]) >= 0.8]
    assert len(pairs) > 150
    rows = {r["__id"]: r["class"] for r in S.similar_documents(make_docs(texts)).collect()}
    assert sum(rows[i] == rows[j] for i, j in pairs) >= 0.98 * len(pairs)


def test_large_groups_go_through_their_hub(spark, make_docs, monkeypatch):
    from mvtrack.llm import common

    monkeypatch.setattr(common, "PAIRWISE", 3)
    texts = copies(2)
    rows = {r["__id"]: r["class"] for r in S.similar_documents(make_docs(texts)).collect()}
    assert len({rows[i] for i in (0, 60, 61)}) == 1


def test_one_of_each(spark, make_docs):
    texts = copies(3)[:70]
    docs = make_docs([*texts, None, "", " ", texts[0], texts[1]], [*range(70), 80, 81, 82, None, 1]).withColumn("class", F.lit("x")).withColumn("n", F.lit(0))
    rows = S.one_of_each(docs).select("doc_id", "class", "n").collect()
    ids = sorted(r.doc_id for r in rows)
    assert len(ids) == len(set(ids)) and None not in ids
    assert {i for i in ids if i < 60} == set(range(60)) and [i for i in ids if i >= 80] == [80]
    assert S.one_of_each(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output on the smallest tables."""
    d, at, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, docs, d).write.parquet(f"{at}/{name}")
        done = spark.read.parquet(f"{at}/{name}")
        out[name] = (docs, done)
        docs = done
    return out


def test_stages_keep_their_columns(stages):
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name, (_, done) in stages.items():
        assert name == "packing" or done.columns == P.COLUMNS
        assert done.count() > 0


def test_quality_keeps_clean_documents(spark, stages):
    before, after = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    good = {r.doc_id for r in before.collect() if labels.get(r.doc_id) == 1 and len(r.text.split()) >= 20}
    assert len(good & kept) >= 0.95 * len(good)


def test_lines_stay_once(stages):
    before, after = (df.orderBy("doc_id").collect() for df in stages["line_dedup"])
    assert [r.doc_id for r in before] == [r.doc_id for r in after]
    seen = set()
    for a, b in zip(before, after, strict=True):
        for line in b.text.split("\n"):
            if len(line.split()) >= 5 and line.replace(".", "").replace(",", "").replace(" ", "").isalpha():
                assert line not in seen
                seen.add(line)
        assert len(b.text) <= len(a.text) and b.n_chars == len(b.text)


def test_no_two_similar_documents_stay(stages):
    texts = [r.text for r in stages["near_dedup"][1].collect()]
    bad = [(i, j) for j in range(len(texts)) for i in range(j) if similarity(texts[i], texts[j]) >= 0.9]
    assert not bad


def test_no_benchmark_item_stays(spark, stages):
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    for r in stages["decontamination"][1].collect():
        text = " ".join(r.text.lower().split())
        assert not any(i in text for i in items)


def test_packing_has_every_document(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}


def test_run_with_nulls_empty_texts_and_an_empty_table(spark, make_docs, tmp_path):
    """The whole run over odd rows: null and repeated ids, null, empty and very long texts, copies."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    texts = [r.text for r in base] + [None, "", " \n ", base[0].text, base[0].text, "long " + " ".join(f"word{k}" for k in range(30_000))]
    ids = [r.doc_id for r in base] + [1000, 1001, 1002, None, base[0].doc_id, 1003]
    docs = make_docs(texts, ids)
    for n, rows in (("some", docs), ("none", docs.limit(0))):
        d = str(tmp_path / n)
        rows.write.parquet(f"{d}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
        out = P.run(spark, d).collect()
        if n == "none":
            assert out == []
            continue
        tokens = {}
        for r in out:
            tokens.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        for (_, total), own in tokens.items():
            own.sort()
            assert own[0][0] == 0 and sum(own[-1]) == total and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        assert {d for d, _ in tokens} <= set(ids) and len(tokens) >= 10


def test_texts_looked_up_without_broadcasts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_TEXTS", 0)
    texts = copies(4)
    docs = make_docs(texts)
    for name in ("class", "n", "body", "size", "p", "m", "keys", "times", "first"):
        docs = docs.withColumn(name, F.lit("x"))
    rows = {r["__id"]: r["class"] for r in S.similar_documents(docs).collect()}
    assert len(rows) == len(texts) and len({rows[i] for i in (0, 60, 61)}) == 1


def test_hubs_lose_little_of_large_groups(spark, make_docs):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choice(words) for _ in range(300)]
    texts = []
    for _ in range(60):
        own = list(base)
        for at in rng.sample(range(300), rng.randrange(0, 8)):
            own[at] = "e" + str(rng.random())
        texts.append(" ".join(own))
    class_of = lambda **how: {r["__id"]: r["class"] for r in S.similar_documents(make_docs(texts), **how).collect()}
    whole, hubs = class_of(hubs=None), class_of()
    assert len(set(hubs.values())) <= len(set(whole.values())) + 2


def test_large_groups_lose_no_link(spark, make_docs, monkeypatch):
    """A chain of texts with a passage at the end in common: neighbours are alike, far ones are not, and no hub is near all."""
    from mvtrack.llm import common

    rng = random.Random(10)
    word = lambda: f"w{rng.randrange(10**6)}"
    own, texts = [word() for _ in range(300)], []
    for k in range(60):
        own[3 * k : 3 * k + 3] = [word() for _ in range(3)]
        texts.append(" ".join(own))
    for block, settled in ((1024, 4096), (8, 20)):
        monkeypatch.setattr(common, "BLOCK", block)
        monkeypatch.setattr(common, "SETTLED", settled)
        rows = {r["__id"]: r["class"] for r in S.similar_documents(make_docs(texts)).collect()}
        assert len(rows) == 60 and len(set(rows.values())) == 1


def test_line_dedup_loses_no_link_of_large_groups(spark, make_docs):
    """A chain of lines that all share their longest words, beside lines of the same groups that are like nothing."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    long_words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16)) for _ in range(5)]
    own, texts = [word() for _ in range(60)], []
    for k in range(90):
        own[k % 60] = word()
        texts.append(" ".join(long_words + own))
    texts += [" ".join(long_words + [word() for _ in range(60)]) for _ in range(20)]
    left = {r.doc_id for r in P.line_dedup(spark, make_docs(texts), "").where("text <> ''").collect()}
    assert left == {0, *range(90, 110)}


def test_texts_judged_again():
    """A later round may ask about rows that are all known."""
    import pyarrow as pa

    rows = pa.table({"p": [[0] * 4] * 3, "m": [[1] * 12] * 3, "body": ["a b c d e f", "A b c d e f", "u v w x y z"]})
    judge = S._Texts(rows, 5, 0.8)
    for _ in range(2):
        assert judge.linked(S.np.array([0, 0]), S.np.array([1, 2])).tolist() == [True, False]
