import random

import numpy as np
from pyspark.sql import functions as F

from mvtrack.llm import quality_rules as Q


def brute(text):
    words = (text or "").encode().split()
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            repeated += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(covered)


def test_statistics_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "é#* ñ x\n\n\né#* ñ x", "a b c d e f g h " * 3, "x " * 500, "one\r\ntwo\x0bthree\x0cfour", "a\n \na\n \n"]
    texts += [" ".join(rng.choice("abcdé|") for _ in range(rng.randrange(0, 400))).replace("d", "\n") for _ in range(60)]
    for t in texts:
        assert Q._stats(t)[:5] == brute(t), t


def test_covering_learns_and_prunes():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    noisy = bad ^ (rng.random(3000) < 0.01)
    rules = Q.cover(x, noisy)
    hit = np.any([r.mask(x) for r in rules.rules], axis=0)
    assert 2 <= len(rules.rules) <= 6
    assert (hit & bad).sum() / bad.sum() > 0.9 and (hit & ~bad).sum() / hit.sum() < 0.05


def test_no_rules_without_both_labels(spark, make_docs):
    docs = make_docs(["word " * 30] * 5)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert not Q.learn(docs, labels).rules
    assert not Q.learn(docs, labels.limit(0)).rules


def test_judge_odd_rows_and_held_out_accuracy(spark, make_docs):
    rng = random.Random(3)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) + str(rng.randrange(50)) for _ in range(60))
    junk = lambda: " ".join(w + "###" for w in clean().split())
    texts = [clean() if i % 3 else junk() for i in range(300)] + [None, "", "few words", "few words"]
    docs = make_docs(texts, [*range(300), None, 301, 302, 302]).withColumn("__other", F.lit(1)).withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    rules = Q.learn(docs, labels)
    rows = Q.judge(docs, rules).select("doc_id", "__base_failed", "__kept", "n_words").collect()
    kept = {r.doc_id: r.__getitem__("__kept") for r in rows}
    assert len(rows) == 304
    assert all(kept[i] == (i % 3 > 0) for i in range(200, 300))  # not in the labels
    assert not kept[None] and not kept[301] and not kept[302]
    assert Q.judge(docs.limit(0), rules).count() == 0


def test_repeated_rows_ties_and_very_long_text(spark, make_docs):
    long = " ".join(f"word{k}" for k in range(40_000)) + "\n" + "again and again this line\n" * 3
    texts = ["same text " * 15] * 3 + [long]
    docs = make_docs(texts, [1, 1, None, 2])
    rules = Q.learn(docs, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int"))
    rows = Q.judge(docs, rules).select("doc_id", "__stats", "__base_failed", "__kept").collect()
    assert len(rows) == 4
    assert len({(r["__stats"], r["__base_failed"], r["__kept"]) for r in rows if r.doc_id != 2}) == 1
    own = next(r["__stats"] for r in rows if r.doc_id == 2)
    assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == brute(long)
