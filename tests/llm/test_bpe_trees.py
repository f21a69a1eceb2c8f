import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mvtrack.llm import bpe_trees as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n  x", "a" * 3000, "ab" * 900 + " " + "日本語" * 400, "🙂é" * 300, " " * 700, "x<|endoftext|>y <|endoftext|>", "<|endoftext|>" * 40, "it's he'll᠎  \n\t ok", "'\n \na" * 50, "1234567890" * 60]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def odd_texts(n):
    rng = random.Random(7)
    sorts = ["ab", "aAbc", "a", "日本語é", "12", "!?.'", "abcdefghijklmnopqrstuvwxyz", " \n", "\xa0 ᠎　a", "'sreltvd ", "𝒳😀", "<|endoftext|>"]
    for _ in range(n):
        words = ["".join(rng.choice(rng.choice(sorts)) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 20))]
        yield rng.choice(["", " ", "  ", "<|endoftext|>"]).join(words)


@pytest.mark.parametrize("piece,leaf", [(1 << 16, 1 << 14), (40, 12), (8, 4)])
def test_equals_the_library(spark, make_docs, tok, piece, leaf):
    """Short, long and unsplit texts, whatever the size of pieces and leaves."""
    texts = [*ODD, *odd_texts(150), ODD[4]]
    docs = make_docs(texts, ids=[*range(len(texts) - 1), 4]).withColumnRenamed("n_chars", "ids")
    got = B.decode(B.encode(docs, PATH, piece, leaf), PATH).collect()
    want = sorted((i if i < len(texts) - 1 else 4, tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts))
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert sorted((r.doc_id, r.text) for r in got) == [(i, tok.decode(ids, skip_special_tokens=False)) for i, ids in want]


def test_trees_join_as_the_whole(tok):
    """Every unsplit text is found, and its tree has the ids of the whole, from windows of one id on."""
    bpe, trees = B.Bpe(PATH), 0
    for text in odd_texts(1500):
        made = []
        for part, unsplit in B.pieces(text, bpe, 16, 6):
            if not unsplit:
                made += np.frombuffer(bpe.encode([part])[0], "<u4").tolist()
                continue
            data, trees = part.encode(), trees + 1
            nodes = [bpe.merge(data[i : i + 6]) for i in range(0, len(data), 6)]
            while len(nodes) > 1:
                nodes = [B.join(*nodes[i : i + 2], bpe, 1) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
            made += nodes[0].tolist()
        assert made == tok.encode(text, add_special_tokens=False).ids
    assert trees > 1000


def test_the_cache_forgets(tok, monkeypatch):
    monkeypatch.setattr(B, "_CACHED", 1)
    monkeypatch.setattr(B, "_AT_ONCE", 12)
    bpe = B.Bpe(PATH)
    texts = ["some words here", "a", "other words there", "", "b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)] == [tok.encode(t).ids for t in texts]
    assert len(bpe.cache) <= 1 and bpe.encode([]) == []


def test_null_ids_bad_bytes_and_an_empty_table(spark, make_docs, tok):
    assert B.encode(make_docs([]), PATH).collect() == []
    ids = tok.encode("日本🙂").ids
    cut = [ids[1:], ids[:-1], ids[::-1]]
    rows = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(cut)] + [(9, None)], "n int, ids binary")
    assert [r.text for r in B.decode(rows, PATH).orderBy("n").collect()] == [tok.decode(x, skip_special_tokens=False) for x in cut] + [None]
    assert B.encode(spark.createDataFrame([(None, "a")], "doc_id long, text string"), PATH).first().doc_id is None


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        B.Bpe(public_tokenizers.path("word_bpe_49k.json"))
