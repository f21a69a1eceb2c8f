"""Benchmark passages in documents, by SimHash over windows as long as each item.

Every document is read through windows of as many words as each benchmark item
has.  A window's SimHash over its five-word shingles comes from running sums of
bits, so windows at every word cost little.  Items are indexed by four blocks of
16 bits of their SimHash: of two fingerprints within the radius, one block
differs by a quarter of it at most, and all values so near are looked up, so
every item within the radius is found.  What is found is verified by the
similarity of the two multisets of shingles.  A window that has no shingle of any
item has similarity 0 and is not fingerprinted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import SHINGLE_WORDS, SIMILARITY, small_batches

#: At a similarity of 0.8, 9.7 +- 2.9 of the 64 bits differ; 64 compares every window that shares a shingle with an item.
RADIUS = 19
#: Items are sent to the executors in parts of so many bytes of text at most, with one pass over the documents for each.
PART_BYTES = 4 << 20
#: Up to so many items of one length are compared one by one; more, by their blocks.
DIRECT = 2048
#: Windows fingerprinted together, pairs compared together, and bytes of text hashed together.
_STEP, _PAIRS, _TOGETHER = 8192, 1 << 20, 1 << 20
_WORDS = re.compile(r"\w+")
_MARKS = re.compile(r"[^\w\x00-\x7f]")
_MATCHES = "array<struct<item:int,start:int,words:int,similarity:double>>"
NO_ID = -(1 << 63)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin."""
    low = [(t or "").lower() for t in texts]
    return hashing.words([(t if t.isascii() else _MARKS.sub(" ", t)).encode("utf-8", "surrogatepass") for t in low], hashing.LETTERS)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Their bits as a row each of +1 and -1."""
    return 2 * np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) - 1


def similarity(a: list[str], b: list[str], k: int) -> float:
    """Weighted Jaccard: shingles count as often as they occur."""
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


class _Sized:
    """The items of one length in words, with their block index."""

    def __init__(self, size: int, shingle_words: int, radius: int):
        self.size, self.k, self.radius = size, min(shingle_words, size), radius
        self.items: list[int] = []
        self.words: list[list[str]] = []

    def close(self) -> None:
        hashes, starts = _hashes([" ".join(w) for w in self.words])
        runs, starts = hashing.shingles(hashes, starts, self.k)
        self.known = np.unique(runs)
        self.prints = np.array([_print(_bits(runs[a:b]).sum(0)[None])[0] for a, b in zip(starts, starts[1:], strict=False)], np.uint64)
        self.blocks = None
        if len(self.prints) > DIRECT:
            keys = self.prints.view(np.uint16).reshape(-1, 4)
            self.blocks = [(np.argsort(keys[:, b], kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(keys[:, b], minlength=1 << 16))))) for b in range(4)]
            flips = [sum(1 << i for i in c) for n in range(min(self.radius // 4, 16) + 1) for c in combinations(range(16), n)]
            self.flips = np.array(flips, np.uint16)

    def near(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) within the radius, each once."""
        if self.blocks is None:
            step = max(1, _PAIRS // len(self.prints))
            for a in range(0, len(prints), step):
                rows, items = np.nonzero(np.bitwise_count(prints[a : a + step, None] ^ self.prints) <= self.radius)
                yield from zip((rows + a).tolist(), items.tolist(), strict=True)
            return
        for a in range(0, len(prints), 1024):
            found: set[tuple[int, int]] = set()
            own = prints[a : a + 1024]
            keys = own.view(np.uint16).reshape(-1, 4)
            for b, (order, starts) in enumerate(self.blocks):
                for flip in self.flips:
                    values = keys[:, b] ^ flip
                    first, size = starts[values], starts[values.astype(np.int64) + 1] - starts[values]
                    rows = np.repeat(np.arange(len(own)), size)
                    items = order[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                    close = np.bitwise_count(own[rows] ^ self.prints[items]) <= self.radius
                    found.update(zip((rows[close] + a).tolist(), items[close].tolist(), strict=True))
            yield from sorted(found)


def _print(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


class _Known:
    """Whether a hash is one of the items' shingles, by a table of low bits first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.some = np.zeros(1 << 20, bool)
        self.some[hashes & np.uint64((1 << 20) - 1)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = self.some[hashes & np.uint64((1 << 20) - 1)]
        at = np.flatnonzero(out)
        place = np.searchsorted(self.hashes, hashes[at])
        out[at] = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes[at]
        return out


class Index:
    def __init__(self, items: list[tuple[int, str | None]], shingle_words: int, radius: int):
        sized: dict[int, _Sized] = {}
        for i, text in items:
            words = words_of(text)
            if words:
                own = sized.setdefault(len(words), _Sized(len(words), shingle_words, radius))
                own.items.append(i)
                own.words.append(words)
        for own in sized.values():
            own.close()
        self.sized = [sized[n] for n in sorted(sized)]
        self.known = {k: _Known(np.unique(np.concatenate([s.known for s in self.sized if s.k == k]))) for k in sorted({s.k for s in self.sized})}

    def all_matches(self, texts: list[str | None], least: float) -> list[list[dict]]:
        """The best window of each item that each text has."""
        out: list[list[dict]] = []
        for part in hashing.groups(np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts)), _TOGETHER):
            out += self._of(texts[part], least)
        return out

    def _of(self, texts: list[str | None], least: float) -> list[list[dict]]:
        hashes, starts = _hashes(texts)
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        words: dict[int, list[str]] = {}
        for k, known in self.known.items():
            runs, begin = hashing.shingles(hashes, starts, k)
            shared = known.has(runs)
            for t in np.unique(np.searchsorted(begin, np.flatnonzero(shared), side="right") - 1).tolist():
                if starts[t + 1] - starts[t] < k:  # a text of fewer words than a shingle
                    continue
                own = words.setdefault(t, words_of(texts[t]))
                self._text(own, runs[begin[t] : begin[t + 1]], shared[begin[t] : begin[t + 1]], k, least, best[t])
        return [[{"item": i, "start": s, "words": n, "similarity": x} for i, (x, s, n) in sorted(b.items())] for b in best]

    def _text(self, words: list[str], hashes: np.ndarray, shared: np.ndarray, k: int, least: float, best: dict) -> None:
        so_far = np.concatenate(([0], np.cumsum(shared)))
        for own in self.sized:
            if own.k != k or len(words) < own.size:
                continue
            span = own.size - k + 1
            starts = np.flatnonzero(so_far[span:] > so_far[:-span])
            for a in range(0, len(starts), _STEP):
                self._look(words, hashes, starts[a : a + _STEP], span, own, least, best)

    @staticmethod
    def _look(words: list[str], hashes: np.ndarray, starts: np.ndarray, span: int, own: _Sized, least: float, best: dict) -> None:
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):  # neighbouring windows share their sums
            lo = int(run[0])
            sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(hashes[lo : int(run[-1]) + span]), axis=0, dtype=np.int32)))
            prints = _print(sums[run - lo + span] - sums[run - lo])
            for w, i in own.near(prints):
                s = int(run[w])
                x = similarity(words[s : s + own.size], own.words[i], own.k)
                if x >= least and x > best.get(own.items[i], (0,))[0]:
                    best[own.items[i]] = (x, s, own.size)


def _matcher(index: Index, least: float) -> Column:
    @F.pandas_udf(_MATCHES)
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(index.all_matches(texts.tolist(), least), dtype=object)

    return match.asNondeterministic()(F.col("text"))


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    part, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        part.append((row.item_id, row.text))
        size += len(row.text or "")
        if size >= PART_BYTES:
            yield part
            part, size = [], 0
    yield part


def with_matches(docs: DataFrame, benchmark: DataFrame, shingle_words: int = SHINGLE_WORDS, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``docs`` with an array ``__matches`` of (item_id, start, words, similarity): the best window of each item found.

    Words are runs of letters and digits in lower case.  Null and empty texts,
    and items without words, match nothing; items of fewer words than a shingle
    are one shingle.  Items with the same id or text are matched each by itself,
    and so are repeated rows.  An empty table gives no rows; all other columns
    pass, whatever their names.
    """
    out = small_batches(docs).withColumn("__matches", F.expr("cast(array() as array<struct<item_id:long,start:int,words:int,similarity:double>>)"))
    for part in _parts(benchmark):
        if any(words_of(t) for _, t in part):
            ids = F.lit([NO_ID if i is None else i for i, _ in part])
            index = Index([(n, t) for n, (_, t) in enumerate(part)], shingle_words, radius)
            out = out.withColumn("__found", _matcher(index, least))
            named = F.transform("__found", lambda m: F.struct(F.nullif(ids[m["item"]], F.lit(NO_ID)).alias("item_id"), m["start"].alias("start"), m["words"].alias("words"), m["similarity"].alias("similarity")))
            out = out.withColumn("__matches", F.concat("__matches", named)).drop("__found")
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, start, words, similarity) for every item that a document has."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, **how)
    return found.where("size(__matches) > 0").select("doc_id", F.expr("inline(__matches)"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that have no item; the others go whole."""
    return with_matches(docs, benchmark, **how).where("size(__matches) = 0").drop("__matches")
