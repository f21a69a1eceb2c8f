"""Repeated passages across documents, by compressed FM-indexes.

Windows of ``window`` words that occur twice must meet in one index.  Each
window is sent where the smallest hash of its five-word shingles says (its
minimizer), so that equal windows go to the same shard; neighbouring windows
with one minimizer travel as one segment, and minimizers that only one place of
the corpus has are left out.  A shard builds an FM-index of its distinct
segments: the Burrows-Wheeler transform of their words in a wavelet matrix of
packed bits, and two bit vectors that mark where the sorted suffixes differ
within ``window`` and ``window - 1`` words.  The segments are then streamed
against it from right to left: one backward step, and one step back to the
shorter context, give the suffix interval of each next window, and the interval
tells where the window first occurs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_key, mix64, small_batches, table

WINDOW = 20
SHINGLE = 5
#: Minimizers of more places than this send each window by itself, to the shard of its own hash.
HOT = 4096
SHARD_WORDS = 1_000_000
#: What is left out of texts is brought to them by broadcast up to so many texts and pieces, else by a shuffled join.
BROADCAST_TEXTS, BROADCAST_PIECES = 500_000, 4_000_000
_RUNS = "struct<m:array<long>,start:array<int>,again:array<boolean>>"
_SEGMENTS = "array<struct<own:boolean,m:long,start:int,size:int,seg:string>>"
_FOUND = "route long, k binary, dh long, start int, n long, offsets array<int>"


# -- windows and their minimizers ------------------------------------------------------------------


def _minimizers(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the smallest hash of its shingles; and the hashes that the text has twice."""
    crc = mix64(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))
    n = len(words) - SHINGLE + 1
    low = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        low = low * np.uint64(0x9E3779B97F4A7C15) + crc[k : k + n]
    low, size, want = mix64(low), 1, window - SHINGLE + 1
    ranked = np.sort(low)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    while size < want:  # of runs of 2, 4, ... shingles
        step = min(size, want - size)
        low, size = np.minimum(low[:-step], low[step:]), size + step
    return low, twice


def runs(window: int = WINDOW) -> Column:
    """Of the column ``text``: where windows with one minimizer begin, that minimizer, and whether the text has it again; the last start is the end."""

    @F.pandas_udf(_RUNS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            made = []
            for text in texts:
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    made.append((np.zeros(0, np.int64), np.zeros(1, np.int32), np.zeros(0, bool)))
                    continue
                low, twice = _minimizers(words, window)
                at = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
                made.append((low[at].view(np.int64), np.append(at, len(low)).astype(np.int32), np.isin(low[at], twice)))
            yield pd.DataFrame({"m": [m for m, _, _ in made], "start": [s for _, s, _ in made], "again": [a for _, _, a in made]})

    return scan.asNondeterministic()(F.col("text"))


def _segments(window: int, text: str, picks: str) -> Column:
    """The words of each picked run (m, start, stop, hot); hot runs window by window."""

    @F.pandas_udf(_SEGMENTS)
    def take(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, picked in batches:
            made = []
            for t, runs_ in zip(texts, picked, strict=True):
                words, out = t.encode("utf-8", "surrogatepass").split(), []
                for r in runs_:
                    spans = [(s, s + 1) for s in range(r["start"], r["stop"])] if r["hot"] else [(r["start"], r["stop"])]
                    out += [{"own": r["hot"], "m": r["m"], "start": a, "size": b - a, "seg": b" ".join(words[a : b + window - 1]).decode("utf-8")} for a, b in spans]
                made.append(out)
            yield pd.Series(made, dtype=object)

    return take.asNondeterministic()(F.col(text), F.col(picks))


# -- the index ------------------------------------------------------------------------------------


class Bits:
    """A bit vector in packed words, with counts at every word for rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words))[:-1])).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Wavelet:
    """A wavelet matrix: one bit vector for each bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, top.bit_length()))):
            bits = (symbols >> shift & 1).astype(np.uint8)
            zeros = int(len(bits) - bits.sum())
            self.levels.append((shift, Bits(bits), zeros))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its i."""
        low = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low


class FmIndex:
    """Of texts given as one array of symbols from 1, each text closed by a 0; ``where`` has a position for each symbol.

    Suffixes are sorted by their first ``window`` symbols, which is all that
    windows need.
    """

    def __init__(self, text: np.ndarray, where: np.ndarray, window: int):
        n, top = len(text), int(text.max())
        ranks = {1: text.astype(np.int64)}

        def longer(a: int, b: int) -> np.ndarray:
            key = ranks[a].copy() * (n + 1)
            key[: n - a] += ranks[b][a:] + 1
            return np.unique(key, return_inverse=True)[1].astype(np.int64)

        def of(k: int) -> np.ndarray:
            if k not in ranks:
                half = 1 << (k - 1).bit_length() - 1
                of(half), of(k - half)
                ranks[k] = longer(half, k - half)
            return ranks[k]

        full, less = of(window), of(window - 1)
        order = np.argsort(full, kind="stable")
        self.wavelet = Wavelet(text[order - 1], top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        new = lambda r: np.concatenate(([True], r[order][1:] != r[order][:-1]))
        starts, shorter = np.flatnonzero(new(full)), np.flatnonzero(new(less))
        self.mark = Bits(new(less).astype(np.uint8))
        self.shorter = np.append(shorter, n)
        self.earliest = np.minimum.reduceat(where[order], starts)
        self.interval = Bits(new(full).astype(np.uint8))
        self.n, self.window = n, window

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of symbol + context, from that of the context."""
        first = self.first[symbol]
        return first + self.wavelet.rank(symbol, low), first + self.wavelet.rank(symbol, high)

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of a window's context without its last symbol."""
        return self.shorter[self.mark.rank(low + 1) - 1], self.shorter[self.mark.rank(high)]

    def statistics(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stream texts of the index, from right to left and all at once: yields (which text, offset, earliest position) for each window that matches."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64)
        for step in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -step, side="left"))  # texts longer than the step
            at = lengths[:live] - 1 - step
            if step >= self.window:
                low[:live], high[:live] = self.shorten(low[:live], high[:live])
            low[:live], high[:live] = self.back(text[starts[:live] + at], low[:live], high[:live])
            if step >= self.window - 1:
                found = low[:live] < high[:live]
                yield order[:live][found], at[found], self.earliest[self.interval.rank(low[:live][found] + 1) - 1]


def _search_shard(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """The windows of each distinct segment that also start earlier."""
    words = [s.encode("utf-8", "surrogatepass").split() for s in rows["seg"]]
    code: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[starts + lengths] = False
    text[inside] = np.fromiter((code.setdefault(w, len(code) + 1) for own in words for w in own), np.int64, int(lengths.sum()))
    del words
    # Positions in order: null doc_ids last, then doc_id, text hash and start.
    keys = [rows[c].to_numpy(np.int64) for c in ("dh", "id", "none")]
    order = np.lexsort(keys)
    new = np.concatenate(([False], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)))
    rank = np.zeros(len(rows), np.int64)
    rank[order] = np.cumsum(new)
    begin = (rank << 32) + rows["start"].to_numpy(np.int64)
    where = np.full(len(text), np.iinfo(np.int64).max)
    offset = np.arange(len(text)) - np.repeat(starts, lengths + 1)
    where[inside] = (np.repeat(begin, lengths + 1) + offset)[inside]

    index = FmIndex(text, where, window)
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    for which, at, earliest in index.statistics(text, starts, lengths):
        early = earliest < begin[which] + at
        hits.append((which[early], at[early]))
    which, at = (np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((at, which))
    which, at = which[order], at[order].astype(np.int32)
    at = np.split(at, np.searchsorted(which, np.arange(1, len(rows))))
    some = np.flatnonzero((rows["n"].to_numpy() > 1) | np.array([len(a) > 0 for a in at]))
    found = rows.iloc[some][["route", "k", "dh", "start", "n"]].reset_index(drop=True)
    found["offsets"] = pd.Series([at[k] for k in some], dtype=object)
    return found


# -- the operator ---------------------------------------------------------------------------------


def _kept(window: int) -> Column:
    @F.pandas_udf("struct<n_words:long,n_removed:long,kept:string,kept_sha256:string>")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, copies, pieces in batches:
            made = []
            for text, copy, gone in zip(texts, copies, pieces, strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if copy and n >= window:
                    words = []
                elif gone is not None and len(gone):
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [p["start"] for p in gone], 1)
                    np.add.at(edge, [p["stop"] for p in gone], -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                rest = b" ".join(words)
                made.append((n, n - len(words), rest.decode("utf-8"), hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(made, columns=["n_words", "n_removed", "kept", "kept_sha256"])

    return keep.asNondeterministic()(F.col("text"), F.col("copy"), F.col("pieces"))


def _second() -> Column:
    """A hash of the text apart from its key's."""
    return F.xxhash64(F.lit(7), F.octet_length("text"), F.col("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (dh, least doc_id, rows), and (dh, pieces) of what their windows that also start earlier cover."""
    docs = small_batches(docs)
    # A second hash of the text that counts as first: another text of the same hash is neither its copy nor has its pieces.
    first_ = F.min(F.struct(F.col("__id").isNull(), "__id", "__g")).alias("f")
    least = docs.select(*doc_key(), _second().alias("__g")).groupBy(F.col("__h").alias("dh")).agg(first_, F.count("*").alias("rows"))
    least = cut(least.select("dh", F.col("f.__id").alias("id"), F.col("f.__g").alias("g"), "rows"))
    scanned = docs.select(F.xxhash64("text").alias("dh"), runs(window).alias("r")).where("size(r.m) > 0")
    each = table(scanned).select("dh", F.expr("inline(transform(r.m, (m, i) -> struct(m, r.start[i] AS start, r.start[i + 1] AS stop, r.again[i] AS again)))"))
    places = each.groupBy("m").agg(F.min("dh").alias("a"), F.max("dh").alias("b"), F.count("*").alias("n"), F.max("again").alias("again"))
    # Copies of one text count as one place.
    shared = places.where("a <> b OR again").select(F.col("m").alias("sm"), (F.col("n") > HOT).alias("hot"))
    picked = each.select("m", "dh", "start", "stop").join(shared, F.col("m") == F.col("sm")).groupBy("dh").agg(F.collect_set(F.struct("m", "start", "stop", "hot")).alias("picks"))
    picked = table(picked.join(least.select(F.col("dh").alias("ldh"), "id"), F.col("dh") == F.col("ldh")).select("dh", "id", "picks"))
    total = picked.agg(F.sum(F.expr(f"aggregate(picks, 0L, (s, p) -> s + p.stop - p.start + if(p.hot, {window - 1} * (p.stop - p.start), {window - 1}))"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))

    own = docs.select(*doc_key(), "text")
    first = own.join(picked, (own["__h"] == picked["dh"]) & own["__id"].eqNullSafe(picked["id"]))
    parts = first.select("dh", "id", F.explode(_segments(window, "text", "picks")).alias("s")).select("dh", "id", "s.*")
    route = F.pmod(F.when(F.col("own"), F.xxhash64("seg")).otherwise(F.col("m")), F.lit(shards))
    parts = table(parts.select(route.alias("route"), F.unhex(F.md5("seg")).alias("k"), "seg", "own", "dh", "id", "start", "size"))
    # Each distinct segment goes once, with its first place; a window by itself that comes once is no repeat.
    place = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "dh", "start")).alias("first")
    once = parts.groupBy("route", "seg").agg(place, F.count("*").alias("n"), F.first("own").alias("own")).where("n > 1 OR NOT own")
    once = once.select("route", F.unhex(F.md5("seg")).alias("k"), "seg", "n", "first.dh", F.col("first.none").cast("long").alias("none"), F.coalesce("first.id", F.lit(0)).alias("id"), "first.start")
    found = table(once.groupBy("route").applyInPandas(lambda rows: _search_shard(rows, window), _FOUND))
    # All windows of a segment that has come before start earlier.
    later = found.where("n > 1").select(F.col("route").alias("r2"), F.col("k").alias("k2"), F.col("dh").alias("dh2"), F.col("start").alias("start2"))
    again = parts.select("route", "k", "dh", "start", "size").join(later, (F.col("route") == F.col("r2")) & (F.col("k") == F.col("k2"))).where("dh <> dh2 OR start <> start2")
    again = again.select("dh", F.expr(f"array(struct(start, start + size + {window - 1} AS stop))").alias("p"))
    # Runs of offsets as pieces of the text.
    edges = "filter(offsets, (o, i) -> i = 0 OR o > offsets[i - 1] + 1)"
    ends = "filter(offsets, (o, i) -> i = size(offsets) - 1 OR o < offsets[i + 1] - 1)"
    pieces = found.where("size(offsets) > 0").select("dh", F.expr(f"zip_with({edges}, {ends}, (a, b) -> struct(start + a AS start, start + b + {window} AS stop))").alias("p"))
    return least, pieces.union(again).groupBy("dh").agg(F.flatten(F.collect_list("p")).alias("pieces"))


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) for every row: what is left without repeated windows.

    A word goes if a window of ``window`` words that covers it also starts
    earlier: in a document of smaller doc_id, or further up in its own.  Null
    doc_ids come last; documents with one doc_id are ordered by the hash of
    their text; rows repeated whole are one document and are treated alike.
    Null and empty texts have no words.  An empty table gives no rows; other
    columns are not read.
    """
    least, pieces = repeated_windows(docs, window)
    known = least.join(pieces.withColumnRenamed("dh", "pdh"), F.col("dh") == F.col("pdh"), "left").where("rows > 1 OR pieces IS NOT NULL")
    known = table(known.select("dh", "id", "g", "pieces"))
    texts, parts = known.agg(F.count("*"), F.sum(F.size("pieces"))).first()
    few = texts <= BROADCAST_TEXTS and (parts or 0) <= BROADCAST_PIECES
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"), _second().alias("__g"))
    rows = own.join(F.broadcast(known) if few else known, (F.col("__h") == F.col("dh")) & (F.col("__g") == F.col("g")), "left")
    copy = F.col("dh").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("id"))
    return rows.select("doc_id", "text", copy.alias("copy"), "pieces").select("doc_id", _kept(window).alias("__kept")).select("doc_id", "__kept.*")
