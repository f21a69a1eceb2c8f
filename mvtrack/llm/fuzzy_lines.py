"""Fuzzy line deduplication over the whole corpus.

Lines are normalised (lower case, words without punctuation) and get a SimHash of
their distinct words.  Distinct normalised lines meet in a join by blocks of the
SimHash: of ``radius + 2`` blocks two agree if ``radius`` bits differ or fewer.
A changed word moves more bits than that in short lines, so they also meet by
words: in one fixed order of all words, longest first, the LOW lowest of a line
are kept, and SHARED of them are a key.  Replacing, adding or removing up to
LOW - SHARED words leaves the lowest SHARED of the common words among the LOW
lowest of both lines, so such lines always meet.  Pairs far apart in bits are
discarded, and the edit similarity of the lines decides.
Of each connected group of lines the first occurrence stays, by doc_id, then by
place in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import SHINGLE_WORDS, SIMILARITY, Judge, bit_counts, bounded, connect, cut, doc_key, meet, mix64, same_key, small_batches, table

#: Lines whose SimHashes differ in so many bits always meet, whatever words they share.
RADIUS = 1
#: Lowest words kept of a line, and how many of them two lines must share to meet.
LOW, SHARED = 5, 3
#: Bits in which two lines may differ and still be compared: two words of six move 17 +- 3.5, unlike lines differ by 32 +- 4.
FAR = 26
#: Groups of more lines under one key are held against so many hubs first, one after the other.
GROUP, HUBS = 8, 1
#: Words of so many bytes or more are equally long in the order of words.
LONG_BYTES = 15
#: Lines looked up, or documents with dropped lines, by broadcast at most; more go by a shuffled join.
BROADCAST_LINES = 500_000
#: Pairs of lines, and cells of their tables, that are compared at once; so few pairs go one by one.
PAIRS, CELLS, FEW = 1 << 14, 1 << 22, 16
#: Shorter lines of fewer words than ``least_words`` stay, even if repeated.
TRIVIAL_CHARS = 12
#: Bytes of text that are taken apart together.
TOGETHER = 1 << 20
#: Runs of scripts that don't part words: Thai to Tibetan, Burmese, Khmer, Japanese, Chinese.
_UNSPACED_CHARS = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_UNSPACED_CHARS}]+")
_MARKS = re.compile(r"[^\w\x00-\x7f]")
_LATIN = bytes(c if c < 128 or _MARKS.match(chr(c)) is None else 32 for c in range(256))
_LINES = "id long, dh long, no int, h long, fp long, size int, " + ", ".join(f"low{k} int" for k in range(LOW))


def _pairs_of(run: re.Match[str]) -> str:
    """Pairs of neighbouring characters as words; all but the first are marked as going on."""
    own = run[0]
    return f" {own[:2]} " + "".join(f"\ue000{own[i : i + 2]} " for i in range(1, len(own) - 1))


def _plain(text: str | None) -> str:
    """Lower case, with punctuation beyond ASCII as spaces, and pairs of characters where scripts don't part words."""
    low = (text or "").lower()
    if low.isascii():
        return low
    try:
        return low.encode("latin-1").translate(_LATIN).decode("latin-1")
    except UnicodeEncodeError:
        pass
    low = _MARKS.sub(" ", low)
    return _UNSPACED.sub(_pairs_of, low) if _UNSPACED.search(low) else low


def sketch(texts: list[str | None], least_words: int = SHINGLE_WORDS) -> dict[str, np.ndarray]:
    """A row for each line worth comparing: the text, the line's number, hash, SimHash, characters and LOW lowest words.

    Lines of fewer than ``least_words`` words have no lowest words (zeros): only exact copies meet.
    """
    plain = [_plain(t).encode("utf-8", "surrogatepass") for t in texts]
    raw, begin = hashing.join(plain)
    starts, ends = hashing.spans(raw, hashing.LETTERS)
    shut = np.flatnonzero(raw == 10)
    line = np.searchsorted(shut, starts)  # of each word
    hashes = hashing.hash_spans(raw, starts, ends)
    text = np.searchsorted(begin, shut, side="right") - 1  # of each line
    first_line = np.searchsorted(shut, begin[:-1])
    size = np.fromiter((len(own) for t in texts for own in (t or "").split("\n")), np.int32, len(shut))
    at = np.searchsorted(line, np.arange(len(shut) + 1))  # the first word of each line
    count = np.diff(at)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    letters = np.concatenate(([0], np.cumsum(chars[ends] - chars[starts])))
    norm = letters[at[1:]] - letters[at[:-1]] + count - 1
    fuzzy = count >= least_words
    some = np.flatnonzero((count > 0) & (fuzzy | (norm >= TRIVIAL_CHARS)))

    place = np.arange(len(line)) - at[line]
    up = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ mix64(place.astype(np.uint64))))))
    h = mix64(up[at[1:]] - up[at[:-1]])
    # Each word once, else long lines look like their language: by line, then longest first, then by hash.
    rank = (np.uint64(LONG_BYTES) - np.minimum(ends - starts, LONG_BYTES).astype(np.uint64)) << np.uint64(36) | hashes >> np.uint64(28)
    if len(shut) < 1 << 24:
        word, _ = hashing.sorted_unique(line.astype(np.uint64) << np.uint64(40) | rank)
        owner, rank = (word >> np.uint64(40)).astype(np.int64), word & np.uint64((1 << 40) - 1)
    else:  # a text of very many lines
        order = np.lexsort((rank, line))
        owner, rank = line[order], rank[order]
        new = np.concatenate(([True], (np.diff(owner) != 0) | (rank[1:] != rank[:-1])))
        owner, rank = owner[new], rank[new]
    held, first = hashing.sorted_unique(owner)
    own = np.diff(np.append(first, len(word)))
    fp, low = np.zeros(len(shut), np.int64), np.zeros((len(shut), LOW), np.int32)
    if len(held):
        fp[held] = np.packbits(2 * bit_counts(mix64(rank), first) > own[:, None], axis=1, bitorder="little").view("<i8").ravel()
        values = mix64(rank[np.minimum(first[:, None] + np.arange(LOW), len(rank) - 1)].ravel()).astype(np.uint32).view(np.int32).reshape(-1, LOW)
        low[held] = np.where(np.arange(LOW) < own[:, None], values, -1 - np.arange(LOW, dtype=np.int32))
    low[~fuzzy] = 0
    return {"text": text[some], "no": (some - first_line[text[some]]).astype(np.int32), "h": h[some].view(np.int64), "fp": fp[some], "size": size[some], **{f"low{k}": low[some, k] for k in range(LOW)}}


def lines(docs: DataFrame, least_words: int) -> DataFrame:
    """(id, dh, no, h, fp, size, low0, ...) of the lines of all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in hashing.groups(np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts)), TOGETHER):
                made = sketch(texts[part], least_words)
                of = pa.array(made.pop("text") + part.start)
                yield pa.RecordBatch.from_arrays([batch.column("__id").take(of), batch.column("__h").take(of), *map(pa.array, made.values())], names=["id", "dh", *made])

    return small_batches(docs).select(*doc_key(), "text").mapInArrow(scan, _LINES)


def _keys(radius: int):
    """Of each line: two of ``radius + 2`` blocks of the SimHash, and SHARED of the lowest words."""
    cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        fp = np.asarray(batch.column("fp")).view(np.uint64)
        low = np.stack([np.asarray(batch.column(f"low{k}")) for k in range(LOW)], axis=1)
        made = [mix64((fp & np.uint64(a | b)) ^ mix64(np.full(1, a | b, np.uint64))) for a, b in combinations(masks, 2)]
        filler = (low < 0) & (low >= -LOW)
        for some in combinations(range(LOW), SHARED):
            key = np.full(len(fp), 1, np.uint64)
            for k in some:
                key = mix64(key ^ low[:, k].astype(np.uint32).astype(np.uint64))
            made.append(np.where(filler[:, some[-2]], np.uint64(0), key))  # fillers that any line may have are no key
        return np.where((low == 0).all(axis=1)[:, None], np.uint64(0), np.stack(made, axis=1)).view(np.int64)

    return keys


def _script(a: str, b: str) -> int:
    """The characters that a plain way of turning one line into the other changes: never less than the edit distance.

    Equal words are passed; where words differ, the nearest pair of equal words ahead, some words apart at most, is where they meet again.
    """
    x, y = a.split(" "), b.split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        step = next(((p, d - p) for d in range(1, 9) for p in range(d + 1) if i + p < len(x) and j + d - p < len(y) and x[i + p] == y[j + d - p]), (len(x) - i, len(y) - j))
        p, q = sum(map(len, x[i : i + step[0]])) + step[0], sum(map(len, y[j : j + step[1]])) + step[1]
        cost += max(p, q)
        i, j = i + step[0], j + step[1]
    return cost + sum(map(len, x[i:])) + len(x) - i + sum(map(len, y[j:])) + len(y) - j


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is ``most`` or less: what both share at the ends, then columns of bits for the rest.

    A column holds the rows that a way of ``most`` changes can pass; along the
    last cell's diagonal the distance never falls, so it ends as soon as it is too large.
    """
    if abs(len(a) - len(b)) > most:
        return False
    if _script(a, b) <= most:
        return True
    for _ in range(2):  # the shared start, then the shared end, each by halving
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
        a, b = a[low:][::-1], b[low:][::-1]
    if len(a) < len(b):
        a, b = b, a
    score = len(a) - len(b)
    before = (most - score) // 2
    last = score + before
    every = (1 << last + before + 1) - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(a, before):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down = every >> before << before, 0
    for j, c in enumerate(b):
        same = masks.get(c, 0) >> j & every
        flat = ((((same & up) + up) ^ up) | same | down) & every
        score += not flat >> last & 1
        if score > most:
            return False
        rise, fall = down | (flat | up) ^ every, up & flat
        flat >>= 1
        up, down = fall | (flat | rise) ^ every, rise & flat
    return score <= most


def _together(mask: np.ndarray, code: np.ndarray, own: np.ndarray, other: np.ndarray, size: np.ndarray, over: np.ndarray, most: np.ndarray, before: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``within`` for many pairs, a column of all of them at a time; and which pairs are open when fewer than FEW are left.

    ``mask`` has the words of bits of each (line, character), ``code`` the
    characters of the other lines by column; a pair has its place in both,
    the other's length and by how much the first is longer.
    """
    found, pair, score = np.zeros(len(own), bool), np.arange(len(own)), over.copy()
    up = np.zeros((words, len(own)), np.uint64)
    for w in range(words):
        up[w] = np.uint64((((1 << 64 * words) - 1) >> before << before) >> 64 * w & (1 << 64) - 1)
    down, one = np.zeros_like(up), np.uint64(1)
    for j in range(int(size.max())):
        if not j % 16:
            found[pair[(size <= j) & (score <= most)]] = True
            on = np.flatnonzero((size > j) & (score <= most))
            if len(on) < FEW:
                return found, pair[on]
            if len(on) < len(pair):
                pair, score, own, other, size, over, most = (x[on] for x in (pair, score, own, other, size, over, most))
                up, down = up[:, on], down[:, on]
            cell, shift = ((over + before) >> 6) * len(on) + np.arange(len(on)), ((over + before) & 63).astype(np.uint64)
        cells = mask[j >> 6 : (j >> 6) + words + 1].take(own + code[j].take(other), axis=1)
        same = cells[:-1] >> np.uint64(j & 63) | cells[1:] << np.uint64(64 - (j & 63)) if j & 63 else cells[:-1]
        flat = (same & up) + up
        carry = flat < up
        for w in range(1, words):
            flat[w] += carry[w - 1]
            carry[w] |= flat[w] < carry[w - 1]
        flat = (flat ^ up) | same | down
        score += (((flat.ravel().take(cell) >> shift) & one) == 0) & (size > j)
        rise, fall = down | ~(flat | up), up & flat
        next_ = flat >> one
        next_[:-1] |= flat[1:] << np.uint64(63)
        up, down = fall | ~(next_ | rise), rise & next_
    found[pair[score <= most]] = True
    return found, pair[:0]


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, ... within each of some lines, and the line's number."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of], of


def alike(lines: list[str], x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the edit similarity of each pair lines[x[i]], lines[y[i]] reaches the bound."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    x, y = np.where(length[x] < length[y], y, x), np.where(length[x] < length[y], x, y)
    most, over = (length[x] * (1 - similarity) + 1e-9).astype(np.int64), length[x] - length[y]
    found = np.zeros(len(x), bool)
    order = np.lexsort((x, length[x]))
    order = order[over[order] <= most[order]]
    if not len(order):
        return found
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum(length) - length
    seen = np.zeros(int(flat.max(initial=0)) + 1, bool)
    seen[flat] = True
    chars = int(seen.sum())
    codes = (np.cumsum(seen) - 1).astype(np.int32)[flat]
    single = [order[:0]]
    while len(order):  # parts of like lengths
        part = order[:PAIRS]
        size = length[x[part]]
        lines_held = np.cumsum(np.concatenate(([True], np.diff(x[part]) != 0)))
        fits = (lines_held * chars * (size // 32 + 4) <= CELLS) & (np.arange(1, len(part) + 1) * size <= CELLS) & (size <= 2 * size[0] + 64)
        part = part[: max(1, int(np.argmin(np.append(fits, False))))]
        order = order[len(part) :]
        half = (most[part] - over[part]) // 2
        before, words = int(half.max()), int(half.max() + (over[part] + half).max()) // 64 + 1
        if len(part) < FEW + 2 * words:
            single.append(part)
            continue
        (left, own), (right, other) = (np.unique(z[part], return_inverse=True) for z in (x, y))
        n, of = _places(length[left])
        bit = n + before
        mask = np.zeros((max(int(bit.max(initial=0)) >> 6, int(length[right].max()) >> 6) + words + 2, len(left) * chars), np.uint64)
        np.bitwise_or.at(mask.reshape(-1), (bit >> 6) * mask.shape[1] + of * chars + codes[begin[left][of] + n], np.uint64(1) << (bit & 63).astype(np.uint64))
        n, of = _places(length[right])
        code = np.zeros((int(length[right].max()), len(right)), np.int32)
        code[n, of] = codes[begin[right][of] + n]
        found[part], rest = _together(mask, code, own * chars, other, length[y[part]], over[part], most[part], before, words)
        single.append(part[rest])
    rest = np.concatenate(single)
    found[rest] = [within(lines[a], lines[b], k) for a, b, k in zip(x[rest].tolist(), y[rest].tolist(), most[rest].tolist(), strict=True)]
    return found


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(n, line) of distinct lines, from the documents in which they come first."""
    by_doc = wanted.groupBy(F.col("first.id").alias("__id"), F.col("first.dh").alias("__h")).agg(F.collect_list(F.struct("n", F.col("first.no").alias("no"))).alias("picks"))
    by_doc = cut(by_doc)
    few = (by_doc.agg(F.sum(F.size("picks"))).first()[0] or 0) <= BROADCAST_LINES
    own = docs.select(*doc_key(), "text")
    rows = own.join(F.broadcast(by_doc) if few else by_doc, same_key(own, by_doc)).select("picks", F.split("text", "\n", -1).alias("all"))
    return rows.select(F.expr("inline(transform(picks, p -> struct(p.n AS n, lower(all[p.no]) AS line)))")).dropDuplicates(["n"])


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) whose edit similarity reaches the bound."""

    @F.pandas_udf("boolean")
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        at = np.arange(len(left))
        return pd.Series(alike([*left, *right], at, at + len(left), similarity))

    a, b = (texts.select(F.col("n").alias(n), F.col("line").alias(x)) for n, x in (("__a", "x"), ("__b", "y")))
    both = pairs.join(a, F.col("src") == F.col("__a")).join(b, F.col("dst") == F.col("__b"))
    return both.where(f"least(length(x), length(y)) >= {similarity}D * greatest(length(x), length(y)) - 1").where(close("x", "y")).select("src", "dst")


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose SimHashes differ in FAR bits or fewer."""
    x, y = (nodes.select(F.col("n").alias(f"__{c}"), F.col("fp").alias(f"__{c}p")) for c in "xy")
    both = pairs.join(x, F.col("src") == F.col("__x")).join(y, F.col("dst") == F.col("__y"))
    return both.where(f"bit_count(__xp ^ __yp) <= {FAR}").select("src", "dst")


class _Lines(Judge):
    """Lines by the bits of their SimHashes and by their edit similarity, which costs least for many at once."""

    quota, more = 16, 4

    def __init__(self, rows: pa.Table, similarity: float) -> None:
        self.fp, self.line, self.similarity = rows["fp"].to_numpy().view(np.uint64), rows["line"], similarity

    def distance(self, x: slice, y: slice) -> np.ndarray:
        bits = np.bitwise_count(self.fp[x, None] ^ self.fp[y]).astype(np.int8)
        return np.where(bits <= FAR, bits, np.int8(-1))

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        held, at = np.unique(np.concatenate((x, y)), return_inverse=True)
        return alike(self.line.take(held).to_pylist(), at[: len(x)], at[len(x) :], self.similarity)


def line_classes(docs: DataFrame, least_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, hubs: int | None = HUBS) -> tuple[DataFrame, DataFrame]:
    """All occurrences (id, dh, no, n) of lines, and (n, class, keep) of those that occur twice or have a link.

    ``hubs`` changes the work, not the classes: of a group of more than GROUP
    lines, each is held against so many hubs before all that is still apart is
    held against each other.
    """
    each = table(lines(docs, least_words).withColumnRenamed("h", "n"))
    first = F.min(F.struct("id", "dh", "no")).alias("first")
    distinct = table(each.groupBy("n").agg(first, F.count("*").alias("times"), *[F.min(c).alias(c) for c in ("fp", "size", *(f"low{k}" for k in range(LOW)))]))
    nodes = distinct.drop("first")
    pairs, hot = meet(nodes, _keys(radius), similarity, GROUP)
    named = pairs.select(F.explode(F.array("src", "dst")).alias("__n")).union(hot.select("n")).distinct()
    texts = table(_line_texts(docs, distinct.join(named, F.col("n") == F.col("__n"), "left_semi")))
    told = nodes.select(F.col("n").alias("__of"), "fp").join(texts, F.col("__of") == F.col("n")).select("n", "fp", "line")
    found = connect(pairs, hot, lambda p: cut(_similar(_near(p, nodes), texts, similarity)), told, lambda rows: _Lines(rows, similarity), similarity, hubs)

    classed = distinct.select("n", "first", "times").join(found, F.col("n") == F.col("node"), "left").select("n", F.coalesce("component", "n").alias("class"), "first", "times")
    kept = classed.groupBy("class").agg(F.min("first").alias("keep"), F.sum("times").alias("times")).where("times > 1").select(F.col("class").alias("__class"), "keep")
    return each.select("id", "dh", "no", "n"), classed.join(kept, F.col("class") == F.col("__class")).select("n", "class", "keep")


def drop_repeated_lines(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and counts ``__n_lines`` and ``__n_removed``.

    Lines of fewer than ``least_words`` words go only where they repeat another
    exactly, but for case and punctuation, and have TRIVIAL_CHARS characters;
    where a script doesn't part words, pairs of characters count as words.  Null texts stay
    null and empty ones empty, with no removed lines.  Rows repeated whole are
    one document and are treated alike; rows that share only the doc_id are
    ordered by the hash of their text, null ids first.  An empty table gives no
    rows; all other columns pass, whatever their names.
    """
    each, classes = line_classes(docs, **how)
    named = classes.select(F.col("n").alias("__n"), "keep")
    drops = each.join(named, F.col("n") == F.col("__n")).where(~F.struct("id", "dh", "no").eqNullSafe(F.col("keep")))
    drops = bounded(cut(drops.groupBy(F.col("id").alias("__of"), F.col("dh").alias("__dh")).agg(F.collect_set("no").alias("__drop"))), BROADCAST_LINES)
    own = docs.withColumn("__h", F.xxhash64(text))
    rows = own.join(drops, (F.col("__h") == F.col("__dh")) & own["doc_id"].eqNullSafe(F.col("__of")), "left")
    rest = "array_join(transform(array_except(sequence(0, size(__all) - 1), __drop), i -> __all[i]), '\\n')"
    out = rows.withColumn("__all", F.split(text, "\n", -1)).withColumn("__n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size("__all")).cast("long"))
    out = out.withColumn("__n_removed", F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long"))
    return out.withColumn(text, F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.expr(rest))).drop("__h", "__of", "__dh", "__drop", "__all")
