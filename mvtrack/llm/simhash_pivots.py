"""SimHash near-duplicates, searched through tables of distances to references.

Each document has a 64-bit SimHash.  The bits are split into ``radius + 1``
blocks, so two fingerprints within the radius agree on one whole block, where
their distances to any reference are equal; in every block, and over all bits,
distances to a reference differ by the radius at most.  So the table of
distances to the references, block by block, is the index: an equi-join on the
distances of one block finds all pairs, the largest difference of coordinates
discards most, and the Hamming distance verifies what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import SHINGLE_WORDS, SIMILARITY, Judge, bit_counts, bounded, components, connect, cut, doc_key, meet, mix64, same_key, small_batches, table

#: Groups of more fingerprints that agree on a block go the way of shared one-bit neighbours.
PAIRWISE = 64


def simhash(text: str | None, words: int) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 without words."""
    if text is None:
        return 0
    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII space count
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    k = min(words, len(own))
    starts = np.concatenate(([0], ends[:-1]))[: len(own) - k + 1]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 1 << 16):  # bounds the memory for very long texts
        part = values[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(words: int) -> Column:
    """Of the column ``text``."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return fp.asNondeterministic()(F.col("text"))  # so that it runs once a row


def _references(n: int) -> list[int]:
    """Fixed references: any will do, as the bounds hold for each."""
    return [int(x) for x in np.random.default_rng(9).integers(-(2**63), 2**63 - 1, n)]


def _blocks(radius: int) -> list[int]:
    """A mask for each of radius + 1 blocks of the 64 bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distances(prints: np.ndarray, references: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of distances to all references, and a key for each block: the row of the block's own distances."""
    refs = np.array(_references(references), np.int64).view(np.uint64)
    apart = prints[:, None] ^ refs
    keys = []
    for b, mask in enumerate(np.array(_blocks(radius), np.int64).view(np.uint64)):
        row = np.full(len(prints), 1 + b, np.uint64)
        for r in range(references):
            row = mix64(row * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_count(apart[:, r] & mask))
        keys.append(row)
    return np.bitwise_count(apart).astype(np.int8), np.stack(keys, axis=1).view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def links(prints: DataFrame, radius: int = 2, references: int = 16) -> DataFrame:
    """Edges (src, dst) that join all distinct fingerprints ``fp`` within the radius, which is 2 at most.

    ``prints`` has distinct values.  Every edge is a true link.  In a block's
    group of up to PAIRWISE fingerprints all pairs are held against each other:
    the largest difference of their distances to a reference discards those that
    can't be near, and the Hamming distance verifies the others.  In larger
    groups fingerprints within 2 bits are found by the values that lie within 1
    bit of both, each linked to the smallest; that loses no connection and grows
    with the fingerprints, not with their pairs.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d, keys = _distances(np.asarray(batch.column("fp")).view(np.uint64), references, radius)
                ones = np.ones(batch.num_rows, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(ones), pa.array(ones.astype(np.int64)), _lists(d), _lists(keys)], names=["n", "size", "times", "d", "keys"])

    nodes = table(prints.select("fp").mapInArrow(measure, "n long, size int, times long, d array<tinyint>, keys array<long>"))
    pairs, hot = meet(nodes.select("n", "size", "times", "keys"), _keys, 0.0, PAIRWISE)
    x, y = (nodes.select(F.col("n").alias(f"__{c}"), F.col("d").alias(f"__{c}d")) for c in "xy")
    both = pairs.join(x, F.col("src") == F.col("__x")).join(y, F.col("dst") == F.col("__y"))
    pivots = f"forall(zip_with(__xd, __yd, (a, b) -> abs(a - b)), v -> v <= {radius})"
    listed = both.where(f"{pivots} AND bit_count(src ^ dst) <= {radius}").select("src", "dst")
    if radius == 0 or hot.isEmpty():
        return listed

    hot = hot.select(F.col("n").alias("fp")).distinct()
    near = hot.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("via"))
    if radius == 1:  # neighbours that are fingerprints themselves
        return listed.union(near.join(hot.select(F.col("fp").alias("other")), F.col("via") == F.col("other")).where("fp <> other").select("fp", "other"))
    least = near.groupBy("via").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("via", "low")
    return listed.union(near.join(least, "via").where("fp <> low").select("fp", "low")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """Classes of documents whose SimHash fingerprints link within the radius, directly or through others.

    Returns (__id, __h, fp, component_id) for every row: the document key, the
    fingerprint (long) and the smallest doc_id of the class.  Null and empty
    texts have fingerprint 0 and form one class with whatever is near 0; null
    doc_ids count only where a class has no other.  Ties and repeated rows share
    a fingerprint and so a class.  An empty table gives no rows; other columns
    are not read.
    """
    own = cut(small_batches(docs).select(*doc_key(), fingerprint(shingle_words).alias("fp")))
    least = own.groupBy("fp").agg(F.min("__id").alias("least"))
    found = components(links(own.select("fp").distinct(), radius))
    classes = least.join(found, least.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    smallest = classes.where("class <> fp OR least IS NOT NULL").groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.select("fp", "class").join(smallest, "class", "left").select(F.col("fp").alias("own_fp"), "component_id")
    return own.join(named, own.fp == named.own_fp).select("__id", "__h", "fp", "component_id")


# -- near copies by similarity --------------------------------------------------------------------

#: Fingerprints of distinct words, and the bits in which near copies may differ in each.
PRINTS, FAR = 4, 14
#: Least hashes of a text's shingles, how many of them make a key, and how many near copies share at least:
#: at a similarity of 0.8 six keys of two miss 0.2 % of the copies, and fewer than five shared of twelve are 0.06 %.
LEASTS, TOGETHER, ALIKE = 12, 2, 5
#: Groups of more texts under one key are held against so many hubs first, one after the other.
GROUP, HUBS = 8, 1
#: Texts looked up by broadcast keys at most.
BROADCAST_TEXTS = 500_000
#: Bytes of text that are hashed together.
HASHED = 1 << 20
_SKETCH = "__id long, __h long, size int, p array<long>, d array<tinyint>, m array<long>, keys array<long>"


def _words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, of which only A-Z are lower-cased and ASCII white space parts, and where each text's begin."""
    return hashing.words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts], hashing.UNSPACED)


def sketch(texts: list[str | None], words: int, references: int) -> dict[str, np.ndarray]:
    """A row for each text: distinct shingles, fingerprints, their distances to the references, least hashes, keys; zeros without words.

    A key is the row of a block's distances to all references, for each block of
    each fingerprint, or TOGETHER of the least hashes.
    """
    odd = np.random.default_rng(11).integers(0, 1 << 63, LEASTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(texts)
    hashes, starts = _words_of(texts)
    some = np.flatnonzero(np.diff(starts) > 0)
    made = {"size": np.zeros(n, np.int32), "p": np.zeros((n, PRINTS), np.int64), "d": np.zeros((n, PRINTS * references), np.int8), "m": np.zeros((n, LEASTS), np.int64), "keys": np.zeros((n, PRINTS * len(_blocks(2)) + LEASTS // TOGETHER), np.int64)}
    if not len(some):
        return made
    own, begin = hashing.distinct(hashes, starts)  # each word once: else long texts look like their language
    sizes = np.diff(begin)[some]
    keys = []
    for k in range(PRINTS):
        ones = bit_counts(mix64(own + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), begin[some])
        fp = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
        d, rows = _distances(fp, references, 2)
        made["p"][some, k] = fp.view(np.int64)
        made["d"][some, k * references : (k + 1) * references] = d
        keys += [mix64(row ^ mix64(np.full(1, k + 1, np.uint64))) for row in rows.view(np.uint64).T]
    runs, first = hashing.shingles(hashes, starts, words)
    runs, first = hashing.distinct(runs, first)
    made["size"][some] = np.diff(first)[some]
    least = np.stack([np.minimum.reduceat(mix64(runs ^ o), first[:-1][some]) for o in odd], axis=1)
    made["m"][some] = least.view(np.int64)
    for k in range(0, LEASTS, TOGETHER):
        row = np.full(len(some), 1000 + k, np.uint64)
        for i in range(TOGETHER):
            row = mix64(row ^ least[:, k + i])
        keys.append(row)
    made["keys"][some] = np.stack(keys, axis=1).view(np.int64)
    return made


def sketches(docs: DataFrame, words: int, references: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells(x: np.ndarray) -> pa.Array:
            return pa.array(x) if x.ndim == 1 else _lists(x)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in hashing.groups(np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts)), HASHED):
                made = sketch(texts[part], words, references)
                size = part.stop - part.start
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(part.start, size), batch.column("__h").slice(part.start, size), *map(cells, made.values())], names=["__id", "__h", *made])

    return small_batches(docs).select(*doc_key(), "text").mapInArrow(scan, _SKETCH)


def similar(left: list[str], right: list[str], words: int, least: float) -> list[bool]:
    """Whether the distinct shingles of each pair of texts are as similar as ``least``."""
    (x, a), (y, b) = (hashing.distinct(*hashing.shingles(*_words_of(t), words)) for t in (left, right))
    out = []
    for k in range(len(left)):
        u, v = x[a[k] : a[k + 1]], y[b[k] : b[k + 1]]
        shared = int(np.isin(u, v, assume_unique=True).sum())
        out.append(shared >= least * (len(u) + len(v) - shared))
    return out


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    @F.pandas_udf("boolean")
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        out: list[bool] = []
        for part in hashing.groups((left.str.len() + right.str.len()).to_numpy(), HASHED):
            out += similar(left[part].tolist(), right[part].tolist(), words, least)
        return pd.Series(out, dtype=bool)

    a, b = (texts.select(F.col("n").alias(n), F.col("body").alias(x)) for n, x in (("__a", "x"), ("__b", "y")))
    return pairs.join(a, F.col("src") == F.col("__a")).join(b, F.col("dst") == F.col("__b")).where(close("x", "y")).select("src", "dst")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    rows = batch.column("keys")
    return np.asarray(rows.flatten()).reshape(len(rows), -1)


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose largest difference of distances to a reference, and whose bits, are FAR or less, or that share least hashes."""
    x, y = (nodes.select(F.col("n").alias(f"__{c}"), *[F.col(v).alias(f"{c}{v}") for v in "pdm"]) for c in "xy")
    both = pairs.join(x, F.col("src") == F.col("__x")).join(y, F.col("dst") == F.col("__y"))
    pivots = f"forall(zip_with(xd, yd, (a, b) -> abs(a - b)), v -> v <= {FAR})"
    bits = f"forall(zip_with(xp, yp, (a, b) -> bit_count(a ^ b)), v -> v <= {FAR})"
    alike = f"size(filter(zip_with(xm, ym, (a, b) -> a = b), v -> v)) >= {ALIKE}"
    return both.where(f"{alike} OR ({pivots} AND {bits})").select("src", "dst")


class _Texts(Judge):
    """Texts by their least hashes or the bits of their fingerprints, as in ``_plausible``, and by their shingles."""

    def __init__(self, rows: pa.Table, words: int, least: float) -> None:
        self.p, self.m = (np.asarray(rows[c].combine_chunks().flatten()).reshape(rows.num_rows, -1).view(np.uint64) for c in "pm")
        self.body, self.words, self.least = rows["body"], words, least
        self.runs: dict[int, np.ndarray] = {}

    def distance(self, x: slice, y: slice) -> np.ndarray:
        shared = sum((self.m[x, k, None] == self.m[y, k]).astype(np.int8) for k in range(self.m.shape[1]))
        near = np.ones(shared.shape, bool)
        for k in range(self.p.shape[1]):
            near &= np.bitwise_count(self.p[x, k, None] ^ self.p[y, k]) <= FAR
        return np.where((shared >= ALIKE) | near, np.int8(self.m.shape[1]) - shared, np.int8(-1))

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        new = [k for k in np.union1d(x, y).tolist() if k not in self.runs]
        texts = self.body.take(pa.array(new, pa.int64())).to_pylist()
        for part in hashing.groups(np.fromiter(map(len, texts), np.int64, len(texts)), HASHED):
            runs, at = hashing.distinct(*hashing.shingles(*_words_of(texts[part]), self.words))
            self.runs.update(zip(new[part], np.split(runs, at[1:-1]), strict=True))
        out = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            u, v = self.runs[a], self.runs[b]
            shared = int(np.isin(u, v, assume_unique=True).sum())
            out.append(shared >= self.least * (len(u) + len(v) - shared))
        return np.array(out, bool)


def similar_documents(docs: DataFrame, words: int = SHINGLE_WORDS, least: float = SIMILARITY, references: int = 16, hubs: int | None = HUBS) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of ``least`` or more over their word shingles.

    Candidates agree, in a block of one of PRINTS fingerprints of their words,
    on the distances to all references; in every fingerprint their distances to
    a reference and their bits differ by FAR at most.  Or they share least hashes
    of their shingles, which hold for passages added, cut off or moved as for
    scattered edits.  Shingles verify them.
    Of more than GROUP texts with a key in common, each is held against the one
    that shares most keys with most others (and ``hubs`` - 1 more, out of what
    that has no link with); then all that is still apart is held against each
    other, so ``hubs`` changes the work, not the classes.  Each text has 18 keys
    with hubs of their own.
    Copies of a text count once.  Returns (__id, __h, class, n), a row for each
    distinct document key: n is the rows that have it.  Null, empty and blank
    texts are one class; an empty table gives no rows; other columns are not
    read, whatever their names.
    """
    own = table(sketches(docs, words, references))
    nodes = own.withColumn("n", F.when(F.col("size") == 0, 0).otherwise(F.col("__h")))
    distinct = table(nodes.where("size > 0").groupBy("n").agg(*[F.first(c).alias(c) for c in ("size", "p", "d", "m", "keys")], F.count("*").alias("times"), F.min(F.struct(F.col("__id").isNull(), "__id", "__h")).alias("first")))

    pairs, hot = meet(distinct.select("n", "size", "times", "keys"), _keys, least, GROUP)
    named = pairs.select(F.explode(F.array("src", "dst")).alias("__n")).union(hot.select("n")).distinct()
    wanted = cut(distinct.join(named, F.col("n") == F.col("__n"), "left_semi").select("n", F.col("first.__id").alias("__id"), F.col("first.__h").alias("__h")))
    body = docs.select(*doc_key(), F.col("text").alias("body"))
    few = bounded(wanted, BROADCAST_TEXTS)
    texts = table(body.join(few, same_key(body, wanted)).select("n", "body").dropDuplicates(["n"]))
    told = distinct.select(F.col("n").alias("__of"), "p", "m").join(texts, F.col("__of") == F.col("n")).select("n", "p", "m", "body")
    found = connect(pairs, hot, lambda p: cut(_verified(_plausible(p, distinct), texts, words, least)), told, lambda rows: _Texts(rows, words, least), least, hubs)
    keys = nodes.groupBy("__id", "__h", F.col("n").alias("node_")).agg(F.count("*").alias("n"))
    return keys.join(found, F.col("node_") == F.col("node"), "left").select("__id", "__h", F.coalesce("component", "node_").alias("class"), "n")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without near copies: of each class of similar documents the one of smallest doc_id stays, null ids last.

    Of rows repeated whole, one stays.  All columns pass, whatever their names.
    """
    found = cut(similar_documents(docs, **how))
    first = found.groupBy("class").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__h", "n")).alias("k"))
    stays = cut(first.select("k.__id", "k.__h", "k.n"))
    own = docs.withColumn("__own", F.xxhash64("text"))
    out = own.join(stays, (F.col("__own") == stays["__h"]) & own["doc_id"].eqNullSafe(stays["__id"]), "left_semi")
    if stays.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "__own"])
    return out.drop("__own")
