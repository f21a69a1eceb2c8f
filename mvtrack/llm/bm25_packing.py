"""Packing of documents into training sequences with their lexical neighbours.

Whole windows of a long document are sequences by themselves.  What is left of
each document, less than a window, is packed: units are dealt over shards of
bounded size by their heaviest terms, so those that share rare terms meet, and in
each shard one task builds an inverted index.  A seed unit opens a window, and
the unused units that score best against it by BM25 fill the rest, cut where
the window ends; what is cut off opens the next window.  How many documents have
a term, and their mean length, are counted over all documents.  What is left at
the end of a shard goes into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import mix64, small_batches, table

WINDOW = 2048
END = 1
K1, B = 1.2, 0.75
#: Heaviest terms of a seed that are looked up; None for all.
QUERY_TERMS = 24
#: Tokens of a shard, and units drawn to place the shards' bounds, for each shard.
SHARD_TOKENS, DRAWN = 2_000_000, 200
#: Bytes of text that are looked up together.
TOGETHER = 1 << 20
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Whole windows are numbered from here, after all shards.
WHOLE = 1 << 62

_TOKENIZERS: dict[str, WordTokens] = {}
#: How the tokenizer parts a lower-case ASCII word.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class _Places:
    """Numbers of 64-bit hashes: a hash table with open addresses, for many at a time."""

    def __init__(self, bits: int):
        self.keys, self.values, self.mask = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64((1 << bits) - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        rest = np.arange(len(hashes))
        slot = hashes & self.mask
        while len(rest):
            held = self.keys[slot]
            same = held == hashes[rest]
            out[rest[same]] = self.values[slot[same]]
            on = ~same & (held != 0)
            rest, slot = rest[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """New and distinct ones."""
        rest, slot = np.arange(len(hashes)), hashes & self.mask
        while len(rest):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[rest[free]]  # of several for one slot the last stays
            won = self.keys[slot] == hashes[rest]
            self.values[slot[won]] = values[rest[won]]
            rest, slot = rest[~won], (slot[~won] + np.uint64(1)) & self.mask


class WordTokens:
    """Token ids of words, each word encoded once and then looked up by its hash.

    The tokenizer drops white space, never joins across it, takes no notice of
    case, and parts words into runs of letters, digits and other characters; so
    the ids of a text are those of its lower-case words, one after the other.
    The first ``most`` words seen, which hold nearly all that are frequent, stay
    in the table; others are encoded when they come.  Texts that have a special
    token's string go to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.places = _Places(max(12, (2 * most).bit_length()))
        self.most = most
        self.flat = np.zeros(1 << 12, np.uint32)
        self.starts = np.zeros(1 << 10, np.int64)
        self.lengths = np.zeros(1 << 10, np.int64)
        self.n = self.end = 0
        self.pieces: dict[str, list[int]] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: how the model writes bytes
        others = iter(range(256, 512))
        self.written = {b: chr(b if b in printable else next(others)) for b in range(256)}

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = [t.id for t in self.tokenizer.model.tokenize(piece)]
            if len(piece) <= 8 and len(self.pieces) < 200_000:
                self.pieces[piece] = ids
        return ids

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out: list[list[int] | None] = []
        odd: list[str] = []
        for raw in words:
            w = raw.decode("utf-8")
            if w.isascii():
                if w.isalpha():
                    out.append(self._piece(w))
                elif w.isprintable():
                    out.append([i for piece in _PIECES.findall(w) for i in self._piece(piece)])
                else:
                    out.append(None)
                    odd.append(w)
            elif max(w) < "\u0250" and w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w):
                out.append(self._piece(raw.decode("latin-1").translate(self.written)))
            else:
                out.append(None)
                odd.append(w)
        coded = iter(self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)) if odd else iter(())
        return [next(coded).ids if ids is None else ids for ids in out]

    def _keep(self, name: str, upto: int) -> np.ndarray:
        own = getattr(self, name)
        if len(own) < upto:
            own = np.concatenate((own, np.zeros(max(upto - len(own), len(own)), own.dtype)))
            setattr(self, name, own)
        return own

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = {k for k, t in enumerate(texts) if b"<|" in t and any(s in t for s in self.special)}
        low = [b"" if k in whole else t.lower() for k, t in enumerate(texts)]
        raw, begin = hashing.join(low)
        starts, ends = hashing.spans(raw, hashing.UNSPACED)
        words, first, of = np.unique(hashing.hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        place = self.places.find(words).astype(np.int64)
        flat, at, size = self.flat, self.starts, self.lengths
        if len(new := np.flatnonzero(place < 0)):
            data = raw.tobytes()
            coded = self._ids([data[starts[k] : ends[k]] for k in first[new].tolist()])
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            ids = np.fromiter((i for own in coded for i in own), np.uint32, int(sizes.sum()))
            offsets = np.cumsum(sizes) - sizes
            place[new] = self.n + np.arange(len(new))
            if self.n + len(new) <= self.most:
                flat, at, size = self._keep("flat", self.end + len(ids)), self._keep("starts", self.n + len(new)), self._keep("lengths", self.n + len(new))
                flat[self.end : self.end + len(ids)] = ids
                at[self.n : self.n + len(new)], size[self.n : self.n + len(new)] = self.end + offsets, sizes
                self.places.add(words[new], place[new].astype(np.int32))
                self.n, self.end = self.n + len(new), self.end + len(ids)
            else:
                flat, at, size = np.concatenate((flat[: self.end], ids)), np.concatenate((at[: self.n], self.end + offsets)), np.concatenate((size[: self.n], sizes))
        place = place[of]
        size = size[place]
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(at[place] - upto[:-1], size) + np.arange(int(upto[-1]))]
        made = np.split(ids, upto[np.searchsorted(starts, begin[1:-1])])
        for k in whole:
            made[k] = np.array(self.tokenizer.encode(texts[k].decode("utf-8"), add_special_tokens=False).ids, np.uint32)
        return made


def _tokenizer(path: str) -> WordTokens:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokens(path)
    return _TOKENIZERS[path]


def token_ids(path: str, text: str = "text") -> Column:
    """The ids of a text column, then END, as little-endian unsigned 16- or 32-bit integers (16 where all fit)."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _tokenizer(path)
        wide = "<u2" if words.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for texts in batches:
            raw = [(t or "").encode("utf-8") for t in texts]
            made = []
            for part in hashing.groups(np.fromiter(map(len, raw), np.int64, len(raw)) + 1, TOGETHER):
                made += [np.append(i, END).astype(wide).tobytes() for i in words.encode(raw[part])]
            yield pd.Series(made, dtype=object)

    return ids.asNondeterministic()(F.col(text))


class Weights:
    """BM25 weights from how many of all documents hold each term, and their mean length."""

    def __init__(self, held: np.ndarray, documents: int, mean: float):
        self.idf = np.log1p((documents - held + 0.5) / (held + 0.5))
        self.shared, self.mean = held > 1, mean

    def of(self, docs: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and weight of the distinct terms of each document, in that order; no weight if no other document has it."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        both = np.repeat(np.arange(len(docs), dtype=np.int64), sizes) << 32 | np.concatenate(docs)
        size = len(both)
        both, first = hashing.sorted_unique(both)
        counts = np.diff(np.append(first, size))
        doc, term = both >> 32, both & 0xFFFFFFFF
        weight = self.idf[term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[doc] / self.mean))
        return doc, term, np.where(self.shared[term], weight, 0.0)

    def places(self, docs: list[np.ndarray], lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where each document stands in an order by its three heaviest terms, then by a hash of its row."""
        doc, term, weight = self.of(docs, lengths)
        starts = np.searchsorted(doc, np.arange(len(docs)))  # each has END at least
        at = np.zeros(len(docs), np.uint64)
        for _ in range(3):
            best = np.maximum.reduceat(weight, starts)
            hit = np.flatnonzero((weight == best[doc]) & (weight > 0))
            own, first = np.unique(doc[hit], return_index=True)
            top = np.zeros(len(docs), np.uint64)
            top[own] = term[hit[first]].astype(np.uint64) & np.uint64(0xFFFF)
            weight[hit[first]] = 0
            at = at << np.uint64(16) | top
        return at << np.uint64(16) | mix64(rows) >> np.uint64(48)


class Bm25:
    """An inverted index of one shard's documents."""

    def __init__(self, docs: list[np.ndarray], lengths: np.ndarray, weights: Weights, query_terms: int | None = QUERY_TERMS):
        self.n, self.most = len(docs), query_terms
        doc, self.terms, self.own = weights.of(docs, lengths)
        self.ends = np.searchsorted(doc, np.arange(len(docs) + 1))
        order = np.argsort(self.terms, kind="stable")
        self.docs, self.weights = doc[order].astype(np.int32), self.own[order].astype(np.float32)
        vocabulary = len(weights.idf)
        self.at = np.concatenate(([0], np.cumsum(np.bincount(self.terms, minlength=vocabulary))))

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share one of the seed's heaviest terms, best first, ties in order."""
        a, b = self.ends[seed], self.ends[seed + 1]
        terms = self.terms[a:b]
        pick = np.flatnonzero((self.at[terms + 1] - self.at[terms] > 1) & (self.own[a:b] > 0))
        pick = pick[np.argsort(-self.own[a:b][pick], kind="stable")[: self.most]]
        if not len(pick):
            return
        runs = [slice(self.at[t], self.at[t + 1]) for t in terms[pick]]
        scores = np.bincount(np.concatenate([self.docs[r] for r in runs]), np.concatenate([self.weights[r] for r in runs]), self.n)
        scores[~unused] = 0
        some = np.flatnonzero(scores > 0)
        yield from some[np.argsort(-scores[some], kind="stable")].tolist()


def pack(lengths: list[int], index: Bm25 | None, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token once."""
    unused = np.ones(len(lengths), bool)
    pieces: list[list[int]] = []
    sequence, filled, cursor = 0, 0, 0
    seed, ranked, after = None, iter(()), None
    while True:
        doc = next((d for d in ranked if unused[d]), None) if filled else None
        if doc is None:
            while cursor < len(lengths) and not unused[cursor]:
                cursor += 1
            if cursor == len(lengths):
                break
            doc = cursor
            seed = None
        unused[doc] = False
        start = 0
        while start < lengths[doc]:
            n = min(window - filled, lengths[doc] - start)
            pieces.append([doc, start, n, sequence, filled])
            start, filled = start + n, filled + n
            if filled == window:
                sequence, filled, seed = sequence + 1, 0, None
        if filled and seed is None and index is not None:  # this document, or its rest, opened the window
            seed, ranked = doc, index.neighbours(doc, unused)
    return _settle(pieces, sequence, filled)


def _settle(pieces: list[list[int]], last: int, filled: int) -> list[tuple[int, int, int, int, int]]:
    """The last, unfilled sequence as sequences of powers of two."""
    done = [tuple(p) for p in pieces if p[3] < last]
    rest = [p for p in pieces if p[3] == last]
    at, size = 0, 0
    for doc, start, n, _, _ in rest:
        while n:
            if not size:
                size, at = 1 << (filled.bit_length() - 1), 0
            take = min(n, size - at)
            done.append((doc, start, take, last, at))
            start, n, at, filled = start + take, n - take, at + take, filled - take
            if at == size:
                size, last = 0, last + 1
    return done


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pack_shard(rows: pd.DataFrame, width: int, weights: Weights, window: int, query_terms: int | None) -> pd.DataFrame:
    rows = rows.sort_values(["place", "doc_id", "row"], kind="stable", na_position="first").reset_index(drop=True)
    docs = [np.frombuffer(b, f"<u{width}") for b in rows["ids"]]
    pieces = pack([len(d) for d in docs], Bm25(docs, rows["n"].to_numpy(), weights, query_terms), window)
    first = int(rows["shard"][0]) << 32
    names, sizes = rows["doc_id"].tolist(), rows["n"].tolist()
    before = [n - len(d) for n, d in zip(sizes, docs, strict=True)]
    made = [(names[d], before[d] + s, n, _crc(docs[d][s : s + n]), sizes[d], first + q, o) for d, s, n, q, o in pieces]
    out = pd.DataFrame(made, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return out.astype({"doc_id": "Int64"})


def term_counts(own: DataFrame, width: int, vocabulary: int) -> np.ndarray:
    """How many documents hold each term: counted in the tasks, then summed, a row a term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                held[np.unique(np.frombuffer(ids, f"<u{width}"))] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "n"])

    sums = own.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(vocabulary, np.int64)
    held[sums["term"]] = sums["n"]
    return held


def pack_documents(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS, window: int = WINDOW, query_terms: int | None = QUERY_TERMS) -> DataFrame:
    """Every token of every document in one piece of one sequence; one row a piece.

    Shards hold about ``shard_tokens`` tokens each, so tasks are bounded and
    alike at every size.  Their bounds, in the order of the units' heaviest
    terms, come from a drawn sample of DRAWN units a shard; every unit is dealt.
    Null and empty texts have the one token END.  Units with the same heaviest
    terms are told apart by where their rows stand in a written table, so
    repeated rows and ties spread over shards, and each gets its own pieces.  An
    empty table gives no rows; other columns are not read.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if vocabulary <= 1 << 16 else 4
    own = small_batches(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), token_ids(tokenizer).alias("ids"))
    own = table(own.withColumn("n", (F.octet_length("ids") / width).cast("long")))  # fixes the row numbers
    low = (1 << 33) - 1  # the bits of a row's number within its partition
    seen = own.agg(F.count("*").alias("n"), F.sum("n").alias("tokens"), F.sum(F.col("n") % window).alias("left"), F.max(F.col("row").bitwiseAND(low)).alias("high"), F.max("n").alias("longest")).first()
    if not seen.n:
        return own.select(*[F.lit(None).cast("long").alias(c.split()[0]) for c in OUT.split(", ")]).limit(0)
    weights = Weights(term_counts(own, width, vocabulary), seen.n, seen.tokens / seen.n)
    shards = max(1, -(-seen.left // shard_tokens))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, rows = np.asarray(batch.column("n")), np.asarray(batch.column("row"))
            ids = [np.frombuffer(b, f"<u{width}")[-k:] for b, k in zip(batch.column("ids").to_pylist(), (n % window).tolist(), strict=True)]
            place = weights.places(ids, n, rows)
            shard = np.searchsorted(bounds, place, side="right").astype(np.int32)
            cells = [batch.column("doc_id"), pa.array(rows), pa.array(n), pa.array((place >> np.uint64(1)).view(np.int64)), pa.array(shard), pa.array([i.tobytes() for i in ids])]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "row", "n", "place", "shard", "ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, high = seen.longest // window, seen.high + 1
        for batch in batches:
            made = []
            for doc, row, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "n", "ids")), strict=True):
                ids = np.frombuffer(raw, f"<u{width}")
                first = WHOLE + ((row >> 33) * high + (row & low)) * most
                made += [(doc, k * window, window, _crc(ids[k * window : (k + 1) * window]), n, first + k, 0) for k in range(n // window)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    made = "doc_id long, row long, n long, place long, shard int, ids binary"
    left = own.where(F.col("n") % window > 0)
    bounds = np.zeros(0, np.uint64)
    if shards > 1:
        drawn = left.sample(min(1.0, DRAWN * shards / seen.n), seed=7) if DRAWN * shards < seen.n else left
        at = np.sort(drawn.mapInArrow(units, made).select("place").toPandas()["place"].to_numpy()).view(np.uint64) << np.uint64(1)
        bounds = np.unique(at[len(at) * np.arange(1, shards) // shards]) if len(at) else bounds
    dealt = left.mapInArrow(units, made)
    packed = dealt.groupBy("shard").applyInPandas(lambda rows: _pack_shard(rows, width, weights, window, query_terms), OUT)
    return packed.unionAll(own.where(F.col("n") >= window).mapInArrow(whole, OUT))
