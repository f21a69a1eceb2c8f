"""Operator 12: byte-level BPE of whole texts, exactly as the tokenizers library has it, with long texts encoded in parallel.

A text of up to ``piece`` characters is encoded where it is: parted before
spaces, where no pre-token can span, and each distinct part looked up once a
task.  A longer one becomes rows of pieces, cut there too, that are dealt out
over all tasks.  What has no such place for ``leaf`` characters is cut at its
pre-tokens, and a pre-token longer than that, which the tokenizer does not split,
becomes the leaves of a tree:

Tree concatenation.  Leaves are encoded in parallel.  Then neighbours are joined
pair by pair, level by level.  At a join the last w ids of the left and the first
w of the right are turned back into bytes and encoded anew; where the new ids
begin with the window's first old one and end with its last, both sides agree and
the window replaces its part; else w doubles.  That is exact: a sequence of ids
is the encoding of its bytes if each two neighbours are the encoding of theirs
(merges are ranked, and a merge over a border of two ids depends on those two
alone until one happens), and each two neighbours are, in the left, in the
window, or in the right.

Cases.  A null text is an empty one, with no ids.  Repeated rows get a row each,
null ids too.  The strings of special tokens in a text become their ids, as the
library's default is.  Texts of any length are encoded whole; a document's ids
come together in one row, as its text was.  Other columns don't matter.  An empty
table gives no rows.  ``decode`` replaces bytes that aren't UTF-8 by U+FFFD, as
the library does; null ids decode to a null text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table

#: Characters that are encoded in one go, and bytes of an unsplit stretch beyond which it becomes leaves.
PIECE = 1 << 16
LEAF = 1 << 14
#: Ids on either side of a join that are encoded anew at first.
WINDOW = 4

_CACHED = 250_000  # distinct parts that a task remembers
_AT_ONCE = 1 << 20  # characters that are parted at a time
#: A space after what is no white space, in any version of Unicode: no pre-token goes on over it.
_SAFE = re.compile(r"(?<=[^\s\u180e])(?= )")
_BLACK = re.compile(r"[^\s\u180e]")


class Bpe:
    """A byte-level BPE file of the tokenizers library, held by a task."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        own = json.loads(self.tok.to_str())
        split = own["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not plain or own["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in own["added_tokens"]) or own["model"].get("dropout"):
            raise ValueError("only byte-level BPE without normalizer, prefix space or dropout")
        self.raw = Tokenizer(self.tok.model)
        special = [t["content"] for t in own["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # Each byte has a printable character: its own where that is printable, else one from 256 on.
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in set(printable)]
        self.char = {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}
        byte = {c: b for b, c in self.char.items()}
        self.bytes = [b""] * self.tok.get_vocab_size(with_added_tokens=True)
        for word, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(byte[c] for c in word) if i not in self.tok.get_added_tokens_decoder() else word.encode()
        self.sizes = np.array(list(map(len, self.bytes)))
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, some of them at a time."""
        out: list[bytes] = []
        at = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= _AT_ONCE or i + 1 == len(texts):
                out += self._encode(texts[at : i + 1])
                at, size = i + 1, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Each distinct part is encoded once, until the cache is full."""
        parts = [_SAFE.split(t) if t else [] for t in texts]
        new = list(set().union(*parts).difference(self.cache))
        spaced = [p for p in new if p[0] == " " and _BLACK.match(p[-1])]  # one after the other they are parted as they are apart
        for at in range(0, len(spaced), 10_000):
            self._learn(spaced[at : at + 10_000])
        for part in new:
            if part not in self.cache:
                self._learn([part])
        out = [b"".join(map(self.cache.__getitem__, p)) for p in parts]
        if len(self.cache) > _CACHED:
            self.cache = {}
        return out

    def _learn(self, parts: list[str]) -> None:
        ids = np.array(self.tok.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) for p in parts])) + 1
        data = ids.tobytes()
        self.cache.update(zip(parts, (data[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)), strict=True))

    def merge(self, data: bytes) -> np.ndarray:
        """The ids of bytes that nothing parts."""
        return np.array(self.raw.encode(data.decode("latin-1").translate(self.char), add_special_tokens=False).ids, "<u4")

    def pretokens(self, text: str, size: int) -> Iterator[str]:
        """The pre-tokens of a text, by slices: the last two of a slice may go on, so the next begins with them."""
        at, now = 0, size
        while at < len(text):
            found = self.tok.pre_tokenizer.pre_tokenize_str(text[at : at + now])
            if at + now < len(text):
                found = found[:-2]
                if not found:
                    now *= 2
                    continue
            for _, (a, b) in found:
                yield text[at + a : at + b]
            at, now = at + found[-1][1][1], size

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def _bpe(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _grouped(parts: Iterator[str], size: int) -> Iterator[str]:
    """Pre-tokens put together, so that each group has the same ones by itself: how white space is parted depends on what follows, so at a group's end its pre-tokens stay apart."""
    held: list[str] = []
    length = 0

    def out() -> Iterator[str]:
        n = len(held)
        while n and not _BLACK.match(held[n - 1][-1]):
            n -= 1
        if n:
            yield "".join(held[:n])
        yield from held[n:]

    for part in parts:
        if held and length + len(part) > size:
            yield from out()
            held, length = [], 0
        held.append(part)
        length += len(part)
    yield from out()


def pieces(text: str, bpe: Bpe, piece: int, leaf: int) -> Iterator[tuple[str, bool]]:
    """A long text in pieces that can be encoded apart, in order, and whether each is one unsplit pre-token of more than ``leaf`` bytes."""
    for i, segment in enumerate(bpe.special.split(text) if bpe.special else [text]):
        if i % 2:
            yield segment, False
            continue
        at = 0
        while at < len(segment):
            found = _SAFE.search(segment, min(len(segment), at + piece))
            end = found.start() if found else len(segment)
            if end - at <= piece + leaf:
                yield segment[at:end], False
                at = end
                continue
            to = max((m.start() for m in _SAFE.finditer(segment, at + 1, at + piece)), default=at)
            if to > at:  # the rest up to ``end`` has no safe place
                yield segment[at:to], False
            for part in _grouped(bpe.pretokens(segment[to:end], piece), leaf):
                yield part, len(part.encode()) > leaf and len(bpe.tok.pre_tokenizer.pre_tokenize_str(part)) == 1
            at = end


def join(left: np.ndarray, right: np.ndarray, bpe: Bpe, window: int = WINDOW) -> np.ndarray:
    """The ids of the bytes of both, which nothing parts."""
    w = window
    while len(left) and len(right):
        a, b = left[-w:], right[:w]
        made = bpe.merge(b"".join(bpe.bytes[i] for i in [*a.tolist(), *b.tolist()]))
        if (w >= len(left) or made[0] == a[0]) and (w >= len(right) or made[-1] == b[-1]):
            return np.concatenate((left[: len(left) - len(a)], made, right[len(b) :]))
        w *= 2
    return np.concatenate((left, right))


def _long(docs: DataFrame, path: str, piece: int, leaf: int) -> DataFrame:
    """(doc_id, ids) of long texts, by rows of pieces."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    raw = f"doc_id {kind}, row long, part int, node int, data binary"
    made = f"doc_id {kind}, row long, part int, node int, ids binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            for doc, row, text in zip(*(batch.column(c) for c in ("doc_id", "row", "text")), strict=True):
                part = 0
                for some, unsplit in pieces(text.as_py(), bpe, piece, leaf):
                    data = some.encode()
                    starts = range(0, len(data), leaf) if unsplit else [0]
                    for node, at in enumerate(starts):
                        cells = [doc.as_py()], [row.as_py()], [part], [node if unsplit else -1], [data[at : at + leaf] if unsplit else data]
                        types = batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.binary()
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["doc_id", "row", "part", "node", "data"])
                    part += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            nodes, data = batch.column("node").to_pylist(), batch.column("data").to_pylist()
            ids = [bpe.merge(d).tobytes() if n >= 0 else bpe.encode([d.decode()])[0] for n, d in zip(nodes, data, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "part", "node")), pa.array(ids, pa.binary())], names=["doc_id", "row", "part", "node", "ids"])

    def halves(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        ids = [np.frombuffer(x, "<u4") for x in rows.column("ids").to_pylist()]
        whole = ids[0] if len(ids) == 1 else join(ids[0], ids[1], _bpe(path))
        first = rows.slice(0, 1)
        cells = [*(first.column(c) for c in ("doc_id", "row", "part")), pa.array([first.column("node")[0].as_py() // 2], pa.int32()), pa.array([whole.tobytes()], pa.binary())]
        return pa.Table.from_arrays(cells, names=["doc_id", "row", "part", "node", "ids"])

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        cells = [rows.column("doc_id").slice(0, 1), pa.array([b"".join(rows.column("ids").to_pylist())], pa.binary())]
        return pa.Table.from_arrays(cells, names=["doc_id", "ids"])

    numbered = small_batches(docs.withColumn("row", F.monotonically_increasing_id()))
    rows = table(numbered.mapInArrow(deal, raw))  # written, so that its numbers stay when executors are lost
    done = table(rows.repartition("row", "part", "node").mapInArrow(encode, made))
    tree = done.where("node >= 0")
    last = tree.agg(F.max("node")).first()[0]
    if last is not None:
        tree = cut(tree)
        while last > 0:
            tree = cut(tree.groupBy("row", "part", F.expr("node DIV 2")).applyInArrow(halves, made))
            last //= 2
    return done.where("node < 0").unionByName(tree).groupBy("row").applyInArrow(whole, f"doc_id {kind}, ids binary")


def encode(docs: DataFrame, path: str, piece: int = PIECE, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids) of each row of ``docs``: its text's ids as little-endian unsigned 32-bit integers.

    ``path`` names a byte-level BPE file that all executors have.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bpe.encode(batch.column("text").to_pylist()), pa.binary())], names=["doc_id", "ids"])

    short = small_batches(docs.where(F.length("text") <= piece)).mapInArrow(here, f"doc_id {kind}, ids binary")
    long_ = docs.where(F.length("text") > piece)
    return short if long_.isEmpty() else short.unionByName(_long(long_, path, piece, leaf))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens``, which has the column ids, with the column text."""
    columns = [c for c in tokens.columns if c != "text"]
    schema = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in columns) + ", text string"

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, "text"])

    return small_batches(tokens.select(columns)).mapInArrow(here, schema)
