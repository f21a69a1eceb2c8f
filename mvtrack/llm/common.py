"""What several operators of this subpackage share.

Row identity.  A document is known by the pair (doc_id, xxhash64 of its text),
both of which may be null.  Rows repeated whole are one document: they share
the key and get the same answer.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Near-duplicate operators on word shingles use these unless told otherwise.
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def prepare(spark: SparkSession) -> None:
    """Use the session's checkpoint folder, ``spark.checkpoint.dir``, which all executors must share.

    Where none is set, a local session, as in tests, gets one of its own; a
    cluster has no folder that this could choose, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows will go to Python by batches of bounded bytes, to bound the workers' memory.

    This sets the session's limits, as a lazy DataFrame reads them when it runs;
    smaller ones that the session already has stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def cut(df: DataFrame) -> DataFrame:
    """A checkpointed copy: computed once, and safe when executors are lost."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table in the checkpoint folder: for wide rows, of which later steps read some columns."""
    prepare(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_key() -> list[Column]:
    """The columns that identify a document within an operator."""
    return [F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h")]


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["__id"].eqNullSafe(b["__id"]) & (a["__h"] == b["__h"])


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers over all bits: two rounds of multiply and shift."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: For each byte, its bits as eight counters of a byte each.
_LANES = sum((np.arange(256, dtype=np.uint64) >> np.uint64(b) & np.uint64(1)) << np.uint64(8 * b) for b in range(8))


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ones in each of the 64 bits, for the groups of hashes that begin at ``starts`` (none empty); lowest bit first."""
    sizes = np.diff(np.append(starts, len(hashes)))
    parts = -(-sizes // 255)  # a byte counts to 255
    first = np.cumsum(parts) - parts
    begin = np.repeat(starts, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    counts = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], begin, axis=0).view(np.uint8)
    return counts.astype(np.int64) if len(counts) == len(starts) else np.add.reduceat(counts, first, axis=0, dtype=np.int64)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph with the edges (src, dst).

    Alternates the large-star and the small-star step, each one aggregation and
    one join, until the edges stop changing; the number of rounds grows with the
    logarithm of the component size.  A node with very many neighbours is the
    hot side of a plain equi-join, which adaptive execution splits.  Returns
    (node, component) for all nodes with an edge to another; component is the
    smallest node.  No edges give no rows.
    """
    now = cut(edges.where("src <> dst").selectExpr("greatest(src, dst) AS u", "least(src, dst) AS v").distinct())
    seen = None
    while True:
        print_ = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_ == seen or not print_[0]:
            return now.selectExpr("u AS node", "v AS component").union(now.selectExpr("v", "v").distinct())
        seen = print_
        both = now.union(now.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS w", "least(u, m) AS m")
        large = both.join(least, both.u == least.w).where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, large.u == low.w).selectExpr("v AS u", "m AS v").union(low.selectExpr("w", "m"))
        now = cut(small.where("u <> v").distinct())


#: Groups of more nodes under one key are held against hubs.
PAIRWISE = 64
MARK = -(1 << 31)
#: Rows that a task of ``meet`` gathers before it lets go of large groups.
GATHERED = 1_000_000
#: Rows of a large group that are held against so many others as one piece of work, and rows of pieces that go together.
BLOCK, SETTLED = 1024, 4096


def _sized(x: np.ndarray, y: np.ndarray, ratio: float) -> np.ndarray:
    return np.minimum(x, y) >= ratio * np.maximum(x, y) - 1


def meet(nodes: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], ratio: float, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (src, dst) of nodes that share a key and whose sizes may differ by ``ratio``, and the rows of large groups.

    ``nodes`` has (n, size, times, ...), a row a node; ``keys`` gives a row of
    64-bit keys for each node of a batch, 0 for no key.  In groups of up to
    ``most`` (PAIRWISE) nodes all pairs are listed; the rows (key, n, size, score, hub) of
    larger ones come back with a hub, to which each is paired; ``rest_links``
    follows for what this leaves apart.  A key that is large within a task before the shuffle
    doesn't pass through it: its rows go anywhere, and one row tells the key's
    task; so no task gathers a group that a large part of all nodes share.
    """
    most, gathered = min(PAIRWISE, most or PAIRWISE), GATHERED

    def hot_of(key: np.ndarray, known: np.ndarray) -> np.ndarray:
        key = np.sort(key)
        return np.union1d(np.unique(key[most:][key[most:] == key[:-most]]), known)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, n: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            hot = hot_of(key, np.zeros(0, np.int64))
            is_hot = np.isin(key, hot)
            none = np.zeros(len(hot), np.int64)
            tag = np.where(is_hot, -1 - size, size)  # of a row of a large group less than 0; of its mark the least
            made = [np.concatenate((x, y)) for x, y in ((key, hot), (n, none), (tag.astype(np.int32), np.full(len(hot), MARK, np.int32)))]
            for at in range(0, len(made[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in made], names=["key", "n", "tag"])

        rows: list[list[np.ndarray]] = []
        for batch in batches:
            table_ = keys(batch)
            own = np.flatnonzero((table_ != 0).ravel())
            n, size = (np.asarray(batch.column(c)) for c in ("n", "size"))
            node = own // table_.shape[1]
            rows.append([table_.ravel()[own], n[node], size[node].astype(np.int32)])
            if sum(len(r[0]) for r in rows) >= gathered:
                yield from out(*map(np.concatenate, zip(*rows, strict=True)))
                rows = []
        if rows:
            yield from out(*map(np.concatenate, zip(*rows, strict=True)))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, a: np.ndarray, b: np.ndarray | None, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(a), 100_000):
                part = slice(at, at + 100_000)
                cells = [pa.array(key[part]), pa.array(a[part]), pa.nulls(len(a[part]), pa.int64()) if b is None else pa.array(b[part]), pa.array(size[part])]
                yield pa.RecordBatch.from_arrays(cells, names=["key", "a", "b", "size"])

        hot = np.zeros(0, np.int64)
        rows: list[list[np.ndarray]] = []
        limit = gathered
        for batch in batches:
            key, n, tag = (np.asarray(batch.column(c)) for c in ("key", "n", "tag"))
            if (tag < 0).any():
                hot = np.union1d(hot, key[tag == MARK])
                at = (tag < 0) & (tag != MARK)
                yield from out(key[at], n[at], None, -1 - tag[at])
            rows.append([key[tag >= 0], n[tag >= 0], tag[tag >= 0]])
            if sum(len(r[0]) for r in rows) >= limit:
                key, n, size = map(np.concatenate, zip(*rows, strict=True))
                hot = hot_of(key, hot)
                at = np.isin(key, hot)
                yield from out(key[at], n[at], None, size[at])
                rows = [[key[~at], n[~at], size[~at]]]
                limit = max(gathered, 2 * len(rows[0][0]))
        if not rows:
            return
        key, n, size = map(np.concatenate, zip(*rows, strict=True))
        hot = hot_of(key, hot)
        at = np.isin(key, hot)
        yield from out(key[at], n[at], None, size[at])
        key, n, size = key[~at], n[~at], size[~at]
        order = np.lexsort((n, key))
        key, n, size = key[order], n[order], size[order]
        for d in range(1, most):
            same = np.flatnonzero(key[d:] == key[:-d])
            if not len(same):
                break
            same = same[_sized(size[same], size[same + d], ratio)]
            yield from out(key[same], np.minimum(n[same], n[same + d]), np.maximum(n[same], n[same + d]), size[same])

    dealt = nodes.mapInArrow(deal, "key long, n long, tag int").repartition(F.expr(f"IF(tag < 0 AND tag <> {MARK}, n, key)"))
    met = table(dealt.mapInArrow(pair, "key long, a long, b long, size int"))
    hot = met.where("b IS NULL").select("key", F.col("a").alias("n"), "size")
    pairs = met.where("b IS NOT NULL AND a <> b").selectExpr("a AS src", "b AS dst")
    if hot.isEmpty():
        return cut(pairs.distinct()), hot.withColumns({"score": F.lit(0).cast("long"), "hub": F.col("n")})
    # The hub is who shares most keys with most others: an original rather than one of its copies.
    sizes = hot.groupBy("key").agg(F.count("*").alias("held"))
    score = hot.join(sizes, "key").groupBy("n").agg(F.sum("held").alias("score")).withColumnRenamed("n", "__n")
    scored = hot.join(score, F.col("n") == F.col("__n"))
    hubs = scored.groupBy("key").agg(F.max(F.struct("score", "n", "size")).alias("hub")).select("key", F.col("hub.n").alias("hub"), F.col("hub.size").alias("__size"))
    hot = table(scored.drop("__n").join(hubs, "key"))
    near = F.least("size", "__size") >= ratio * F.greatest("size", "__size") - 1
    to_hub = hot.where("n <> hub").where(near).select(F.least("n", "hub").alias("src"), F.greatest("n", "hub").alias("dst"))
    return cut(pairs.union(to_hub).distinct()), hot.select("key", "n", "size", "score", "hub")


class Judge:
    """What ``rest_links`` asks about the rows of some groups; ``quota`` pairs of a component first, then ``more`` times as many a round."""

    quota, more = 2, 2

    def distance(self, x: slice, y: slice) -> np.ndarray:
        """How far each row of x is from each of y by its sketch; less than 0 where they are no candidates."""
        raise NotImplementedError

    def linked(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the rows x[i] and y[i] are linked."""
        raise NotImplementedError


def _settle(rows: pa.Table, judge: Judge, ratio: float) -> list[tuple[int, int]]:
    """The links that join components of the rows' groups, found nearest pairs first; no pair of a group that they leave apart is untried."""
    key, size, c, block = (rows[x].to_numpy() for x in ("key", "size", "c", "block"))
    cell, two = rows["cell"].to_numpy(), rows["two"].to_numpy(zero_copy_only=False)
    keys = rows["keys"].combine_chunks()
    held = np.diff(keys.offsets.to_numpy())
    at = np.arange(int(held.max())) < held[:, None]
    table_ = np.zeros(at.shape, np.int64)
    table_[at] = keys.flatten().to_numpy()
    edges = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (key[1:] != key[:-1]), [True])))
    found = []
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        for i in range(a, b, 256):
            x, y = slice(i, min(i + 256, b)), slice(i, b)
            far = judge.distance(x, y)
            ok = (far >= 0) & (c[x, None] != c[y]) & (np.arange(x.start, x.stop)[:, None] < np.arange(y.start, y.stop)) & _sized(size[x, None], size[y], ratio)
            if two[a]:
                ok &= block[x, None] != block[y]
            u, v = np.nonzero(ok)
            far, u, v = far[u, v], u + i, v + i
            for p in range(0, len(u), 50_000):  # a pair belongs to the least of the keys that both have
                part = slice(p, p + 50_000)
                both = (table_[u[part], :, None] == table_[v[part], None, :]).any(axis=2) & at[u[part]]
                mine = table_[u[part], both.argmax(axis=1)] == key[a]
                found.append((u[part][mine], v[part][mine], far[part][mine]))
    if not found:
        return []
    u, v, far = map(np.concatenate, zip(*found, strict=True))
    names, own = np.unique(c, return_inverse=True)
    root, links, quota = np.arange(len(names)), [], judge.quota
    while True:
        p, q = root[own[u]], root[own[v]]
        apart = p != q
        u, v, far, p, q = (x[apart] for x in (u, v, far, p, q))
        if not len(u):
            return links
        # Of each component the nearest pairs, more of them each round.
        ends, pair = np.concatenate((p, q)), np.tile(np.arange(len(u)), 2)
        order = np.lexsort((far[pair], ends))
        first = np.concatenate(([True], np.diff(ends[order]) != 0))
        rank = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        take = np.zeros(len(u), bool)
        take[pair[order][rank < quota]] = True
        good = judge.linked(u[take], v[take])
        for x, y in zip(p[take][good].tolist(), q[take][good].tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(names[x]), int(names[y])))
        while (root[root] != root).any():
            root = root[root]
        u, v, far, quota = u[~take], v[~take], far[~take], judge.more * quota


def rest_links(hot: DataFrame, found: DataFrame, told: DataFrame, judge: Callable[[pa.Table], Judge], ratio: float) -> DataFrame | None:
    """Links (src, dst) between components, of all pairs of large groups whose members are in different ones; None if no group has such.

    ``found`` has (node, component).  Members of one component are connected
    already, so their pairs tell nothing new.  A group goes in blocks of some
    BLOCK rows: each two blocks are a cell, which a task has whole, and a pair
    is looked at once, whatever keys it shares.  ``told`` has n and what ``judge``
    needs of it.  Where many members are alike but not alike enough, this grows
    with the square of the group.
    """
    named = found.select(F.col("node").alias("__n"), "component")
    own = hot.join(named, F.col("n") == F.col("__n"), "left").select("key", "n", "size", F.coalesce("component", "n").alias("c"))
    own = cut(own)
    several = own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("held")).where("low <> high")
    own = cut(own.join(several.select(F.col("key").alias("__key"), F.expr(f"CAST(ceil(held / {BLOCK}D) AS INT)").alias("blocks")), F.col("key") == F.col("__key")).drop("__key"))
    if own.isEmpty():
        return None
    keys = own.groupBy("n").agg(F.sort_array(F.collect_list("key")).alias("keys")).join(told.withColumnRenamed("n", "__n"), F.col("n") == F.col("__n")).drop("__n")
    own = own.withColumn("block", F.expr("CAST(pmod(xxhash64(n), blocks) AS INT)")).withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
    own = own.select("key", F.col("n").alias("__n"), "size", "c", "block", F.expr("block <> other").alias("two"), F.expr("xxhash64(key, least(block, other), greatest(block, other))").alias("cell"))
    cells = own.join(keys, F.col("n") == F.col("__n")).drop("__n").repartition("key", "cell").sortWithinPartitions("key", "cell")

    most = SETTLED

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table) -> pa.RecordBatch:
            links = np.array(_settle(rows, judge(rows), ratio), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["src", "dst"])

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            if sum(b.num_rows for b in rest) >= most:
                rows = pa.Table.from_batches(rest)
                cell = rows["cell"].to_numpy()
                whole = len(cell) - int(np.argmax(np.append(cell[::-1] != cell[-1], True)))  # the last cell may go on
                if whole:
                    yield out(rows.slice(0, whole))
                    rest = rows.slice(whole).to_batches()
        if sum(b.num_rows for b in rest):
            yield out(pa.Table.from_batches(rest))

    return cut(cells.mapInArrow(settle, "src long, dst long").distinct())


def hub_pairs(hot: DataFrame, links: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """A new hub out of what each large group's hub has no link with, paired with the others of it; and those rows with their new hub."""
    to_hub = links.union(links.select("dst", "src")).toDF("__n", "__hub")
    alone = table(hot.where("n <> hub").join(to_hub, (F.col("n") == F.col("__n")) & (F.col("hub") == F.col("__hub")), "left_anti").drop("hub"))
    hubs = alone.groupBy("key").agg(F.max(F.struct("score", "n", "size")).alias("h")).select(F.col("key").alias("__key"), F.col("h.n").alias("hub"), F.col("h.size").alias("__size"))
    left = alone.join(hubs, F.col("key") == F.col("__key")).drop("__key")
    near = F.least("size", "__size") >= ratio * F.greatest("size", "__size") - 1
    pairs = left.where("n <> hub").where(near).select(F.least("n", "hub").alias("src"), F.greatest("n", "hub").alias("dst")).distinct()
    return pairs, left.drop("__size")


def connect(pairs: DataFrame, hot: DataFrame, verify: Callable[[DataFrame], DataFrame], told: DataFrame, judge: Callable[[pa.Table], Judge], ratio: float, hubs: int | None) -> DataFrame:
    """Components of all links among the pairs and within large groups: so many hubs first, then whatever pairs they leave apart."""
    links = verify(pairs)
    if hot.isEmpty():
        return components(links)
    left = hot
    for _ in range((hubs or 1) - 1):
        more, left = hub_pairs(left, links, ratio)
        links = links.union(verify(more))
    found = cut(components(links))
    more = rest_links(hot, found, told, judge, ratio)
    if more is None or more.isEmpty():
        return found
    joined = components(more).select(F.col("node").alias("__c"), F.col("component").alias("__to"))
    joined = cut(joined)
    known = found.join(joined, F.col("component") == F.col("__c"), "left").select("node", F.coalesce("__to", "component").alias("component"))
    return known.union(joined.join(found, F.col("__c") == F.col("node"), "left_anti").select("__c", "__to"))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which is cut, to be broadcast if it has so many rows at most; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df
