"""Operator 11: how far the sources of a language diverge, term by term and pair by pair, in exact integers.

A term's share in a group (lang, source) is p = 1 + floor(10^9 (n + 1) / (N + V)):
n its count there, N the group's count of kept terms, V the number of terms that
the language keeps.  The divergence of a group from another with the shares q is
the sum of floor((p - q)^2 / q) over all kept terms.

Heavy-light split.  Most terms are in few groups, so most shares are a group's
share of nothing, p0, and most summands equal f0 = floor((p0 - q0)^2 / q0).  The
sum is V f0 and, for each term that some group has, what it differs from f0.
Terms in many groups are summed in dense tiles (groups x groups x terms); of the
others only postings are visited: one correction for each posting against all
groups without the term, one for each pair of postings of a term.  Tiles are
dealt out by hash of term and, beyond ``GROUPS`` groups, of both groups, so a
tile is bounded whatever the number of terms, groups or documents; the partial
sums are added up by Spark.

Cases.  Null text, language and source count as ''.  A repeated row is one more
document.  A group without terms has the shares of nothing and takes part; where
a language keeps no term, all pair values are 0.  Ties: the smaller item by UTF-8
first.  A text of any length is read by slices.  Other columns don't matter.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, small_batches, table

#: Documents that a kept term is in, at least; ranks kept of the terms of a group.
LEAST_DOCS = 3
TOP_TERMS = 200
#: A term in this share of a language's groups is heavy.
DENSE_SHARE = 0.25
#: Heavy terms of a dense tile, postings of a sparse one, groups along its side.
DENSE_TERMS = 512
POSTINGS = 32_768
GROUPS = 256
#: Groups (lang, source) up to which their sizes are broadcast.
BROADCAST_GROUPS = 100_000

_FLUSH = 500_000  # distinct terms of groups that a task counts before it passes them on
_SLICE = 4 << 20
_CELLS = 1 << 20
#: Letters of ASCII, lower-cased, and all bytes of other characters; the rest parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    text = text.translate(_TERM_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + _SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                cells = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string())]
                cells += [pa.array([c[t] for t in part], pa.int64()) for c in (n, docs)]
                yield pa.RecordBatch.from_arrays(cells, names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in term_slices(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in counts.values()) > _FLUSH:
            yield from out()
    yield from out()


def _named(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents there that have it.

    Each task counts its own documents first, so a group with a third of all rows
    sends a row a term and task.
    """
    counted = small_batches(_named(docs, "lang", "source", "text")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, all_: str, v: str) -> Column:
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * (CAST({n} AS DECIMAL(20, 0)) + 1)) DIV CAST({all_} + {v} AS DECIMAL(20, 0))")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so squares fit."""
    d = (p - q).astype(np.int64)
    return ((d * d).view(np.uint64) // q.astype(np.uint64)).view(np.int64)


def _dense(total: np.ndarray, f0: np.ndarray, p0: np.ndarray, q0: np.ndarray, left: tuple, right: tuple) -> None:
    """All terms of the tile, for all pairs of groups at once, some terms at a time."""
    n_terms = 1 + max((int(t.max()) for t, _, _ in (left, right) if len(t)), default=-1)
    step = max(1, _CELLS // max(1, f0.size))
    for at in range(0, n_terms, step):
        size = min(step, n_terms - at)
        sides = []
        for (term, group, p), nothing in ((left, p0), (right, q0)):
            tile = np.repeat(nothing[:, None], size, axis=1)
            own = (term >= at) & (term < at + size)
            tile[group[own], term[own] - at] = p[own]
            sides.append(tile)
        total += _f(sides[0][:, None, :], sides[1][None, :, :]).sum(axis=2) - size * f0


def _sparse(total: np.ndarray, f0: np.ndarray, p0: np.ndarray, q0: np.ndarray, left: tuple, right: tuple) -> None:
    """Each posting as if the other groups had none, then each pair of postings of a term."""
    for (_, group, p), other, out, base, ours in ((left, q0, total, f0, True), (right, p0, total.T, f0.T, False)):
        if not len(p) or not len(other):
            continue
        pairs, times = np.unique(np.stack((group, p)), axis=1, return_counts=True)
        step = max(1, _CELLS // len(other))
        for at in range(0, len(times), step):
            g, own = pairs[0, at : at + step], pairs[1, at : at + step, None]
            made = _f(own, other[None, :]) if ours else _f(other[None, :], own)
            np.add.at(out, g, (made - base[g]) * times[at : at + step, None])
    order = np.argsort(right[0], kind="stable")
    term, group, p = (x[order] for x in right)
    first, end = np.searchsorted(term, left[0]), np.searchsorted(term, left[0], side="right")
    ends = np.cumsum(end - first)
    at = 0
    while at < len(ends):  # pairs of a slice of postings at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS, side="right")))
        sizes = (end - first)[at:to]
        i = np.repeat(np.arange(at, to), sizes)
        j = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[at:to], sizes)
        a, b = left[1][i], group[j]
        np.add.at(total, (a, b), _f(left[2][i], p[j]) - _f(left[2][i], q0[b]) - _f(p0[a], p[j]) + f0[a, b])
        at = to


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Partial sums of one tile, for all its pairs of groups."""
    names = rows.column("source").combine_chunks().dictionary_encode()
    source, side, p, times = np.asarray(names.indices), *(rows.column(c).to_numpy() for c in ("side", "p", "times"))
    is_group = rows.column("term").is_null().to_numpy()
    term = np.asarray(rows.column("term").combine_chunks().dictionary_encode().indices.fill_null(0)).astype(np.int64)
    sides, groups = [], []
    for own in (0, 1):
        at = is_group & (side != 1 - own)
        place = np.zeros(len(names.dictionary), np.int64)
        place[source[at]] = np.arange(at.sum())
        groups.append((source[at], p[at]))
        posted = ~is_group & (side != 1 - own)
        sides.append((term[posted], place[source[posted]], p[posted]))
    (left, p0), (right, q0) = groups
    f0 = _f(p0[:, None], q0[None, :])
    total = f0 * (int(times[is_group].max()) if is_group.any() else 0)
    (_dense if key[1].as_py() == 0 else _sparse)(total, f0, p0, q0, *sides)
    a, b = np.nonzero(left[:, None] != right[None, :])
    cells = [pa.array([key[0].as_py()] * len(a), pa.string()), names.dictionary.take(pa.array(left[a])), names.dictionary.take(pa.array(right[b])), pa.array(total[a, b])]
    return pa.Table.from_arrays(cells, names=["lang", "source", "item", "value"])


def _spread(rows: DataFrame) -> DataFrame:
    """Each row once for every tile that its group is a side of; ``side`` 0: of the left groups, 1: of the right ones, 2: of both."""
    to = """explode(concat(
        transform(sequence(0, sides - 1), o -> named_struct('a', own, 'b', o, 'side', IF(o = own, 2, 0))),
        transform(filter(sequence(0, sides - 1), o -> o <> own), o -> named_struct('a', o, 'b', own, 'side', 1)))) AS t"""
    rows = rows.withColumn("own", F.expr("CAST(pmod(xxhash64(source), sides) AS INT)"))
    return rows.selectExpr("lang", "kind", "block", "source", "term", "p", "times", to).selectExpr("lang", "kind", "block", "t.a", "t.b", "source", "term", "p", "times", "t.side")


def divergence(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, dense_share: float = DENSE_SHARE, dense_terms: int = DENSE_TERMS, postings: int = POSTINGS, side: int = GROUPS
) -> DataFrame:
    """(lang, source, part, item, value, rank): of every group its divergence from each other source of its language, and its terms above the language's share.

    Part ``pair`` has all other sources, part ``term`` the ``top_terms`` ranks.
    ``dense_share`` = 0 makes all tiles dense, above 1 all sparse; the results are the same.
    """
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"total": F.sum("n").over(by_term), "df": F.sum("docs").over(by_term), "m": F.count("*").over(by_term)})
    first = F.row_number().over(by_term.orderBy("source")) == 1
    own = table(counts.withColumn("first", first).where(F.col("df") >= least_docs).drop("docs", "df"))

    sources = cut(_named(docs, "lang", "source").distinct())
    per_lang = sources.groupBy("lang").agg(F.count("*").alias("g"))
    per_lang = cut(per_lang.withColumn("sides", F.expr(f"CAST(ceil(g / {side}) AS INT)")))
    marked = own.join(bounded(per_lang, BROADCAST_GROUPS), "lang").withColumn("kind", F.when(F.col("m") >= dense_share * F.col("g"), 0).otherwise(1))
    stats = marked.groupBy("lang").agg(
        F.count_if("first").alias("v"), F.sum("n").alias("n_lang"), F.count_if(F.col("first") & (F.col("kind") == 0)).alias("heavy"), F.count_if(F.col("kind") == 1).alias("light")
    )
    blocks = {"dense": F.expr(f"CAST(ceil(heavy / {dense_terms}) AS INT)"), "sparse": F.expr(f"CAST(greatest(1, ceil(light / {postings})) AS INT)")}
    langs = per_lang.join(stats, "lang", "left").na.fill(0).withColumns(blocks)
    sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = sources.join(langs, "lang").join(sizes, ["lang", "source"], "left").na.fill(0)
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, _share("0", "n_group", "v")).otherwise(1)))

    priced = own.join(bounded(groups, BROADCAST_GROUPS), ["lang", "source"]).withColumns({"p": _share("n", "n_group", "v"), "q": _share("total", "n_lang", "v")})
    above = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) DIV q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    kind = F.when(F.col("m") >= dense_share * F.col("g"), 0).otherwise(1)
    posted = priced.withColumn("kind", kind).withColumn("block", F.expr("CAST(pmod(xxhash64(term), IF(kind = 0, dense, sparse)) AS INT)")).withColumn("times", F.lit(0).cast("long"))
    tiles = """inline(concat(
        transform(filter(sequence(0, dense), x -> x < dense), x -> named_struct('kind', 0, 'block', x)),
        transform(sequence(0, sparse - 1), x -> named_struct('kind', 1, 'block', x))))"""
    nothing = groups.selectExpr("lang", "source", "CAST(NULL AS STRING) AS term", "p0 AS p", "v", "sides", tiles).withColumn("times", F.expr("IF(kind = 1 AND block = 0, v, 0)"))
    columns = ["lang", "kind", "block", "source", "term", "p", "times", "sides"]
    dealt = _spread(posted.select(columns).unionByName(nothing.select(columns)))
    sums = dealt.groupBy("lang", "kind", "block", "a", "b").applyInArrow(_tile, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(top)
