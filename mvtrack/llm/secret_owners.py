"""Secrets in texts, told from examples by who else has them.

A value that many owners publish is an example out of some manual; one that a
single owner has, and that looks random, is likely live.  Candidates are hashed
where they are found, the hashes are counted by distinct repositories and
owners over the whole corpus, and each finding gets its verdict by a join.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

# The base kinds, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "live"]

#: What else may be a secret: a run of 20 or more of these, mixed and random enough.
LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENTROPY = 3.0

_HEX_RUN = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_LOOSE_RUN = bytes(104 if LOOSE.fullmatch(chr(c) * 20) and c < 128 else 32 for c in range(256))
_HASH = "array<struct<rank:int,start:int,stop:int,value:binary>>"


def _random_looking(value: str) -> bool:
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= ENTROPY


def find(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, hash) of the base kinds and of loose candidates that overlap none of them; code points."""
    if not text:
        return []
    found: list[tuple[int, int, int, str]] = []
    if ":" in text or "=" in text:
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    raw = text.encode("utf-8", "surrogatepass")
    if raw.translate(_HEX_RUN).find(b"h" * 32) >= 0:
        found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    if raw.translate(_LOOSE_RUN).find(b"h" * 20) >= 0:
        starts, ends = sorted(a for _, a, _, _ in found), sorted(b for _, _, b, _ in found)
        for m in LOOSE.finditer(text):  # what ends before it, or begins after it, is all there is
            if _random_looking(m[0]) and bisect_right(ends, m.start()) == bisect_left(starts, m.end()):
                found.append((3, m.start(), m.end(), m[0]))
    return [(k, a, b, hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16]) for k, a, b, v in sorted(found, key=lambda x: (x[1], x[0]))]


def candidates(text: str = "text") -> Column:
    @F.pandas_udf(_HASH)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"rank": k, "start": a, "stop": b, "value": v} for k, a, b, v in find(t)] for t in texts], dtype=object)

    return scan.asNondeterministic()(F.col(text))


def _joined(spans: str) -> Column:
    """kind:start:end of an array of spans, by start, then kind."""
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    ranked = f"array_sort(transform({spans}, s -> struct(s.start, s.rank, s.stop)))"
    return F.expr(f"array_join(transform({ranked}, s -> concat_ws(':', {names}[s.rank], s.start, s.stop)), ',')")


def scan_secrets(docs: DataFrame, repository: Column, owner: Column, examples_from: int = 3) -> DataFrame:
    """Every row's findings with verdicts: (doc_id, repository, owner, base, spans, n_live, n_example).

    ``base`` and ``spans`` are arrays of (rank in KINDS, start, stop); spans adds
    the loose candidates that the count calls live: under ``examples_from``
    distinct owners and repositories hold the value.  A value that so many hold
    is an example; base findings stay whatever the verdict.  Null texts are
    empty; null owners or repositories count as one more.  Rows are kept as
    they are, repeated ones too; an empty table gives no rows; other columns are
    not read.
    """
    own = small_batches(docs).select("doc_id", repository.alias("repository"), owner.alias("owner"), candidates().alias("found"))
    own = cut(own.withColumn("__row", F.monotonically_increasing_id()))  # fixed by the checkpoint
    each = own.where("size(found) > 0").select("__row", "repository", "owner", F.expr("inline(found)"))
    # Counted in two steps, so that a value that a third of all rows hold is small before it is shuffled.
    held = each.groupBy("value").agg(F.count_distinct(F.coalesce("owner", F.lit("\0"))).alias("owners"), F.count_distinct(F.coalesce("repository", F.lit("\0"))).alias("repositories"))
    example = (F.col("owners") >= examples_from) | (F.col("repositories") >= 2 * examples_from)
    judged = each.join(held.select(F.col("value").alias("held"), example.alias("example")), F.col("value") == F.col("held"))
    span = F.struct("rank", "start", "stop")
    spans = judged.groupBy(F.col("__row").alias("__of")).agg(
        F.collect_list(F.when(F.col("rank") < 3, span)).alias("base"),
        F.collect_list(F.when((F.col("rank") < 3) | ~F.col("example"), span)).alias("spans"),
        F.count_if(~F.col("example")).alias("n_live"),
        F.count_if(F.col("example")).alias("n_example"),
    )
    none = F.expr("cast(array() as array<struct<rank:int,start:int,stop:int>>)")
    out = own.select("__row", "doc_id", "repository", "owner").join(spans, F.col("__row") == F.col("__of"), "left")
    return out.select("doc_id", "repository", "owner", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.rank = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), "n_live", "n_example")
