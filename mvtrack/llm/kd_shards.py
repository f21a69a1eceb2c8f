"""Shards of near equal bytes that are boxes in the space of metadata.

The corpus is split in two along the dimension in which it is widest, at the
weighted median of bytes, and each half again, until leaves reach the target
size.  A median is found by counting: each pass sums bytes by the next 12 bits
of the coordinate in the bucket where the median lies, for all boxes of a level
at once, so no pass moves more than a few thousand sums.  Where one coordinate
holds too many bytes, equal coordinates are told apart by the hash of the text,
and copies of one text that are too many for one side by their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

STEP = 12
#: Bits, a multiple of STEP, of the keys that are cut one after the other: coordinate, text, row.
KEYS = [48, 60, 60]
#: A bucket of less than this share of a leaf is not cut further, and copies of a text stay together up to the other.
NEAR, GROUP = 0.001, 0.05


def _coordinates(dims: dict[str, Column]) -> Column:
    return F.array(*[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in dims.items()])


def log_scaled(c: Column) -> Column:
    """A size as a coordinate: equal ratios are equal distances."""
    return F.floor(F.log2(F.greatest(c, F.lit(0)) + 1) * (1 << 20))


def category(c: Column) -> Column:
    """A name as a coordinate; null has the first."""
    return F.when(c.isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(c), F.lit((1 << 24) - 1)))


def _medians(boxes: DataFrame, leaves: dict[int, int], widest: dict[int, int], bytes_: dict[int, int]) -> list[tuple]:
    """(node, dimension, [prefix, shift] of each key, whether the last prefix goes left) for the nodes to split.

    What comes to the driver is a row a node and pass.
    """
    spark = boxes.sparkSession
    open_ = {n: {"goal": bytes_[n] * (k // 2) / k, "leaf": bytes_[n] / k, "key": 0, "cuts": [], "prefix": 0, "shift": KEYS[0], "below": 0.0} for n, k in leaves.items() if k > 1}
    done: dict[int, tuple] = {}
    while open_:
        state = spark.createDataFrame([(n, widest[n], s["key"], s["prefix"], s["shift"], [c[0] for c in s["cuts"]], s["goal"] - s["below"]) for n, s in open_.items()], "__n int, dim int, stage int, prefix long, shift int, cuts array<long>, left double")
        rows = boxes.join(F.broadcast(state), F.col("__node") == F.col("__n"))
        keys = [F.expr("__coords[dim]"), F.col("__text"), F.col("__row")]
        inside = F.lit(True)
        for k in range(2):  # the keys before this one are settled
            inside &= (F.col("stage") <= k) | (keys[k] == F.expr(f"cuts[{k}]"))
        key = F.when(F.col("stage") == 0, keys[0]).when(F.col("stage") == 1, keys[1]).otherwise(keys[2])
        rows = rows.withColumn("__key", key).where(inside & F.expr("shiftright(__key, shift) = prefix"))
        sums = rows.groupBy("__n", F.expr(f"shiftright(__key, shift - {STEP})").alias("bucket")).agg(F.sum("__size").alias("bytes"), F.first("left").alias("left"))
        by_node = Window.partitionBy("__n").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("bytes").over(by_node)).withColumn("last", F.max("bucket").over(Window.partitionBy("__n")))
        hits = sums.where("upto >= left OR bucket = last").groupBy("__n").agg(F.min(F.struct("bucket", "bytes", "upto")).alias("hit")).collect()
        for n, hit in hits:
            s = open_[n]
            s["prefix"], s["shift"] = hit.bucket, s["shift"] - STEP
            before = s["below"] + hit.upto - hit.bytes
            over, under = s["below"] + hit.upto - s["goal"], s["goal"] - before
            group = s["key"] == 1 and s["shift"] == 0
            last = s["key"] == 2 and s["shift"] == 0
            if hit.bytes <= NEAR * s["leaf"] or (group and hit.bytes <= GROUP * s["leaf"]) or last:
                done[n] = (n, widest[n], [*s["cuts"], (s["prefix"], s["shift"])], over <= under)
            else:
                s["below"] = before
                if s["shift"] == 0:
                    s["cuts"].append((s["prefix"], 0))
                    s["key"], s["prefix"], s["shift"] = s["key"] + 1, 0, KEYS[s["key"] + 1]
        open_ = {n: s for n, s in open_.items() if n not in done}
    return [done[n] for n in sorted(done)]


def kd_shards(docs: DataFrame, dims: dict[str, Column], target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row.

    Size is the bytes of the text, plus 1; a null text has none.  Give the
    number of shards, or a size that they should have.  A shard's sizes come to
    the same within NEAR of a shard a split, or within GROUP where copies of a
    text are kept together.  Null coordinates are 0.  Rows with equal
    coordinates, copies and repeated rows are told apart by where they stand;
    each has its own slot, from 0 without gaps.  An empty table gives no rows;
    columns that no dimension uses are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("__size"), F.crc32(text).alias("__crc"), F.shiftrightunsigned(F.xxhash64(text), 4).alias("__text"), _coordinates(dims).alias("__coords"), F.monotonically_increasing_id().alias("__row")
    )
    boxes = cut(own.withColumn("__node", F.lit(1)))  # fixes the row numbers
    total = boxes.agg(F.sum("__size")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    k = len(dims)
    bounds = [f(F.col("__coords")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("low", F.min), ("high", F.max))]
    leaves = {1: shards}
    whole: list[int] = []
    while True:
        seen = {r["__node"]: r for r in boxes.groupBy("__node").agg(F.sum("__size").alias("bytes"), *bounds).collect()}
        if not any(m > 1 and n in seen for n, m in leaves.items()):  # a box without rows stays as it is
            break
        whole = whole or [max(1, seen[1][f"high{i}"] - seen[1][f"low{i}"]) for i in range(k)]
        here = {n: m for n, m in leaves.items() if m > 1 and n in seen}
        width = {n: [(seen[n][f"high{i}"] - seen[n][f"low{i}"]) / whole[i] for i in range(k)] for n in here}
        widest = {n: max(range(k), key=lambda i: (w[i], -i)) for n, w in width.items()}
        found = _medians(boxes, here, widest, {n: seen[n]["bytes"] for n in here})
        cuts = boxes.sparkSession.createDataFrame([(n, d, [p for p, _ in c], [s for _, s in c], left) for n, d, c, left in found], "__n int, dim int, prefixes array<long>, shifts array<int>, inclusive boolean")
        rows = boxes.join(F.broadcast(cuts), F.col("__node") == F.col("__n"), "left")
        right = F.lit(False)
        for stage, key in reversed(list(enumerate((F.expr("__coords[dim]"), F.col("__text"), F.col("__row"))))):
            at, end = F.call_function("shiftright", key, F.get("shifts", F.lit(stage))), F.get("prefixes", F.lit(stage))
            tie = F.when(F.size("prefixes") == stage + 1, ~F.col("inclusive")).otherwise(right)
            right = F.when(at > end, True).when(at < end, False).otherwise(tie)
        node = F.when(F.col("__n").isNull(), F.col("__node")).otherwise(2 * F.col("__node") + right.cast("int"))
        boxes = cut(rows.select("doc_id", "__size", "__crc", "__text", "__coords", "__row", node.alias("__node")))
        leaves = {n: m for n, m in leaves.items() if n not in here} | {2 * n + side: m // 2 + side * (m % 2) for n, m in here.items() for side in (0, 1)}
    order = sorted(leaves, key=lambda n: bin(n)[3:])  # from left to right
    first = [sum(leaves[m] for m in order[:i]) for i in range(len(order))]
    names = boxes.sparkSession.createDataFrame(list(zip(order, first, strict=True)), "__leaf int, shard int")
    placed = boxes.join(F.broadcast(names), F.col("__node") == F.col("__leaf"))
    # Slots: counts by shard and input partition, of which there are few, then a number within each.
    block = F.shiftright("__row", 33)
    before = placed.groupBy("shard", block.alias("__block")).agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("__block")) - F.col("n")
    before = before.select(F.col("shard").alias("__s"), F.col("__block").alias("__b"), start.alias("__start"))
    numbered = placed.withColumn("__block", block).withColumn("__k", F.row_number().over(Window.partitionBy("shard", "__block").orderBy("__row")))
    out = numbered.join(before, (F.col("shard") == F.col("__s")) & (F.col("__block") == F.col("__b")))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "shard", (F.col("__start") + F.col("__k") - 1).alias("slot"))
