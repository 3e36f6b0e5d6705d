"""A uniform shuffle into shards of exact size, in built-in functions only.

Rows fall into source partitions by a hash. How many rows each partition gives
to each shard is drawn exactly, as the cells of a table with fixed margins
(multivariate hypergeometric). Inside a partition a random order decides which
rows go where; inside a shard a second random order gives the slots. Any
assignment with the exact shard sizes is then as likely as any other.

Rows with equal keys are numbered first and hashed with their number, so a
million copies spread like a million rows. Partitions, and the stretches of a
shard, follow the number of rows: a task orders about ``ROWS`` of them.

Only a table of partition and shard counts meets on the driver: one number for
each shard and million rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import brought_back, set_apart, stage

SHARDS = 40
# Source partitions, and stretches of a shard whose rows one task orders: at
# least so many, and more beyond so many rows in each.
PARTITIONS = 512
STRETCHES = 128
ROWS = 1 << 20
# A larger table of counts is joined by its partition instead of sent to all tasks.
SENT_BYTES = 32 << 20
SEED = 20


def hypergeometric(u: float, good: int, bad: int, draws: int) -> int:
    """The value of the hypergeometric law at probability ``u``, for any sizes.

    Probabilities around the mode follow from the ratios of neighbours; what
    lies beyond fourteen deviations is less than rounding.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(max(int((draws + 1) * (good + 1) / (total + 2)), low), high)
    deviation = (draws * good / total * bad / total * (total - draws) / max(total - 1, 1)) ** 0.5
    reach = int(14 * deviation) + 14
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=float)
    ratio = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    weight = np.append(0.0, np.cumsum(ratio))
    share = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(share, u * share[-1], side="right").clip(0, len(k) - 1)])


def communication(sizes: list[int], quotas: list[int], seed: int = SEED) -> list[list[int]]:
    """Rows that each partition gives to each shard: ``sizes`` by row, ``quotas`` by column."""
    rng = np.random.default_rng(seed)
    left = list(quotas)
    table = []
    for size in sizes:
        rest, row = sum(left), []
        for s, quota in enumerate(left):
            n = hypergeometric(rng.random(), quota, rest - quota, size)
            rest -= quota
            size -= n
            row.append(n)
            left[s] -= n
        table.append(row)
    return table


def _random(seed: int, *row: Column) -> Column:
    return F.xxhash64(F.lit(seed), *row)


def _numbered(marked: DataFrame) -> DataFrame:
    """``marked``, staged, with ``_copy``: a number from 0 for each of the rows with one ``_key``.

    Copies are counted by the task that wrote them, so no task meets more of
    them than one task wrote.
    """
    counts = marked.groupBy("_key", "_task").agg(F.count(F.lit(1)).alias("_n"))
    by_task = Window.partitionBy("_key").orderBy("_task")
    before = F.coalesce(F.sum("_n").over(by_task.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy("_key"))
    copies = counts.select("_key", "_task", before.alias("_before"), total.alias("_total")).where("_total > 1").drop("_total")
    copies = stage(copies, "copies")
    at = F.row_number().over(Window.partitionBy("_key", "_task").orderBy("_at")) - 1
    many = marked.join(copies, ["_key", "_task"]).withColumn("_copy", F.col("_before") + at).drop("_before")
    once = marked.join(copies, ["_key", "_task"], "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    return once.unionByName(many)


def assign(docs: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED, partitions: int = PARTITIONS, rows: int = ROWS) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1; sizes at most one apart) and
    ``slot`` (from 0 without gaps in each shard).

    ``keys`` are the columns that the random order is drawn from, by hash with
    ``seed``: the same rows give the same shuffle wherever they lie. Rows with
    equal keys still get places of their own, as far apart as those of other
    rows; which of them gets which is arbitrary, as they differ in nothing read.
    Nulls hash like values. There are ``partitions`` source partitions, or more
    if they would hold over ``rows`` rows. Columns with the two names are
    replaced, other names may be any; an empty table gives an empty one.
    """
    docs, own = set_apart(docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")]))
    # Two hashes tell keys apart; the task and the place in it are fixed by staging.
    key = F.struct(*[_random(seed + s, *[F.col(own[k]) for k in keys]).alias(f"h{s}") for s in (3, 4)])
    marked = stage(docs.withColumns({"_key": key, "_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "marked")
    total = marked.count()
    partitions = max(partitions, -(-total // rows))
    stretches = max(STRETCHES, 1 << (-(-total // (shards * rows))).bit_length())
    drawn = {"_first": _random(seed + 1, F.col("_key"), F.col("_copy")), "_second": _random(seed + 2, F.col("_key"), F.col("_copy"))}
    source = F.pmod(_random(seed, F.col("_key"), F.col("_copy")), F.lit(partitions)).cast("int")
    marked = stage(_numbered(marked).select(*own.values(), source.alias("_from"), *[c.alias(n) for n, c in drawn.items()]), "dealt")

    sizes = {r["_from"]: r["n"] for r in marked.groupBy("_from").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    held = sorted(sizes)
    cells = communication([sizes[p] for p in held], quotas, seed)
    spark = docs.sparkSession
    bounds = spark.createDataFrame([(p, np.cumsum(c).tolist()) for p, c in zip(held, cells, strict=True)], "_from int, _bounds array<long>")
    if len(held) * shards * 8 <= SENT_BYTES:
        bounds = F.broadcast(bounds)

    rank = F.row_number().over(Window.partitionBy("_from").orderBy("_first", "_second"))
    placed = marked.withColumn("_rank", rank).join(bounds, "_from")
    shard = F.size(F.filter("_bounds", lambda b: b < F.col("_rank"))).cast("int")
    # The second order, by stretches of its range: a stretch begins where the ones before it end.
    part = F.shiftrightunsigned("_second", 64 - (stretches - 1).bit_length()).cast("int")
    placed = stage(placed.select(*own.values(), "_second", shard.alias("shard"), part.alias("_part")), "placed")
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    slot = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_second")) - 1
    out = placed.withColumn("_slot", slot).join(begins, ["shard", "_part"])
    return brought_back(out.withColumn("slot", (F.col("_slot") + F.col("_begin")).cast("long")), own, "shard", "slot")
