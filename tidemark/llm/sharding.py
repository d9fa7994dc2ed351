"""Shards by longest-processing-time scheduling.

Rows of equal text form a group that must stay together. Groups are sorted by size and each goes to the shard that has
least so far, which a heap keeps at hand. Groups of one size are alike to the schedule: it says how many of them each
shard takes, and which ones follows from their rank (by the md5 of the text) among the groups of that size. So the heap
works through a histogram of sizes, largest first, in one task that streams it: sizes that differ add up to all bytes at
most, so there are fewer than sqrt(2 * bytes) of them (14 million for 100 TB). Where many groups have one size, all of
them that stay below a common level are placed at once, and the heap deals the rest; the result is that of one by one.

Ranks and slots are numbered in two levels: counts by run (a prefix of the hash that orders) first, rows within a run
next. A run of rows that holds more than `rows_per_run`, as one repeated row makes it, is split once more.

Edge cases: a null text counts as an empty one (size 1, CRC 0, one group with the empty texts); repeated rows, null ids
and equal ids each get a slot; a group larger than a shard's share stays whole and makes its shard larger; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written


def taken(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each shard takes, if each goes to the least-loaded shard (ties to the first).

    A shard's k-th group of these finds a load of loads + k * size: the groups take the `count` smallest such loads.
    """
    below = lambda level: [max(0, -((x - level) // size)) for x in loads]  # noqa: E731  loads under a level
    n = [0] * len(loads)
    if count > 4 * len(loads):
        low, high = min(loads), min(loads) + size * count + 1
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
        n = below(low)
    heap = [(x + k * size, i) for i, (x, k) in enumerate(zip(loads, n, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(n)):
        load, i = heap[0]
        n[i] += 1
        heapq.heapreplace(heap, (load + size, i))
    return n


def schedule(sizes: DataFrame, shards: int) -> DataFrame:
    """group_size and ends, the ranks at which each shard's groups of that size end. sizes: (group_size, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = [0] * shards
        for batch in batches:
            ends = []
            for size, count in zip(batch["group_size"].tolist(), batch["n"].tolist(), strict=True):
                own, end, row = taken(loads, size, count), 0, []
                for i, k in enumerate(own):
                    loads[i] += k * size
                    end += k
                    row.append(end)
                ends.append(row)
            yield pd.DataFrame({"group_size": batch["group_size"], "ends": ends})

    ordered = sizes.select("group_size", "n").repartition(1).sortWithinPartitions(F.col("group_size").desc())
    return ordered.mapInPandas(run, "group_size long, ends array<long>")


def digits_for(rows: int, per_run: int) -> int:
    """Hexadecimal digits whose prefixes cut so many rows into runs of about per_run or fewer."""
    return max(1, math.ceil(math.log(max(1, rows / per_run), 16)))


def ahead(counts: DataFrame, by: list[str], run: list[str], n: str) -> DataFrame:
    """Adds _ahead, the rows of the runs before."""
    return counts.withColumn("_ahead", F.sum(n).over(Window.partitionBy(*by).orderBy(*run)) - F.col(n))


def shard_documents(docs: DataFrame, shards: int = 16, rows_per_run: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (0.. without gaps in each shard), grown_shard (null).

    Slots follow the md5 of doc_id and text.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_key"))
    place = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_key"))
    base = written(base.withColumn("_place", place).withColumn("_row", F.monotonically_increasing_id()))  # _row tells repeated rows apart
    n = base.count()
    digits = digits_for(n, rows_per_run)

    groups = written(base.groupBy("_key").agg(F.sum("size").alias("group_size")))
    plan = schedule(groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n")), shards)
    ranked = groups.withColumn("_run", F.substring("_key", 1, digits))
    runs = ahead(ranked.groupBy("group_size", "_run").agg(F.count(F.lit(1)).alias("_n")), ["group_size"], ["_run"], "_n").drop("_n")
    rank = F.col("_ahead") + F.row_number().over(Window.partitionBy("group_size", "_run").orderBy("_key"))  # from 1
    ranked = ranked.join(runs, ["group_size", "_run"]).withColumn("_rank", rank).join(plan, "group_size")
    where = ranked.select("_key", F.size(F.filter("ends", lambda end: end < F.col("_rank"))).alias("shard"))

    dealt = base.join(where, "_key").withColumn("_run", F.substring("_place", 1, digits))
    dealt = written(dealt.select("doc_id", "size", "text_crc32", "shard", "_run", "_place", "_row"))
    parts = dealt.groupBy("shard", "_run").agg(F.ceil(F.count(F.lit(1)) / (4 * rows_per_run)).alias("_parts"))
    cut = dealt.join(parts, ["shard", "_run"]).withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")))
    before = ahead(cut.groupBy("shard", "_run", "_part").agg(F.count(F.lit(1)).alias("_n")), ["shard"], ["_run", "_part"], "_n").drop("_n")
    within = F.row_number().over(Window.partitionBy("shard", "_run", "_part").orderBy("_place", "_row")) - 1
    slot = (F.col("_ahead") + F.col("_at")).cast("long").alias("slot")
    numbered = cut.withColumn("_at", within).join(before, ["shard", "_run", "_part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
