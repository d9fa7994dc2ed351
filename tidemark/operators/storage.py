"""Storage layout: file metadata, probes, compaction, log purging, sizes, segments and membership filters."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mvcc import snapshot

# Bytes a row takes besides key and value, in a file, in memory, and in a framed log batch.
FILE_ROW, MEMORY_ROW, FRAME_HEAD, BATCH_HEAD = 17, 24, 8, 13


def data_bytes() -> Column:
    """Bytes of key and value."""
    return F.octet_length("key") + F.octet_length(F.coalesce("value", F.lit("")))


def file_bytes() -> Column:
    return (data_bytes() + FILE_ROW).cast("long")


def table_meta(entries: DataFrame, level: Column) -> DataFrame:
    """One row for each file: file_num, level, smallest, largest, min_seq, max_seq, rows, size."""
    meta = entries.groupBy("file_num").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("rows"), F.sum(file_bytes()).alias("size"))
    return meta.withColumn("level", level)


def probes(meta: DataFrame, keys: list[str]) -> DataFrame:
    """key, probe, level, file_num: the files that can hold a key, in the order they are read (newest first)."""
    asked = F.explode(F.array(*map(F.lit, keys)))  # the keys are a bounded list
    rows = meta.select("*", asked.alias("key")).where("key BETWEEN smallest AND largest")
    order = Window.partitionBy("key").orderBy("level", F.when(F.col("level") == 0, F.col("file_num")).desc(), F.col("max_seq").desc(), F.col("file_num").desc())
    return rows.select("key", F.row_number().over(order).alias("probe"), "level", "file_num")


def in_range(meta: DataFrame, lower: str | None, upper: str | None) -> DataFrame:
    """Files that overlap [lower, upper)."""
    if upper is not None:
        meta = meta.where(F.col("smallest") < upper)
    return meta if lower is None else meta.where(F.col("largest") >= lower)


def compaction_inputs(meta: DataFrame, trigger: int = 4) -> DataFrame:
    """All files of level 0, once there are `trigger`, and those of level 1 that overlap their key range (closed)."""
    span = meta.where("level = 0").agg(F.min("smallest").alias("_lower"), F.max("largest").alias("_upper"), F.count(F.lit(1)).alias("_n"))
    both = meta.join(F.broadcast(span), F.col("_n") >= trigger)  # one row
    return both.where("level = 0 OR level = 1 AND smallest <= _upper AND largest >= _lower").drop("_lower", "_upper", "_n")


def compacted(entries: DataFrame, meta: DataFrame, trigger: int = 4) -> DataFrame:
    """The rows of the merged file: newest versions, without tombstones."""
    return snapshot(entries.join(compaction_inputs(meta, trigger).select("file_num"), "file_num", "left_semi"))


def purgeable(log: DataFrame, segment: str, flushed: int) -> DataFrame:
    """Segments but the current one whose newest sequence is flushed."""
    segments = log.groupBy(segment).agg(F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("rows"))
    current = segments.agg(F.max(segment).alias("_current"))
    return segments.join(F.broadcast(current), F.col(segment) != F.col("_current")).where(F.col("max_seq") <= flushed).drop("_current")


def space(entries: DataFrame) -> DataFrame:
    """Bytes in memory, in files and in the log (a frame for each row), of live rows, and files against live rows."""
    size = data_bytes()
    total = entries.agg(F.sum(size + MEMORY_ROW).alias("memory_bytes"), F.sum(file_bytes()).alias("file_bytes"), F.sum(size + FILE_ROW + FRAME_HEAD + BATCH_HEAD).alias("log_bytes"))
    live = snapshot(entries).agg(F.sum(file_bytes()).alias("live_bytes"))
    amplification = F.when(F.col("live_bytes") > 0, F.floor(F.col("file_bytes") * 1000 / F.col("live_bytes")))
    return total.crossJoin(live).withColumn("amplification_permille", amplification)  # one row each


def version_state(added: DataFrame, deleted: DataFrame) -> DataFrame:
    """Files that are left, with the next file number and the last sequence, which never fall."""
    counters = added.agg((F.max("file_num") + 1).alias("next_file_num"), F.max("max_seq").alias("last_seq"))
    return added.join(deleted.select("file_num"), "file_num", "left_anti").join(F.broadcast(counters))


def segments(rows: DataFrame, group: str, order: str, size: Column, most: int, before: bool = True) -> DataFrame:
    """Segment numbers of rows in order within each group, from sums that start anew.

    before: a row that does not fit (segment not empty) starts the next segment, as in a log; otherwise the row that
    reaches `most` ends its segment, as in a memory table. Each group is folded in order, so groups must be bounded.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        used, segment, out = 0, 0, []
        for n in rows["_size"].tolist():
            if before and used and used + n > most:
                segment, used = segment + 1, 0
            out.append(segment)
            used += n
            if not before and used >= most:
                segment, used = segment + 1, 0
        return rows.assign(segment=np.array(out, "i8"))[[group, order, "segment"]]

    cut = rows.select(group, order, size.cast("long").alias("_size"))
    kinds = dict(cut.dtypes)
    return cut.groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, {order} {kinds[order]}, segment long")


# ---- membership filter, bit by bit

# FNV-1a offset and prime, finalizer multipliers, and the substitute for a zero second hash.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
FINAL_1, FINAL_2, NOT_ZERO = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15


def filter_bits(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """The bit numbers of each key (keys, hashes): double hashing modulo `bits`, column by column over all keys."""
    lengths = np.array([len(k) for k in keys])
    data = np.zeros((len(keys), max(1, lengths.max(initial=0))), "u8")
    for i, k in enumerate(keys):
        data[i, : len(k)] = np.frombuffer(k, "u1")
    first = np.full(len(keys), FNV_OFFSET, "u8")
    for j in range(data.shape[1]):
        first = np.where(j < lengths, (first ^ data[:, j]) * np.uint64(FNV_PRIME), first)
    second = first.copy()
    for factor in (FINAL_1, FINAL_2):
        second = (second ^ (second >> np.uint64(33))) * np.uint64(factor)
    second ^= second >> np.uint64(33)
    second[second == 0] = np.uint64(NOT_ZERO)
    return (first[:, None] + np.arange(hashes, dtype="u8") * second[:, None]) % np.uint64(bits)


def filter_shape(expected: int, per_key: int = 10) -> tuple[int, int]:
    """Bits (a multiple of 64) and hashes of a filter."""
    bits = max(64, max(1, expected) * max(1, per_key))
    return -(-bits // 64) * 64, min(30, max(1, max(1, per_key) * 69 // 100))


def built_filter(keys: list[bytes], expected: int, per_key: int = 10) -> np.ndarray:
    bits, hashes = filter_shape(expected, per_key)
    out = np.zeros(bits, bool)
    if keys:
        out[filter_bits(keys, bits, hashes).astype("i8").ravel()] = True
    return out


def may_contain(built: np.ndarray, keys: list[bytes], hashes: int) -> np.ndarray:
    return built[filter_bits(keys, len(built), hashes).astype("i8")].all(1) if keys else np.zeros(0, bool)


# ---- two-queue cache


class TwoQueues:
    """A cache that keeps new keys in a short queue, returning ones in a longer one, and remembers evicted new keys."""

    def __init__(self, capacity: int):
        self.capacity = max(1, capacity)
        self.short = max(1, self.capacity // 4)
        self.new, self.often, self.gone = OrderedDict(), OrderedDict(), OrderedDict()

    def hit(self, key) -> bool:
        """Looks a key up and adds it if it is missing."""
        if key in self.new:
            del self.new[key]
            self.often[key] = True
            return True
        if key in self.often:
            self.often.move_to_end(key)
            return True
        if self.gone.pop(key, None):
            self.often[key] = True
        else:
            self.new[key] = True
        while len(self.new) + len(self.often) > self.capacity:
            if self.new and (len(self.new) > self.short or not self.often):
                self.gone[self.new.popitem(last=False)[0]] = True
                while len(self.gone) > self.capacity:
                    self.gone.popitem(last=False)
            else:
                self.often.popitem(last=False)
        return False


def cache_hits(reads: DataFrame, owner: str, group: str, order: str, key: str, capacity: int) -> DataFrame:
    """group, hits, misses of a two-queue cache for each owner, which sees all of its reads in order.

    group: runs of an owner's reads that are counted together. An owner's reads are sorted by Spark and stream through
    one task, which holds the cache and one batch.
    """

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, cache, run, hits, n = None, None, None, 0, 0
        for batch in batches:
            out = []
            for whose, g, k in zip(batch[owner], batch[group], batch[key], strict=True):
                if cache is None or whose != own or g != run:
                    if cache is not None:
                        out.append((run, hits, n - hits))
                    if cache is None or whose != own:
                        cache = TwoQueues(capacity)
                    own, run, hits, n = whose, g, 0, 0
                hits, n = hits + cache.hit(k), n + 1
            yield pd.DataFrame(out, columns=[group, "hits", "misses"])
        if cache is not None:
            yield pd.DataFrame([(run, hits, n - hits)], columns=[group, "hits", "misses"])

    cut = reads.select(owner, group, order, key).repartition(owner).sortWithinPartitions(owner, order)
    return cut.mapInPandas(simulate, f"{group} {dict(reads.dtypes)[group]}, hits long, misses long")
