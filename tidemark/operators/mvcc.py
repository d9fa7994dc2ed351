"""Reads of versioned entries (key, value, seq, kind): the newest version no newer than a sequence number counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(entries: DataFrame, at: int | None = None, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """The newest version of each key in [lower, upper) as of `at`, tombstones included. Filters reach the scan."""
    if at is not None:
        entries = entries.where(F.col("seq") <= at)
    if lower is not None:
        entries = entries.where(F.col("key") >= lower)
    if upper is not None:
        entries = entries.where(F.col("key") < upper)
    last = F.max_by(F.struct("value", "seq", "kind"), "seq")
    return entries.groupBy("key").agg(last.alias("e")).select("key", "e.value", "e.seq", "e.kind")


def snapshot(entries: DataFrame, at: int | None = None, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """What a reader at `at` sees: key, value, seq of live keys."""
    return newest(entries, at, lower, upper).where("kind = 'put'").select("key", "value", "seq")


def get(entries: DataFrame, keys: list[str], at: int | None = None) -> DataFrame:
    """key, value, found for each asked key; a missing or deleted key is a row with found = false."""
    asked = entries.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
    seen = snapshot(entries.where(F.col("key").isin(*keys)), at).select("key", "value", F.lit(True).alias("_found"))
    return asked.join(seen, "key", "left").select("key", "value", F.coalesce("_found", F.lit(False)).alias("found"))


def seek(entries: DataFrame, targets: list[str], at: int | None = None) -> DataFrame:
    """target and the first live key at or after it (null past the end), for all targets in one aggregation."""
    live = snapshot(entries, at)
    firsts = live.agg(*[F.min(F.when(F.col("key") >= t, F.col("key"))).alias(f"_{i}") for i, t in enumerate(targets)])
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_{i}").alias("key")) for i, t in enumerate(targets)])
    return firsts.select(F.inline(pairs))


def following(entries: DataFrame, at: int | None = None, prefix: int = 12) -> DataFrame:
    """key and next_key among live keys.

    Keys are put in order within those of one prefix (so many characters), and prefixes among each other; only these, one
    row each, go through one task.
    """
    live = snapshot(entries, at).select("key", F.substring("key", 1, prefix).alias("_p"))
    after = live.groupBy("_p").agg(F.min("key").alias("_first")).select("_p", F.lead("_first").over(Window.orderBy("_p")).alias("_after"))
    return live.join(after, "_p").select("key", F.coalesce(F.lead("key").over(Window.partitionBy("_p").orderBy("key")), "_after").alias("next_key"))


def versions(entries: DataFrame) -> DataFrame:
    """Every version with its age (1 is the newest) and whether a newer one hides it."""
    age = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))
    return entries.select("key", "seq", "kind", age.alias("age")).withColumn("hidden", F.col("age") > 1)


def tombstones(entries: DataFrame) -> DataFrame:
    """Keys whose newest version is a delete."""
    return newest(entries).where("kind = 'delete'").select("key", "seq")


def merged(*groups: DataFrame) -> DataFrame:
    """Tiers merged into live rows; the order of the tiers does not matter."""
    all_rows = groups[0]
    for g in groups[1:]:
        all_rows = all_rows.unionByName(g)
    return snapshot(all_rows)
