"""Generated workloads: keys, operations and values."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def value_of(size: int) -> str:
    """Letters in turn."""
    return (LETTERS * (size // 26 + 1))[:size]


def operation_of(roll: Column, read: int, write: int, delete: int) -> Column:
    """get, set or delete from a number 0 to 99; the shares must sum to 100."""
    if min(read, write, delete) < 0 or read + write + delete != 100:
        raise ValueError("operation shares must be non-negative and sum to 100")
    return F.when(roll < read, "get").when(roll < read + write, "set").otherwise("delete")


def unit(seed: int, number: Column) -> Column:
    """A number in [0, 1) from a hash of seed and number: the same in every run and at every split of the rows."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), number.cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32


def zipf_numbers(rows: DataFrame, u: str, name: str, keyspace: int, s: float = 1.2, cells: int = 4096) -> DataFrame:
    """Adds an integer below keyspace with probability in proportion to (1 + k) ** -s, from u in [0, 1).

    Cumulative weights cut [0, 1) into ranges, one for each k, listed by the equal cells that they touch; a row looks for
    its range within its cell. The table has at most keyspace + cells rows.
    """
    upper = list(accumulate((1.0 + k) ** -s for k in range(keyspace)))
    upper = [x / upper[-1] for x in upper]
    ranges = rows.sparkSession.createDataFrame(list(zip(range(keyspace), [0.0, *upper[:-1]], upper, strict=True)), f"{name} long, _lower double, _upper double")
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("long")
    ranges = ranges.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lower")), cell(F.col("_upper")))))
    return rows.withColumn("_cell", cell(F.col(u))).join(ranges, "_cell").where((F.col(u) >= F.col("_lower")) & (F.col(u) < F.col("_upper"))).drop("_cell", "_lower", "_upper")


def requests(spark: SparkSession, n: int, keyspace: int, size: int, kind: str = "sequential", mix: tuple[int, int, int] = (0, 100, 0), prefix: str = "bench:key:", seed: int = 1) -> DataFrame:
    """seq, op, key, value: n requests, generated in parallel."""
    ids, u = spark.range(n), unit(seed, F.col("id"))
    number = F.col("id") % keyspace if kind == "sequential" else F.floor(u * keyspace)
    if kind == "zipfian":
        ids, number = zipf_numbers(ids.withColumn("_u", u), "_u", "_k", keyspace), F.col("_k")
    roll = F.col("id") % 100 if kind == "sequential" else F.floor(unit(seed + 1, F.col("id")) * 100)
    rows = ids.select(F.col("id").alias("seq"), operation_of(roll, *mix).alias("op"), F.concat(F.lit(prefix), number.cast("string")).alias("key"))
    return rows.withColumn("value", F.when(F.col("op") == "set", F.lit(value_of(size))))
