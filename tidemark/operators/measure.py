"""Measurement of operations: summaries, exact nearest-rank percentiles, histograms, edges, gauges and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Histogram bounds in milliseconds.
BOUNDS_MS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)


def error_class(err: Column) -> Column:
    """'' for success; not_leader, then deadline_exceeded, then unknown for blank texts, else the trimmed text."""
    known = F.when(F.lower(err).contains("not leader"), "not_leader").when(err.contains("deadline exceeded"), "deadline_exceeded")
    return F.when(err == "", "").otherwise(known.when(F.trim(err) == "", "unknown").otherwise(F.trim(err)))


def nanos(ms: Column) -> Column:
    return F.round(ms * 1_000_000).cast("long")


def operation_summary(ops: DataFrame, seconds: float, *by: str) -> DataFrame:
    """Counts and rates; latencies and totals include failed operations, found and missing count successful reads."""
    fine = F.col("err") == ""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    out = ops.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        count(fine)("success"),
        count(~fine)("errors"),
        count(fine & (F.col("op") == "get") & F.col("found"))("found"),
        count(fine & (F.col("op") == "get") & ~F.col("found"))("missing"),
    )
    rate = lambda c: F.when(F.lit(seconds) > 0, F.col(c) / F.lit(seconds)).otherwise(0.0)
    return out.withColumn("success_qps", rate("success")).withColumn("attempted_qps", rate("total"))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], width: int = 1_000_000) -> DataFrame:
    """by..., n and a column for each share: the value at 0-based rank floor(p * (n - 1) + 0.5) in order.

    Exact without sorting a group in one task: a histogram over value ranges finds the range of each rank, and only
    distinct values of those ranges are ranked, by their counts.
    """
    cells = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k")).withColumn("_cell", F.floor(F.col(value) / width))
    cell = cells.groupBy(*by, "_cell").agg(F.sum("_k").alias("_c"))
    run, whole = Window.partitionBy(*by).orderBy("_cell"), Window.partitionBy(*by)
    cell = cell.withColumn("_end", F.sum("_c").over(run)).withColumn("n", F.sum("_c").over(whole))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.lit(p) * (F.col("n") - 1) + F.lit(0.5)).cast("long").alias("rank")) for name, p in shares.items()])
    hit = cell.select(*by, "_cell", "n", (F.col("_end") - F.col("_c")).alias("_start"), "_end", F.explode(wanted).alias("w")).where("w.rank >= _start AND w.rank < _end")
    inside = Window.partitionBy(*by, "_cell").orderBy(value)
    ranked = cells.join(hit.select(*by, "_cell").distinct(), [*by, "_cell"], "left_semi").withColumn("_upto", F.sum("_k").over(inside))
    found = ranked.join(hit, [*by, "_cell"]).where("w.rank - _start < _upto AND w.rank - _start >= _upto - _k")
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("w.name") == name, F.col(value))).alias(name) for name in shares])


def latencies(ops: DataFrame, *by: str) -> DataFrame:
    """by..., n, avg_ns (rounded down), p50_ns, p95_ns, p99_ns, max_ns of all operations, failed ones included."""
    timed = ops.withColumn("ns", nanos(F.col("latency_ms")))
    ranks = nearest_ranks(timed, list(by), "ns", {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99})
    rest = timed.groupBy(*by).agg(F.expr("sum(ns) div count(ns)").alias("avg_ns"), F.max("ns").alias("max_ns"))
    return ranks.join(rest, list(by))


def histogram(rows: DataFrame, by: list[str], ns: Column) -> DataFrame:
    """by..., le, count (cumulative, bounds included), with sum_ns, max_ns and n of the whole; negative counts as 0."""
    d = F.greatest(ns, F.lit(0))
    below = [F.sum(F.when(d <= b * 1_000_000, 1).otherwise(0)).alias(f"_{b}") for b in BOUNDS_MS]
    wide = rows.groupBy(*by).agg(*below, F.count(F.lit(1)).alias("n"), F.sum(d).alias("sum_ns"), F.max(d).alias("max_ns"))
    bars = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"_{b}").alias("count")) for b in BOUNDS_MS], F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("count")))
    return wide.select(*by, "n", "sum_ns", "max_ns", F.inline(bars))


def rising_edges(samples: DataFrame, node: str, order: str, leader: Column) -> DataFrame:
    """node, changes: how often a node became leader; a first sample as leader counts."""
    was = F.lag(leader).over(Window.partitionBy(node).orderBy(order))
    return samples.withColumn("_edge", leader & ~F.coalesce(was, F.lit(False))).groupBy(node).agg(F.sum(F.col("_edge").cast("long")).alias("changes"))


def last_values(samples: DataFrame, node: str, order: str, *values: str) -> DataFrame:
    return samples.groupBy(node).agg(*[F.max_by(v, order).alias(v) for v in values])


def method_name(path: Column) -> Column:
    """The last part of a full method name."""
    return F.substring_index(path, "/", -1)


def compared(baseline: DataFrame, current: DataFrame, most_qps: float = 20.0, most_p99: float = 20.0, more_errors: int = 0) -> DataFrame:
    """label, qps_drop, p99_rise (percent), status, reason. Both sides: (label, success_qps, errors, p99_ms).

    The first rule broken names the reason: rate, then p99, then errors.
    """
    b = baseline.select("label", *[F.col(c).alias(f"b_{c}") for c in ("success_qps", "errors", "p99_ms")])
    rows = current.join(b, "label")
    worse = lambda a, b: F.when((b > 0) & (a > 0), a / b * 100).otherwise(0.0)
    drop = worse(F.col("b_success_qps") - F.col("success_qps"), F.col("b_success_qps"))
    rise = worse(F.col("p99_ms") - F.col("b_p99_ms"), F.col("b_p99_ms"))
    rows = rows.withColumn("qps_drop", drop).withColumn("p99_rise", rise)
    reason = F.when(F.col("qps_drop") > most_qps, "qps").when(F.col("p99_rise") > most_p99, "p99").when(F.col("errors") > F.col("b_errors") + more_errors, "errors").otherwise("")
    return rows.select("label", "qps_drop", "p99_rise", F.when(reason == "", "OK").otherwise("REGRESSION").alias("status"), reason.alias("reason"))
