"""Reports as rows of text: Markdown tables and the metrics exposition format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = "| Label | Mode | Routing | Concurrency | Value Bytes | Success QPS | Errors | P95 ms | P99 ms | Leader | Result |"
RULE = "|---|---|---|---:|---:|---:|---:|---:|---:|---|---|"


def unpiped(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|"))


def result_table(results: DataFrame) -> DataFrame:
    """line_no, line: the result table, rows by label. Columns as in the head, in lower case with underscores."""
    row = F.format_string("| %s | %s | %s | %d | %d | %.2f | %d | %.3f | %.3f | %s | %s |", *map(unpiped, map(F.col, ("label", "mode", "routing"))), "concurrency", "value_bytes", "success_qps", "errors", "p95_ms", "p99_ms", unpiped(F.col("leader")), unpiped(F.col("result")))
    head = results.sparkSession.createDataFrame([("0", HEAD), ("1", RULE)], "line_key string, line string")
    return head.unionByName(results.select(F.concat(F.lit("2"), F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("result"))).alias("line_key"), row.alias("line")))


def escaped(label: Column) -> Column:
    out = F.replace(label, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def metric_line(name: str, labels: dict[str, Column], value: Column) -> Column:
    """name{label="value",...} with labels in order of their names, and the value with six decimals."""
    parts = [F.concat(F.lit(f'{k}="'), escaped(labels[k]), F.lit('"')) for k in sorted(labels)]
    return F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.format_string("%.6f", value.cast("double")))


def histogram_lines(bars: DataFrame, name: str, by: list[str]) -> DataFrame:
    """The lines of a histogram (by..., le, count, n, sum_ns): a bucket for each bound, then sum and count."""
    own = {b: F.col(b) for b in by}
    lines = bars.select(metric_line(name + "_bucket", own | {"le": F.col("le")}, F.col("count")).alias("line"))
    whole = bars.select(*by, "n", "sum_ns").distinct()
    for suffix, value in (("_sum", F.col("sum_ns") / 1_000_000), ("_count", F.col("n"))):
        lines = lines.unionByName(whole.select(metric_line(name + suffix, own, value).alias("line")))
    return lines
