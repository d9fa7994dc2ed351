"""The operation log: one row for each operation, in the total order of idx.

Any table of operations can be brought into this form; here it is derived from the `events` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operations of one flushed file, entries of one term.
FILE_ROWS, TERM_ROWS = 512, 1000


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, term, op, key, value, client_id, request_id, latency_ms, node, err, file_num, ts."""
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    text = lambda c: c.cast("string")
    return e.select(
        (i + 1).alias("idx"),
        (F.expr(f"event_id div {TERM_ROWS}") + 1).alias("term"),
        F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"),
        F.concat(F.lit("bench:"), F.lpad(text(F.col("user_id")), 8, "0")).alias("key"),
        F.col("props").alias("value"),
        F.concat(F.lit("c"), text(F.col("user_id") % 16)).alias("client_id"),
        (i % 400 + 1).alias("request_id"),
        F.col("value").alias("latency_ms"),
        F.concat(F.lit("node"), text(F.col("user_id") % 3 + 1)).alias("node"),
        F.when(i % 37 == 0, "not leader; leader=node1").when(i % 41 == 0, "context deadline exceeded").otherwise("").alias("err"),
        (F.expr(f"event_id div {FILE_ROWS}") + 1).alias("file_num"),
        "ts",
    )


#: The same projection in SQL.
SQL = f"""o AS (SELECT event_id + 1 AS idx, 1 + event_id // {TERM_ROWS} AS term,
  CASE event_type WHEN 'view' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'set' END AS op,
  'bench:' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, props AS value,
  'c' || CAST(user_id % 16 AS VARCHAR) AS client_id, 1 + event_id % 400 AS request_id, "value" AS latency_ms,
  'node' || CAST(1 + user_id % 3 AS VARCHAR) AS node,
  CASE WHEN event_id % 37 = 0 THEN 'not leader; leader=node1' WHEN event_id % 41 = 0 THEN 'context deadline exceeded' ELSE '' END AS err,
  1 + event_id // {FILE_ROWS} AS file_num, ts FROM events)"""


def writes(log: DataFrame) -> DataFrame:
    """The versioned entries a log makes: key, value, seq, kind ('put' or 'delete')."""
    kind = F.when(F.col("op") == "set", "put").otherwise("delete")
    return log.where("op <> 'get'").select("key", F.when(F.col("op") == "set", F.col("value")).alias("value"), F.col("idx").alias("seq"), kind.alias("kind"), "file_num")


def case_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark case matrix: CSV with a header; blank rows and rows that start with # are left out."""
    return spark.read.csv(path, header=True, comment="#", inferSchema=True).dropna("all")


def results(spark: SparkSession, root: str, name: str = "result.json") -> DataFrame:
    """All files of that name under a folder, one JSON object each, with their path."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(root)
    return rows.select("*", F.col("_metadata.file_path").alias("path"))
