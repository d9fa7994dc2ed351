"""A key-value store over an operation log in a table: Set and Delete append, Get and Scan read as of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mvcc

LOG = "key string, value string, seq long, kind string"


class LogStore:
    """key, value, seq, kind rows under a path. One writer; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.path)

    def last(self) -> int:
        from pyspark.errors import AnalysisException

        try:
            return self.entries().agg(F.max("seq")).first()[0] or 0
        except AnalysisException:  # nothing written yet
            return 0

    def write(self, ops: list[tuple[str, str, str | None]]) -> int:
        """Appends one batch of (op, key, value) atomically with consecutive sequence numbers; an empty one is a no-op."""
        for op, key, _ in ops:
            if not key or op not in ("set", "delete"):
                raise ValueError(f"invalid operation: {op!r} {key!r}")
        if not ops:
            return self.last()
        first = self.last() + 1
        rows = [(k, v if op == "set" else None, first + i, "put" if op == "set" else "delete") for i, (op, k, v) in enumerate(ops)]
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(self.path)
        return rows[-1][2]

    def set(self, key: str, value: str) -> int:
        return self.write([("set", key, value)])

    def delete(self, *keys: str) -> int:
        """How many of the keys were there; a key given twice counts once."""
        there = {r.key for r in self.get(*keys).where("found").collect()} if keys else set()
        if there:
            self.write([("delete", k, None) for k in dict.fromkeys(keys) if k in there])
        return len(there)

    def get(self, *keys: str, at: int | None = None) -> DataFrame:
        return mvcc.get(self.entries(), list(keys), at)

    def scan(self, lower: str | None = None, upper: str | None = None, at: int | None = None) -> DataFrame:
        return mvcc.snapshot(self.entries(), at, lower, upper).orderBy("key")
