"""The log as a stream: the newest version of each key, and commands applied once each in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.commands import in_session
from ..sources.oplog import writes


def newest_stream(log: DataFrame) -> DataFrame:
    """A streaming aggregation: max_by does not depend on the order of arrival. Tombstones are kept as state."""
    last = F.max_by(F.struct("value", "seq", "kind"), "seq")
    return writes(log).groupBy("key").agg(last.alias("e")).select("key", "e.value", "e.seq", "e.kind")


def once(log: DataFrame) -> DataFrame:
    """Writes without the repeats of a (client, request); needs the log in idx order, as repeats follow their first."""
    own = log.withColumn("_request", F.when(in_session(), F.concat_ws("/", "client_id", F.col("request_id").cast("string"))).otherwise(F.concat(F.lit("#"), F.col("idx").cast("string"))))
    return own.where("op <> 'get'").dropDuplicates(["_request"]).drop("_request")


def materialize(log: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps `table` as the newest versions after each micro-batch, rewriting it from its own rows and the batch's.

    A batch can be delivered again after a failure: rows are compared by seq, so applying it twice changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = writes(batch).drop("file_num")
        both = fresh.unionByName(spark.table(table)) if spark.catalog.tableExists(table) else fresh
        last = both.groupBy("key").agg(F.max_by(F.struct("value", "seq", "kind"), "seq").alias("e")).select("key", "e.*")
        last.write.mode("overwrite").saveAsTable(f"{table}_next")
        spark.table(f"{table}_next").write.mode("overwrite").saveAsTable(table)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
