from pyspark.sql import functions as F

from tidemark.operators import commands, mvcc
from tidemark.sources.oplog import operations, writes
from tidemark.streaming import replay

DIR = "/root/testdata/sf0.001"


def stream(spark, log, folder, files=4):
    log.repartitionByRange(files, "idx").sortWithinPartitions("idx").write.parquet(folder)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_newest_versions(spark, tmp_path):
    log = operations(spark, DIR)
    live = replay.newest_stream(stream(spark, log, str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    want = {(r.key, r.seq) for r in mvcc.newest(writes(log)).collect()}
    assert {(r.key, r.seq) for r in spark.table("newest").collect()} == want


def test_once(spark, tmp_path):
    log = operations(spark, DIR)
    q = replay.once(stream(spark, log, str(tmp_path / "in"))).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == commands.applied(log.where("op <> 'get'")).count()


def test_materialized_table(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS kept")
    log = operations(spark, DIR)
    replay.materialize(stream(spark, log, str(tmp_path / "in")), "kept", str(tmp_path / "c")).awaitTermination(240)
    got = {(r.key, r.seq) for r in spark.table("kept").where(F.col("kind") == "put").collect()}
    assert got == {(r.key, r.seq) for r in mvcc.snapshot(writes(log)).collect()}
    for t in ("kept", "kept_next"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
