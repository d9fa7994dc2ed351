"""What the operators of this subpackage share: tables, scratch tables and deterministic blocks."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word and white-space classes of every contract here: ASCII space and \t \n \v \f \r part words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
ROW_GROUP_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, as in tests, one of our own if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_discard_rest, spark)
    _written.append(path)
    # a reader holds a row group's columns at once; rows here can be large, so groups are small
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shrink_executors(spark: SparkSession) -> None:
    """Lets executors give unused heap back: what one step has made them take would add to the next one's Python workers."""
    cores = spark.sparkContext.defaultParallelism
    collected = spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')")
    collected.write.format("noop").mode("overwrite").save()


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more, and lets Spark drop the shuffle files of written ones.

    Spark drops a shuffle's files once the driver's JVM has collected its plan; that is asked for here, twice, as the
    events of the last query hold on to its plan until the listeners have seen them. Executors shrink as well.
    """
    for table in tables:
        _delete(spark, table.scratch_path)
        _written.remove(table.scratch_path)
    gc.collect()
    for pause in (0.3, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
    shrink_executors(spark)


#: What a Python worker keeps from task to task, by the name of the module that made it.
worker_stores: dict[str, dict] = {}
_trimmed = 0.0


def lean_worker() -> None:
    """Frees what other operators keep in this Python worker, which Spark reuses, and what its allocators hold unused.

    For functions that run in workers and keep nothing themselves. Once a second is enough.
    """
    import ctypes

    import pyarrow as pa

    global _trimmed
    if time.monotonic() - _trimmed < 1 and not any(worker_stores.values()):
        return
    for store in worker_stores.values():
        store.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
    _trimmed = time.monotonic()


def scratch_mark() -> int:
    return len(_written)


def discard_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes all tables written after scratch_mark() gave mark, but for those named."""
    kept = {table.scratch_path for table in keep}
    for path in _written[mark:]:
        if path not in kept:
            _delete(spark, path)
            _written.remove(path)


def _discard_rest(spark: SparkSession) -> None:
    """At the end of the application: results that read scratch tables can't be evaluated any more."""
    try:
        discard_since(spark, 0)
    except Exception:  # noqa: BLE001  the session has ended before; the folder is its owner's to clear
        pass


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; sizes the blocks."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def bucket_count(blocks: int) -> int:
    """Hash buckets for the items of so many blocks. A bucket never gets more than 16 blocks' worth of items."""
    return max(16, min(blocks, 4096), blocks // 16)


def packed_texts(docs: DataFrame, block_bytes: int, carry: str | None = None, keys: bool = False) -> DataFrame:
    """Texts in blocks of about block_bytes: rows (block, ids, present, lengths, texts, extra, keys).

    ids and lengths (in UTF-8 bytes) are little-endian int64, texts is their zstd-compressed concatenation in the
    order of the rows; present marks ids that are not null. carry: a string column kept as JSON in extra. keys: the
    16-byte md5 digests of the texts. Write the result before use: a block is what one attempt of a task has packed.
    """
    import hashlib
    import json

    import numpy as np
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    names = ["block", "ids", "present", "lengths", "texts", "extra", "keys"]
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary()]

    def run(batches):
        lean_worker()
        part, made, packer = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        ids, texts, extra, size = [], [], [], 0

        def out():
            row = [f"{part}-{made}", np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids]).tobytes()]
            row += [np.array([len(t) for t in texts], "<i8").tobytes(), packer.compress(b"".join(texts)), json.dumps(extra) if carry else None]
            row.append(b"".join(hashlib.md5(t, usedforsecurity=False).digest() for t in texts) if keys else None)
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append((batch.column(1)[i].as_py() or "").encode())
                size += len(texts[-1])
                if carry:
                    extra.append(batch.column(2)[i].as_py())
                if size >= block_bytes or len(ids) >= 200_000:
                    yield out()
                    made, ids, texts, extra, size = made + 1, [], [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([carry] if carry else []))
    return rows.mapInArrow(run, "block string, ids binary, present binary, lengths binary, texts binary, extra string, keys binary")


def unpacked(row) -> tuple:
    """ids, present, starts (one more than documents) and the bytes of a block of packed_texts."""
    import numpy as np
    import zstandard

    lengths = np.frombuffer(row.lengths, "<i8")
    starts = np.concatenate([[0], np.cumsum(lengths)])
    data = zstandard.ZstdDecompressor().decompress(row.texts, max_output_size=int(starts[-1])) if starts[-1] else b""
    return np.frombuffer(row.ids, "<i8"), np.frombuffer(row.present, "?"), starts, data


def by_bucket(hashes, buckets: int):
    """The order that puts 64-bit hashes of one bucket together (and sorts them), and where each bucket starts in it."""
    import numpy as np

    order = np.argsort(hashes, kind="stable")
    bounds = (np.arange(1, buckets, dtype="u8") * np.uint64(2**64 // buckets)).astype("u8")
    return order, np.concatenate([[0], np.searchsorted(hashes[order], bounds), [len(hashes)]])
