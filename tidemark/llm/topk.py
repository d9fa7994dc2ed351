"""Exact top-k inner products over norm-sorted, rotated tiles.

Vectors are sorted by descending length and packed into tiles. A query meets the tiles in that order and leaves
out a tile once |query| * (largest length in it) cannot reach its k-th best score so far. Within a tile, the right
singular vectors of all vectors turn the coordinates so that the first ones carry most of the product; the partial
sum over those plus |query's rest| * |vector's rest| (Cauchy-Schwarz) bounds the product from above, and only
vectors whose bound reaches the k-th best are multiplied in full, in exact integers.

Tiles are numbered groups in descending order of length, queries are packed into blocks. Every block first meets the
longest tiles (a bounded number of rows), which gives each of its queries a k-th best score, and the block the length
that a vector must have at least to reach one of them. Only groups with such vectors are sent to the block: a prefix of
the groups, found by merging two sorted lists of lengths. Each (block, group) pair is one unit of work that holds one
query block and one tile at a time: a stated query set against all rows, in blocks.

Edge cases: a null vector, or one with a null or non-finite component, takes no part; shorter vectors count as
padded with zeros; rows that share a vec_id are never each other's candidates (they are the query's own); equal
scores go to the smaller vec_id; an empty table gives no rows; further columns are ignored. Rows are not collapsed, as in
the SQL: a query's k places go to pairs of one of its rows and a candidate row, so that a repeated row takes a place
each time, and a query with several rows still has one list of k. Products are exact integers of any size; one beyond
a long is given as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: Slack of the floating-point bounds, relative to the product of the lengths.
SLACK = 1e-9


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the array of floor(scale * x), of all vectors that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    doubles = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return doubles.where(F.forall("v", fine)).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors, from their d x d second moments (summed on the executors)."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch["v"], dim)
            total += x.T @ x
        yield pd.DataFrame({"i": range(dim), "row": list(total)})

    rows = vectors.select("v").mapInPandas(moments, "i int, row array<double>")
    sums = rows.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(dim)]).toPandas()  # d rows
    gram = np.zeros((dim, dim))
    for r in sums.itertuples(index=False):
        gram[r[0]] = r[1:]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def products(whole: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of integer rows with q, as longs. largest: a bound of their size."""
    if largest < 2**52:
        return (whole.astype("f8") @ q.astype("f8")).astype("i8")
    if largest < 2**62:
        return whole @ q
    top = np.iinfo("i8").max
    return np.array([min(max(x, -top), top) for x in whole.astype(object) @ q.astype(object)], "i8")


def pruned_top(q: dict, tiles: Iterable[dict], k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """score, vec_id and whether there is one, k for each row of a query block, over tiles in descending order of length.

    Scores below a query's floor are left out.
    """
    n = len(q["ids"])
    score, who, found = np.zeros((n, k), "i8"), np.full((n, k), np.iinfo("i8").max), np.zeros((n, k), bool)
    norms, rest = np.sqrt((q["turned"] ** 2).sum(1)), np.sqrt((q["turned"][:, first:] ** 2).sum(1))
    for tile in tiles:
        least = np.maximum(np.where(found[:, -1], score[:, -1].astype("f8"), -np.inf), q["floor"])
        length = np.sqrt((tile["turned"] ** 2).sum(1))
        top = length.max()
        open_ = np.nonzero(norms * top * (1 + SLACK) + SLACK >= least)[0]
        if not len(open_):
            break
        bound = q["turned"][open_, :first] @ tile["turned"][:, :first].T
        bound += np.outer(rest[open_], np.sqrt((tile["turned"][:, first:] ** 2).sum(1))) + SLACK * np.outer(norms[open_], length) + SLACK
        near = (bound >= least[open_, None]) & (tile["ids"][None, :] != q["ids"][open_, None])
        for row in np.nonzero(near.any(1))[0]:
            i, cand = open_[row], np.nonzero(near[row])[0]
            exact = products(tile["whole"][cand], q["whole"][i], norms[i] * top * 1.01)
            s, w, f = np.concatenate([score[i], exact]), np.concatenate([who[i], tile["ids"][cand]]), np.concatenate([found[i], np.ones(len(cand), bool)])
            best = np.lexsort((w, -s, ~f))[:k]
            score[i], who[i], found[i] = s[best], w[best], f[best]
    return score, who, found


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, tile_rows: int = 2048, query_rows: int = 2048, first: int = 16, head: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score for the queries with vec_id divisible by `every`."""
    spark = vectors.sparkSession
    result = "query_id long, vec_id long, score long"
    base = written(usable(vectors))
    n, dim = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not dim:
        empty = spark.createDataFrame([], result)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    turn = rotation(base, dim)
    parts = max(1, -(-n // (8 * tile_rows)))

    def pack(some: pd.DataFrame, number: int) -> pd.DataFrame:
        v = np.zeros((len(some), dim), "<i8")
        for i, x in enumerate(some["v"]):
            v[i, : len(x)] = x
        most = float(np.sqrt((v.astype("f8") ** 2).sum(1)).max())
        return pd.DataFrame({"number": [number], "ids": [some["vec_id"].to_numpy("int64").tobytes()], "v": [zstandard.compress(v.tobytes(), 1)], "most": [most]})

    def tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held = pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch])
            while len(held) >= tile_rows:
                yield pack(held[:tile_rows], part)
                held = held[tile_rows:]
        if len(held):
            yield pack(held, part)

    def opened(row) -> dict:
        whole = np.frombuffer(zstandard.decompress(row.v), "<i8").reshape(-1, dim)
        return {"ids": np.frombuffer(row.ids, "int64"), "whole": whole, "turned": whole.astype("f8") @ turn}

    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    by_length = base.withColumn("_l", length).repartitionByRange(parts, F.col("_l").desc(), "vec_id").sortWithinPartitions(F.col("_l").desc(), "vec_id")
    packed = "number int, ids binary, v binary, most double"
    tiles = written(by_length.select("vec_id", "v").mapInPandas(tiled, packed).withColumnRenamed("number", "part"))
    longest = [opened(r) for r in tiles.orderBy(F.col("most").desc()).limit(head).toPandas().itertuples()]  # head tiles

    n_blocks = max(1, -(-n // (every * query_rows)))
    asked = base.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))

    def floored(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A query block with its queries' k-th best scores of the longest tiles, and the length that can reach one."""
        row = pack(rows, key[0])
        q = opened(next(row.itertuples())) | {"floor": np.full(len(rows), -np.inf)}
        score, _, found = pruned_top(q, longest, k, min(first, dim))
        floor = np.where(found[:, -1], score[:, -1].astype("f8"), -np.inf)
        norms = np.sqrt((q["turned"] ** 2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(norms > 0, (floor - SLACK) / (norms * (1 + SLACK)), -np.inf)
        return row.rename(columns={"number": "block"}).assign(floor=[floor.astype("<f8").tobytes()], reach=[float(reach.min())])

    blocks = written(asked.groupBy("block").applyInPandas(floored, "block int, ids binary, v binary, most double, floor binary, reach double"))
    # how many groups have vectors of at least the length a block needs: lengths of groups and blocks in one order
    lengths = tiles.groupBy("part").agg(F.max("most").alias("x")).select("x", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("block"), F.col("part").alias("last"))
    lengths = lengths.unionByName(blocks.select(F.col("reach").alias("x"), F.lit(1).alias("kind"), "block", F.lit(None).cast("int").alias("last")))
    above = F.max("last").over(Window.orderBy(F.col("x").desc(), "kind"))
    met = lengths.withColumn("last", above).where("kind = 1 AND last IS NOT NULL").select("block", F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    left = tiles.join(met, "part")
    right = blocks.drop("most", "reach").join(met, "block")

    def search(key: tuple, some: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if some.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ordered = some.sort_values("most", ascending=False)
        own = next(queries.itertuples())
        q = opened(own) | {"floor": np.frombuffer(own.floor, "<f8")}
        score, who, found = pruned_top(q, (opened(r) for r in ordered.itertuples()), k, min(first, dim))
        return pd.DataFrame({"query_id": np.repeat(q["ids"], k)[found.ravel()], "vec_id": who[found], "score": score[found]})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(search, result)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
