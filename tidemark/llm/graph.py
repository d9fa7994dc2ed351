"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def components(edges: DataFrame) -> DataFrame:
    """id and comp, the smallest id that can be reached, for every id in edges(a, b).

    Each round takes the smallest label among neighbours and then that label's own label (pointer jumping), so the
    rounds grow with the logarithm of the longest shortest path. Labels are written each round.
    """
    both = written(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("comp")))
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "to"}), "to").groupBy("id").agg(F.min("comp").alias("_near"))
        low = labels.join(near, "id").select("id", F.col("comp").alias("_old"), F.least("comp", "_near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("_jump"))
        new = written(low.join(jump, "comp", "left").select("id", "_old", F.least("comp", F.coalesce("_jump", "comp")).alias("comp")))
        moved = new.where("comp < _old").limit(1).count()
        labels = new.select("id", "comp")
        if not moved:
            return labels
