"""Link faults over a table of messages: pauses and blocks stop a message, then drops lose it, then delays shift it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "from_node string, to_node string, start_ts long, end_ts long, kind string, amount double"


def isolation(node: str, peers: list[str], start: int, end: int) -> list[tuple]:
    """Rules that block a node from its peers both ways."""
    return [(a, b, start, end, "block", 0.0) for p in peers if p != node for a, b in ((node, p), (p, node))]


def delivered(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """messages(id, from_node, to_node, ts, draw) -> id, outcome (blocked, dropped, sent), arrives.

    rules: RULES, a rule in force for start_ts <= ts < end_ts; a pause names its node in from_node and stops both
    ways; amount is a drop rate (kept to 0..1) or a delay. draw: the message's random number in [0, 1).
    """
    m, r = messages.alias("m"), rules.alias("r")
    now = "m.ts >= r.start_ts AND m.ts < r.end_ts"
    link = m.join(r, F.expr(f"m.from_node = r.from_node AND m.to_node = r.to_node AND r.kind <> 'pause' AND {now}"))
    paused = [m.join(r, F.expr(f"m.{side} = r.from_node AND r.kind = 'pause' AND {now}")) for side in ("from_node", "to_node")]
    pick = lambda x: x.select(F.col("m.id").alias("id"), F.col("r.kind").alias("kind"), F.col("r.amount").alias("amount"))
    hits = pick(link).unionByName(pick(paused[0])).unionByName(pick(paused[1]))
    amount = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("amount")))
    by = hits.groupBy("id").agg(F.max(F.col("kind").isin("pause", "block")).alias("stopped"), F.least(F.greatest(amount("drop"), F.lit(0.0)), F.lit(1.0)).alias("rate"), amount("delay").alias("delay"))
    rows = messages.join(by, "id", "left")
    outcome = F.when(F.coalesce("stopped", F.lit(False)), "blocked").when(F.col("draw") < F.coalesce("rate", F.lit(0.0)), "dropped").otherwise("sent")
    return rows.withColumn("outcome", outcome).select("id", "outcome", F.when(F.col("outcome") == "sent", F.col("ts") + F.greatest(F.coalesce("delay", F.lit(0.0)), F.lit(0.0)).cast("long")).alias("arrives"))
