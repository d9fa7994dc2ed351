"""Linearizability of operation histories against a register for each key.

history: client_id, type (get, set, delete), key, value, call_ns, return_ns, out_value, out_found, err.
Failed operations are left out. Keys are independent, and a key's history is judged as a whole.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checked(history: DataFrame) -> DataFrame:
    return history.where(F.coalesce("err", F.lit("")) == "")


def sequential(history: DataFrame) -> DataFrame:
    """key, n, overlapping, wrong_reads for histories in which a key's operations don't overlap: one window each."""
    own = Window.partitionBy("key").orderBy("call_ns", "return_ns")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    write = F.when(F.col("type") == "set", F.struct(F.col("value").alias("v"), F.lit(True).alias("f"))).when(F.col("type") == "delete", F.struct(F.lit(None).cast("string").alias("v"), F.lit(False).alias("f")))
    rows = checked(history).withColumn("_w", F.last(write, True).over(before)).withColumn("_end", F.max("return_ns").over(before))
    there = F.coalesce("_w.f", F.lit(False))
    wrong = (F.col("type") == "get") & ((F.col("out_found") != there) | (there & ~F.col("out_value").eqNullSafe(F.col("_w.v"))))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), count(F.col("_end") > F.col("call_ns")).alias("overlapping"), count(wrong).alias("wrong_reads"))


def registers(ops: list[tuple], first: set[str | None], until: float) -> set[str | None] | None:
    """The registers that operations (type, value, call, return, out_value, out_found) can end in, from these; None when out of time.

    Depth-first over (set of linearized operations, register): an operation may be next if none that is left
    returned before it was called. States seen once are not tried again.
    """
    n = len(ops)
    whole, seen, last = (1 << n) - 1, set(), set()
    stack = [(0, register) for register in first]
    while stack:
        if time.monotonic() > until:
            return None
        done, register = stack.pop()
        if done == whole:
            last.add(register)
            continue
        left = [i for i in range(n) if not done >> i & 1]
        first_return = min(ops[i][3] for i in left)
        for i in left:
            kind, value, call, _, out, found = ops[i]
            if call > first_return:
                continue
            if kind == "get" and (found != (register is not None) or (found and register != out)):
                continue
            state = (done | 1 << i, value if kind == "set" else None if kind == "delete" else register)
            if state not in seen:
                seen.add(state)
                stack.append(state)
    return last


def search(ops: list[tuple], seconds: float) -> str:
    """ok, illegal or unknown (out of time) for one key's operations in order of their calls.

    The history is searched piece by piece: a piece ends where all operations so far have returned before the next call,
    and the next one starts from every register that it can end in.
    """
    until, states, piece, end = time.monotonic() + seconds, {None}, [], 0
    for op in [*ops, None]:
        if piece and (op is None or op[2] > end):
            states = registers(piece, states, until)
            if not states:
                return "unknown" if states is None else "illegal"
            piece = []
        if op is not None:
            end = max(end, op[3]) if piece else op[3]
            piece.append(op)
    return "ok"


def check(history: DataFrame, seconds: float = 5.0) -> DataFrame:
    """key, verdict, n for each key's whole history.

    Keys whose operations don't overlap are judged in a window; the others are searched (grouped map; the history of a
    key with overlapping operations must fit one task).
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["call_ns", "return_ns"])
        ops = [(r.type, r.value, r.call_ns, r.return_ns, r.out_value, bool(r.out_found)) for r in rows.itertuples()]
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "verdict": [search(ops, seconds)], "n": [len(ops)]})

    columns = ["key", "type", F.coalesce("value", F.lit("")).alias("value"), "call_ns", "return_ns", F.coalesce("out_value", F.lit("")).alias("out_value"), F.coalesce("out_found", F.lit(False)).alias("out_found")]
    ops = checked(history).select(*columns)
    # a call at the very time of a return may come first, so that it overlaps as well
    plain = sequential(ops.withColumns({"err": F.lit(""), "return_ns": F.col("return_ns") + 1}))
    simple = plain.where("overlapping = 0").select("key", F.when(F.col("wrong_reads") > 0, "illegal").otherwise("ok").alias("verdict"), "n")
    open_ = plain.where("overlapping > 0").select(F.col("key").alias("_key"))
    searched = ops.join(open_, F.col("key").eqNullSafe(F.col("_key")), "left_semi").groupBy("key").applyInPandas(run, "key string, verdict string, n long")
    return simple.unionByName(searched)


def worst(verdicts: DataFrame) -> DataFrame:
    """The verdict over all keys."""
    rank = F.max(F.when(F.col("verdict") == "illegal", 2).when(F.col("verdict") == "unknown", 1).otherwise(0))
    return verdicts.agg(F.element_at(F.array(F.lit("ok"), F.lit("unknown"), F.lit("illegal")), F.coalesce(rank, F.lit(0)) + 1).alias("verdict"))
