"""Algebra of a replicated log: overwritten suffixes, compacted prefixes, quorum commit, conflict hints, terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import later_minimum


def surviving(records: DataFrame, entries: DataFrame) -> DataFrame:
    """The log after all records. records: (rec, cut), entries: (rec, index, term).

    cut is the first index of an append, or i + 1 of a suffix truncation at i: an entry lives if its index is below
    the cut of every later record.
    """
    cuts = later_minimum(records.select("rec", "cut"), "rec", F.col("cut"), "next_cut").select("rec", "next_cut")
    return entries.join(cuts, "rec").where("next_cut IS NULL OR index < next_cut").select("index", "term", "rec")


def without_prefix(log: DataFrame, upto: int) -> DataFrame:
    """Entries from `upto` on; that one stays as a marker without data."""
    return log.where(F.col("index") >= upto).withColumn("data", F.when(F.col("index") > upto, F.col("data")))


#: What a log refuses, by name.
COMPACTED, CONFLICT, NOT_FOUND, INVALID = "compacted", "conflict", "not found", "invalid"


def bounds(log: DataFrame) -> DataFrame:
    """_offset and _last, the first and last index of a log: one row."""
    return log.agg(F.min("index").alias("_offset"), F.max("index").alias("_last"))


def append_errors(log: DataFrame, attempts: DataFrame) -> DataFrame:
    """attempt, error of appends that begin at `first`: before the log it is compacted, beyond its end a gap."""
    rows = attempts.crossJoin(F.broadcast(bounds(log)))  # one row
    error = F.when(F.col("first") < F.col("_offset"), COMPACTED).when(F.col("first") > F.col("_last") + 1, CONFLICT).otherwise("")
    return rows.select("attempt", error.alias("error"))


def saved_snapshots(log: DataFrame, attempts: DataFrame) -> DataFrame:
    """attempt, error, offset, kept of snapshots (attempt, index, term) of one's own log, each tried on the log as it is.

    A snapshot must lie in the log and have the term of its entry there; the log then begins at its index.
    """
    at = log.select("index", F.col("term").alias("_term"))
    rows = attempts.join(at, "index", "left").crossJoin(F.broadcast(bounds(log)))  # one row
    i = F.col("index")
    error = F.when(i == 0, INVALID).when(i < F.col("_offset"), COMPACTED).when(i > F.col("_last"), NOT_FOUND).when(F.col("_term") != F.col("term"), CONFLICT).otherwise("")
    offset = F.when(error == "", i).otherwise(F.col("_offset"))
    return rows.select("attempt", error.alias("error"), offset.alias("offset"), (F.col("_last") - offset + 1).alias("kept"))


def applied_snapshots(log: DataFrame, attempts: DataFrame, held: tuple[int, int, str]) -> DataFrame:
    """attempt, outcome, offset, kept of a leader's snapshots (attempt, index, term, data), each tried on the log as it is.

    held: index, term and data of the snapshot in store (index 0: none). An older one is compacted, the same one changes
    nothing, another one of its index is a conflict; a newer one replaces the whole log.
    """
    i, same = F.col("index"), (F.col("term") == held[1]) & F.col("data").eqNullSafe(F.lit(held[2]))
    rows = attempts.crossJoin(F.broadcast(bounds(log)))  # one row
    outcome = F.when(i == 0, INVALID).when(i < held[0], COMPACTED).when((i == held[0]) & same, "unchanged").when(i == held[0], CONFLICT).otherwise("replaced")
    new = outcome == "replaced"
    kept = F.when(new, F.lit(1)).otherwise(F.col("_last") - F.col("_offset") + 1)
    return rows.select("attempt", outcome.alias("outcome"), F.when(new, i).otherwise(F.col("_offset")).alias("offset"), kept.cast("long").alias("kept"))


def proposal_errors(proposals: DataFrame, log: DataFrame) -> DataFrame:
    """index, error: a proposal whose index was applied with other data has been replaced by another leader's entry."""
    got = log.select("index", F.col("data").alias("_applied"))
    mismatch = ~F.col("data").eqNullSafe(F.col("_applied"))
    return proposals.join(got, "index").select("index", F.when(mismatch, "proposal mismatch").otherwise("").alias("error"))


def entries_between(log: DataFrame, start: int, end: int) -> DataFrame:
    return log.where((F.col("index") >= start) & (F.col("index") < end))


def quorum_index(matches: Column) -> Column:
    """The largest index that a majority has reached, from an array of the members' match indexes."""
    n = F.size(matches)
    return F.element_at(F.sort_array(matches), n - (F.floor(n / 2).cast("int") + 1) + 1)


def commits(matches: DataFrame, log: DataFrame, group: str = "term") -> DataFrame:
    """group, candidate, term_at, committed: a quorum index commits only entries of the leader's own term.

    matches: (group, node, match), one row for each member. group is the leader's term.
    """
    found = matches.groupBy(group).agg(quorum_index(F.collect_list("match")).alias("candidate"))
    at = log.select(F.col("index").alias("candidate"), F.col("term").alias("term_at"))
    return found.join(at, "candidate", "left").select(group, "candidate", "term_at", F.coalesce(F.col("term_at") == F.col(group), F.lit(False)).alias("committed"))


def term_runs(log: DataFrame) -> DataFrame:
    """term, first, last, n; terms never fall along a log, so a term is one run."""
    return log.groupBy("term").agg(F.min("index").alias("first"), F.max("index").alias("last"), F.count(F.lit(1)).alias("n"))


def conflict_hints(log: DataFrame, asked: list[int], compacted: int = 0) -> DataFrame:
    """prev, hint_index, hint_term for previous indexes that did not match: where the leader should go on."""
    runs = term_runs(log.where(F.col("index") >= compacted))
    last = log.agg(F.max("index").alias("_last"))
    prev = log.sparkSession.createDataFrame([(p,) for p in asked], "prev long")
    at = log.where(F.col("index").isin(*asked)).select(F.col("index").alias("prev"), "term")
    rows = prev.join(at, "prev", "left").join(runs.select("term", "first"), "term", "left").crossJoin(F.broadcast(last))  # one row
    beyond, cut = F.col("prev") > F.col("_last"), (F.lit(compacted) > 0) & (F.col("prev") < compacted)
    index = F.when(beyond, F.col("_last") + 1).when(cut, F.lit(compacted + 1)).otherwise(F.coalesce("first", F.col("_last") + 1))
    return rows.select("prev", index.cast("long").alias("hint_index"), F.when(beyond | cut, 0).otherwise(F.coalesce("term", F.lit(0))).cast("long").alias("hint_term"))


def next_index(leader: DataFrame, replies: DataFrame, least: int = 1) -> DataFrame:
    """peer, next_index after a refusal. replies: (peer, next, conflict_index, conflict_term).

    The leader goes on after its own last entry of the conflicting term, else at the hint, never forward, never below `least`.
    """
    last = leader.groupBy(F.col("term").alias("conflict_term")).agg(F.max("index").alias("_last"))
    rows = replies.join(last, "conflict_term", "left")
    hint = F.when(F.col("conflict_index") > 0, F.col("conflict_index")).otherwise(F.col("next") - 1)
    new = F.when((F.col("conflict_term") != 0) & F.col("_last").isNotNull(), F.col("_last") + 1).otherwise(hint)
    new = F.greatest(new, F.lit(least))
    new = F.when(new >= F.col("next"), F.greatest(F.col("next") - 1, F.lit(least))).otherwise(new)
    return rows.select("peer", F.when(F.col("next") <= least, F.col("next")).otherwise(new).cast("long").alias("next_index"))


def appended(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """A follower's log after an append: from the first missing or differing entry on, the incoming ones replace it."""
    mine = local.select("index", F.col("term").alias("_mine"))
    first = incoming.join(mine, "index", "left").where("_mine IS NULL OR _mine <> term").agg(F.min("index").alias("_cut"))
    cut = F.broadcast(first)  # one row
    kept = local.crossJoin(cut).where("_cut IS NULL OR index < _cut").drop("_cut")
    return kept.unionByName(incoming.crossJoin(cut).where("index >= _cut").drop("_cut").select(*local.columns))


def up_to_date(term: Column, index: Column, own_term: Column, own_index: Column) -> Column:
    """Whether a candidate's last entry is at least as new as one's own."""
    return (term > own_term) | ((term == own_term) & (index >= own_index))


# Bytes of a frame's head, of an append request without leader name and entries, and of an entry without data.
FRAME, REQUEST, ENTRY = 18, 48, 21


def append_frame_bytes(leader: Column, data_bytes: Column, n: Column) -> Column:
    return F.lit(FRAME + REQUEST) + F.octet_length(leader) + n * ENTRY + data_bytes
