"""A deterministic state machine over commands (idx, op, key, value, client_id, request_id) with exactly-once sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sum


def in_session() -> Column:
    return (F.col("client_id") != "") & (F.col("request_id") > 0)


def first_of_request(commands: DataFrame) -> DataFrame:
    """Adds first_idx, the idx whose result a command gets: the first of its (client, request), or its own."""
    first = F.min("idx").over(Window.partitionBy("client_id", "request_id"))
    return commands.withColumn("first_idx", F.when(in_session(), first).otherwise(F.col("idx")))


def applied(commands: DataFrame) -> DataFrame:
    """The commands that take effect: all without a session, and the first of each (client, request)."""
    row = F.struct(*commands.columns)
    sessions = commands.where(in_session()).groupBy("client_id", "request_id").agg(F.min_by(row, "idx").alias("_r")).select("_r.*")
    return commands.where(~in_session()).unionByName(sessions)


def with_found(commands: DataFrame) -> DataFrame:
    """Adds found: true for a put; for a delete, whether the key was there just before; false for unknown operations."""
    known = commands.where("op IN ('set', 'delete')")
    before = F.lag("op").over(Window.partitionBy("key").orderBy("idx"))
    judged = known.withColumn("found", (F.col("op") == "set") | F.coalesce(before == "set", F.lit(False)))
    odd = commands.where("op NOT IN ('set', 'delete')").withColumn("found", F.lit(False))
    return judged.unionByName(odd)


def error_of() -> Column:
    return F.when(~F.col("op").isin("set", "delete"), F.concat(F.lit("unknown command type: "), F.col("op"))).otherwise("")


def results(commands: DataFrame) -> DataFrame:
    """idx, found, applied, error of every command; a repeat gets the first's stored result."""
    done = with_found(applied(commands)).select(F.col("idx").alias("first_idx"), "found", error_of().alias("error"))
    return first_of_request(commands).join(done, "first_idx").select("idx", "found", (F.col("idx") == F.col("first_idx")).alias("applied"), "error")


def sessions(commands: DataFrame) -> DataFrame:
    """client_id, last_request_id, n_results."""
    return commands.where(in_session()).groupBy("client_id").agg(F.max("request_id").alias("last_request_id"), F.count_distinct("request_id").alias("n_results"))


def deleted(commands: DataFrame, batch: str) -> DataFrame:
    """How many of a batch's deletes hit a key that was there; a key deleted twice counts once."""
    hits = with_found(commands).where("op = 'delete'")
    return hits.groupBy(batch).agg(F.sum(F.col("found").cast("long")).alias("deleted"), F.count(F.lit(1)).alias("requested"))


def engine_sequence(commands: DataFrame) -> DataFrame:
    """idx and the engine's last sequence after it: a command writes a session row, and a data row unless it deletes nothing."""
    rows = F.when(in_session(), 1).otherwise(0) + F.when((F.col("op") == "set") | F.col("found"), 1).otherwise(0)
    return running_sum(with_found(applied(commands)), "idx", rows.cast("long"), "last_seq").select("idx", "last_seq")


def state(commands: DataFrame) -> DataFrame:
    """key and value after all commands."""
    last = applied(commands).where("op IN ('set', 'delete')").groupBy("key").agg(F.max_by(F.struct("op", "value"), "idx").alias("s"))
    return last.where("s.op = 'set'").select("key", "s.value")


# The namespaces of a store's rows in its engine.
DATA, SESSION = 1, 2


def store_rows(commands: DataFrame) -> DataFrame:
    """namespace, id, value: what a store that keeps itself in an engine has there after all commands.

    Data rows are the live keys. A session row holds its client's last request and all results as JSON, by request in
    the order of their texts.
    """
    data = state(commands).select(F.lit(DATA).alias("namespace"), F.col("key").alias("id"), "value")
    done = with_found(applied(commands)).where(in_session())
    error = F.substring_index(F.to_json(F.struct(error_of().alias("Error"))), "{", -1)
    each = F.concat(F.lit('"'), F.col("request_id"), F.lit('":{"Value":null,"Found":'), F.col("found").cast("string"), F.lit(","), error)
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col("request_id").cast("string").alias("r"), each.alias("j")))), lambda x: x["j"])
    value = F.concat(F.lit('{"LastRequestID":'), F.max("request_id"), F.lit(',"Results":{'), F.concat_ws(",", listed), F.lit("}}"))
    own = done.groupBy("client_id").agg(value.alias("value"))
    return data.unionByName(own.select(F.lit(SESSION).alias("namespace"), F.col("client_id").alias("id"), "value"))


def loaded_sessions(rows: DataFrame) -> DataFrame:
    """client_id, last_request_id, request_id, found, error: the results that session rows of store_rows hold."""
    schema = "struct<LastRequestID:bigint,Results:map<string,struct<Value:string,Found:boolean,Error:string>>>"
    s = rows.where(F.col("namespace") == SESSION).select(F.col("id").alias("client_id"), F.from_json("value", schema).alias("s"))
    each = s.select("client_id", F.col("s.LastRequestID").alias("last_request_id"), F.explode("s.Results").alias("r", "x"))
    return each.select("client_id", "last_request_id", F.col("r").cast("long").alias("request_id"), F.col("x.Found").alias("found"), F.col("x.Error").alias("error"))


# ---- the JSON document of a snapshot

ENTRY = "struct<key:string,value:string>"
RESULT = "struct<request_id:bigint,result:struct<Value:string,Found:boolean,Error:string>>"
DOCUMENT = f"struct<version:int,entries:array<{ENTRY}>,sessions:array<struct<client_id:string,last_request_id:bigint,results:array<{RESULT}>>>>"


def snapshot_lines(commands: DataFrame) -> DataFrame:
    """The pieces of a version-2 snapshot document, one JSON text for each entry and session: (part, id, json).

    The pieces are what a large snapshot is stored as; `snapshot_document` joins the pieces of a small one.
    """
    value = F.base64(F.coalesce("value", F.lit("")).cast("binary"))
    entries = state(commands).select(F.lit("entry").alias("part"), F.col("key").alias("id"), F.to_json(F.struct("key", value.alias("value"))).alias("json"))
    done = with_found(applied(commands)).where(in_session())
    result = F.struct(F.lit(None).cast("string").alias("Value"), F.col("found").alias("Found"), error_of().alias("Error"))
    listed = F.sort_array(F.collect_list(F.struct("request_id", result.alias("result"))))
    each = done.groupBy("client_id").agg(F.max("request_id").alias("last_request_id"), listed.alias("results"))
    return entries.unionByName(each.select(F.lit("session").alias("part"), F.col("client_id").alias("id"), F.to_json(F.struct("client_id", "last_request_id", "results")).alias("json")))


def snapshot_document(lines: DataFrame) -> DataFrame:
    """One row with the whole document; for snapshots that fit one task."""
    of = lambda part: F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("id", "json")))), lambda x: x["json"]))
    return lines.agg(F.concat(F.lit('{"version":2,"entries":['), of("entry"), F.lit('],"sessions":['), of("session"), F.lit("]}")).alias("document"))


def snapshot_problems(documents: DataFrame) -> DataFrame:
    """Adds problem: null for a valid document, else why it is not one."""
    d = documents.withColumn("_d", F.from_json("document", DOCUMENT))
    names = F.transform(F.coalesce("_d.entries", F.array().cast(f"array<{ENTRY}>")), lambda x: x["key"])
    clients = F.transform(F.coalesce("_d.sessions", F.array()), lambda x: x["client_id"])
    requests = F.transform(F.coalesce("_d.sessions", F.array()), lambda x: F.transform(x["results"], lambda r: r["request_id"]))
    twice = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    problem = (
        F.when(F.coalesce(F.trim("document"), F.lit("")) == "", "empty snapshot")
        .when(F.col("_d").isNull() | F.col("_d.version").isNull(), "invalid JSON")
        .when(~F.col("_d.version").isin(1, 2), "unsupported version")
        .when(twice(names), "duplicate key")
        .when(F.exists(clients, lambda x: F.coalesce(x, F.lit("")) == ""), "empty client id")
        .when(twice(clients), "duplicate client")
        .when(F.exists(requests, lambda x: F.exists(x, lambda r: r == 0)), "request id 0")
        .when(F.exists(requests, twice), "duplicate request id")
    )
    return d.withColumn("problem", problem).drop("_d")
