"""All queries of the log, storage, replication and measurement operators, each beside the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.codec import command_bytes, decode_any, decode_command, encode_command, legacy_command
from .operators import commands, faults, linearize, measure, mvcc, replog, report, storage, workload
from .sources.oplog import SQL, operations, writes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PROBES = ["bench:00000001", "bench:00000007", "bench:00000042", "bench:99999999"]
LOWER, UPPER = "bench:00000003", "bench:00000050"
ASKED = ", ".join(f"('{p}')" for p in PROBES)
#: CTEs over o: entries, newest versions, live rows, applied commands.
ENTRIES = SQL + ", e AS (SELECT key, CASE WHEN op = 'set' THEN value END AS value, idx AS seq, CASE WHEN op = 'set' THEN 'put' ELSE 'delete' END AS kind, file_num FROM o WHERE op <> 'get')"
NEWEST = ENTRIES + ", n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM e) WHERE rn = 1), live AS (SELECT key, value, seq FROM n WHERE kind = 'put')"
APPLIED = SQL + """, m AS (SELECT * FROM o WHERE op <> 'get'),
  r AS (SELECT *, row_number() OVER (PARTITION BY client_id, request_id ORDER BY idx) AS rn, min(idx) OVER (PARTITION BY client_id, request_id) AS first_idx FROM m),
  a AS (SELECT *, op = 'set' OR coalesce(lag(op) OVER (PARTITION BY key ORDER BY idx) = 'set', false) AS found FROM r WHERE rn = 1)"""
META = ENTRIES + """, meta AS (SELECT file_num, CASE WHEN file_num % 4 = 0 THEN 1 ELSE 0 END AS level, min(key) AS smallest, max(key) AS largest,
  min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS rows, CAST(sum(17 + octet_length(encode(key)) + octet_length(encode(coalesce(value, '')))) AS BIGINT) AS size FROM e GROUP BY file_num)"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def entries_of(spark: SparkSession, d: str) -> DataFrame:
    return writes(operations(spark, d))


def last_index(log: DataFrame, column: str = "idx") -> int:
    return log.agg(F.max(column)).first()[0] or 0


def level() -> Column:
    return F.when(F.col("file_num") % 4 == 0, 1).otherwise(0)


def meta_of(spark: SparkSession, d: str) -> DataFrame:
    return storage.table_meta(entries_of(spark, d), level())


# ---- versioned reads


@query(f"WITH {NEWEST} SELECT key, value, seq FROM live")
def kv_snapshot(spark, d):
    return mvcc.snapshot(entries_of(spark, d)).orderBy("key")


@query(f"WITH {ENTRIES}, h AS (SELECT * FROM e WHERE seq <= (SELECT max(idx) // 2 FROM o)), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM h) SELECT key, value, seq FROM n WHERE rn = 1 AND kind = 'put'")
def kv_snapshot_asof(spark, d):
    log = operations(spark, d)
    return mvcc.snapshot(writes(log), at=last_index(log) // 2)


@query(f"WITH {NEWEST} SELECT p.key, l.value, l.key IS NOT NULL AS found FROM (VALUES {ASKED}) p(key) LEFT JOIN live l USING (key)")
def kv_point_get(spark, d):
    return mvcc.get(entries_of(spark, d), PROBES)


@query(f"WITH {NEWEST} SELECT key, value, seq FROM live WHERE key >= '{LOWER}' AND key < '{UPPER}'")
def kv_range_scan(spark, d):
    return mvcc.snapshot(entries_of(spark, d), lower=LOWER, upper=UPPER).orderBy("key")


@query(f"WITH {NEWEST} SELECT p.target, (SELECT min(key) FROM live WHERE key >= p.target) AS key FROM (VALUES {ASKED}) p(target)")
def kv_seek(spark, d):
    return mvcc.seek(entries_of(spark, d), PROBES)


@query(f"WITH {NEWEST} SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM live")
def kv_iterator_next(spark, d):
    return mvcc.following(entries_of(spark, d))


@query(f"WITH {ENTRIES} SELECT key, seq, kind, CAST(row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS INTEGER) AS age, row_number() OVER (PARTITION BY key ORDER BY seq DESC) > 1 AS hidden FROM e")
def kv_version_chain(spark, d):
    return mvcc.versions(entries_of(spark, d))


@query(f"WITH {NEWEST} SELECT key, seq FROM n WHERE kind = 'delete'")
def kv_tombstones(spark, d):
    return mvcc.tombstones(entries_of(spark, d))


@query(f"WITH {NEWEST} SELECT key, value, seq FROM live")
def kv_tier_merge(spark, d):
    e = entries_of(spark, d)
    tiers = [e.where(F.col("file_num") % 3 == i) for i in range(3)]
    return mvcc.merged(*tiers)


@query(f"WITH {ENTRIES}, b AS (SELECT * FROM e WHERE seq <= (SELECT max(idx) // 3 FROM o)), l AS (SELECT * FROM e WHERE seq > (SELECT max(seq) FROM b)), u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM (SELECT * FROM b UNION ALL SELECT * FROM l)) SELECT key, value, seq FROM u WHERE rn = 1 AND kind = 'put'")
def kv_recovery(spark, d):
    """A base of flushed entries, and the log entries after its last sequence."""
    log = operations(spark, d)
    e = writes(log)
    base = mvcc.newest(e, at=last_index(log) // 3)
    return mvcc.merged(base, e.where(F.col("seq") > last_index(base, "seq")).select(*base.columns))


# ---- state machine


def mutations(spark: SparkSession, d: str) -> DataFrame:
    return operations(spark, d).where("op <> 'get'")


@query(f"WITH {APPLIED} SELECT idx, op, key, client_id, request_id FROM r WHERE rn = 1")
def sm_dedup_apply(spark, d):
    return commands.applied(mutations(spark, d)).select("idx", "op", "key", "client_id", "request_id")


@query(f"WITH {APPLIED} SELECT idx, key, found FROM a WHERE op = 'delete'")
def sm_delete_found(spark, d):
    return commands.with_found(commands.applied(mutations(spark, d))).where("op = 'delete'").select("idx", "key", "found")


@query(f"WITH {APPLIED} SELECT r.idx, a.found, r.rn = 1 AS applied, '' AS error FROM r JOIN a ON r.first_idx = a.idx")
def sm_results(spark, d):
    return commands.results(mutations(spark, d))


@query(f"WITH {APPLIED} SELECT client_id, max(request_id) AS last_request_id, count(DISTINCT request_id) AS n_results FROM m GROUP BY client_id")
def sm_sessions(spark, d):
    return commands.sessions(mutations(spark, d))


@query(f"WITH {SQL}, m AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY key ORDER BY idx) = 'set', false) AS found FROM o WHERE op <> 'get') SELECT file_num, CAST(sum(CASE WHEN found THEN 1 ELSE 0 END) AS BIGINT) AS deleted, count(*) AS requested FROM m WHERE op = 'delete' GROUP BY file_num")
def sm_delete_count(spark, d):
    return commands.deleted(mutations(spark, d), "file_num")


@query(f"WITH {APPLIED}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS k FROM r WHERE rn = 1) SELECT key, value FROM s WHERE k = 1 AND op = 'set'")
def sm_state(spark, d):
    return commands.state(mutations(spark, d))


@query(f"WITH {APPLIED}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS k FROM r WHERE rn = 1) SELECT 'entry' AS part, key AS id, '{{\"key\":\"' || key || '\",\"value\":\"' || base64(encode(value)) || '\"}}' AS json FROM s WHERE k = 1 AND op = 'set' UNION ALL SELECT 'session', client_id, '{{\"client_id\":\"' || client_id || '\",\"last_request_id\":' || max(request_id) || ',\"results\":[' || string_agg('{{\"request_id\":' || request_id || ',\"result\":{{\"Found\":' || CASE WHEN found THEN 'true' ELSE 'false' END || ',\"Error\":\"\"}}}}', ',' ORDER BY request_id) || ']}}' FROM a GROUP BY client_id")
def sm_snapshot_lines(spark, d):
    return commands.snapshot_lines(mutations(spark, d))


@query(f"WITH {APPLIED}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS k FROM r WHERE rn = 1) SELECT key, value FROM s WHERE k = 1 AND op = 'set'")
def sm_snapshot_restore(spark, d):
    """Entries written to snapshot lines and read back."""
    lines = commands.snapshot_lines(mutations(spark, d)).where("part = 'entry'")
    entry = F.from_json("json", commands.ENTRY)
    return lines.select(entry["key"].alias("key"), F.unbase64(entry["value"]).cast("string").alias("value"))


_RESULT = """'"' || request_id || '":{"Value":null,"Found":' || CASE WHEN found THEN 'true' ELSE 'false' END || ',"Error":""}'"""


@query(f"""WITH {APPLIED}, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS k FROM r WHERE rn = 1)
  SELECT 1 AS namespace, key AS id, value FROM s WHERE k = 1 AND op = 'set' UNION ALL
  SELECT 2, client_id, '{{"LastRequestID":' || max(request_id) || ',"Results":{{' || string_agg({_RESULT}, ',' ORDER BY CAST(request_id AS VARCHAR)) || '}}}}' FROM a GROUP BY client_id""")
def lsm_store_rows(spark, d):
    return commands.store_rows(mutations(spark, d))


@query(f"WITH {APPLIED} SELECT client_id, max(request_id) OVER (PARTITION BY client_id) AS last_request_id, request_id, found, '' AS error FROM a")
def lsm_sessions(spark, d):
    """Sessions read back from the rows of the store."""
    return commands.loaded_sessions(commands.store_rows(mutations(spark, d)))


# ---- storage


@query(f"WITH {APPLIED} SELECT idx, CAST(sum(1 + CASE WHEN found THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS BIGINT) AS last_seq FROM a")
def lsm_engine_seq(spark, d):
    return commands.engine_sequence(mutations(spark, d))


@query(f"WITH {META} SELECT file_num, CAST(level AS INTEGER) AS level, smallest, largest, min_seq, max_seq, rows, size FROM meta")
def lsm_table_meta(spark, d):
    return meta_of(spark, d)


@query(f"WITH {META} SELECT p.key, CAST(row_number() OVER (PARTITION BY p.key ORDER BY level, CASE WHEN level = 0 THEN file_num END DESC, max_seq DESC, file_num DESC) AS INTEGER) AS probe, CAST(level AS INTEGER) AS level, file_num FROM (VALUES {ASKED}) p(key) JOIN meta ON p.key BETWEEN smallest AND largest")
def lsm_files_for_key(spark, d):
    return storage.probes(meta_of(spark, d), PROBES)


@query(f"WITH {META}, s AS (SELECT min(smallest) AS lo, max(largest) AS hi, count(*) AS k FROM meta WHERE level = 0), i AS (SELECT file_num FROM meta, s WHERE k >= 4 AND (level = 0 OR (smallest <= hi AND largest >= lo))), c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM e WHERE file_num IN (SELECT file_num FROM i)) SELECT key, value, seq FROM c WHERE rn = 1 AND kind = 'put'")
def lsm_compaction_l0_l1(spark, d):
    return storage.compacted(entries_of(spark, d), meta_of(spark, d))


@query(f"WITH {META} SELECT count(*) >= 4 AS due, count(*) AS files FROM meta WHERE level = 0")
def lsm_compaction_due(spark, d):
    return meta_of(spark, d).where("level = 0").agg((F.count(F.lit(1)) >= 4).alias("due"), F.count(F.lit(1)).alias("files"))


@query(f"WITH {META} SELECT file_num, smallest, largest FROM meta WHERE smallest < '{UPPER}' AND largest >= '{LOWER}'")
def lsm_zone_prune(spark, d):
    return storage.in_range(meta_of(spark, d), LOWER, UPPER).select("file_num", "smallest", "largest")


@query(f"WITH {ENTRIES}, s AS (SELECT 1 + (seq - 1) // 700 AS segment, max(seq) AS max_seq, count(*) AS rows FROM e GROUP BY 1) SELECT segment, max_seq, rows FROM s WHERE segment <> (SELECT max(segment) FROM s) AND max_seq <= (SELECT max(seq) // 2 FROM e)")
def lsm_wal_purge(spark, d):
    e = entries_of(spark, d)
    return storage.purgeable(e.withColumn("segment", F.expr("(seq - 1) div 700") + 1), "segment", last_index(e, "seq") // 2)


@query(f"WITH {NEWEST}, b AS (SELECT key, octet_length(encode(key)) + octet_length(encode(coalesce(value, ''))) AS kv FROM e), t AS (SELECT CAST(sum(kv + 24) AS BIGINT) AS memory_bytes, CAST(sum(kv + 17) AS BIGINT) AS file_bytes, CAST(sum(kv + 38) AS BIGINT) AS log_bytes FROM b), v AS (SELECT CAST(sum(octet_length(encode(key)) + octet_length(encode(value)) + 17) AS BIGINT) AS live_bytes FROM live) SELECT *, file_bytes * 1000 // live_bytes AS amplification_permille FROM t, v")
def lsm_space(spark, d):
    return storage.space(entries_of(spark, d))


@query(f"WITH {META} SELECT file_num, CAST(level AS INTEGER) AS level, smallest, largest, (SELECT max(file_num) + 1 FROM meta) AS next_file_num, (SELECT max(max_seq) FROM meta) AS last_seq FROM meta WHERE file_num % 5 <> 0")
def lsm_version_state(spark, d):
    meta = meta_of(spark, d)
    return storage.version_state(meta, meta.where("file_num % 5 = 0")).select("file_num", "level", "smallest", "largest", "next_file_num", "last_seq")


@query(f"WITH {ENTRIES} SELECT key, seq, kind FROM e ORDER BY key, seq DESC")
def lsm_sorted_entries(spark, d):
    return entries_of(spark, d).select("key", "seq", "kind").orderBy("key", F.col("seq").desc())


@query(f"""WITH RECURSIVE {ENTRIES}, z AS (SELECT file_num, seq, 38 + octet_length(encode(key)) + octet_length(encode(coalesce(value, ''))) AS size, row_number() OVER (PARTITION BY file_num ORDER BY seq) AS rn FROM e),
  w AS (SELECT file_num, seq, rn, size AS used, CAST(0 AS BIGINT) AS segment FROM z WHERE rn = 1 UNION ALL
    SELECT z.file_num, z.seq, z.rn, CASE WHEN w.used + z.size > 8192 THEN z.size ELSE w.used + z.size END, w.segment + CASE WHEN w.used + z.size > 8192 THEN 1 ELSE 0 END FROM w JOIN z ON z.file_num = w.file_num AND z.rn = w.rn + 1)
  SELECT file_num, seq, segment FROM w""")
def lsm_log_segments(spark, d):
    """Log segments of at most 8 KiB within each flush unit, from sums that start anew.

    A simulation by unit, as the SQL has it: a log goes on in its segment over a flush, and its numbers run through.
    """
    size = storage.data_bytes() + 38
    return storage.segments(entries_of(spark, d), "file_num", "seq", size, 8192)


_WORD = "18446744073709551616::UHUGEINT"
_BYTES = "list_transform(regexp_extract_all(hex(encode(key)), '..'), lambda x: CAST('0x' || x AS UHUGEINT))"
_FIRST = f"list_reduce({_BYTES}, lambda h, b: (xor(h, b) * {storage.FNV_PRIME}::UHUGEINT) % {_WORD}, {storage.FNV_OFFSET}::UHUGEINT)"
_SECOND = "h"
for _factor in (storage.FINAL_1, storage.FINAL_2):
    _SECOND = f"((xor({_SECOND}, {_SECOND} // 8589934592::UHUGEINT) * {_factor}::UHUGEINT) % {_WORD})"
_SECOND = f"xor({_SECOND}, {_SECOND} // 8589934592::UHUGEINT)"
_BITS, _HASHES = storage.filter_shape(1024)


@query(f"""WITH {ENTRIES}, k AS (SELECT DISTINCT file_num, key FROM e), a(key) AS (VALUES {ASKED}), h AS (SELECT key, {_FIRST} AS h FROM (SELECT key FROM k UNION SELECT key FROM a)),
  b AS (SELECT key, ((h + i::UHUGEINT * CASE WHEN s = 0 THEN {storage.NOT_ZERO}::UHUGEINT ELSE s END) % {_WORD}) % {_BITS} AS bit FROM (SELECT key, h, {_SECOND} AS s FROM h), range({_HASHES}) r(i)),
  f AS (SELECT DISTINCT file_num, bit FROM k JOIN b USING (key)), t AS (SELECT f.file_num, a.key, count(*) AS n FROM a JOIN b USING (key) JOIN f USING (bit) GROUP BY ALL)
  SELECT g.file_num, a.key, coalesce(t.n = {_HASHES}, false) AS may_contain, k.key IS NOT NULL AS contains FROM (SELECT DISTINCT file_num FROM k) g CROSS JOIN a LEFT JOIN t ON t.file_num = g.file_num AND t.key = a.key LEFT JOIN k ON k.file_num = g.file_num AND k.key = a.key""")
def lsm_filter_probes(spark, d):
    """Bit-exact membership filters: for each file and asked key, whether its filter lets the key through."""
    import pandas as pd

    def probe(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [k.encode() for k in rows["key"].unique()]
        built = storage.built_filter(keys, 1024)
        hit = storage.may_contain(built, [p.encode() for p in PROBES], storage.filter_shape(1024)[1])
        return pd.DataFrame({"file_num": rows["file_num"].iloc[0], "key": PROBES, "may_contain": hit, "contains": [p.encode() in keys for p in PROBES]})

    keys = entries_of(spark, d).select("file_num", "key").distinct()
    return keys.groupBy("file_num").applyInPandas(probe, "file_num long, key string, may_contain boolean, contains boolean")


@query()
def lsm_cache_hits(spark, d):
    """A two-queue cache over all of each node's reads in order, counted by flush unit."""
    reads = operations(spark, d).where("op = 'get'").withColumn("unit", F.concat_ws("/", "node", F.col("file_num").cast("string")))
    return storage.cache_hits(reads, "node", "unit", "idx", "key", 16)


# ---- replicated log

LOG_SQL = SQL + """, recs AS (SELECT idx AS rec, idx - idx % 5 + CASE WHEN op = 'delete' THEN 1 ELSE 0 END AS cut FROM o),
  ents AS (SELECT rec, "index", term FROM (SELECT idx AS rec, unnest([idx - idx % 5, idx - idx % 5 + 1]) AS "index", term FROM o WHERE op <> 'delete'))"""


@query(f"WITH {LOG_SQL}, w AS (SELECT rec, min(cut) OVER (ORDER BY rec ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM recs) SELECT e.\"index\", e.term, e.rec FROM ents e JOIN w USING (rec) WHERE w.nxt IS NULL OR e.\"index\" < w.nxt")
def raft_log_survival(spark, d):
    """Each operation is an append of two entries (a delete truncates) that overwrites some of the last ones."""
    log = operations(spark, d).withColumn("at", F.col("idx") - F.col("idx") % 5)
    records = log.select(F.col("idx").alias("rec"), (F.col("at") + F.when(F.col("op") == "delete", 1).otherwise(0)).alias("cut"))
    entries = log.where("op <> 'delete'").select(F.col("idx").alias("rec"), F.explode(F.array("at", F.col("at") + 1)).alias("index"), "term")
    return replog.surviving(records, entries)


def log_of(spark: SparkSession, d: str) -> DataFrame:
    return operations(spark, d).select(F.col("idx").alias("index"), "term", F.col("value").alias("data"))


@query(f"WITH {SQL}, t AS (SELECT term, node, max(idx) AS match FROM o GROUP BY ALL), q AS (SELECT term, list_sort(list(match)) AS ms, count(*) AS n FROM t GROUP BY term), c AS (SELECT term, ms[n - (n // 2 + 1) + 1] AS candidate FROM q) SELECT c.term, c.candidate, o.term AS term_at, coalesce(o.term = c.term, false) AS committed FROM c LEFT JOIN o ON o.idx = c.candidate")
def raft_quorum_commit(spark, d):
    log = operations(spark, d)
    matches = log.groupBy("term", "node").agg(F.max("idx").alias("match"))
    return replog.commits(matches, log_of(spark, d))


@query(f"WITH {SQL}, l AS (SELECT max(idx) AS last FROM o), p AS (SELECT CAST(prev AS BIGINT) AS prev FROM (VALUES (1), (3), (700), (2500), (99999999)) p(prev)), f AS (SELECT term, min(idx) AS first FROM o GROUP BY term) SELECT p.prev, CASE WHEN p.prev > last THEN last + 1 ELSE f.first END AS hint_index, CASE WHEN p.prev > last THEN 0 ELSE o.term END AS hint_term FROM p CROSS JOIN l LEFT JOIN o ON o.idx = p.prev LEFT JOIN f ON f.term = o.term")
def raft_conflict_hint(spark, d):
    return replog.conflict_hints(log_of(spark, d), [1, 3, 700, 2500, 99_999_999])


@query(f"WITH {SQL} SELECT term, min(idx) AS first, max(idx) AS last, count(*) AS n FROM o GROUP BY term")
def raft_term_runs(spark, d):
    return replog.term_runs(log_of(spark, d))


@query(f"WITH {SQL} SELECT idx AS \"index\", term, CASE WHEN idx > 500 THEN value END AS data FROM o WHERE idx >= 500")
def raft_truncate_prefix(spark, d):
    return replog.without_prefix(log_of(spark, d), 500)


@query(f"WITH {SQL} SELECT idx AS \"index\", term FROM o WHERE idx >= 100 AND idx < 164")
def raft_entries_range(spark, d):
    return replog.entries_between(log_of(spark, d), 100, 164).select("index", "term")


@query(f"WITH {SQL}, x AS (SELECT idx AS \"index\", CASE WHEN idx >= 750 THEN term + 1 ELSE term END AS term, value AS data FROM o WHERE idx BETWEEN 600 AND 900) SELECT idx AS \"index\", term, value AS data FROM o WHERE idx < 750 UNION ALL SELECT * FROM x WHERE \"index\" >= 750")
def raft_follower_append(spark, d):
    log = log_of(spark, d)
    incoming = log.where("index BETWEEN 600 AND 900").withColumn("term", F.when(F.col("index") >= 750, F.col("term") + 1).otherwise(F.col("term")))
    return replog.appended(log, incoming)


@query(f"WITH {SQL}, r AS (SELECT peer, CAST(nxt AS BIGINT) AS nxt, CAST(ci AS BIGINT) AS ci, CAST(ct AS BIGINT) AS ct FROM (VALUES ('a', 900, 500, 1), ('b', 900, 300, 77), ('c', 900, 0, 0), ('d', 1, 1, 0), ('e', 50, 800, 0)) r(peer, nxt, ci, ct)), t AS (SELECT term, max(idx) AS last FROM o GROUP BY term), c AS (SELECT peer, nxt, greatest(1, CASE WHEN ct <> 0 AND last IS NOT NULL THEN last + 1 WHEN ci > 0 THEN ci ELSE nxt - 1 END) AS w FROM r LEFT JOIN t ON t.term = r.ct) SELECT peer, CASE WHEN nxt <= 1 THEN nxt WHEN w >= nxt THEN greatest(nxt - 1, 1) ELSE w END AS next_index FROM c")
def raft_next_index(spark, d):
    replies = spark.createDataFrame([("a", 900, 500, 1), ("b", 900, 300, 77), ("c", 900, 0, 0), ("d", 1, 1, 0), ("e", 50, 800, 0)], "peer string, next long, conflict_index long, conflict_term long")
    return replog.next_index(log_of(spark, d), replies)


@query(f"WITH {SQL}, l AS (SELECT node, max(term) AS term, max(idx) AS idx FROM o GROUP BY node) SELECT a.node AS candidate, b.node AS voter, a.term > b.term OR (a.term = b.term AND a.idx >= b.idx) AS grants FROM l a CROSS JOIN l b")
def raft_up_to_date(spark, d):
    last = operations(spark, d).groupBy("node").agg(F.max("term").alias("term"), F.max("idx").alias("idx"))
    own = last.withColumnsRenamed({"node": "voter", "term": "own_term", "idx": "own_idx"})
    return last.crossJoin(own).select(F.col("node").alias("candidate"), "voter", replog.up_to_date(F.col("term"), F.col("idx"), F.col("own_term"), F.col("own_idx")).alias("grants"))  # members of one group


def numbered(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"attempt long, {columns}")


SNAPSHOTS = [(0, 0), (300, 1), (500, 1), (600, 1), (600, 9), (999_999_999, 1)]
RECEIVED = [(0, 0, "s"), (550, 1, "s"), (600, 1, "s"), (600, 2, "s"), (600, 1, "t"), (700, 1, "u"), (999_999_999, 77, "v")]
KEPT_SQL = SQL + ", l AS (SELECT idx, term FROM o WHERE idx >= 500), b AS (SELECT min(idx) AS lo, max(idx) AS hi FROM l)"


@query(f"WITH {KEPT_SQL} SELECT CAST(a AS BIGINT) AS attempt, CASE WHEN f < lo THEN 'compacted' WHEN f > hi + 1 THEN 'conflict' ELSE '' END AS error FROM b, (VALUES (0, 100), (1, 499), (2, 500), (3, 750), (4, 999999999)) v(a, f)")
def raft_append_errors(spark, d):
    """Appends to a log that begins at 500."""
    return replog.append_errors(replog.without_prefix(log_of(spark, d), 500), numbered(spark, [(100,), (499,), (500,), (750,), (999_999_999,)], "first long"))


@query(f"WITH {KEPT_SQL}, v AS (SELECT * FROM (VALUES {', '.join(str((i, *s)) for i, s in enumerate(SNAPSHOTS))}) v(a, i, t)), x AS (SELECT v.*, lo, hi, CASE WHEN i = 0 THEN 'invalid' WHEN i < lo THEN 'compacted' WHEN i > hi THEN 'not found' WHEN term <> t THEN 'conflict' ELSE '' END AS error FROM v CROSS JOIN b LEFT JOIN l ON l.idx = i) SELECT CAST(a AS BIGINT) AS attempt, error, CAST(CASE WHEN error = '' THEN i ELSE lo END AS BIGINT) AS \"offset\", hi - CASE WHEN error = '' THEN i ELSE lo END + 1 AS kept FROM x")
def raft_save_snapshot(spark, d):
    return replog.saved_snapshots(replog.without_prefix(log_of(spark, d), 500), numbered(spark, SNAPSHOTS, "index long, term long"))


@query(f"WITH {KEPT_SQL}, x AS (SELECT *, CASE WHEN i = 0 THEN 'invalid' WHEN i < 600 THEN 'compacted' WHEN i = 600 AND t = 1 AND s = 's' THEN 'unchanged' WHEN i = 600 THEN 'conflict' ELSE 'replaced' END AS outcome FROM b, (VALUES {', '.join(str((i, *s)) for i, s in enumerate(RECEIVED))}) v(a, i, t, s)) SELECT CAST(a AS BIGINT) AS attempt, outcome, CAST(CASE WHEN outcome = 'replaced' THEN i ELSE lo END AS BIGINT) AS \"offset\", CASE WHEN outcome = 'replaced' THEN 1 ELSE hi - lo + 1 END AS kept FROM x")
def raft_apply_snapshot(spark, d):
    return replog.applied_snapshots(replog.without_prefix(log_of(spark, d), 500), numbered(spark, RECEIVED, "index long, term long, data string"), (600, 1, "s"))


@query(f"WITH {SQL} SELECT idx AS \"index\", CASE WHEN idx % 50 = 0 THEN 'proposal mismatch' ELSE '' END AS error FROM o")
def raft_proposal_mismatch(spark, d):
    log = log_of(spark, d)
    proposals = log.select("index", F.when(F.col("index") % 50 == 0, F.concat("data", F.lit("!"))).otherwise(F.col("data")).alias("data"))
    return replog.proposal_errors(proposals, log)


VARINT = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"


@query(f"WITH {SQL}, b AS (SELECT idx, octet_length(encode(key)) AS kb, octet_length(encode(value)) AS vb, octet_length(encode(client_id)) AS cb, request_id FROM o WHERE op <> 'get') SELECT idx, CAST(6 + {VARINT.format('kb')} + kb + {VARINT.format('vb')} + vb + {VARINT.format('cb')} + cb + {VARINT.format('request_id')} AS BIGINT) AS size FROM b")
def raft_cmd_size(spark, d):
    m = mutations(spark, d)
    return m.select("idx", command_bytes(F.col("key"), F.col("value"), F.col("client_id"), F.col("request_id")).cast("long").alias("size"))


@query(f"WITH {SQL} SELECT idx, op, key, value, client_id, request_id FROM o WHERE op <> 'get'")
def raft_cmd_codec(spark, d):
    """Commands encoded to bytes and decoded again."""
    coded = mutations(spark, d).select("idx", encode_command("op", "key", "value", "client_id", "request_id").alias("payload"))
    back = coded.select("idx", decode_command("payload").alias("c"))
    text = lambda n: F.col(f"c.{n}").cast("string").alias(n)
    return back.select("idx", F.when(F.col("c.type") == 1, "set").otherwise("delete").alias("op"), text("key"), text("value"), "c.client_id", "c.request_id")


@query(f"WITH {SQL} SELECT idx, CASE WHEN idx % 7 = 0 THEN 'unsupported command version: 2' ELSE '' END AS error, CASE WHEN idx % 7 > 0 THEN CASE op WHEN 'set' THEN 1 ELSE 2 END END AS type, CASE WHEN idx % 7 > 0 THEN key END AS key, CASE WHEN idx % 7 > 0 THEN value END AS value, CASE WHEN idx % 7 > 0 THEN client_id END AS client_id, CASE WHEN idx % 7 > 0 THEN request_id END AS request_id FROM o WHERE op <> 'get'")
def raft_legacy_command(spark, d):
    """Commands in the binary and in the older JSON form, some of them of a version that nobody reads, decoded again."""
    m, parts = mutations(spark, d), ("op", "key", "value", "client_id", "request_id")
    old = legacy_command(*map(F.col, parts)).cast("string")
    old = F.when(F.col("idx") % 7 == 0, F.replace(old, F.lit('"version":1'), F.lit('"version":2'))).otherwise(old)
    binary = (F.col("idx") % 2 == 0) & (F.col("idx") % 7 > 0)
    coded = m.select("idx", F.when(binary, encode_command(*parts)).otherwise(old.cast("binary")).alias("payload"))
    back = coded.select("idx", decode_any(F.col("payload")).alias("c"))
    text = lambda n: F.col(f"c.{n}").cast("string").alias(n)
    return back.select("idx", "c.error", "c.type", text("key"), text("value"), "c.client_id", "c.request_id")


@query(f"WITH {SQL} SELECT idx // 64 AS batch, CAST(66 + 5 + count(*) * 21 + sum(octet_length(encode(value))) AS BIGINT) AS bytes FROM o GROUP BY 1")
def raft_frame_bytes(spark, d):
    """Bytes of append requests of at most 64 entries."""
    batch = operations(spark, d).groupBy(F.expr("idx div 64").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("data"))
    return batch.select("batch", replog.append_frame_bytes(F.lit("node1"), F.col("data"), F.col("n")).cast("long").alias("bytes"))


# ---- measurement

CLASS = "CASE WHEN err = '' THEN '' WHEN lower(err) LIKE '%not leader%' THEN 'not_leader' WHEN err LIKE '%deadline exceeded%' THEN 'deadline_exceeded' WHEN trim(err) = '' THEN 'unknown' ELSE trim(err) END"
READS = SQL + ", x AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'get' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'delete') = 'set' AS found FROM o)"
SUMMARY = "count(*) AS total, count(*) FILTER (err = '') AS success, count(*) FILTER (err <> '') AS errors, count(*) FILTER (err = '' AND op = 'get' AND found) AS found, count(*) FILTER (err = '' AND op = 'get' AND NOT found) AS missing, count(*) FILTER (err = '') / 10.0::DOUBLE AS success_qps, count(*) / 10.0::DOUBLE AS attempted_qps"
RANKED = SQL + ", t AS (SELECT op, CAST(round(latency_ms * 1000000) AS BIGINT) AS ns FROM o), l AS (SELECT op, list_sort(list(ns)) AS a, count(*) AS n, CAST(sum(ns) AS BIGINT) // count(*) AS avg_ns, max(ns) AS max_ns FROM t GROUP BY op)"
RANK = ", ".join(f"a[CAST(floor({p}::DOUBLE * (n - 1) + 0.5::DOUBLE) AS BIGINT) + 1] AS p{name}_ns" for p, name in ((0.5, 50), (0.95, 95), (0.99, 99)))


def observed(spark: SparkSession, d: str) -> DataFrame:
    """Operations with found: whether the key was there before, as a read sees it."""
    write = F.when(F.col("op") != "get", F.col("op"))
    before = F.last(write, True).over(Window.partitionBy("key").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return operations(spark, d).withColumn("found", F.coalesce(before == "set", F.lit(False)))


@query(f"WITH {READS} SELECT op, {SUMMARY} FROM x GROUP BY op")
def bench_op_summary(spark, d):
    return measure.operation_summary(observed(spark, d), 10.0, "op")


@query(f"WITH {READS} SELECT coalesce(op, 'all') AS op, {SUMMARY} FROM x GROUP BY ROLLUP (op)")
def bench_totals(spark, d):
    """By operation and in total, from one pass: the totals add up the operations' rows."""
    by = measure.operation_summary(observed(spark, d), 10.0, "op")
    total = by.agg(F.lit("all").alias("op"), *[F.sum(c).alias(c) for c in ("total", "success", "errors", "found", "missing")])
    rate = lambda c: F.col(c) / F.lit(10.0)
    return by.unionByName(total.withColumn("success_qps", rate("success")).withColumn("attempted_qps", rate("total")))


@query(f"WITH {RANKED} SELECT op, n, {RANK}, avg_ns, max_ns FROM l")
def bench_latency(spark, d):
    return measure.latencies(operations(spark, d), "op")


@query(f"WITH {SQL} SELECT op, {CLASS} AS error, count(*) AS n FROM o WHERE err <> '' GROUP BY ALL")
def bench_error_classes(spark, d):
    return operations(spark, d).where("err <> ''").groupBy("op", measure.error_class(F.col("err")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL} SELECT node, op, CASE WHEN err = '' THEN 'ok' ELSE 'error' END AS status, le, count(*) FILTER (CAST(round(latency_ms * 1000000) AS BIGINT) <= bound) AS count, count(*) AS n, CAST(sum(CAST(round(latency_ms * 1000000) AS BIGINT)) AS BIGINT) AS sum_ns, max(CAST(round(latency_ms * 1000000) AS BIGINT)) AS max_ns FROM o CROSS JOIN (VALUES " + ", ".join(f"('{b}', {b * 1_000_000})" for b in measure.BOUNDS_MS) + ", ('+Inf', 9000000000000000000)) b(le, bound) GROUP BY ALL")
def obs_histogram(spark, d):
    rows = operations(spark, d).withColumn("status", F.when(F.col("err") == "", "ok").otherwise("error"))
    return measure.histogram(rows, ["node", "op", "status"], measure.nanos(F.col("latency_ms")))


@query(f"WITH {SQL}, s AS (SELECT node, idx, op = 'set' AS leader FROM o), e AS (SELECT node, leader AND NOT coalesce(lag(leader) OVER (PARTITION BY node ORDER BY idx), false) AS edge FROM s) SELECT node, count(*) FILTER (edge) AS changes FROM e GROUP BY node")
def obs_leader_edges(spark, d):
    return measure.rising_edges(operations(spark, d), "node", "idx", F.col("op") == "set")


@query(f"WITH {SQL} SELECT node, arg_max(term, idx) AS term, arg_max(key, idx) AS key, max(idx) AS idx FROM o GROUP BY node")
def obs_last_gauge(spark, d):
    return measure.last_values(operations(spark, d), "node", "idx", "term", "key", "idx")


HALVES = SQL + ", s AS (SELECT idx <= (SELECT max(idx) // 2 FROM o) AS base, op AS label, count(*) FILTER (err = '') / 10.0::DOUBLE AS success_qps, count(*) FILTER (err <> '') AS errors, list_sort(list(CAST(round(latency_ms * 1000000) AS BIGINT))) AS a, count(*) AS n FROM o GROUP BY ALL), q AS (SELECT *, a[CAST(floor(0.99::DOUBLE * (n - 1) + 0.5::DOUBLE) AS BIGINT) + 1] / 1000000.0::DOUBLE AS p99_ms FROM s)"


@query(f"WITH {HALVES}, r AS (SELECT c.label, CASE WHEN b.success_qps > c.success_qps THEN (b.success_qps - c.success_qps) / b.success_qps * 100 ELSE 0 END AS qps_drop, CASE WHEN c.p99_ms > b.p99_ms AND b.p99_ms > 0 THEN (c.p99_ms - b.p99_ms) / b.p99_ms * 100 ELSE 0 END AS p99_rise, c.errors AS ce, b.errors AS be FROM q c JOIN q b USING (label) WHERE b.base AND NOT c.base), v AS (SELECT *, CASE WHEN qps_drop > 20 THEN 'qps' WHEN p99_rise > 20 THEN 'p99' WHEN ce > be THEN 'errors' ELSE '' END AS reason FROM r) SELECT label, CAST(qps_drop AS DOUBLE) AS qps_drop, CAST(p99_rise AS DOUBLE) AS p99_rise, CASE WHEN reason = '' THEN 'OK' ELSE 'REGRESSION' END AS status, reason FROM v")
def regress_compare(spark, d):
    """The second half of the operations against the first, by operation."""
    log = operations(spark, d)
    half = last_index(log) // 2

    def side(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("found", F.lit(False))
        qps = measure.operation_summary(rows, 10.0, "op").select(F.col("op").alias("label"), "success_qps", "errors")
        p99 = measure.latencies(rows, "op").select(F.col("op").alias("label"), (F.col("p99_ns") / F.lit(1_000_000.0)).alias("p99_ms"))
        return qps.join(p99, "label")

    return measure.compared(side(log.where(F.col("idx") <= half)), side(log.where(F.col("idx") > half)))


# ---- workload, faults, linearizability, reports


@query("SELECT i AS seq, CASE WHEN i % 100 < 70 THEN 'get' ELSE 'set' END AS op, 'bench:key:' || (i % 1024) AS key, CASE WHEN i % 100 >= 70 THEN substr(repeat('abcdefghijklmnopqrstuvwxyz', 3), 1, 64) END AS value FROM range(20000) t(i)")
def workload_sequential(spark, d):
    return workload.requests(spark, 20_000, 1024, 64, mix=(70, 30, 0))


@query("""WITH w AS (SELECT k, pow(1.0::DOUBLE + k, -1.2::DOUBLE) AS w FROM range(256) t(k)), c AS (SELECT k, sum(w) OVER (ORDER BY k) / sum(w) OVER () AS upper FROM w),
  b AS (SELECT k, coalesce(lag(upper) OVER (ORDER BY k), 0) AS lower, upper FROM c), u AS (SELECT CAST('0x' || substr(md5('5:' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM range(100000) t(i))
  SELECT 'bench:key:' || k AS key, count(*) AS n FROM u JOIN b ON u >= lower AND u < upper GROUP BY k""")
def workload_zipfian(spark, d):
    """How often each key is asked for."""
    rows = workload.requests(spark, 100_000, 256, 64, "zipfian", (70, 30, 0), seed=5)
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL}, h AS (SELECT idx AS id, CASE WHEN node = 'node1' AND idx BETWEEN 100 AND 199 OR idx BETWEEN 50 AND 119 AND node = 'node2' THEN 'blocked' WHEN node = 'node3' AND idx BETWEEN 0 AND 999 AND (idx % 10) / 10.0 < 0.3 THEN 'dropped' ELSE 'sent' END AS outcome, node, idx FROM o) SELECT id, outcome, CASE WHEN outcome = 'sent' THEN idx + CASE WHEN node = 'node2' AND idx BETWEEN 200 AND 299 THEN 7 ELSE 0 END END AS arrives FROM h")
def fault_timeline(spark, d):
    """Messages from each node to node0 under a block, a pause, a drop rate and a delay."""
    messages = operations(spark, d).select(F.col("idx").alias("id"), F.col("node").alias("from_node"), F.lit("node0").alias("to_node"), F.col("idx").alias("ts"), (F.col("idx") % 10 / 10).alias("draw"))
    rules = [("node1", "node0", 100, 200, "block", 0.0), ("node2", "", 50, 120, "pause", 0.0), ("node3", "node0", 0, 1000, "drop", 0.3), ("node2", "node0", 200, 300, "delay", 7.0)]
    return faults.delivered(messages, spark.createDataFrame(rules, faults.RULES))


HISTORY = SQL + """, y AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN {'op': op, 'value': value} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM o),
  h AS (SELECT key, op, value, idx, coalesce(seen.op = 'set', false) AND idx % 97 <> 0 AS out_found, CASE WHEN coalesce(seen.op = 'set', false) AND idx % 97 <> 0 THEN seen.value END AS out_value FROM y WHERE err = ''),
  w AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN {'op': op, 'value': value} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM h),
  v AS (SELECT key, count(*) AS n, count(*) FILTER (op = 'get' AND (out_found <> coalesce(last.op = 'set', false) OR (coalesce(last.op = 'set', false) AND out_value IS DISTINCT FROM last.value))) AS wrong_reads FROM w GROUP BY key)"""


def history(spark: SparkSession, d: str) -> DataFrame:
    """The operations as a history: one after another, each seeing the state before it; every 97th read is stale."""
    seen = F.last(F.when(F.col("op") != "get", F.struct("op", "value")), True).over(Window.partitionBy("key").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    rows = observed(spark, d).withColumn("_s", seen).withColumn("_stale", F.col("idx") % 97 == 0)
    found = F.coalesce(F.col("_s.op") == "set", F.lit(False))
    return rows.select(F.lit(1).alias("client_id"), F.col("op").alias("type"), "key", "value", (F.col("idx") * 10).alias("call_ns"), (F.col("idx") * 10 + 5).alias("return_ns"), F.when(found & ~F.col("_stale"), F.col("_s.value")).alias("out_value"), (found & ~F.col("_stale")).alias("out_found"), "err", "idx")


@query(f"WITH {HISTORY} SELECT key, n, CAST(0 AS BIGINT) AS overlapping, wrong_reads FROM v")
def lin_sequential_check(spark, d):
    return linearize.sequential(history(spark, d))


@query(f"WITH {HISTORY} SELECT key, CASE WHEN wrong_reads > 0 THEN 'illegal' ELSE 'ok' END AS verdict, n FROM v")
def lin_check(spark, d):
    """Verdict for each key's whole history."""
    return linearize.check(history(spark, d))


@query(f"WITH {RANKED}, s AS (SELECT op, count(*) FILTER (err = '') / 10.0::DOUBLE AS q, count(*) FILTER (err <> '') AS x FROM o GROUP BY op), u AS (SELECT op, {RANK} FROM l) SELECT '2' || op AS line_key, printf('| %s | mixed | leader | 32 | 256 | %.2f | %d | %.3f | %.3f | node1 | %s |', op, q, x, p95_ns / 1000000.0::DOUBLE, p99_ns / 1000000.0::DOUBLE, op || '/result.json') AS line FROM s JOIN u USING (op) UNION ALL VALUES ('0', '{report.HEAD}'), ('1', '{report.RULE}')")
def report_markdown(spark, d):
    log = operations(spark, d).withColumn("found", F.lit(False))
    rates = measure.operation_summary(log, 10.0, "op").join(measure.latencies(log, "op"), "op")
    ms = lambda c: (F.col(c) / F.lit(1_000_000.0)).alias
    rows = rates.select(F.col("op").alias("label"), F.lit("mixed").alias("mode"), F.lit("leader").alias("routing"), F.lit(32).alias("concurrency"), F.lit(256).alias("value_bytes"), "success_qps", "errors", ms("p95_ns")("p95_ms"), ms("p99_ns")("p99_ms"), F.lit("node1").alias("leader"), F.concat("op", F.lit("/result.json")).alias("result"))
    return report.result_table(rows)


@query(f"WITH {SQL} SELECT printf('kv_operations_total{{node=\"%s\",operation=\"%s\",status=\"%s\"}} %.6f', node, op, CASE WHEN err = '' THEN 'ok' ELSE 'error' END, count(*)::DOUBLE) AS line FROM o GROUP BY node, op, CASE WHEN err = '' THEN 'ok' ELSE 'error' END")
def prom_counters(spark, d):
    rows = operations(spark, d).withColumn("status", F.when(F.col("err") == "", "ok").otherwise("error")).groupBy("node", "op", "status").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(report.metric_line("kv_operations_total", {"node": F.col("node"), "operation": F.col("op"), "status": F.col("status")}, F.col("n")).alias("line"))


def _line(suffix: str, value: str, le: bool = False) -> str:
    head, first = ('le="%s",', "le, ") if le else ("", "")
    return f"""printf('kv_operation_duration_ms{suffix}{{{head}node="%s",operation="%s",status="%s"}} %.6f', {first}node, op, status, {value}) AS line"""


@query(f"WITH b AS ({ORACLES['obs_histogram']}), w AS (SELECT DISTINCT node, op, status, n, sum_ns FROM b) SELECT {_line('_bucket', 'count::DOUBLE', le=True)} FROM b UNION ALL SELECT {_line('_sum', 'sum_ns / 1000000.0::DOUBLE')} FROM w UNION ALL SELECT {_line('_count', 'n::DOUBLE')} FROM w")
def prom_histogram(spark, d):
    return report.histogram_lines(obs_histogram(spark, d).withColumnRenamed("op", "operation"), "kv_operation_duration_ms", ["node", "operation", "status"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
