"""Small literal cases: visibility, sessions, log algebra, percentiles, verdicts and searches."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import catalogue
from tidemark.functions import codec
from tidemark.operators import commands, faults, linearize, measure, mvcc, ordered, replog, report, storage, workload
from tidemark.plans.store import LogStore

ENTRY = "key string, value string, seq long, kind string"
COMMAND = "idx long, op string, key string, value string, client_id string, request_id long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_visibility(spark):
    e = spark.createDataFrame([("a", "v1", 1, "put"), ("a", "v3", 3, "put"), ("a", None, 4, "delete"), ("b", "", 2, "put")], ENTRY)
    assert rows(mvcc.snapshot(e, at=2)) == [("a", "v1", 1), ("b", "", 2)]
    assert rows(mvcc.snapshot(e, at=3)) == [("a", "v3", 3), ("b", "", 2)]
    assert rows(mvcc.snapshot(e)) == [("b", "", 2)]
    assert rows(mvcc.get(e, ["a", "b", "z"])) == [("a", None, False), ("b", "", True), ("z", None, False)]


def test_bounds_and_seek(spark):
    e = spark.createDataFrame([("a", "1", 1, "put"), ("b", "2", 2, "put"), ("b", "3", 3, "put"), ("c", "4", 4, "put")], ENTRY)
    assert rows(mvcc.snapshot(e, at=3, lower="b", upper="d")) == [("b", "3", 3)]
    assert rows(mvcc.seek(e, ["", "aa", "c", "d"])) == [("", "a"), ("aa", "b"), ("c", "c"), ("d", None)]


def test_merge_does_not_depend_on_the_split(spark):
    rng = random.Random(1)
    data = [(f"k{rng.randint(0, 9)}", str(i), i, rng.choice(["put", "put", "delete"])) for i in range(120)]
    whole = spark.createDataFrame(data, ENTRY)
    want = rows(mvcc.snapshot(whole))
    rng.shuffle(data)
    assert rows(mvcc.merged(spark.createDataFrame(data[:50], ENTRY), spark.createDataFrame(data[50:], ENTRY))) == want
    base = mvcc.newest(whole, at=60)
    assert rows(mvcc.merged(base, whole.where("seq > 60").select(*base.columns))) == want


def fold(log):
    state, sessions, out = {}, {}, []
    for idx, op, key, value, client, request in log:
        own = (client, request) if client and request > 0 else None
        if own in sessions:
            out.append((idx, sessions[own], False))
            continue
        found = op == "set" or (op == "delete" and key in state)
        if op == "set":
            state[key] = value
        elif op == "delete":
            state.pop(key, None)
        if own:
            sessions[own] = found
        out.append((idx, found, True))
    return state, sessions, out


def test_state_machine_against_a_fold(spark):
    rng = random.Random(2)
    log = [(i, rng.choice(["set", "set", "delete", "odd"]), f"k{rng.randint(0, 5)}", f"v{i}", rng.choice(["", "c1", "c2"]), rng.randint(0, 40)) for i in range(1, 250)]
    df = spark.createDataFrame(log, COMMAND)
    state, sessions, out = fold(log)
    assert {r.key: r.value for r in commands.state(df).collect()} == state
    assert sorted((r.idx, r.found, r.applied) for r in commands.results(df).collect()) == out
    assert {r.client_id: r.n_results for r in commands.sessions(df).collect()} == {c: sum(k[0] == c for k in sessions) for c in ("c1", "c2")}


def test_snapshot_documents(spark):
    log = [(1, "set", "a", "x", "c", 1), (2, "set", "b", "", "c", 2), (3, "delete", "a", None, "d", 5)]
    doc = commands.snapshot_document(commands.snapshot_lines(spark.createDataFrame(log, COMMAND)))
    assert [r.problem for r in commands.snapshot_problems(doc).collect()] == [None]
    bad = ["", "{", '{"version":3}', '{"version":2,"entries":[{"key":"a","value":""},{"key":"a","value":""}]}', '{"version":2,"sessions":[{"client_id":"","results":[]}]}', '{"version":2,"sessions":[{"client_id":"c","results":[{"request_id":0}]}]}', '{"version":1,"entries":[]}']
    got = {r.document: r.problem for r in commands.snapshot_problems(spark.createDataFrame([(b,) for b in bad], "document string")).collect()}
    assert [got[b] for b in bad] == ["empty snapshot", "invalid JSON", "unsupported version", "duplicate key", "empty client id", "request id 0", None]


@pytest.mark.parametrize("width", [3, 1000])
def test_ordered_sums(spark, width):
    values = [5, -1, 3, 8, 2, 2, 9, 0]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    got = dict(rows(ordered.running_sum(df, "i", F.col("v"), "s", width).select("i", "s")))
    assert got == {i: sum(values[: i + 1]) for i in range(8)}
    later = dict(rows(ordered.later_minimum(df, "i", F.col("v"), "m", width).select("i", "m")))
    assert later == {i: min(values[i + 1 :], default=None) for i in range(8)}


def test_log_survival_against_a_list(spark):
    rng = random.Random(3)
    log, records, entries = [], [], []
    for rec in range(60):
        if log and rng.random() < 0.3:
            keep = rng.randint(0, len(log))
            records.append((rec, keep + 1))
            del log[keep:]
        else:
            first = rng.randint(max(1, len(log) - 2), len(log) + 1)
            del log[first - 1 :]
            for i in range(rng.randint(1, 3)):
                entries.append((rec, first + i, rec))
                log.append(rec)
            records.append((rec, first))
    got = replog.surviving(spark.createDataFrame(records, "rec long, cut long"), spark.createDataFrame(entries, "rec long, index long, term long"))
    assert [r[1] for r in sorted((r.index, r.term) for r in got.collect())] == log


def test_hints_quorum_and_append(spark):
    log = spark.createDataFrame([(i + 1, t, "d") for i, t in enumerate([1, 2, 2, 2, 3])], "index long, term long, data string")
    assert rows(replog.conflict_hints(log, [4, 9])) == [(4, 2, 2), (9, 6, 0)]
    assert rows(replog.conflict_hints(log.where("index >= 3"), [1], compacted=3)) == [(1, 4, 0)]
    three = spark.createDataFrame([(3, n, m) for n, m in (("a", 5), ("b", 1), ("c", 3))], "term long, node string, match long")
    assert rows(replog.commits(three, log)) == [(3, 3, 2, False)]
    new = spark.createDataFrame([(3, 2, "d"), (4, 4, "n"), (5, 4, "n")], "index long, term long, data string")
    assert [(i, t) for i, t, _ in rows(replog.appended(log, new))] == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 4)]
    assert rows(replog.appended(log, log)) == rows(log)


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_nearest_rank(spark, width):
    rng = random.Random(width)
    data = {"a": [rng.randint(0, 50) for _ in range(101)], "b": [4, 9], "c": [7]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "g string, v long")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    for r in measure.nearest_ranks(df, ["g"], "v", shares, width).collect():
        values = sorted(data[r.g])
        assert [r[n] for n in shares] == [values[int(p * (len(values) - 1) + 0.5)] for p in shares.values()]


def test_errors_edges_verdicts(spark):
    e = spark.createDataFrame([("",), (" Not Leader x",), ("context deadline exceeded",), ("  ",), (" boom ",)], "err string")
    assert [r[0] for r in e.select(measure.error_class(F.col("err"))).collect()] == ["", "not_leader", "deadline_exceeded", "unknown", "boom"]
    s = spark.createDataFrame([("n", i, x) for i, x in enumerate([True, True, False, True])], "node string, ts long, leader boolean")
    assert rows(measure.rising_edges(s, "node", "ts", F.col("leader"))) == [("n", 2)]
    side = lambda q, x, p: spark.createDataFrame([("case", q, x, p)], "label string, success_qps double, errors long, p99_ms double")
    assert rows(measure.compared(side(100.0, 0, 10.0), side(100.0, 0, 13.0)))[0][3:] == ("REGRESSION", "p99")
    assert rows(measure.compared(side(100.0, 0, 10.0), side(90.0, 0, 11.0)))[0][3:] == ("OK", "")
    assert rows(measure.compared(side(100.0, 0, 10.0), side(70.0, 3, 20.0)))[0][3:] == ("REGRESSION", "qps")
    assert rows(measure.compared(side(100.0, 0, 10.0), side(100.0, 1, 10.0)))[0][3:] == ("REGRESSION", "errors")
    assert spark.range(1).select(measure.method_name(F.lit("/a.b/Get"))).first()[0] == "Get"


def test_codec(spark):
    data = codec.encoded(1, b"k" * 200, b"", b"client", 300)
    assert codec.decoded(data) == (1, b"k" * 200, b"", b"client", 300)
    for broken in (data[:-1], data + b"x", b"nope", data[:4] + b"\x07" + data[5:]):
        with pytest.raises(ValueError):
            codec.decoded(broken)
    size = spark.range(1).select(codec.command_bytes(F.lit("k" * 200), F.lit(""), F.lit("client"), F.lit(300))).first()[0]
    assert size == len(data)


def test_segments_filter_cache(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate([4, 4, 4, 10, 1])], "g string, i long, n long")
    assert [r[2] for r in rows(storage.segments(df, "g", "i", F.col("n"), 9))] == [0, 0, 1, 2, 3]
    assert [r[2] for r in rows(storage.segments(df, "g", "i", F.col("n"), 8, before=False))] == [0, 0, 1, 1, 2]
    keys = [f"key{i}".encode() for i in range(500)]
    built, (_, hashes) = storage.built_filter(keys, 1024), storage.filter_shape(1024)
    assert hashes == 6 and len(built) == 10240 and storage.may_contain(built, keys, hashes).all()
    assert storage.may_contain(built, [f"other{i}".encode() for i in range(1000)], hashes).mean() < 0.02
    cache = storage.TwoQueues(4)
    assert [cache.hit(k) for k in "abacdefab"] == [False, False, True, False, False, False, False, True, False]


def test_registered_cache_carries_over(spark):
    d = "/root/testdata/sf0.001"
    caches, want = {}, {}
    for r in catalogue.operations(spark, d).where("op = 'get'").orderBy("idx").collect():
        hit = caches.setdefault(r.node, storage.TwoQueues(16)).hit(r.key)
        hits, misses = want.get(f"{r.node}/{r.file_num}", (0, 0))
        want[f"{r.node}/{r.file_num}"] = (hits + hit, misses + (not hit))
    got = catalogue.queries()["lsm_cache_hits"](spark, d).collect()
    assert len(got) == len(want) > len(caches) and {r.unit: (r.hits, r.misses) for r in got} == want


def test_workload(spark):
    got = rows(workload.requests(spark, 3, 2, 3, prefix="k:"))
    assert got == [(0, "set", "k:0", "abc"), (1, "set", "k:1", "abc"), (2, "set", "k:0", "abc")]
    with pytest.raises(ValueError):
        workload.requests(spark, 1, 1, 1, mix=(50, 60, 0))
    zipf = {r.key: r["count"] for r in workload.requests(spark, 20_000, 50, 1, "zipfian", prefix="").groupBy("key").count().collect()}
    assert zipf["0"] > zipf["1"] > zipf["10"] and set(map(int, zipf)) <= set(range(50))


def test_zipf_law(spark):
    """Shares of the draws are those of (1 + k) ** -1.2, at every number of cells."""
    rows_ = spark.range(40_000).select("id", workload.unit(3, F.col("id")).alias("u"))
    for keyspace, cells in ((1, 4096), (7, 2), (256, 64)):
        got = {r.k: r["count"] / 40_000 for r in workload.zipf_numbers(rows_, "u", "k", keyspace, cells=cells).groupBy("k").count().collect()}
        weights = [(1 + k) ** -1.2 for k in range(keyspace)]
        assert abs(sum(got.values()) - 1) < 1e-9
        assert all(abs(got.get(k, 0) - w / sum(weights)) < 0.01 for k, w in enumerate(weights))


def test_unknown_commands_and_store_rows(spark):
    c = spark.createDataFrame([(1, "set", "a", "1", "c1", 1), (2, "move", "a", None, "c1", 2), (3, "delete", "zz", None, "c1", 10), (4, "set", "b", "2", "", 0), (5, "delete", "a", None, "c1", 1)], "idx long, op string, key string, value string, client_id string, request_id long")
    stored = commands.store_rows(c)
    assert {(r.namespace, r.id): r.value for r in stored.collect()} == {
        (1, "a"): "1",
        (1, "b"): "2",
        (2, "c1"): '{"LastRequestID":10,"Results":{"1":{"Value":null,"Found":true,"Error":""},"10":{"Value":null,"Found":false,"Error":""},"2":{"Value":null,"Found":false,"Error":"unknown command type: move"}}}',
    }
    assert sorted(tuple(r) for r in commands.loaded_sessions(stored).collect()) == [("c1", 10, 1, True, ""), ("c1", 10, 2, False, "unknown command type: move"), ("c1", 10, 10, False, "")]
    line = commands.snapshot_lines(c).where("part = 'session'").first().json
    assert '"Error":"unknown command type: move"' in line


def test_following_across_prefixes(spark):
    keys = ["", "a", "ab", "abc", "abd", "b", "ba", "é", "éa", "z"]
    e = spark.createDataFrame([(k, "v", i + 1, "put") for i, k in enumerate(keys)] + [("b", None, 99, "delete")], "key string, value string, seq long, kind string")
    live = sorted((k for k in keys if k != "b"), key=str.encode)
    for prefix in (1, 2, 12):
        assert {r.key: r.next_key for r in mvcc.following(e, prefix=prefix).collect()} == dict(zip(live, [*live[1:], None]))


def test_commands_of_either_form(spark):
    rows_ = [('{"version":1,"command":{"Type":1,"Key":"k","Value":"dg==","ClientID":"c","RequestID":3}}',), ('{"version":3,"command":{}}',), ("nonsense",), (None,)]
    got = spark.createDataFrame(rows_, "j string").select(codec.decode_any(F.col("j").cast("binary")).alias("c")).select("c.*").collect()
    assert (got[0].type, bytes(got[0].key), bytes(got[0].value), got[0].client_id, got[0].request_id, got[0].error) == (1, b"k", b"v", "c", 3, "")
    assert [(r.type, r.error) for r in got[1:]] == [(None, "unsupported command version: 3"), (None, "invalid JSON"), (None, "invalid JSON")]


HISTORY = "client_id int, type string, key string, value string, call_ns long, return_ns long, out_value string, out_found boolean, err string"


def test_linearizability(spark):
    def verdict(*ops):
        return linearize.worst(linearize.check(spark.createDataFrame([(1, *o) for o in ops], HISTORY))).first()[0]

    put = ("set", "a", "1", 0, 1, None, None, "")
    assert verdict(put, ("get", "a", None, 2, 3, "1", True, "")) == "ok"
    assert verdict(put, ("get", "a", None, 2, 3, "2", True, "")) == "illegal"
    assert verdict(put, ("get", "a", None, 0, 3, None, False, "")) == "ok"  # overlaps: may come first
    assert verdict(put, ("delete", "a", None, 2, 3, None, False, ""), ("get", "a", None, 4, 5, None, False, "")) == "ok"
    assert linearize.check(spark.createDataFrame([(1, *put[:-1], "failed")], HISTORY)).count() == 0
    assert linearize.search([("set", str(i), 0, 100, "", False) for i in range(16)] + [("get", "", 101, 102, "x", True)], 0.0) == "unknown"


def brute_verdict(ops):
    """ok if some order of all operations, in which none comes after one that it returned before, is legal for a register."""

    def possible(left, register):
        if not left:
            return True
        for i, (kind, value, call, _, out, found) in enumerate(left):
            if any(other[3] < call for other in left):
                continue
            if kind == "get" and (out if found else None) != register:
                continue
            if possible(left[:i] + left[i + 1 :], {"set": value, "delete": None}.get(kind, register)):
                return True
        return False

    return "ok" if possible(ops, None) else "illegal"


def test_linearizability_against_brute_force(spark):
    rng, kept = random.Random(3), {}
    for k in range(150):
        ops, now = [], 0
        for _ in range(rng.randint(1, 7)):
            now += rng.randint(1, 5)
            kind, found = rng.choice(["set", "get", "get", "delete"]), rng.random() < 0.7
            ops.append((kind, rng.choice("xy"), now, now + rng.randint(0, 4 if k % 2 else 0), rng.choice("xy") if found else "", found))
        kept[f"k{k}"] = ops
    sent = [(1, t, key, v, c, r, o, f, "") for key, ops in kept.items() for t, v, c, r, o, f in ops]
    got = {r.key: (r.verdict, r.n) for r in linearize.check(spark.createDataFrame(sent, HISTORY)).collect()}
    assert got == {key: (brute_verdict(ops), len(ops)) for key, ops in kept.items()}
    assert len(set(got.values())) > 8


def test_registered_linearizability(spark):
    d = "/root/testdata/sf0.001"
    kept = {}
    for r in catalogue.history(spark, d).where("err = ''").orderBy("idx").collect():
        kept.setdefault(r.key, []).append(r)

    def replay(ops):
        register = None
        for r in ops:
            if r.type == "get" and (r.out_value if r.out_found else None) != register:
                return "illegal"
            register = {"set": r.value, "delete": None}.get(r.type, register)
        return "ok"

    assert {r.key: r.verdict for r in catalogue.queries()["lin_check"](spark, d).collect()} == {key: replay(ops) for key, ops in kept.items()}


def test_faults(spark):
    m = spark.createDataFrame([(i, "a", "b", i * 10, 0.5) for i in range(6)], "id long, from_node string, to_node string, ts long, draw double")
    rules = [("a", "b", 0, 10, "block", 0.0), ("b", "", 10, 20, "pause", 0.0), ("a", "b", 20, 30, "drop", 2.0), ("a", "b", 30, 40, "delay", 5.0), ("a", "b", 40, 50, "drop", 0.4)]
    got = rows(faults.delivered(m, spark.createDataFrame(rules, faults.RULES)))
    assert got == [(0, "blocked", None), (1, "blocked", None), (2, "dropped", None), (3, "sent", 35), (4, "sent", 40), (5, "sent", 50)]
    assert faults.isolation("a", ["a", "b"], 0, 1) == [("a", "b", 0, 1, "block", 0.0), ("b", "a", 0, 1, "block", 0.0)]


def test_report_escapes(spark):
    line = spark.range(1).select(report.metric_line("m", {"b": F.lit('x"\\'), "a": F.lit("y\nz")}, F.lit(2))).first()[0]
    assert line == 'm{a="y\\nz",b="x\\"\\\\"} 2.000000'
    table = spark.createDataFrame([("a|b", "get", "leader", 1, 2, 3.0, 4, 5.0, 6.0, "n", "r")], "label string, mode string, routing string, concurrency int, value_bytes int, success_qps double, errors long, p95_ms double, p99_ms double, leader string, result string")
    assert "| a\\|b | get | leader | 1 | 2 | 3.00 | 4 | 5.000 | 6.000 | n | r |" in [r.line for r in report.result_table(table).collect()]


def test_store_against_a_dict(spark, tmp_path):
    store, model, rng = LogStore(spark, str(tmp_path / "log")), {}, random.Random(5)
    assert store.last() == 0 and store.write([]) == 0
    for i in range(12):
        key = f"k{rng.randint(0, 4)}"
        if i % 4 == 3:
            assert store.delete(key, key) == (key in model)
            model.pop(key, None)
        else:
            store.set(key, f"v{i}")
            model[key] = f"v{i}"
        if i == 5:
            at, then = store.last(), dict(model)
    assert {r.key: r.value for r in store.scan().collect()} == model
    assert {r.key: r.value for r in store.scan(at=at).collect()} == then
    with pytest.raises(ValueError):
        store.set("", "x")
