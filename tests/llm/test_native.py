import heapq
import random
import re
import zlib
from collections import Counter

from tidemark.llm.mixing import mix
from tidemark.llm.quality import judge
from tidemark.llm.sharding import shard_documents, taken

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark, odd_docs):
    docs = odd_docs.union(spark.createDataFrame([(70, "a b c d e f g h i a b c d e f g h x " + "q " * 15, "en", "s", 1, "")], odd_docs.schema))
    got = {r.doc_id: r for r in judge(docs, ["doc_id"]).collect()}
    for row in docs.collect():
        want = base_rules(row.text)
        r = got[row.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, row.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_rejects_divergent_and_keeps_usual(spark):
    usual = [(i, f"the quick brown fox of the north and a dog in the yard that is {i} " * 1 + " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(50)]
    odd = [(99, " ".join(f"$$${j}%%%" for j in range(80)), "en")]
    got = {r.doc_id: r.kept for r in judge(spark.createDataFrame(usual + odd, "doc_id long, text string, lang string"), ["doc_id"]).collect()}
    assert not got[99] and all(got[i] for i in range(50))


def test_pipeline_rejects_text_without_common_words(spark):
    import corpus_pipeline

    listed = "the of and to in a is that it for".split()
    usual = [(i, " ".join(listed[(i + j // 5) % 10] if j % 5 == 0 else f"w{i}x{j}" for j in range(60)), "en", "s", 1) for i in range(50)]
    plain = lambda n: " ".join(f"q{j}z" for j in range(n))
    more = [(90, plain(50), "en", "s", 1), (91, plain(49), "en", "s", 1), (92, plain(50), "xx", "s", 1)]
    more += [(93 + i, plain(50) + f" u{i}", "fr", "s", 1) for i in range(3)]  # nothing to be expected: no French text has any
    docs = spark.createDataFrame(usual + more, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert got == {r[0] for r in usual + more} - {90}


def test_quality_empty(no_docs):
    assert judge(no_docs, ["doc_id"]).count() == 0


def one_by_one(loads, size, count):
    heap, n = [(x, i) for i, x in enumerate(loads)], [0] * len(loads)
    heapq.heapify(heap)
    for _ in range(count):
        load, i = heapq.heappop(heap)
        n[i] += 1
        heapq.heappush(heap, (load + size, i))
    return n


def test_groups_of_one_size_at_once():
    rng = random.Random(2)
    for _ in range(400):
        loads = [rng.randint(0, rng.choice([3, 1000])) for _ in range(rng.randint(1, 16))]
        size, count = rng.randint(1, 40), rng.choice([0, 1, 5, 63, 64, 65, 400, 1000])
        assert taken(loads, size, count) == one_by_one(loads, size, count)
    assert sum(taken([0, 10**14, 5], 3, 10**13)) == 10**13


def lpt(groups, shards):
    """Loads of the shards, and how many groups of each size each of them gets, one group at a time."""
    loads, got = [0] * shards, Counter()
    for size in sorted(groups, reverse=True):
        i = loads.index(min(loads))
        loads[i] += size
        got[size, i] += 1
    return loads, got


def test_shards_are_the_schedule(spark):
    rng = random.Random(5)
    texts = [f"{i} " + "x" * rng.choice([1, 7, 7, 7, 50, 400]) for i in range(300)] + ["hot text"] * 900 + [None, ""]
    rows = [(rng.choice([i, 2**53 + 1 + i, 4, None]), t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, shard int")
    size = Counter()
    for t in texts:
        size[t or ""] += len((t or "").encode()) + 1
    loads, got = lpt(size.values(), 5)
    for per_run in (3, 20_000):
        out = shard_documents(docs, shards=5, rows_per_run=per_run).collect()
        assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
        assert [sum(r.size for r in out if r.shard == s) for s in range(5)] == loads
        by_crc = {zlib.crc32(t.encode()): n for t, n in size.items()}
        assert Counter((by_crc[c], s) for c, s in {(r.text_crc32, r.shard) for r in out}) == got
        for s in range(5):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_sharding(spark, odd_docs, no_docs):
    rows = shard_documents(odd_docs, shards=4).collect()
    assert len(rows) == odd_docs.count()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    where = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert where.setdefault(data, r.shard) == r.shard
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert shard_documents(no_docs).count() == 0


def test_sharding_balances(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "repeat(cast(id as string), cast(1 + id % 50 as int)) text")
    sizes = [r[0] for r in shard_documents(docs).groupBy("shard").agg({"size": "sum"}).selectExpr("`sum(size)`").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.02 * max(sizes)


def plan(caps, weights, total):
    """Water level by brute force: hand out one token at a time in the limit, that is by bisection."""
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for c, w in zip(caps, weights)) < total else (low, mid)
    return [min(c, high * w) for c, w in zip(caps, weights)]


def test_mixing_budgets(spark):
    rows = [(i, "w " * (1 + i % 7), lang, f"src{s}", 1) for i, (lang, s) in enumerate([("en", 0)] * 300 + [("de", 0)] * 40 + [("en", 1)] * 200 + [("fr", 1)] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mix(docs, {("lang", "en"): 4}, (7, 10), 2).collect()
    supply = sum(len(r[1].split()) for r in rows)
    total = supply * 7 // 10
    leaves = {(r.domain, r.lang, r.source): (r.leaf_tokens, r.leaf_budget) for r in got}
    caps = {k: 2 * t for k, (t, _) in leaves.items()}
    top = plan([sum(c for k, c in caps.items() if k[0] == d) for d in ("d0", "d1")], [1, 1], total)
    for d, langs, share in (("d0", ("de", "en"), top[0]), ("d1", ("en", "fr"), top[1])):
        parts = plan([caps[(d, x, f"src{d[1]}")] for x in langs], [4 if x == "en" else 1 for x in langs], share)
        for x, part in zip(langs, parts):
            assert abs(leaves[(d, x, f"src{d[1]}")][1] - part) <= 2
    taken = Counter()
    for r in got:
        taken[(r.domain, r.lang, r.source)] += r.taken_tokens
    assert all(taken[k] == b for k, (_, b) in leaves.items())
    seen = Counter((r.doc_id, r.epoch) for r in got)
    assert max(seen.values()) == 1 and {r.epoch for r in got} <= {0, 1}


def test_mixing_odd_rows(spark, odd_docs, no_docs):
    """Every token of a leaf's budget is taken, in whole epochs and one prefix; null ids come last."""
    rows = odd_docs.union(spark.createDataFrame([(None, f"no id {i} " * (1 + i % 4), "en", "src0", 1, "") for i in range(30)] + [(57, "other text of its own", "en", "src0", 1, "")], odd_docs.schema))
    got = mix(rows, {}).collect()
    taken_, whole = Counter(), Counter()
    for r in got:
        leaf = (r.domain, r.lang, r.source)
        taken_[leaf] += r.taken_tokens
        whole[leaf] = r.leaf_budget
    assert taken_ == whole
    partial = [r for r in got if 0 < r.taken_tokens < r.n_tokens]
    assert len(partial) <= len(whole)
    last = max(r.epoch for r in got if (r.lang, r.source) == ("en", "src0"))
    here = [r for r in got if (r.lang, r.source, r.epoch) == ("en", "src0", last)]
    if any(r.doc_id is None for r in here):  # then every row with an id is in
        ids = [r.doc_id for r in rows.collect() if (r.lang, r.source) == ("en", "src0") and r.doc_id is not None and (r.text or "").split()]
        assert not Counter(ids) - Counter(r.doc_id for r in here)
    kept = lambda parts: sorted(map(tuple, mix(rows.repartition(parts), {}, (9, 10), 1, keep=["doc_id", "text"]).collect()), key=repr)
    assert kept(1) == kept(5)
    assert mix(no_docs, {}).count() == 0
