import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import language_model as lm
from tidemark.llm import substrings as sub
from tidemark.llm.near_copies import linked
from tidemark.llm.substrings import without_repeats


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "src0", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


# ---- repeated passages


def brute_removed(rows):
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - 49):
                s = data[i : i + 50]
                least[s] = min(doc, least.get(s, doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 49):
            if doc is not None and least[data[i : i + 50]] < doc:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(8, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(1, 40)) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(0, 3 * n), " ".join(parts)))
    rows += [(500, shared[0] + shared[1]), (501, shared[0] + shared[1]), (502, "a" * 400), (503, "a" * 300), (504, "ab" * 100), (505, "ab" * 100), (506, None), (507, ""), (None, shared[0]), (None, shared[0])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_brute_force(spark, seed):
    rows = passages(seed)
    got = sorted(map(tuple, without_repeats(frame(spark, rows), block_bytes=3000).collect()), key=repr)
    assert got == sorted(brute_removed(rows), key=repr)


def test_passages_empty_and_carry(spark, no_docs, odd_docs):
    assert without_repeats(no_docs).count() == 0
    got = without_repeats(odd_docs, carry="source").collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(got) == odd_docs.count()
    for r in got:
        if not r.n_removed:
            assert r.kept_text == texts[r.doc_id]


def test_suffix_sort_orders_strings():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype("u1")
    data[1000:1400] = data[:400]
    at = np.sort(rng.integers(0, 3900, 700))
    group = np.sort(rng.integers(0, 9, 700))
    order = sub.suffix_order(data, at, group)
    keys = [(g, data[a : a + 50].tobytes()) for a, g in zip(at[order], group[order])]
    assert keys == sorted(keys) and sorted(order) == list(range(700))


def test_collisions_are_verified(monkeypatch):
    """With a hash under which everything is equal, the bytes still decide."""
    monkeypatch.setattr(sub.Polynomial, "__init__", lambda self, data, base: self.__dict__.update(sums=np.zeros(len(data) + 1, "u8"), down=np.ones(len(data) + 1, "u8")))
    data = np.frombuffer(b"x" * 50 + b"y" * 50 + b"x" * 50, "u1")
    assert sub.smallest_holder(data, np.array([0, 50, 100]), np.zeros(3, int), np.array([5, 1, 3])).tolist() == [3, 1, 3]


def test_equal_span_hashes_of_other_bytes():
    """Spans with equal hashes are told apart by their bytes, within a block and between blocks."""
    rng = np.random.default_rng(2)
    head, tails = b"0123456789abcdefghij" * 2, [rng.integers(97, 123, 30).astype("u1").tobytes() for _ in range(3)]
    data = np.frombuffer(b"".join(head + t for t in (*tails, tails[0])), "u1")
    at = np.arange(4) * 70
    r = {"doc": np.array([0, 1, 2, 3]), "first": at, "last": at + 20, "anchor_at": at, "anchor": np.zeros(4, "u8"), "span": np.zeros(4, "u8")}
    some, number, least = sub.distinct_runs(r, data, np.array([9, 8, 7, 6]))
    assert len(some) == 3 and number[0] == number[3] and len(set(number)) == 3 and least[number[0]] == 6
    doc, zero = np.array([9, 8, 7, 6]), np.zeros(4, "u8")
    got = sub.held_strings(zero, zero, doc, np.full(4, 5), np.full(4, 70), np.array([1, 1, 1, 3]), data).reshape(4, 21)
    strings = [[data[a + i : a + i + 50].tobytes() for i in range(21)] for a in at]
    want = [[int(any(strings[k][i] == strings[j][i] and doc[k] < doc[j] for k in range(4))) for i in range(21)] for j in range(4)]
    assert got.tolist() == want


def spans_of_anchors(seed, anchors=3, n=60):
    """Spans of a few anchors with few letters around them: arguments of held_strings, and what it should say."""
    rng = np.random.default_rng(seed)
    spans, rows = [], []
    for a in range(anchors):
        inner = rng.integers(97, 123, 20).astype("u1").tobytes()
        common = b"ab" * 20
        for _ in range(n):
            place, windows = int(rng.integers(0, 31)), int(rng.integers(1, 32))
            windows = min(windows, place + 1)
            size = windows + 49
            text = bytearray((common[:30] + inner + common)[30 - place :][:size])
            for i in rng.integers(0, size, rng.integers(0, 3)):
                if not place <= i < place + 20:
                    text[i] = 99
            spans.append(bytes(text))
            rows.append((a, zlib.crc32(bytes(text)) * 32 + place, int(rng.integers(0, 40)), place, size))
    anchor, span, doc, place, size = (np.array(x) for x in zip(*rows))
    anchor, span = anchor.astype("u8"), span.astype("u8")
    least = {}
    for a, s, d in zip(anchor, span, doc):
        least[a, s] = min(d, least.get((a, s), d))
    code = np.array([1 if least[a, s] < d else 2 for a, s, d in zip(anchor, span, doc)])
    strings = [[(a, p - i, t[i : i + 50]) for i in range(len(t) - 49)] for a, p, t in zip(anchor, place, spans)]
    holder = {}
    for d, own in zip(doc, strings):
        for x in own:
            holder[x] = min(d, holder.get(x, d))
    want = [int(holder[x] < d) for d, own in zip(doc, strings) for x in own]
    return (anchor, span, doc, place, size, code, np.frombuffer(b"".join(spans), "u1")), want


@pytest.mark.parametrize("collide", [False, True])
def test_spans_are_sorted_not_each_string(monkeypatch, collide):
    """Two sorted suffixes for each span, however many strings it has; right results also where hashes mislead."""
    args, want = spans_of_anchors(5)
    sorted_, plain = [], sub.suffix_order
    monkeypatch.setattr(sub, "suffix_order", lambda data, at, group: sorted_.append(len(at)) or plain(data, at, group))
    if collide:  # every second place has the hash sums of the one before
        first = sub.Polynomial.__init__

        def init(self, data, base):
            first(self, data, base)
            self.sums = np.repeat(self.sums[::2], 2)[: len(self.sums)]

        monkeypatch.setattr(sub.Polynomial, "__init__", init)
    assert sub.held_strings(*args).tolist() == want and 0 < sum(want) < len(want)
    if not collide:
        assert sum(sorted_) <= 2 * len(args[0])


# ---- near copies


def sets_of(rows):
    out = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        out[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return out


def brute_components(rows):
    sets = sets_of(rows)
    label = {d: d for d in sets}
    find = lambda x: x if label[x] == x else find(label[x])
    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d)) for d in docs)


def copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, rows = text(60), []
    for base in range(12):
        original = text(rng.choice([3, 5, 12, 60, 200, 900]))
        for _ in range(rng.randint(1, 9)):
            words = list(original)
            for _ in range(rng.choice([0, 0, 1, 2, 3, max(1, len(words) // 40)])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words) if rng.random() < 0.8 else "\n".join(words).upper())
    rows += [" ".join(passage + text(rng.randint(0, 60))) for _ in range(40)]
    rows += ["", None, " \n", "One two", "one TWO", "one two three four", "one two three four five"]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed,stars", [(1, 2), (2, 0), (3, 1)])
def test_components_against_brute_force(spark, seed, stars):
    rows = copies(seed)
    got = sorted(map(tuple, linked(frame(spark, rows), block_bytes=20_000, stars=stars).collect()))
    assert got == brute_components(rows)


def brute_links(rows):
    sets = {d: s for d, s in sets_of(rows).items() if s}
    linked_ = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    return {d: sum(d != e and linked_(d, e) for e in sets) if d in sets else 0 for d, _ in rows}


@pytest.mark.parametrize("seed,tile", [(1, 300), (2, 5000)])
def test_links_against_brute_force(spark, seed, tile):
    rows = copies(seed)
    same = " ".join(f"s{i}" for i in range(60))
    rows += [(2000 + i, same + f" t{i}" if i % 3 else same) for i in range(60)]  # one dense group of near and exact copies
    docs = frame(spark, rows + rows[:5] + [(None, same)])
    got = linked(docs, block_bytes=20_000, count=True, link_tile=tile).collect()
    assert len(got) == len(rows) + 6
    assert {r.doc_id: r.n_links for r in got} == brute_links(rows) | {None: None}


def test_components_odd_rows(spark, odd_docs, no_docs):
    assert linked(no_docs).count() == 0
    got = linked(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {r.component_id for r in got if r.doc_id in (53, 54, 55, 57)} == {53}
    rows = spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in linked(rows).collect())[1] == (1, 1)


def test_rows_are_judged_by_their_own_text(spark):
    """Null ids, ids over 2^53, one id with two texts, and clashing columns."""
    big, text = 2**53 + 1, lambda w, n=40: " ".join(f"{w}{i}" for i in range(n))
    rows = [(big, text("a")), (big + 2, text("a") + " x"), (None, text("a") + " y"), (None, "one two three four five six seven")]
    rows += [(5, text("b")), (5, text("c")), (6, text("c") + " z"), (7, text("d", 9)), (7, text("d", 9)), (8, None), (None, None)]
    docs = spark.createDataFrame([(*r, i, "x", 1, 2) for i, r in enumerate(rows)], "doc_id long, text string, n long, block string, node long, comp long")
    got = linked(docs, count=True, mark=True)
    want = [(big, 36, big, 1), (big + 2, 37, big, 1), (None, 37, big, None), (None, 3, None, None), (5, 36, 5, 0), (5, 36, 5, 1), (6, 37, 5, 1), (7, 5, 7, 0), (7, 5, 7, 0), (8, 0, 8, 0), (None, 0, None, None)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[:4]) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=key) == sorted(want, key=key)
    firsts = {(r.doc_id, r.text_md5) for r in got.where("is_first").collect()}
    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    assert firsts == {(i, md5(rows[k][1])) for i, k in ((big, 0), (None, 3), (5, 4), (5, 5), (7, 7), (8, 9), (None, 10))}


# ---- language model


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def base(rows):
    tokens = {d: (t or "").encode().lower().split() + [None] for d, t in rows}
    c = Counter(w for d, t in tokens.items() if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    return {d: (held(d), len(t), sum(c[w] > 0 for w in t), n, sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for d, t in tokens.items()}


def test_base_scores(spark, no_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("The the OF of und\tÜber mañana x1 x2 x3".split(" ")) + rng.choice(["", "", str(rng.randint(0, 50))]) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "never seen words only")]
    want = base(rows)
    for r in lm.score_documents(frame(spark, rows)).collect():
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 and r.score < 0
    assert lm.score_documents(no_docs).count() == 0


def test_gradients():
    rng = np.random.default_rng(2)
    net = lm.Network({k: rng.normal(0, 0.3, s) for k, s in zip(lm.Network.NAMES, lm.Network.SHAPES)})
    inputs, targets = rng.integers(0, 40, (5, 3)), rng.integers(0, lm.LEAVES, (5, 3))
    inputs[2, 1] = 0
    real, h = np.ones((5, 3), bool), rng.normal(0, 0.3, (3, lm.HIDDEN))
    real[4, 2] = False
    net.states = lambda i, s, keep=None, f=net.states: f(i, s, keep).astype("f8")
    grads, _, _ = net.gradients(inputs, targets, real, h)
    for k in net.p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old, losses = net.p[k][at], []
        for e in (1e-3, -1e-3):
            net.p[k][at] = old + e
            losses.append(net.gradients(inputs, targets, real, h)[2] / real.sum())
        net.p[k][at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - grads[k][at]) < 2e-3 * max(1, abs(grads[k][at])), k


def test_windows_and_lanes_do_not_change_scores():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 300, 40)
    leaf = rng.integers(1, lm.LEAVES, lengths.sum()).astype("i4")
    leaf[np.cumsum(lengths) - 1] = 0
    net = lm.Network.fresh(rng.integers(1, 1000, lm.LEAVES).astype(float))
    whole = lm.block_scores(net, leaf, lengths, window=7)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for d in range(0, 40, 7):
        alone = lm.block_scores(net, leaf[starts[d] : starts[d + 1]], lengths[d : d + 1], window=1000)
        assert abs(alone[0] - whole[d]) < 1e-3


def test_leaf_probabilities_sum_to_one():
    net = lm.Network.fresh(np.arange(1, lm.LEAVES + 1).astype(float))
    state = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype("f4")
    logs = [net.log_probs(state, np.array([leaf]))[0] for leaf in range(lm.LEAVES)]
    assert abs(np.exp(logs).sum() - 1) < 1e-4


def plain_scores(rows, leaves, net):
    """Scores of (doc_id, text) rows by loops over tokens: counts, leaves and the network's equations, one word at a time."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    count = Counter(w for i, t in rows if not lm.is_held_out(i, 5) for w in lm.tokens_of(t))
    singles = {int(h): k for k, h in enumerate(leaves.words)}
    leaf_of = lambda w: 0 if w is None else singles.get(xxhash.xxh3_64_intdigest(w), lm.SINGLES + zlib.crc32(w[-3:]) % lm.RARE)
    held = {}
    for w, c in count.items():
        held.setdefault(leaf_of(w), []).append(c)
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    out = []
    for doc, text in rows:
        h, before, total = np.zeros(lm.HIDDEN), 0, 0.0
        for w in [*lm.tokens_of(text), None]:
            h = h if before else np.zeros(lm.HIDDEN)
            f = 1 / (1 + np.exp(-(p["x"][before, : lm.HIDDEN] + h @ p["uf"])))
            u = p["x"][before, lm.HIDDEN :] + (f * h) @ p["un"]
            h = h + f * (u / (1 + np.abs(u)) - h)
            leaf = leaf_of(w)
            c, m = leaf % lm.CLASSES, leaf // lm.CLASSES
            total += soft(h @ p["cw"] + p["cb"])[c] + soft(h @ p["lw"][c] + p["lb"][c])[m]
            if leaf >= lm.SINGLES:
                own = held.get(leaf, [])
                total += np.log((count[w] + 0.5) / (sum(own) + 0.5 * (len(own) + 1)))
            before = leaf
        out.append((doc, total / np.log(10)))
    return sorted(out, key=repr)


def test_scores_against_plain_loops_and_other_partitions(spark):
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(5000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    rows += [(2**53 + 1, "w1 w2 w1"), (2**53 + 3, "w3"), (None, "w1 w9 unheard"), (7, "w5 w6"), (7, "w5 w6"), (None, None), (200, " ".join(vocabulary[:3000]))]
    schema = "doc_id long, text string, tokens int, number string"
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = sorted(((r.doc_id, r.score) for r in lm.score_documents(frame.repartition(3)).collect()), key=repr)
    assert got == sorted(((r.doc_id, r.score) for r in lm.score_documents(frame.repartition(7, "text")).collect()), key=repr)
    _, leaves, net = lm.fitted(frame)
    want = plain_scores(rows, leaves, net)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-4)


def test_model_beats_counts_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = lm.score_documents(docs).where("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
    print(got)
    assert got[0] > 0.95 * got[1]
