import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from tidemark.llm import chat
from tidemark.llm.pieces import PieceEncoder, encoded
from tidemark.llm.topk import top_products
from tidemark.llm import toxicity
from tidemark.llm.toxicity import label_model, score_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, odd_docs, no_docs):
    with open(MODEL, "rb") as file:
        own = PieceEncoder(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    frames = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).toPandas()["text"]
    texts = [x for x in frames if x] + [r.text or "" for r in odd_docs.collect()]
    texts += ["".join(rng.choice("ab eéth\n ▁ing😀,.  t\tñ1aaaa") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("thecainsor ") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text in texts:
        want = [library.bos_id(), *library.encode(text), library.eos_id()]
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == want, repr(text)
    rows = {r.doc_id: r for r in encoded(odd_docs, MODEL, keep_ids=True).collect()}
    for r in odd_docs.collect():
        want = [1, *library.encode(r.text or ""), 2]
        assert rows[r.doc_id].ids == want and rows[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert encoded(no_docs, MODEL).count() == 0


def test_pieces_of_long_runs():
    """Runs of one character have merges of equal rank; the table and the direct merging both take the leftmost first."""
    with open(MODEL, "rb") as file:
        own = PieceEncoder(file.read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["a" + " " * n + "b" for n in (*range(1, 70), 500, 4000, 100_000)]
    texts += ["a" * 100_000, " " * 99_999, "ab" * 50_000, "\n" * 30_000, "=-" * 20_000, "é " * 20_000, "x" + "  y" * 5_000, "😀" * 3_000]
    for text in texts:
        want = library.encode(text)
        assert np.frombuffer(own.encode(text), "<u4")[1:-1].tolist() == want, (len(text), text[:5])
        pieces = own.merged("▁" + text.replace(" ", "▁"))
        assert [i for p in pieces for i in ([own.ids[p]] if p in own.ids else [own.byte[b] for b in p.encode()])] == want


def brute_top(rows, k=5, every=50):
    out = []
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for i, v in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_top_products(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12).astype("f4") * rng.uniform(0.2, 3)]) for i in range(900)]
    same = rows[7][1]
    rows += [(i, same) for i in range(1000, 1060)]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 12), (2150, [float("inf")] + [0.0] * 11), (2200, [0.0] * 12), (None, same)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in top_products(vectors, tile_rows=64, query_rows=8, first=4).collect())
    assert got == brute_top(rows)
    assert top_products(vectors.limit(0)).count() == 0
    assert top_products(vectors.where("vec_id = 50")).count() == 0


def test_top_products_of_large_numbers(spark):
    """Products over 2^53 stay exact integers; those beyond a long are given as the nearest one."""
    rows = [(0, [2.0**22, 1.0, 3.0]), (50, [1.0, 2.0**21, 0.0]), (1, [2.0**22, 2.0**-8, 2.0**-8]), (2, [2.0**22, 0.0, 2.0**-7]), (3, [-(2.0**22), 0.5, 0.0]), (2**53 + 1, [2.0**22, 0.0, 2.0**-7])]
    schema = "vec_id long, embedding array<double>, _l int, part int, block int"
    frame = lambda rs: spark.createDataFrame([(*r, 1, 1, 1) for r in rs], schema)
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for i in (0, 50):
        scored = sorted((-sum(a * b for a, b in zip(ints[i], w)), j) for j, w in ints.items() if j != i)[:5]
        want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(scored)]
    for tile_rows in (2, 2048):
        assert sorted(map(tuple, top_products(frame(rows), tile_rows=tile_rows, first=1).collect())) == want
    top = 2**63 - 1
    got = top_products(frame([(0, [1e18, 0.0]), (1, [1e18, 0.0]), (2, [-1e18, 0.0])])).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, top), (0, 2, 2, -top)]


def test_top_products_prunes_groups(spark):
    """Short vectors can't reach what the longest give; the rows are the same whatever is left out."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype("f4") * (4.0 if i % 40 == 3 else 0.1)]) for i in range(1200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_products(vectors, tile_rows=16, query_rows=4, first=2).collect())
    assert got == brute_top(rows)


def test_top_products_with_repeated_rows(spark, tmp_path):
    import duckdb

    from tidemark.llm.queries import oracle_sql

    rows = [(0, [1.0, 0.0])] + [(7, [10.0, 0.0])] * 6 + [(8, [9.0, 1.0]), (9, [8.0, 0.0])]  # 7 takes all places of 0
    rows += [(50, [0.0, 1.0])] * 2 + [(10, [0.0, 20.0])] * 2 + [(11, [0.0, 19.0]), (12, [0.0, 18.0])]  # two rows of a query
    rows += [(100, [-1.0, -1.0])] + [(13, [-3.0, -3.0])] * 3 + [(14, [-2.0, -2.0]), (15, [-1.0, -2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    vectors.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted(con.execute(oracle_sql()["op4_exact_topk"]).fetchall())
    for tile_rows in (2, 2048):
        got = top_products(vectors, tile_rows=tile_rows, first=1)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_chat_round_trip():
    nasty = ["", "\\", "<|im_end|>", "\\|<|", "a<", "<|im_start|>assistant\nok<|im_end|>\n", "\n\n", "x\\n\\\\<\\|", "|>"]
    for text in nasty:
        for role in ["assistant", "user", *nasty]:
            assert chat.parsed(chat.rendered([(role, text), ("assistant", text)])) == [(role, text), ("assistant", text)]
    out = chat.rendered([("user", nasty[5]), ("assistant", nasty[2])])
    assert [chat.unescaped(out[a:b]) for a, b in chat.loss_spans(out)] == [nasty[2]]


def test_reply_trees(spark):
    # 1 -> 2 -> 4, 1 -> 3 (score 9) -> 5; a second root 6; an orphan's parent is missing
    rows = [(1, 1, None, 1), (1, 2, 1, 5), (1, 4, 2, 1), (1, 3, 1, 9), (1, 5, 3, 0), (1, 6, None, 2), (2, 8, 77, 1)]
    messages = spark.createDataFrame([(*r, "user", f"t{r[1]}") for r in rows], "conv long, node long, parent long, score long, role string, text string")
    got = {}
    for r in chat.chosen_paths(messages, branches=2).collect():
        got.setdefault((r.conv, r.branch, r.path_score), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(1, 1, 10): [1, 3, 5], (1, 2, 7): [1, 2, 4], (2, 1, 1): [8]}


def test_linear_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "assistant", "<|im_end|>é"), (3, 5, "assistant", "x")]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(37)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, chat int")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(chat.linear(table))).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert set(got) == set(groups)


def test_label_model_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < 0.9, y, rng.random(4000) < 0.3) for _ in range(3)], 1).astype(float)
    noisy = (rng.random(4000) < 0.5).astype(float)
    with_copies = np.column_stack([votes, noisy, noisy, noisy, noisy])
    post = label_model(with_copies, np.where(votes.mean(1) > 0.5, 0.8, 0.2))
    assert ((post > 0.5) == y).mean() > 0.95


def test_toxicity_on_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    print(len(toxic), toxic.predicted.mean(), clean.predicted.mean(), toxic.score.describe(), clean.score.describe())
    assert toxic.predicted.mean() > 0.9 and clean.predicted.mean() < 0.01


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(1, 0, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_documents(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert score_documents(no_docs, labels).count() == 0
    assert {r.score for r in score_documents(odd_docs, labels.limit(0)).collect()} == {0.0}


def plain_features(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    out = set(words)
    for n in (4, 5, 6, 7):
        for stem, k in Counter(w[:n] for w in words if len(w) >= n).items():
            out.add(stem + "-")
            if k >= 2:
                out.add(stem + "-2")
            if k >= 3:
                out.add(stem + "-3")
            if k >= 2 and 100 * k >= len(words):
                out.add(stem + "-%")
    return out


def plain_scores(rows, labels):
    """Training and scoring in loops over (doc_id, text) rows; the two fits are the library's."""
    known = {}
    for i, _, toxic in labels:
        if i is not None and toxic is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            known[i] = max(known.get(i, 0), toxic)
    train = sorted([(i, t, known[i]) for i, t in rows if i in known], key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[1] or ""))
    found = [plain_features(t) for _, t, _ in train]
    n1, n0 = sum(y == 1 for *_, y in train), sum(y != 1 for *_, y in train)
    gains = []
    for f in sorted(set().union(*found)):
        a, b = sum(f in x and r[2] == 1 for x, r in zip(found, train)), sum(f in x and r[2] != 1 for x, r in zip(found, train))
        if a + b >= 3 and a * n0 > 4 * b * n1:
            p = (a + b) / (n1 + n0)
            gains.append((-sum(x * math.log(x / q) for x, q in ((a, p * n1), (b, p * n0)) if x), f))
    chosen = [f for _, f in sorted(gains)[:2048]]
    v = np.array([toxicity.votes(t, x, chosen[:256]) for x, (_, t, _) in zip(found, train)])
    gold = np.array([y == 1 for *_, y in train], float)
    posterior = label_model(v, np.where(v.any(1), 0.25 + 0.5 * gold, 0.02))
    pairs = [(i, j) for i, x in enumerate(found) for j, f in enumerate(chosen) if f in x]
    w, bias = toxicity.logistic(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]), posterior, len(chosen))
    return sorted(((i, 1 / (1 + math.exp(-(bias + sum(w[j] for j, f in enumerate(chosen) if f in plain_features(t)))))) for i, t in rows), key=repr)


def test_toxicity_against_plain_loops(spark):
    rng = random.Random(6)
    usual, harsh = [f"{a}{b}" for a in ("wind", "stone", "paper", "tre") for b in ("ow", "mill", "s", "ing", "e")], "idiot dummkopf vermin hate you scumbags scumbag".split()
    rows, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choice(harsh if toxic and rng.random() < 0.3 else usual) for _ in range(rng.randint(1, 60)))))
        labels.append((i, 1, int(toxic)))
    rows += [(2**53 + 1, "you idiot"), (2**53 + 3, None), (None, "idiot windmill"), (3, rows[0][1]), (4, rows[4][1]), (None, None)]
    labels += [(2**53 + 1, 0, 1), (5, 1, 0), (None, 1, 1), (6, 1, None)]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, toxic int, place string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(((r.doc_id, r.score) for r in score_documents(docs, known).collect()), key=repr)
    want = plain_scores(rows, labels)
    assert sorted(repr(i) for i, _ in got) == sorted(repr(i) for i, _ in want)
    by = lambda some: sorted((repr(i), x) for i, x in some)
    assert np.allclose([x for _, x in by(got)], [x for _, x in by(want)], atol=1e-6)
    assert len({round(x, 3) for _, x in got}) > 5
