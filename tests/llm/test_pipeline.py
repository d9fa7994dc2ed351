"""The pipeline's stages against plain versions of their decisions."""

import contextlib
import io
import random
import re

import corpus_pipeline
import pytest
import sentencepiece

from tidemark.llm import _shared
from tidemark.llm import language_model as lm
from tidemark.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    words = [f"word{i}" for i in range(300)] + "the of and to in".split() * 20
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(60, 120)), "en", f"src{i % 5}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src9", 1) for i in range(5)]  # exact copies
    rows += [(200 + i, rows[i][1] + " tail", "en", "src9", 1) for i in range(10, 15)]  # near copies
    passage = text(40)
    rows += [(300 + i, text(50) + " " + passage + " " + text(50), "en", "src1", 1) for i in range(3)]
    rows += [(400, None, None, None, None), (401, "too short", "en", "src0", 1), (402, "$$$ %%% " * 40, "en", "src0", 1), (None, text(80), "en", "src2", 1)]
    return rows, passage


def test_stages(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame([(*r, 7) for r in rows], DOCS + ", kept int")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    texts = {r[0]: r[1] for r in rows}
    assert set(kept["quality_rules"]) == set(texts) - {400, 401, 402}
    assert set(kept["near_copies"]) == set(kept["quality_rules"]) - {100, 101, 102, 103, 104, 210, 211, 212, 213, 214}
    cut = kept["repeated_passages"]
    assert set(cut) == set(kept["near_copies"])
    assert passage in cut[300] and all(passage not in cut[i] and len(cut[i]) >= len(texts[i]) - len(passage) - 30 for i in (301, 302))
    assert all(cut[i] == texts[i] for i in range(60))
    mixed = kept["source_mix"]
    assert set(mixed) <= set(cut) and all(mixed[i] == cut[i] for i in mixed)
    tokens = lambda some: sum(len((cut[i] or "").split()) for i in some)
    assert 0.85 * tokens(cut) < tokens(mixed) <= tokens(cut)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect():
        assert r.ids == [1, *library.encode(mixed[r.doc_id]), 2] and r.n_tokens == len(r.ids)


def text_shuffles(df):
    """Shuffles of the plan whose rows carry texts, as such or as states of first()."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return len(re.findall(r"^\(\d+\) Exchange\nInput.*[\[ ](?:text|first)#", out.getvalue(), re.M))


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_disk_of_stages(spark, no_broadcasts):
    """Near copies: texts are shuffled once, and only what the result reads is left. Quality rules write no texts."""
    docs = spark.createDataFrame([(*r, 7) for r in corpus()[0]], DOCS + ", kept int")
    mark = _shared.scratch_mark()
    judged = corpus_pipeline.quality_rules(spark, docs, "")
    left = _shared._written[mark:]
    assert left and all("text" not in spark.read.parquet(path).columns for path in left)
    assert text_shuffles(judged) == 1
    judged, mark = spark.createDataFrame(judged.collect(), DOCS), _shared.scratch_mark()
    first = corpus_pipeline.near_copies(spark, judged, "")
    assert text_shuffles(first) == 1
    left = [spark.read.parquet(path).columns for path in _shared._written[mark:]]
    assert len(left) == 2 and not any({"hashes", "prefix", "shingle", "texts"} & set(columns) for columns in left)
    assert first.count() == len({r.doc_id for r in judged.collect()}) - 10


def test_memory_of_executors(spark):
    """Executors are asked to shrink, workers drop what other operators keep, and near copies need no second kind of workers."""
    from tidemark.llm import near_copies, pieces

    _shared.shrink_executors(spark)
    rows = [(i, "a b c d e f g h i j k l" + " m" * (i % 2), "en", "s", 1) for i in range(4)]
    docs, made = spark.createDataFrame(rows, DOCS).cache(), []
    docs.count()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark), "createDataFrame", lambda *a, **b: made.append(a))
        assert {r.component_id for r in near_copies.linked(docs).collect()} == {0}
    assert not made

    def worker(key, found):
        import pandas as pd

        pieces._encoders["kept"] = None
        _shared.lean_worker()
        return pd.DataFrame({"n": [len(pieces._encoders)]})

    assert spark.range(1).groupBy("id").applyInPandas(worker, "n int").first().n == 0


def test_rows_as_keys(spark):
    """Verdicts hold for a text in its language, and a document is a doc_id with a text, whatever is null or repeated."""
    text = lambda seed: " ".join(random.Random(seed).choices([f"w{i}" for i in range(300)] + "the of and to in".split() * 20, k=90))
    bare = " ".join(f"x{i}" for i in range(90))  # none of the common words
    rows = [(i, text(i), lang, "s", 1) for i in range(30) for lang in ("en", None)]
    rows += [(50, bare, lang, "s", 1) for lang in ("en", "", None)] + [(None, text(99), "en", "s", 1)] * 2 + [(7, text(98), "en", "s", 1)] + [(60, "short", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in docs.collect() if r.doc_id != 60 and (r.doc_id, r.lang) != (50, "en"))
    first = corpus_pipeline.near_copies(spark, spark.createDataFrame(kept, DOCS), "")
    assert sorted(map(str, first.select("doc_id", "text").collect())) == sorted({str(r) for r in spark.createDataFrame(kept, DOCS).select("doc_id", "text").collect()})


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_model_odd_rows(spark, odd_docs):
    odd = odd_docs.union(spark.createDataFrame([(None, "no id", "en", "s", 1, "")], odd_docs.schema))
    got = lm.score_documents(odd).collect()
    assert len(got) == odd.count()
    assert {r.n_tokens for r in got if r.doc_id in (50, 51, 52)} == {1}
    assert sum(r.doc_id is None for r in got) == 1 and all(r.score < 0 for r in got)
