"""The corpus pipeline: quality rules, near copies, repeated passages, the mix, and token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents.

Edge cases: nulls, empty texts, repeated rows and empty tables pass as the operators define it. Rows without doc_id
are judged by their text; in a group of near copies they stay only if no row has an id. n_chars is brought up to date
where a stage changes the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import discard_since, scratch_mark, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can't express the passages' removal or the encoding; tests compare the stages with brute force.
ORACLE_SQL = None
#: Word distances are held against this share of the distance of a document without common words.
WORD_SHARE = 0.9


def row_key(doc_id: str, text_md5: Column) -> Column:
    """A document's doc_id and text as one key, so that texts are shuffled once for all that is done by it."""
    return F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), F.lit(":"), text_md5)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("_row", row_key("doc_id", F.md5(F.coalesce("text", F.lit("")))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and those that lack their language's common words.

    The verdict rests on text and language; it is found without carrying texts along, so that no copy of them is written.
    """
    from tidemark.llm.quality import judge

    own = keyed(docs)
    kept = judge(own, ["_row", "lang"], word_share=WORD_SHARE).where("kept").select("_row", F.col("lang").alias("_lang"))
    return own.join(kept, (own["_row"] == kept["_row"]) & own["lang"].eqNullSafe(kept["_lang"]), "left_semi").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: the one with the smallest id, once.

    A document is a doc_id with a text; rows that repeat both are one.
    """
    from tidemark.llm.near_copies import linked

    first = linked(docs, mark=True).where("is_first").select(row_key("doc_id", F.col("text_md5")).alias("_row")).distinct()
    return keyed(docs).join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds go; documents stay."""
    from tidemark.llm.substrings import without_repeats

    cut = without_repeats(docs.withColumn("_rest", F.to_json(F.struct("lang", "source"))), carry="_rest")
    rest = F.from_json("carried", "lang string, source string")
    return cut.select("doc_id", F.col("kept_text").alias("text"), rest["lang"].alias("lang"), rest["source"].alias("source"), F.length("kept_text").cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the token budgets of the mix's leaves, one epoch at most.

    Documents stay whole: the last one of a leaf's prefix passes with its whole text, so that a leaf's budget is rounded
    up by less than one document.
    """
    from tidemark.llm.mixing import mix
    from tidemark.llm.queries import MIX_WEIGHTS

    chosen = mix(docs, MIX_WEIGHTS, share_of_supply=(9, 10), max_epochs=1, keep=COLUMNS)
    return chosen.select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and digests."""
    from tidemark.llm.pieces import encoded
    from tidemark.llm.queries import tokenizer

    return encoded(docs, tokenizer(), keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        mark = scratch_mark()
        docs = written(stage(spark, docs, sf_dir))
        discard_since(spark, mark, docs)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
