"""Mixes sources to target weights: hierarchical budgets and seeded epochs.

The leaves are (domain, language, source). A node can give at most `max_epochs` times its tokens. Budgets go
down the tree one level at a time: the children of a node share its budget in proportion to their weights,
a child that cannot fill its share gives all it has, and the shortage goes to its siblings. A node's capacity
is the sum of its leaves', so a shortage leaves a node only when all its children are exhausted, and then goes
to the node's own siblings: siblings first, ancestors next. All of this is window arithmetic over the (small)
table of nodes in exact integers.

A leaf with budget b and t tokens takes floor(b / t) whole epochs and then a token-prefix of the next. The order
within epoch e is that of md5(seed:e:doc_id), so it is stable and differs from epoch to epoch. Running sums over
a leaf are taken over hash buckets first and rows within a bucket next, so that no task holds a whole leaf; the buckets
grow in number with the largest leaf.

Edge cases: null domain, language or source is its own child ('' sorts first); a text without words has no
tokens: it takes part in whole epochs alone; rows without doc_id follow all others in their leaf, in the order of
md5(seed:e:md5(text)); rows of one doc_id follow each other by tokens, then by the md5 of the text; repeated rows are
separate rows; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, written

LEVELS = ("domain", "lang", "source")
#: Rows of a leaf that share a bucket, on average at most.
BUCKET_ROWS = 20_000


def domain_of(source: Column) -> Column:
    """A domain for each source: its trailing number modulo 4; d0 without a number."""
    number = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(number.try_cast("long") % 4, F.lit(0)).cast("string"))


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget` to children(parent..., name, weight, cap, parent_budget): water level with caps.

    In order of cap / weight, a child is full when its cap is no more than its share of what its predecessors
    left; the full ones are a prefix of that order, and the others divide the rest by weight (rounded down).
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), F.col(name))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    marked = children.withColumn("_left", left).withColumn("_rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    marked = marked.withColumn("_full", (F.col("_left").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)")) >= (F.col("cap").cast("decimal(20,0)") * F.col("_rest").cast("decimal(18,0)")))
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0))
    open_weight = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole), F.lit(1))
    marked = marked.withColumn("_taken", taken).withColumn("_open", open_weight)
    part = F.expr("(CAST(parent_budget - _taken AS decimal(20,0)) * CAST(weight AS decimal(18,0))) div CAST(_open AS decimal(38,0))")
    return marked.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(part.cast("long"))).drop("_left", "_rest", "_full", "_taken", "_open", "parent_budget")


def budgets(leaves: DataFrame, total: Column, weights: dict[tuple[str, str], int], max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with `budget`. weights: (level, value) -> weight, 1 where absent."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)

    def weight(level: str) -> Column:
        out = F.lit(1)
        for (at, value), w in sorted(weights.items()):
            if at == level:
                out = F.when(F.col(level) == value, w).otherwise(out)
        return out.cast("long")

    above = caps.agg(F.sum("cap").alias("cap")).select(F.lit(0).alias("_root"), F.least(total, F.col("cap")).cast("long").alias("parent_budget"))
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        nodes = caps.groupBy(F.lit(0).alias("_root"), *keys).agg(F.sum("cap").alias("cap")).withColumn("weight", weight(level))
        shared = share(nodes.join(above, ["_root", *keys[:-1]]), ["_root", *keys[:-1]], level)
        above = shared.select("_root", *keys, F.col("budget").alias("parent_budget"))
    return caps.join(above.drop("_root"), list(LEVELS)).withColumnRenamed("parent_budget", "budget")


def mix(docs: DataFrame, weights: dict[tuple[str, str], int], share_of_supply: tuple[int, int] = (7, 10), max_epochs: int = 2, seed: int = 1, keep: list[str] | None = None) -> DataFrame:
    """The chosen rows: doc_id, domain, lang, source, n_tokens, epoch, taken_tokens, leaf_tokens, leaf_budget.

    The total budget is `share_of_supply` of all tokens. taken_tokens is n_tokens but for the last row of a
    prefix, which gives only the tokens that the budget still allows. keep: columns to carry along.
    """
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    none = F.lit("")
    # the text tells rows apart that share an id and their number of tokens; without other columns such rows are alike
    text_md5 = F.md5(F.coalesce("text", none))
    text_md5 = text_md5 if keep else F.when(F.col("doc_id").isNull(), text_md5).otherwise(none)
    slim = docs.select("doc_id", F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"), count.alias("n_tokens"), text_md5.alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep or []])
    slim = written(slim.withColumn("domain", domain_of(F.col("source"))))
    leaves = written(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("_rows")))
    supply, rows = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    leaves = leaves.drop("_rows")
    digits = max(2, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    total = F.lit(supply * share_of_supply[0] // share_of_supply[1]).cast("long")
    planned = budgets(leaves, total, weights, max_epochs)
    planned = planned.select(*LEVELS, F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"), F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("_whole"))
    planned = written(planned)
    placed = slim.join(planned, list(LEVELS)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.col("_whole"), F.lit(max_epochs - 1)).cast("int"))))
    hashed = lambda x: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), x))
    own = F.col("doc_id").cast("string")
    placed = placed.withColumn("_order", F.when(own.isNotNull(), hashed(own)).otherwise(F.concat(F.lit("~"), hashed(F.col("_text")))))  # ~ is after all digits
    placed = placed.withColumn("_bucket", F.substr("_order", F.lit(1), F.lit(digits) + own.isNull().cast("int")))
    leaf = [*LEVELS, "epoch"]
    ahead = placed.groupBy(*leaf, "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    ahead = ahead.withColumn("_ahead", F.sum("_sum").over(Window.partitionBy(*leaf).orderBy("_bucket")) - F.col("_sum")).drop("_sum")
    run = Window.partitionBy(*leaf, "_bucket").orderBy("_order", "doc_id", "n_tokens", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = placed.withColumn("_within", F.sum("n_tokens").over(run) - F.col("n_tokens")).join(ahead, [*leaf, "_bucket"])
    room = F.col("leaf_budget") - F.col("leaf_tokens") * F.col("epoch") - F.col("_ahead") - F.col("_within")
    taken = F.when(F.col("epoch") < F.col("_whole"), F.col("n_tokens")).otherwise(F.least(F.col("n_tokens"), room))
    kept = [F.col(f"_keep_{c}").alias(c) for c in keep or [] if c not in ("doc_id",)]
    chosen = within.withColumn("taken_tokens", taken).where((F.col("epoch") < F.col("_whole")) | (F.col("taken_tokens") > 0))
    if keep:
        return chosen.select("doc_id", *kept)
    return chosen.select("doc_id", *LEVELS, "n_tokens", F.col("epoch").cast("int").alias("epoch"), "taken_tokens", "leaf_tokens", "leaf_budget")
