r"""Reply trees and chat formatting.

Messages form trees by their parent. Pointer doubling, an iterated self-join, gives each message its ancestors at
distances 1, 2, 4, ... and the sum of the scores on its way from the root; leaves are ranked by that sum within
their conversation, and the best `branches` of them are chosen. The doubling tables, read from the longest distance
to the shortest, then enumerate each chosen path exactly once: ceil(log2(depth)) joins each way, never all paths.

Template, one turn after another:
    <|im_start|>ROLE\nTEXT<|im_end|>\n
Escapes inside roles and texts: `\` becomes `\\`, `<|` becomes `<\|`, and in roles a line end becomes `\n`. So no
control string can come from a text, and `unescaped` gives each text back.

Edge cases: null roles and texts are empty; a null conversation id is one conversation of its own; turns order by
turn (null first), then role and text; repeated rows are turns of their own; an empty table gives no conversations
but those added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

START, END = "<|im_start|>", "<|im_end|>"
NO_CONV = -(2**63)


def escaped(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if role else text


def unescaped(text: str, role: bool = False) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if role and m[1] == "n" else m[1], text, flags=re.S)


def rendered(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{START}{escaped(role, True)}\n{escaped(text)}{END}\n" for role, text in turns)


def parsed(chat: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for part in chat.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescaped(role, True), unescaped(rest[: rest.rindex(END)])))
    return turns


def loss_spans(chat: str) -> list[tuple[int, int]]:
    """Start and end of each assistant text in a rendered conversation: what the loss is taken on."""
    head = f"{START}assistant\n"
    return [(m.end(), chat.index(END, m.end())) for m in re.finditer(re.escape(head), chat)]


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """messages(conv, node, parent, score) -> conv, branch (from 1), path_score, node, depth (0 at the root).

    node is unique within conv; parent is null at a root; a parent that does not exist ends the path.
    Messages that reply to each other in a circle are an error.
    """
    nodes = messages.select("conv", "node", F.coalesce("score", F.lit(0)).cast("long").alias("score"), "parent")
    known = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    nodes = nodes.join(known, ["conv", "parent"], "left").withColumn("up", F.when(F.col("_known"), F.col("parent")))
    first = written(nodes.select("conv", "node", "up", "score", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    # hops[k]: the ancestor at distance 2^k, of messages that have one; done: messages whose way to the root is summed up
    hops, done = [first.where("up IS NOT NULL")], first.where("up IS NULL")
    most = first.count()
    while hops[-1].limit(1).count():
        if 2 ** len(hops) > 2 * most:
            raise ValueError("messages reply to each other in a circle")
        now = hops[-1]
        above = now.unionByName(done).select("conv", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("depth").alias("_depth"))
        step = now.join(above, ["conv", "up"])
        add = lambda a, b: (F.col(a) + F.col(b)).alias(a)
        new = written(step.select("conv", "node", F.col("_up").alias("up"), add("score", "_score"), add("depth", "_depth")))
        hops.append(new.where("up IS NOT NULL"))
        done = done.unionByName(new.where("up IS NULL"))
    sums = done.select("conv", "node", F.col("score").alias("path_score"), "depth")
    leaves = sums.join(hops[0].select("conv", F.col("up").alias("node")), ["conv", "node"], "left_anti")
    best = Window.partitionBy("conv").orderBy(F.col("path_score").desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(best).cast("int")).where(F.col("branch") <= branches)
    paths = written(chosen.select("conv", "branch", "path_score", "node"))
    for hop in reversed(hops[:-1]):
        above = paths.join(hop.select("conv", "node", "up"), ["conv", "node"]).select("conv", "branch", "path_score", F.col("up").alias("node"))
        paths = written(paths.unionByName(above))
    return paths.join(sums.select("conv", "node", "depth"), ["conv", "node"])


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """messages(conv, node, parent, score, role, text) -> conv, branch, path_score, chat."""
    paths = chosen_paths(messages, branches)
    turns = paths.join(messages.select("conv", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["conv", "node"])
    listed = turns.groupBy("conv", "branch", "path_score").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chats = [rendered([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"]]
            yield batch[["conv", "branch", "path_score"]].assign(chat=chats)

    return listed.mapInPandas(run, "conv long, branch int, path_score long, chat string")


def linear(conversations: DataFrame) -> DataFrame:
    """A table (conv_id, turn, role, text) as chains: each turn replies to the one before."""
    conv = F.coalesce("conv_id", F.lit(NO_CONV)).alias("conv")
    rows = conversations.select(conv, "turn", "role", "text")
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    node = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return node.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1).alias("score"), "role", "text")


def digests(chats: DataFrame) -> DataFrame:
    """What a reader of the rendered conversations gets back from them."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, chat in zip(batch["conv"], batch["chat"], strict=True):
                turns = parsed(chat)
                loss = "".join(unescaped(chat[a:b]) for a, b in loss_spans(chat))
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((None if conv == NO_CONV else conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"conv_id": "Int64"})

    return chats.mapInPandas(run, schema)
