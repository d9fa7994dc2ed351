"""N-gram Jaccard join: documents whose shingle sets overlap by 0.8 or more, and their components.

Exact, in these steps; sets are sorted arrays of 64-bit shingle hashes.

1. Rows of equal text become one node; what follows links nodes, and each row belongs to the node of its text.
2. Every block of documents reports its distinct shingles to hash buckets and gets back in how many documents each
   occurs. In the global order (rarest first, then by hash), two sets of which neither shares one of its first
   n - ceil(0.8 n) + 1 shingles with the other's cannot overlap enough. A shingle of one document alone can match
   nothing, so a document with that many of them is done: only the others send the non-unique rest of their prefix.
3. Documents that share such a shingle are candidates. A component needs no more than a spanning set of its links,
   so at first each document meets one pivot of its shingles' groups: the one whose parity bitmap (1024 bits, each
   shingle flips one) differs least. Each group draws a pivot. Bits that differ bound the overlap from above:
   |A n B| <= (|A| + |B| - differing bits) / 2. Pairs within the bound are verified by sorted-array intersection.
4. What is left is exact for the rest: in each group, the documents outside the group's largest component are
   tiled, sorted by size, against all documents of the group, in tiles of bounded size. A size that many documents
   share is dealt over several tiles. Tiles meet only where their bands of sizes allow 0.8; of those, pairs of
   different components whose sizes and bitmaps allow 0.8 are verified: in a first pass the closest one of each
   document, which joins most of what belongs together, and then all that are left. No pair is cut off.
5. On demand, links are counted: they lie within components, so each component's distinct texts, sorted by size, meet
   in tiles of bounded bytes; all pairs whose sizes and bitmaps allow 0.8 are verified there, and each text counts as
   many times as there are documents with it. Only sums leave a tile.

Edge cases: a document with fewer words than a shingle is one shingle, the whole sequence; null, empty and blank
texts have no shingles and no links. Every row is judged by its own text: repeated rows are copies of each other, and
rows of one doc_id with different texts are linked only if their texts are. A row without doc_id has its shingles and
links, but its id can't name a component: component_id is the smallest doc_id among all rows that links reach, null if
none of them has one. An empty table gives no rows; further columns are ignored; long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bucket_count, by_bucket, discard, discard_since, lean_worker, packed_texts, scratch_mark, shrink_executors, unpacked, written
from .graph import components

SHINGLE, SHARE = 5, (80, 100)
BITS = 1024
#: Documents of a tile's two sides.
TILE = (512, 2048)
#: Hashes of one side of a tile in which links are counted.
LINK_TILE = 500_000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")


def shingles(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. known: word hashes so far."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "u8")
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], "u8")
    for w in words:
        if w not in known:
            if len(known) > 200_000:
                known.clear()
            known[w] = xxhash.xxh3_64_intdigest(w)
    try:
        h = np.array([known[w] for w in words], "u8")
    except KeyError:  # emptied in between
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], "u8")
    with np.errstate(over="ignore"):
        n = len(h) - SHINGLE + 1
        total = np.zeros(n, "u8")
        for i in range(SHINGLE):  # a scramble after each word, so that the order counts
            total = (total ^ h[i : i + n]) * MULTIPLIERS[i]
            total ^= total >> np.uint64(29)
    return np.unique(total)


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The least intersection of sets of these sizes with 100 * intersection >= 80 * union."""
    return -((-SHARE[0] * (a + b)) // (SHARE[0] + SHARE[1]))


def prefix_length(n: int) -> int:
    return n - -((-SHARE[0] * n) // SHARE[1]) + 1


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity of the shingles on each of BITS places."""
    return np.packbits(np.bincount((hashes >> np.uint64(20)).astype("i8") % BITS, minlength=BITS).astype("u1") & 1).tobytes()


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, for each row of a (m, words) against each of b (n, words)."""
    out = np.zeros((len(a), len(b)), "i4")
    for i in range(a.shape[1]):
        out += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    return out


def text_nodes(blocks: DataFrame) -> DataFrame:
    """(block, key, node): each distinct text's number, and a block that holds it."""
    each = F.transform(F.sequence(F.lit(0), (F.length("keys") / 16).cast("int") - 1), lambda i: F.substr("keys", i * 16 + 1, F.lit(16)))
    keys = blocks.select("block", F.explode(each).alias("key")).groupBy("key").agg(F.min("block").alias("block"))
    return written(keys.select("block", "key", F.monotonically_increasing_id().alias("node")))


def block_sets(row, wanted: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each wanted text of a block with its shingles, once, under its node. wanted: node by key."""
    _, _, starts, data = unpacked(row)
    known: dict[bytes, int] = {}
    left = dict(wanted)
    for k, (i, j) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        node = left.pop(row.keys[16 * k : 16 * k + 16], None)
        if node is not None:
            yield node, shingles(data[i:j], known)


def counted(blocks: DataFrame, nodes: DataFrame, buckets: int) -> DataFrame:
    """Rows (block, bucket, answer): in how many documents (255 at most) each distinct shingle of a block occurs."""

    def ask(key, own: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        names = ["block", "bucket", "shingle", "n"]
        if own.empty or chosen.empty:
            return pd.DataFrame(columns=names)
        sets = [s for _, s in block_sets(next(own.itertuples()), dict(zip(chosen["key"], chosen["node"], strict=True)))]
        h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, "u8"), np.zeros(0))
        _, start = by_bucket(h, buckets)
        n = np.minimum(n, 255).astype("u1")
        # 32 bits below those that choose the bucket: a chance equality only makes a shingle seem less rare, for all alike
        low = (h >> np.uint64(16)).astype("<u4")
        rows = [(key[0], b, low[i:j].tobytes(), n[i:j].tobytes()) for b, (i, j) in enumerate(zip(start[:-1], start[1:], strict=True)) if j > i]
        return pd.DataFrame(rows, columns=names)

    def answer(key, rows: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        sizes = [len(x) for x in rows["n"]]
        h, n = np.concatenate([np.frombuffer(x, "<u4") for x in rows["shingle"]]), np.concatenate([np.frombuffer(x, "u1") for x in rows["n"]])
        _, inverse = np.unique(h, return_inverse=True)
        total = np.minimum(np.bincount(inverse, n), 255).astype("u1")[inverse]
        return pd.DataFrame({"block": rows["block"], "bucket": key[0], "answer": [x.tobytes() for x in np.split(total, np.cumsum(sizes)[:-1])]})

    asked = blocks.groupBy("block").cogroup(nodes.groupBy("block")).applyInPandas(ask, "block string, bucket int, shingle binary, n binary")
    return asked.groupBy("bucket").applyInPandas(answer, "block string, bucket int, answer binary")


def survivors(blocks: DataFrame, nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (id, n, prefix, hashes, bits): every distinct text's set size; the rest for those that may have a link."""

    def run(key, own: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        names = ["id", "n", "prefix", "hashes", "bits"]
        if own.empty or rest.empty:
            return pd.DataFrame(columns=names)
        mine = rest[rest["key"].notna()]
        sets = list(block_sets(next(own.itertuples()), {k: int(n) for k, n in zip(mine["key"], mine["node"], strict=True)}))
        if not sets:
            return pd.DataFrame(columns=names)
        parts = rest[rest["answer"].notna()].sort_values("bucket")["answer"]
        df = np.concatenate([np.frombuffer(x, "u1") for x in parts]) if len(parts) else np.zeros(0, "u1")
        # in how many documents each shingle of each set occurs: answers are in the order of the block's distinct ones
        flat, sizes = np.concatenate([s for _, s in sets]), np.array([len(s) for _, s in sets])
        order, starts = np.argsort(flat), np.cumsum(sizes) - sizes
        new = np.ones(len(flat), bool)
        new[1:] = flat[order[1:]] != flat[order[:-1]]
        often = np.empty(len(flat), "u1")
        often[order] = df[np.cumsum(new) - 1]
        alone = np.diff(np.concatenate([[0], np.cumsum(often == 1)])[np.append(starts, len(flat))])
        rows = []
        for (doc, s), at, ones in zip(sets, starts.tolist(), alone.tolist(), strict=True):
            row = (doc, len(s), None, None, None)
            open_ = prefix_length(len(s)) - ones
            if len(s) and open_ > 0:
                own = often[at : at + len(s)]
                shared = s[own > 1]
                first = shared[np.lexsort((shared, own[own > 1]))[:open_]]
                if len(first):
                    row = (doc, len(s), first.astype("i8"), s.astype("<u8").tobytes(), bitmap(s))
            rows.append(row)
        return pd.DataFrame(rows, columns=names)

    # node travels as text: beside the nulls of the answers, a number would become a float
    none = lambda kind: F.lit(None).cast(kind)
    rest = nodes.select("block", "key", F.col("node").cast("string").alias("node"), none("int").alias("bucket"), none("binary").alias("answer"))
    rest = rest.unionByName(counts.select("block", none("binary").alias("key"), none("string").alias("node"), "bucket", "answer"))
    schema = "id long, n long, prefix array<long>, hashes binary, bits binary"
    return blocks.groupBy("block").cogroup(rest.groupBy("block")).applyInPandas(run, schema)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    of = lambda name: sets.select(F.col("id").alias(name), F.col("hashes").alias(f"_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):  # read in place, as sets can be large
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                keep.append(int((both[1:] == both[:-1]).sum()) >= needed(len(x), len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def closest(rated: DataFrame) -> DataFrame:
    """(a, b): each id of rated(id, pivot, gap) with its pivot of the smallest gap."""
    best = rated.groupBy("id").agg(F.min_by("pivot", F.struct("gap", "pivot")).alias("pivot"))
    return best.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def star_pairs(postings: DataFrame, comp: DataFrame, sets: DataFrame, seed: int) -> DataFrame:
    """For each document the most promising pivot among its shingles' groups, if bound and component allow a link.

    Each group draws a pivot of its own, so that a document of many groups has many to choose from.
    """
    labelled = postings.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    groups = labelled.groupBy("shingle").agg(F.min_by(F.struct("id", "comp"), F.xxhash64("shingle", "id", F.lit(seed))).alias("pivot"), F.count_distinct("comp").alias("comps"))
    met = labelled.join(groups.where("comps > 1"), "shingle").where("comp <> pivot.comp").select("id", F.col("pivot.id").alias("pivot")).distinct()
    light = sets.select("id", "n", "bits")
    near = met.join(light, "id").join(light.withColumnsRenamed({"id": "pivot", "n": "m", "bits": "with"}), "pivot")

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[k]), "u8").reshape(len(batch), -1) for k in ("bits", "with"))
                gap = np.bitwise_count(x ^ y).sum(1).astype("i8")
                n, m = batch["n"].to_numpy(), batch["m"].to_numpy()
                fine = (n + m - gap >= 2 * needed(n, m)) & (np.minimum(n, m) >= needed(n, m))
                yield batch.loc[fine, ["id", "pivot"]].assign(gap=gap[fine])

    return closest(near.mapInPandas(estimate, "id long, pivot long, gap long"))


def tile_pairs(postings: DataFrame, comp: DataFrame, sets: DataFrame, buckets: int, nearest: bool = False) -> DataFrame:
    """All pairs of different components within a group whose sizes and bitmaps allow a link.

    nearest: of these, for each document outside its groups' largest components, the one whose bitmaps differ least.
    """
    labelled = postings.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    sizes = labelled.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"))
    groups = sizes.groupBy("shingle").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("k").alias("k")).where("comps > 1")
    rows = labelled.join(groups, "shingle").join(sets.select("id", "n", "bits"), "id")
    # ranks by size within a group come from counts by size, so that no task sorts a whole group
    by_size = rows.groupBy("shingle", "n").agg(F.sum(F.when(F.col("comp") != F.col("main"), 1).otherwise(0)).alias("minor"), F.count(F.lit(1)).alias("all"))
    below = Window.partitionBy("shingle").orderBy("n")

    def spread(count: str, most: int) -> DataFrame:
        """shingle, n, tile, parts: the first tile of a size, and over how many tiles it is dealt."""
        start = F.floor((F.sum(count).over(below) - F.col(count)) / most).cast("int")
        return by_size.select("shingle", "n", start.alias("tile"), F.greatest(F.lit(1), F.ceil(F.col(count) / most)).cast("int").alias("parts"), F.col(count).alias("_k")).where("_k > 0").drop("_k")

    def bands(sizes: DataFrame) -> DataFrame:
        each = sizes.select("shingle", "n", F.explode(F.sequence("tile", F.col("tile") + F.col("parts") - 1)).alias("tile"))
        return each.groupBy("shingle", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))

    def placed(of: DataFrame, sizes: DataFrame) -> DataFrame:
        return of.join(sizes, ["shingle", "n"]).withColumn("tile", F.col("tile") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    minor_sizes, all_sizes = spread("minor", TILE[0]), spread("all", TILE[1])
    x, y = (bands(sizes).select("shingle", *[F.col(c).alias(f"{side}{c}") for c in ("tile", "lo", "hi")]) for sizes, side in ((minor_sizes, "x"), (all_sizes, "y")))
    met = x.join(y, "shingle").where(f"ylo * {SHARE[0]} <= xhi * {SHARE[1]} AND xlo * {SHARE[0]} <= yhi * {SHARE[1]}").select("shingle", F.col("xtile").alias("x"), F.col("ytile").alias("y"))
    base = ["id", "n", "comp", "bits", "shingle"]
    side = lambda of, sizes, name: placed(of, sizes).withColumnRenamed("tile", name).join(met, ["shingle", name]).select(*base, "x", "y", F.lit(name == "x").alias("left"))
    # tiles are dealt to buckets: small groups share one, and a large group's tiles go to many
    dealt = side(rows.where("comp <> main"), minor_sizes, "x").unionByName(side(rows, all_sizes, "y")).withColumn("bucket", F.pmod(F.xxhash64("shingle", "x", "y"), F.lit(buckets)).cast("int"))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        out = []
        words = np.frombuffer(b"".join(rows["bits"]), "u8").reshape(len(rows), -1)
        ids, n, comp, left = (rows[k].to_numpy() for k in ("id", "n", "comp", "left"))
        for places in rows.groupby(["shingle", "x", "y"], sort=False).indices.values():
            a, b = places[left[places]], places[~left[places]]
            for i in range(0, len(a), TILE[0]):  # a size that many documents share can exceed a tile
                p = a[i : i + TILE[0]]
                for j in range(0, len(b), TILE[1]):
                    q = b[j : j + TILE[1]]
                    need = needed(n[p][:, None], n[q][None, :])
                    fine = (comp[p][:, None] != comp[q][None, :]) & (np.minimum(n[p][:, None], n[q][None, :]) >= need)
                    if not fine.any():
                        continue
                    gap = differing(words[p], words[q])
                    fine &= n[p][:, None] + n[q][None, :] - gap >= 2 * need
                    if nearest:
                        gap = np.where(fine, gap, BITS + 1)
                        x, y = np.arange(len(p)), gap.argmin(1)
                        some = gap[x, y] <= BITS
                        out.append(np.stack([ids[p], ids[q[y]], gap[x, y]], 1)[some])
                    else:
                        x, y = np.nonzero(fine)
                        out.append(np.stack([np.minimum(ids[p[x]], ids[q[y]]), np.maximum(ids[p[x]], ids[q[y]]), np.zeros(len(x), "i8")], 1))
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), "i8")
        return pd.DataFrame(found, columns=["id", "pivot", "gap"])

    found = dealt.groupBy("bucket").applyInPandas(run, "id long, pivot long, gap long")
    return closest(found) if nearest else found.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()


def counted_links(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray, own: bool) -> pd.DataFrame:
    """id and links that the rows at a have with those at b (own: among each other), in documents."""
    both = a if own else np.concatenate([a, b])
    ids, n, w = (rows[k].to_numpy()[both] for k in ("id", "n", "w"))
    words = np.frombuffer(b"".join(rows["bits"].iloc[both]), "u8").reshape(len(both), -1)
    known, flat = np.unique(np.frombuffer(b"".join(rows["hashes"].iloc[both]), "<u8"), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(n)])
    first = 0 if own else len(a)
    mark, total = np.zeros(len(known), "u1"), np.zeros(len(both), "i8")
    for i in range(0, len(a), TILE[0]):
        p = np.arange(i, min(i + TILE[0], len(a)))
        for j in range(i if own else first, len(both), TILE[1]):
            q = np.arange(j, min(j + TILE[1], len(both)))
            need = needed(n[p][:, None], n[q][None, :])
            fine = (np.minimum(n[p][:, None], n[q][None, :]) >= need) & (p[:, None] < q[None, :])
            fine &= n[p][:, None] + n[q][None, :] - differing(words[p], words[q]) >= 2 * need
            for r in np.nonzero(fine.any(1))[0]:
                near, mine = np.nonzero(fine[r])[0], flat[start[p[r]] : start[p[r] + 1]]
                mark[mine] = 1
                if 2 * len(near) > len(q):
                    shared = np.add.reduceat(mark[flat[start[j] : start[q[-1] + 1]]], start[q] - start[j], dtype="i8")[near]
                else:
                    shared = np.array([np.count_nonzero(mark[flat[start[k] : start[k + 1]]]) for k in q[near]])
                mark[mine] = 0
                with_ = q[near[shared >= need[r, near]]]
                total[p[r]] += w[with_].sum()
                total[with_] += w[p[r]]
    return pd.DataFrame({"id": ids, "links": total})


def link_counts(comp: DataFrame, sets: DataFrame, weights: DataFrame, buckets: int, most: int = LINK_TILE) -> DataFrame:
    """id and links, the documents with other texts that each text of a component is linked with. weights: id, w."""
    light = comp.join(sets.select("id", "n"), "id")
    below, mass = Window.partitionBy("comp").orderBy("n"), F.col("k") * F.col("n")
    # tiles follow each other by size; a size with more than one tile's hashes is dealt over several
    by_size = light.groupBy("comp", "n").agg(F.count(F.lit(1)).alias("k"))
    by_size = by_size.select("comp", "n", F.floor((F.sum(mass).over(below) - mass) / most).cast("int").alias("tile"), F.ceil(mass / most).cast("int").alias("parts"))
    spans = by_size.select("comp", "n", F.explode(F.sequence("tile", F.col("tile") + F.col("parts") - 1)).alias("x"))
    tiles = spans.groupBy("comp", "x").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    others = tiles.select("comp", F.col("x").alias("y"), F.col("lo").alias("y_lo"))
    pairs = tiles.join(others, "comp").where(f"x <= y AND hi * {SHARE[1]} >= y_lo * {SHARE[0]}").select("comp", "x", "y")
    sides = pairs.select("*", F.col("x").alias("tile"), F.lit(True).alias("left")).unionByName(pairs.where("x < y").select("*", F.col("y").alias("tile"), F.lit(False).alias("left")))
    members = comp.join(sets.select("id", "n", "hashes", "bits"), "id").join(weights, "id").join(by_size, ["comp", "n"])
    placed = members.withColumn("tile", F.col("tile") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(sides, ["comp", "tile"])
    dealt = placed.select("id", "n", "w", "hashes", "bits", "comp", "x", "y", "left", F.pmod(F.xxhash64("comp", "x", "y"), F.lit(buckets)).cast("int").alias("bucket"))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        out, left = [pd.DataFrame({"id": [], "links": []}, dtype="int64")], rows["left"].to_numpy()
        for (_, x, y), places in rows.groupby(["comp", "x", "y"], sort=False).indices.items():
            a, b = places[left[places]], places[~left[places]]
            if len(a) and (x == y or len(b)):
                out.append(counted_links(rows, a, b, x == y))
        return pd.concat(out)

    return dealt.groupBy("bucket").applyInPandas(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def linked(docs: DataFrame, block_bytes: int = 4_000_000, stars: int = 1, count: bool = False, link_tile: int = LINK_TILE, mark: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    count: also n_links, the number of other documents (doc_ids) that a document is linked with; null without a doc_id.
    mark: also text_md5, and is_first for the one document (doc_id and text) of each component that can stand for it:
    the smallest doc_id; of its texts in the component the one with the smallest md5. Texts without words are all first.
    """
    spark, before = docs.sparkSession, scratch_mark()
    shrink_executors(spark)
    keyed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key")))
    blocks = written(packed_texts(docs, block_bytes, keys=True))
    n = blocks.count()
    buckets = bucket_count(n)
    nodes = text_nodes(blocks)
    counts = written(counted(blocks, nodes, buckets))
    discard(spark)
    sets = written(survivors(blocks, nodes, counts))
    discard(spark, blocks, counts)
    open_ = sets.where("prefix IS NOT NULL")
    postings = open_.select("id", F.explode("prefix").alias("shingle"))
    often = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("shingle")
    postings = written(postings.join(often, "shingle"))
    # no rows yet; made by the JVM, as rows from Python would need workers beside those of the functions here
    links = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    comp = spark.range(0).select("id", F.col("id").alias("comp"))
    for step in range(stars + 2):
        pairs = star_pairs(postings, comp, open_, step) if step < stars else tile_pairs(postings, comp, open_, max(256, buckets), nearest=step == stars)
        found = written(verified(pairs, open_))
        links = links.unionByName(found)
        comp = components(links)
        discard(spark)  # verification shuffles the sets, anew in each step
    # a text's rows, and the smallest doc_id of all rows of its component
    texts = nodes.select("key", F.col("node").alias("id")).join(sets.select("id", "n"), "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    rows = keyed.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("_rows")).groupBy("key").agg(F.min("doc_id").alias("_least"), F.count("doc_id").alias("_ids"))
    texts = written(texts.join(rows, "key"))
    still_read = [keyed, texts]
    least = texts.groupBy("comp").agg(F.min("_least").alias("_comp"), F.min_by("key", F.struct(F.col("_least").isNull(), "_least", "key")).alias("_first"))
    named, extra = texts.join(least, "comp"), []
    if count:
        others = written(link_counts(comp, open_, texts.select("id", F.col("_ids").alias("w")), max(256, buckets), link_tile))
        still_read.append(others)
        named = named.join(others, "id", "left").withColumn("_links", F.coalesce("links", F.lit(0)) + F.col("_ids") - 1)
        extra = ["_links"]
    discard_since(spark, before, *still_read)  # sets, postings and labels go before the result is read
    discard(spark)
    named = named.select("key", F.col("n").alias("_n"), "_comp", "_first", *extra)
    # a text without words links with nothing, not even its copies
    out = keyed.join(named, "key", "left").withColumn("n_shingles", F.coalesce("_n", F.lit(0)).cast("long"))
    if count:
        extra = [F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("_links")).otherwise(0)).cast("long").alias("n_links")]
    if mark:
        first = (F.col("n_shingles") == 0) | ((F.col("key") == F.col("_first")) & F.col("doc_id").eqNullSafe(F.col("_comp")))
        extra = [*extra, F.lower(F.hex("key")).alias("text_md5"), first.alias("is_first")]
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_comp")).otherwise(F.col("doc_id")).alias("component_id"), *extra)
