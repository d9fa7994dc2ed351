"""Log-likelihood of whole documents under a gated recurrent language model.

Words fall into leaves: the commonest words are leaves of their own, all others share a leaf with the words of the
same (hashed) three-byte ending. Leaves are dealt to classes. With the state h of a gated recurrent unit,

    P(word | before) = P(class | h) * P(leaf | class, h) * P(word | leaf)

the first two factors are the class-factored softmax, the last is (c + 0.5) / (N_leaf + 0.5 * (V_leaf + 1)) from
the counts of all training tokens; one more word of each leaf stands for all unknown ones. A document starts from
a zero state, and its state is carried across windows to its end, for training (truncated backpropagation within
a window) as for scoring. Every training token is trained on once.

How it is laid out: documents are dealt to partitions and ordered by a hash of id and text, so that blocks, and with
them the model, depend on the rows alone and not on how the input is split or on which task was retried. Each partition
packs its documents into numbered blocks of token numbers; blocks send their distinct words (hash, count) to hash
buckets, which add up and answer each block with the total counts; from then on a block is a row of leaf numbers.
Training is data-parallel: groups of GROUP blocks with neighbouring numbers train in the order of their numbers, the
weights are averaged by tokens in a fixed tree of sums, in two rounds (a first share of the blocks, then the rest from
the first average).

Edge cases: null and empty texts are one end token; a null doc_id counts as training text; repeated rows count as
often as they occur; an empty table gives no rows; without training text all counts are 0 and every token is
unknown; further columns are ignored. Words are counted by their 64-bit hashes.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_count, by_bucket, discard, written

SINGLES, RARE = 512, 164
CLASSES = LEAVES_PER_CLASS = 26  # CLASSES * LEAVES_PER_CLASS == SINGLES + RARE
LEAVES = SINGLES + RARE
HIDDEN = 16
END_HASH = 1
BLOCK_TOKENS = 1_500_000
#: Blocks of a training group, the blocks of which one is in the first round, and groups added up at once.
GROUP, FIRST, SUMMED = 4, 6, 64
LOG10 = np.log(10.0)


def is_held_out(doc_id: int | None, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(int(doc_id)).encode()) % fold == 1


def tokens_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split touch ASCII only: A-Z, and space with \\t \\n \\v \\f \\r."""
    return (text or "").encode().lower().split()


# ---- blocks of token numbers and their words' counts


def partition_count(total_bytes: int) -> int:
    """Partitions for texts of so many bytes; it depends on the data alone."""
    return max(4, min(total_bytes // 8_000_000, 512), total_bytes // 500_000_000)


def packed_blocks(docs: DataFrame, fold: int) -> DataFrame:
    """Rows (number, ids, present, lengths, held, tokens, hashes, rare, counts): documents as numbers of the block's words.

    Word 0 is the end. counts are those of training documents.
    """
    parts = partition_count(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("_place"))
    rows = rows.repartition(parts, "_place").sortWithinPartitions("_place", "doc_id", "text")
    kinds = [pa.int64()] + [pa.binary()] * 8
    names = ["number", "ids", "present", "lengths", "held", "tokens", "hashes", "rare", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        ids: list[int | None] = []
        pieces: list[np.ndarray] = []
        total = 0

        def out() -> pa.RecordBatch:
            words = list(known)
            tokens = np.concatenate(pieces)
            lengths = np.array([len(p) for p in pieces], "<i8")
            held = np.array([is_held_out(i, fold) for i in ids])
            counts = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(words) + 1).astype("<i8")
            hashes = np.array([END_HASH, *map(xxhash.xxh3_64_intdigest, words)], "<u8")
            rare = np.array([0, *(zlib.crc32(w[-3:]) % RARE for w in words)], "<u2")
            present = np.array([i is not None for i in ids])
            arrays = [np.array([i or 0 for i in ids], "<i8"), present, lengths, held, tokens.astype("<u4"), hashes, rare, counts]
            row = [made * parts + part, *(x.tobytes() for x in arrays)]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                words = tokens_of(batch.column(1)[i].as_py())
                get = known.setdefault
                numbers = [get(w, len(known) + 1) for w in words]
                numbers.append(0)
                ids.append(batch.column(0)[i].as_py())
                pieces.append(np.array(numbers, "u4"))
                total += len(numbers)
                if total >= BLOCK_TOKENS:
                    yield out()
                    made, known, ids, pieces, total = made + 1, {}, [], [], 0
        if ids:
            yield out()

    return rows.select("doc_id", "text").mapInArrow(run, "number long, " + ", ".join(f"{n} binary" for n in names[1:]))


def word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """Rows (kind, number, bucket, answer, n, v, rare_n, rare_v, top, top_n).

    kind 'a' answers a block with the total counts of its words in a bucket, in its own order; kind 's' has a
    bucket's sums: tokens and words, the same by rare leaf, and its commonest words.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                hashes, rare, counts = np.frombuffer(r.hashes, "<u8"), np.frombuffer(r.rare, "<u2"), np.frombuffer(r.counts, "<i8")
                order, start = by_bucket(hashes, buckets)
                hashes, rare, counts = hashes[order], rare[order], counts[order]
                rows = [(r.number, b, hashes[i:j].tobytes(), rare[i:j].tobytes(), counts[i:j].astype("<u4").tobytes()) for b, (i, j) in enumerate(zip(start[:-1], start[1:], strict=True)) if j > i]
                yield pd.DataFrame(rows, columns=["number", "bucket", "h", "r", "c"])

    def add(key, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // 8 for x in rows["h"]]
        h, r, c = (np.concatenate([np.frombuffer(x, kind) for x in rows[name]]) for name, kind in (("h", "<u8"), ("r", "<u2"), ("c", "<u4")))
        words, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(inverse, c).astype("i8")
        answers = np.split(total[inverse], np.cumsum(sizes)[:-1])
        rare, seen = r[first], total > 0
        word = seen & (words != END_HASH)
        top = np.lexsort((words, -total))[: SINGLES - 1]
        top = top[word[top]]
        sums = {"n": int(total.sum()), "v": int(seen.sum()), "rare_n": np.bincount(rare[word], total[word], RARE).astype("i8"), "rare_v": np.bincount(rare[word], minlength=RARE)}
        sums |= {"top": words[top].astype("i8"), "top_n": total[top], "top_rare": rare[top].astype("i4")}
        out = [{"kind": "a", "number": b, "bucket": key[0], "answer": a.astype("<i8").tobytes()} for b, a in zip(rows["number"], answers, strict=True)]
        names = ["kind", "number", "bucket", "answer", *sums]
        rows = [[x.get(k) for k in names] for x in (*out, {"kind": "s", "bucket": key[0], **sums})]
        return pd.DataFrame(rows, columns=names, dtype=object).astype({"number": "Int64", "n": "Int64", "v": "Int64"})

    asked = blocks.select("number", "hashes", "rare", "counts").mapInPandas(ask, "number long, bucket int, h binary, r binary, c binary")
    schema = "kind string, number long, bucket int, answer binary, n long, v long, rare_n array<long>, rare_v array<long>, top array<long>, top_n array<long>, top_rare array<int>"
    return asked.groupBy("bucket").applyInPandas(add, schema)


class Leaves:
    """Which leaf a word is in, and the sizes of leaves: everything of a bounded number of numbers."""

    def __init__(self, counts: DataFrame):
        sums = counts.where("kind = 's'")
        self.n, self.v = (x or 0 for x in sums.agg(F.sum("n"), F.sum("v")).first())
        each = lambda name: sums.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        rare_n, rare_v = np.zeros(RARE), np.zeros(RARE)
        for r in each("rare_n"):
            rare_n[r.i] = r.x
        for r in each("rare_v"):
            rare_v[r.i] = r.x
        top = sums.select(F.explode(F.arrays_zip("top", "top_n", "top_rare")).alias("x")).select("x.*").orderBy(F.col("top_n").desc(), "top").limit(SINGLES - 1).collect()
        for r in top:  # a word with a leaf of its own leaves the shared one
            rare_n[r.top_rare] -= r.top_n
            rare_v[r.top_rare] -= 1
        self.words = np.array([END_HASH, *(r.top % 2**64 for r in top)], "u8")
        self.order = np.argsort(self.words)
        self.rare_n, self.rare_v = rare_n, rare_v
        single_n = np.zeros(SINGLES)
        single_n[: len(self.words)] = [self.n - sum(r.top_n for r in top) - rare_n.sum(), *(r.top_n for r in top)]
        self.sizes = np.concatenate([single_n, rare_n])

    def of(self, hashes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, hashes, sorter=self.order).clip(0, len(self.words) - 1)
        found = self.order[at]
        return np.where(self.words[found] == hashes, found, SINGLES + rare).astype("<u2")

    def within(self, leaf: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(word | leaf); 0 for a leaf of one word."""
        i = np.maximum(leaf.astype(int) - SINGLES, 0)
        return np.where(leaf < SINGLES, 0.0, np.log10((c + 0.5) / (self.rare_n[i] + 0.5 * (self.rare_v[i] + 1))))


def leafed_blocks(blocks: DataFrame, counts: DataFrame, leaves: Leaves, buckets: int) -> DataFrame:
    """Rows (number, ids, present, lengths, held, leaf, known, base, inner): a block as leaf numbers, with what counts alone give."""
    n, v = leaves.n, leaves.v

    def run(key, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["number", "ids", "present", "lengths", "held", "leaf", "known", "base", "inner"]
        if own.empty:
            return pd.DataFrame(columns=names)
        r = own.iloc[0]
        hashes, rare, tokens, lengths = np.frombuffer(r.hashes, "<u8"), np.frombuffer(r.rare, "<u2"), np.frombuffer(r.tokens, "<u4"), np.frombuffer(r.lengths, "<i8")
        order, _ = by_bucket(hashes, buckets)
        c = np.empty(len(hashes), "i8")
        c[order] = np.concatenate([np.frombuffer(x, "<i8") for x in answers.sort_values("bucket")["answer"]])
        leaf = leaves.of(hashes, rare)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        summed = lambda x: np.add.reduceat(x[tokens], starts)
        base = summed(np.log10((c + 0.5) / (n + 0.5 * (v + 1))))
        row = [r.number, r.ids, r.present, r.lengths, r.held, leaf[tokens].tobytes(), summed((c > 0).astype("i8")).tobytes(), base.tobytes(), summed(leaves.within(leaf, c)).tobytes()]
        return pd.DataFrame([row], columns=names)

    answers = counts.where("kind = 'a'").select("number", "bucket", "answer")
    schema = "number long, ids binary, present binary, lengths binary, held binary, leaf binary, known binary, base binary, inner binary"
    return blocks.drop("counts").groupBy("number").cogroup(answers.groupBy("number")).applyInPandas(run, schema)


# ---- the network


class Network:
    """A minimal gated unit over leaves with a class-factored softmax, in numpy.

    f = sigmoid(Xf[in] + h Uf), n = softsign(Xn[in] + (f h) Un), h = h + f (n - h)
    """

    NAMES = ("x", "uf", "un", "cw", "cb", "lw", "lb")
    SHAPES = ((LEAVES, 2 * HIDDEN), (HIDDEN, HIDDEN), (HIDDEN, HIDDEN), (HIDDEN, CLASSES), (CLASSES,), (CLASSES, HIDDEN, LEAVES_PER_CLASS), (CLASSES, LEAVES_PER_CLASS))

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, sizes: np.ndarray, seed: int = 1) -> Network:
        """Small random weights; the output's intercepts give the leaves' frequencies."""
        rng = np.random.default_rng(seed)
        p = {k: rng.normal(0, 0.1, s).astype("f4") for k, s in zip(cls.NAMES, cls.SHAPES, strict=True)}
        # leaf i is member i // CLASSES of class i % CLASSES: classes of about equal frequency
        table = (sizes + 0.5).reshape(LEAVES_PER_CLASS, CLASSES).T
        p["lb"], p["cb"] = np.log(table).astype("f4"), np.log(table.sum(1)).astype("f4")
        p["x"][:, :HIDDEN] -= 1  # slow updates at first
        return cls(p)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    @classmethod
    def of_flat(cls, flat: np.ndarray) -> Network:
        p, i = {}, 0
        for k, s in zip(cls.NAMES, cls.SHAPES, strict=True):
            p[k], i = flat[i : i + int(np.prod(s))].reshape(s).astype("f4"), i + int(np.prod(s))
        return cls(p)

    def states(self, inputs: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step of a window (steps, lanes); an end as input starts from zero. Fills keep for backward."""
        p, out = self.p, np.empty((*inputs.shape, HIDDEN), "f4")
        into, fresh_all = p["x"][inputs], (inputs != 0).astype("f4")[:, :, None]
        with np.errstate(over="ignore"):
            for t in range(len(inputs)):
                h = h * fresh_all[t]
                f = h @ p["uf"]
                f += into[t, :, :HIDDEN]
                np.negative(f, out=f)
                np.exp(f, out=f)
                f += 1
                np.reciprocal(f, out=f)
                g = f * h
                n = g @ p["un"]
                n += into[t, :, HIDDEN:]
                n /= np.abs(n) + 1
                if keep is not None:
                    keep.append((fresh_all[t], h, f, g, n))
                h = h + f * (n - h)
                out[t] = h
        return out

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        """Natural log P(leaf | state) of each row; with grads also d(sum of -log P) / d(state), filling the output's gradients."""
        p, cls, member = self.p, (targets % CLASSES).astype("u1"), targets // CLASSES
        order = np.argsort(cls, kind="stable")
        cls, member, at = cls[order], member[order], np.arange(len(order))
        cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
        s = np.ascontiguousarray(states[order].T)  # (HIDDEN, rows) by class: sums over classes and members run along rows

        def softmax(w: np.ndarray, b: np.ndarray, x: np.ndarray, picked: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            """log P of the picked ones, and d(-log P) / d(logits) if gradients are wanted."""
            z = w.T @ x
            z += b[:, None]
            z -= z.max(0)
            of = z[picked, places]
            np.exp(z, out=z)
            total = z.sum(0)
            if grads is not None:
                z /= total
                z[picked, places] -= 1
            return of - np.log(total), z

        logp, d = softmax(p["cw"], p["cb"], s, cls, at)
        if grads is not None:
            grads["cw"], grads["cb"], back = s @ d.T, d.sum(1), p["cw"] @ d
            grads["lw"], grads["lb"] = np.zeros_like(p["lw"]), np.zeros_like(p["lb"])
        for c in range(CLASSES):
            i, j = cuts[c], cuts[c + 1]
            if i == j:
                continue
            own, d = softmax(p["lw"][c], p["lb"][c], s[:, i:j], member[i:j], at[: j - i])
            logp[i:j] += own
            if grads is not None:
                grads["lw"][c], grads["lb"][c] = s[:, i:j] @ d.T, d.sum(1)
                back[:, i:j] += p["lw"][c] @ d
        out = np.empty_like(logp)
        out[order] = logp
        if grads is None:
            return out
        d_states = np.empty_like(states)
        d_states[order] = back.T
        return out, d_states

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean loss over a window, the state after it, and the summed loss. real: places that hold tokens."""
        p, keep, grads = self.p, [], {}
        states = self.states(inputs, h, keep)
        flat = np.nonzero(real.ravel())[0]
        logp, back = self.log_probs(states.reshape(-1, HIDDEN)[flat], targets.ravel()[flat], grads)
        d_out = np.zeros((real.size, HIDDEN), "f4")
        d_out[flat] = back
        d_out = d_out.reshape(*real.shape, HIDDEN)
        daf, du = np.empty_like(d_out), np.empty_like(d_out)
        dh = np.zeros_like(h)
        for t in range(len(inputs) - 1, -1, -1):
            fresh, before, f, g, n = keep[t]
            dh += d_out[t]
            df = dh * (n - before)
            slope = 1 - np.abs(n)
            du[t] = dh * f * slope * slope
            dg = du[t] @ p["un"].T
            df += dg * before
            daf[t] = df * f * (1 - f)
            dh = (dh * (1 - f) + dg * f + daf[t] @ p["uf"].T) * fresh
        join = lambda i: np.concatenate([k[i] for k in keep])
        grads["uf"] = join(1).T @ daf.reshape(-1, HIDDEN)
        grads["un"] = join(3).T @ du.reshape(-1, HIDDEN)
        both = np.concatenate([daf.reshape(-1, HIDDEN), du.reshape(-1, HIDDEN)], 1)
        order = np.argsort(inputs.ravel(), kind="stable")
        first = np.concatenate([[0], np.nonzero(np.diff(inputs.ravel()[order]))[0] + 1])
        grads["x"] = np.zeros_like(p["x"])
        grads["x"][inputs.ravel()[order[first]]] = np.add.reduceat(both[order], first, axis=0)
        for k in grads:
            grads[k] = grads[k] / max(1, len(flat))
        return grads, states[-1], float(-logp.sum())


def lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first to the shortest lane; lanes in descending order of length."""
    heap = [(0, i) for i in range(max(1, min(most, len(lengths))))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable"):
        total, lane = heap[0]
        out[lane].append(int(d))
        heapq.heapreplace(heap, (total + int(lengths[d]), lane))
    return sorted(out, key=lambda x: -sum(int(lengths[d]) for d in x))


def woven(leaf: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets and their document (steps, lanes), and each lane's length. Shorter lanes are padded with document -1."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    dealt = lanes(lengths, most)
    total = np.array([sum(int(lengths[d]) for d in x) for x in dealt])
    targets, docs = np.zeros((total.max(), len(dealt)), "i4"), np.full((total.max(), len(dealt)), -1, "i4")
    for i, lane in enumerate(dealt):
        targets[: total[i], i] = np.concatenate([leaf[starts[d] : starts[d + 1]] for d in lane])
        docs[: total[i], i] = np.repeat(lane, lengths[lane])
    return targets, docs, total


def shifted(targets: np.ndarray) -> np.ndarray:
    """Inputs: the token before; the end (0) at the start of a lane, as after a document."""
    return np.concatenate([np.zeros((1, targets.shape[1]), targets.dtype), targets[:-1]])


class Trainer:
    """Adam over windows; the learning rate falls with the number of updates."""

    def __init__(self, network: Network, rate: float):
        self.net, self.rate, self.t = network, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in network.p.items()}

    def block(self, leaf: np.ndarray, lengths: np.ndarray, window: int = 24) -> None:
        targets, docs, total = woven(leaf, lengths, int(np.clip(len(leaf) // 8000, 8, 256)))
        inputs, h = shifted(targets), np.zeros((targets.shape[1], HIDDEN), "f4")
        for i in range(0, len(targets), window):
            live = int((total > i).sum())
            grads, h, _ = self.net.gradients(inputs[i : i + window, :live], targets[i : i + window, :live], docs[i : i + window, :live] >= 0, h[:live])
            self.t += 1
            rate = self.rate / (1 + self.t / 400) ** 0.5
            for k, g in grads.items():
                self.m[k] += 0.1 * (g - self.m[k])
                self.s[k] += 0.01 * (g * g - self.s[k])
                step = rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-8)
                self.net.p[k] = self.net.p[k] - step.astype("f4")


def block_scores(net: Network, leaf: np.ndarray, lengths: np.ndarray, window: int = 64) -> np.ndarray:
    """log10 P of each document's leaves."""
    targets, docs, total = woven(leaf, lengths, 512)
    inputs, h, out = shifted(targets), np.zeros((targets.shape[1], HIDDEN), "f4"), np.zeros(len(lengths))
    for i in range(0, len(targets), window):
        live = int((total > i).sum())
        states = net.states(inputs[i : i + window, :live], h[:live])
        h, where = states[-1], docs[i : i + window, :live].ravel()
        real = where >= 0
        logp = net.log_probs(states.reshape(-1, HIDDEN)[real], targets[i : i + window, :live].ravel()[real])
        out += np.bincount(where[real], logp.astype("f8"), len(lengths))
    return out / LOG10


def trained(blocks: DataFrame, leaves: Leaves, rate: float) -> Network:
    """One pass over all training documents in two rounds of data-parallel training."""
    net, number = Network.fresh(leaves.sizes), F.col("number")
    n_blocks = (blocks.agg(F.max("number")).first()[0] or 0) + 1
    rounds = ((number % FIRST == 0, FIRST * GROUP), (number % FIRST != 0, GROUP + 1))
    for chosen, span in rounds:  # fit is sent with the start of its round
        start, groups = net.flat(), -(-n_blocks // span)

        def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            own, seen = Trainer(Network.of_flat(start), rate), 0
            for r in rows.sort_values("number").itertuples():
                lengths, held, leaf = np.frombuffer(r.lengths, "<i8"), np.frombuffer(r.held, "?"), np.frombuffer(r.leaf, "<u2")
                if not held.all():
                    own.block(leaf[np.repeat(~held, lengths)].astype("i4"), lengths[~held])
                    seen += int(lengths[~held].sum())
            params = (own.net.flat().astype("<f8") * seen).tobytes()
            return pd.DataFrame({"group": [key[0]], "weight": [float(seen)], "params": [params]})

        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("group")
            total = sum(np.frombuffer(x, "<f8") for x in rows["params"])
            return pd.DataFrame({"group": [key[0]], "weight": [rows["weight"].sum()], "params": [total.tobytes()]})

        schema = "group long, weight double, params binary"
        slim = blocks.where(chosen).select("number", "lengths", "held", "leaf", F.floor(number / span).alias("group"))
        # by ranges, as hashes would put several groups into one task
        sums = slim.repartitionByRange(groups, "group").groupBy("group").applyInPandas(fit, schema)
        while groups > SUMMED:
            groups = -(-groups // SUMMED)
            sums = sums.groupBy(F.floor(F.col("group") / SUMMED).alias("key")).applyInPandas(add, schema)
        rows = sorted((r for r in sums.collect() if r.weight), key=lambda r: r.group)  # at most SUMMED rows
        if rows:
            net = Network.of_flat(sum(np.frombuffer(r.params, "<f8") for r in rows) / sum(r.weight for r in rows))
    return net


def fitted(docs: DataFrame, fold: int = 5, rate: float = 0.02) -> tuple[DataFrame, Leaves, Network]:
    """The blocks of leafed_blocks, the leaves and the network that was trained on them."""
    spark = docs.sparkSession
    blocks = written(packed_blocks(docs, fold))
    buckets = bucket_count(blocks.count())
    counts = written(word_counts(blocks, buckets))
    discard(spark)
    leaves = Leaves(counts)
    ready = written(leafed_blocks(blocks, counts, leaves, buckets))
    discard(spark, blocks, counts)
    return ready, leaves, trained(ready, leaves, rate)


def score_documents(docs: DataFrame, fold: int = 5, rate: float = 0.02) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document."""
    ready, leaves, net = fitted(docs, fold, rate)
    flat, n = net.flat(), int(leaves.n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network.of_flat(flat)
        for batch in batches:
            for r in batch.itertuples():
                lengths = np.frombuffer(r.lengths, "<i8")
                score = block_scores(net, np.frombuffer(r.leaf, "<u2").astype("i4"), lengths) + np.frombuffer(r.inner, "<f8")
                present = np.frombuffer(r.present, "?")
                out = {"doc_id": pd.Series(np.frombuffer(r.ids, "<i8")).astype("Int64").mask(~present), "held_out": np.frombuffer(r.held, "?"), "n_tokens": lengths, "n_known": np.frombuffer(r.known, "<i8")}
                yield pd.DataFrame(out | {"train_tokens": n, "base_score": np.frombuffer(r.base, "<f8"), "score": score})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return ready.mapInPandas(run, schema)
