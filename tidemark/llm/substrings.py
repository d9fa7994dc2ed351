"""Exact removal of long byte strings that an earlier document holds, by a hash-compared suffix sort.

Any 50-byte string holds 31 strings of 20 bytes; the one with the smallest hash (the leftmost, if equal) is its
anchor. Equal strings have equal anchors at equal places, so strings need comparing only within the group of an
anchor. The starts with one anchor form a run, and the run's bytes (at most 80) are its span.

1. Each block of documents reports its distinct (anchor, span hash) pairs with the smallest document of each, in
   arrays dealt to buckets by the anchor's hash. A bucket answers 1 where a smaller document seems to have the same
   span, 2 where this is the first document of its span but the anchor has other spans too, 3 where it is the first
   and only others' copies of this very span exist, and 0 for spans that are alone.
2. Blocks send the bytes of all spans but those answered 0, once each. Spans answered 1 are compared with the bytes of
   the first holder's span. The spans answered 2 are sorted within the groups of an anchor by a mergesort: once by the
   suffix that starts with the anchor, once by what is before it, read backwards. A comparison takes logarithmic time:
   prefix polynomial hashes and binary search find the common extension, and the next byte decides. Neighbours' bytes
   are compared once more; they give the exact common lengths, and with these the equal strings at each distance from
   the anchor. In a group that collided hashes had put in a wrong order every string is sorted, and if need be by its
   bytes. Where one span's hash had collided, all spans of its anchor are sorted, too. The answer says which strings of
   a span a smaller document holds.
3. Blocks mark the bytes to remove.

Every removal thus rests on bytes that were compared: hashes only say what to compare.

Edge cases: null and empty texts have no bytes and get a row; a null doc_id is compared with nothing; rows of the
same doc_id are one document as far as "smaller" goes, so repeated rows don't remove each other; an empty table
gives no rows; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_count, by_bucket, discard, lean_worker, packed_texts, shrink_executors, unpacked, written

LENGTH, ANCHOR = 50, 20
WINDOW = LENGTH - ANCHOR + 1
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MOST_SPAN = LENGTH + WINDOW - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Polynomial:
    """Hashes of any substring from prefix sums of x[i] * base^i modulo 2^64; base is odd and so has an inverse."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        n = len(data) + 1
        if base not in self._powers or len(self._powers[base][0]) < n:
            with np.errstate(over="ignore"):
                up = np.full(max(n, CHUNK + 1), np.uint64(base))
                down = np.full(len(up), np.uint64(pow(base, -1, 2**64)))
                up[0] = down[0] = 1
                self._powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        up, self.down = self._powers[base]
        self.sums = np.zeros(n, "u8")
        table = mixed(np.arange(256, dtype="u8") + np.uint64(base & 0xFFFF))
        np.cumsum(table[data] * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


RUN = ("doc", "first", "last", "anchor_at", "anchor", "span")


def runs(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of starts with one anchor, of all documents: doc, first and last start, anchor place, hashes.

    starts: where documents start in data (one more than documents).
    """
    out: list[dict[str, np.ndarray]] = []
    doc = 0
    while doc < len(starts) - 1:
        # whole documents up to about CHUNK bytes
        end = max(doc + 1, int(np.searchsorted(starts, starts[doc] + CHUNK, "right")) - 1)
        own = data[starts[doc] : starts[end]]
        if len(own) >= LENGTH:
            out.append(_runs(own, starts[doc : end + 1] - starts[doc], doc, int(starts[doc])))
        doc = end
    return {k: np.concatenate([x[k] for x in out]) if out else np.zeros(0, "u8" if k in ("anchor", "span") else "i8") for k in RUN}


def _runs(own: np.ndarray, starts: np.ndarray, doc: int, offset: int) -> dict[str, np.ndarray]:
    with np.errstate(over="ignore"):
        poly, n = Polynomial(own, BASE), len(own)
        grams = mixed((poly.sums[ANCHOR:] - poly.sums[:-ANCHOR]) * poly.down[: n - ANCHOR + 1])
        bits = np.uint64(max(21, int(n).bit_length()))
        low = (grams >> bits << bits) | np.arange(len(grams), dtype="u8")  # leftmost among equal hashes
        size = 1
        while size < WINDOW:  # minima over windows of doubled size
            step = min(size, WINDOW - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        # a string fits if it ends within its document; strings that don't fit part the runs of two documents
        fits, some = np.ones(n, bool), starts[1:] > starts[:-1]
        fits[np.maximum(starts[1:][some, None] - 1 - np.arange(LENGTH - 1), starts[:-1][some, None]).ravel()] = False
        fits = fits[: len(low)]
        same = (low[1:] == low[:-1]) & fits[1:] & fits[:-1]
        first = np.nonzero(fits & np.concatenate([[True], ~same]))[0]
        last = np.nonzero(fits & np.concatenate([~same, [True]]))[0]
        at = (low[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype("i8")
        length = last - first + LENGTH
        shape = length.astype("u8") * np.uint64(128) + (at - first).astype("u8")
        of = np.searchsorted(starts, first, "right") - 1
        return {"doc": of + doc, "first": first + offset, "last": last + offset, "anchor_at": at + offset, "anchor": mixed(grams[at]), "span": mixed(poly.of(first, length) + shape)}


def sorted_by(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """The lexicographic order: one sort by the first key, and by all keys only where it is equal."""
    order = np.argsort(first)
    same = first[order[1:]] == first[order[:-1]]
    tied = np.nonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))[0] if len(order) else order
    some = np.sort(order[tied])
    order[tied] = some[np.lexsort(tuple(k[some] for k in (*rest[::-1], first)))]
    return order


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys differ from those before; the first place does."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def equal_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, x_size: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Whether the bytes at x and y are the same."""
    out, reach = x_size == y_size, np.arange(MOST_SPAN, dtype="u1")
    spans = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(MOST_SPAN, "u1")]), MOST_SPAN)
    for i in range(0, len(x), 20_000):
        s = slice(i, i + 20_000)
        out[s] &= ~((spans[x[s]] != spans[y[s]]) & (reach < x_size[s, None].astype("u1"))).any(1)
    return out


def distinct_runs(r: dict[str, np.ndarray], data: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct spans of a block in order of (anchor, span): a run of each; each run's number; the smallest documents.

    Runs of one number have the same bytes; should a hash collide, its spans get numbers of their own.
    """
    size, extra = r["last"] - r["first"] + LENGTH, None
    while True:
        keys = (r["anchor"], r["span"], *(() if extra is None else (extra,)))
        order = sorted_by(*keys)
        new = changes(*(k[order] for k in keys))
        number = np.empty(len(order), "i8")
        number[order] = np.cumsum(new) - 1
        some = order[new]
        again = order[~new]
        first = some[number[again]]
        wrong = again[~equal_bytes(data, r["first"][again], r["first"][first], size[again], size[first])]
        if not len(wrong):
            docs = ids[r["doc"][order]]
            return some, number, np.minimum.reduceat(docs, np.nonzero(new)[0]) if len(docs) else docs
        extra = np.zeros(len(order), "i8")
        for g in np.unique(number[wrong]):
            own = np.nonzero(number == g)[0]
            texts = [data[x : x + n].tobytes() for x, n in zip(r["first"][own], size[own], strict=True)]
            extra[own] = np.unique(np.array(texts, object), return_inverse=True)[1]


def block_runs(row) -> tuple:
    ids, present, starts, raw = unpacked(row)
    data = np.frombuffer(raw, "u1")
    r = runs(data, starts)
    mine = present[r["doc"]]
    if not mine.all():
        r = {k: v[mine] for k, v in r.items()}
    return ids, starts, data, r, *distinct_runs(r, data, ids)


def packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit numbers, or their differences, by byte planes and compressed."""
    x = x.astype("<u8")
    if ascending and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    return zstandard.compress(x.view("u1").reshape(-1, 8).T.tobytes(), 1)


def opened(x: bytes, ascending: bool = False) -> np.ndarray:
    out = np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), "u1").reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(out, dtype="u8") if ascending else out


# ---- the suffix sort of step 2


def common(poly: Polynomial, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix, up to LENGTH, of the strings at x and y: binary search over prefix hashes."""
    low, high = np.zeros(len(x), "i8"), np.full(len(x), LENGTH)
    sums, x0, y0, x1, y1 = poly.sums, poly.sums[x], poly.sums[y], poly.down[x], poly.down[y]
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (sums[x + mid] - x0) * x1 == (sums[y + mid] - y0) * y1
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def less(data: np.ndarray, poly: Polynomial, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the string at x is before the one at y."""
    n = common(poly, x, y)
    near = np.minimum(n, LENGTH - 1)
    return (n < LENGTH) & (data[x + near] < data[y + near])


def suffix_order(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A stable mergesort of the strings at `at` within groups (group is ascending), all merges of a level at once."""
    poly, n = Polynomial(data, BASE), len(at)
    begin = np.searchsorted(group, group, "left")
    size = np.searchsorted(group, group, "right") - begin
    place = np.arange(n) - begin
    held, width = np.arange(n), 1
    while n and width < size.max():
        run = place // width
        other = (run ^ 1) * width
        low, high = np.minimum(other, size), np.minimum(other + width, size)
        todo, left = np.nonzero(high > low)[0], run % 2 == 0
        lo, hi = low[todo].copy(), high[todo].copy()
        while len(todo) and (lo < hi).any():  # how many of the other run come before
            open_ = np.nonzero(lo < hi)[0]
            mid = (lo[open_] + hi[open_]) // 2
            x, y = at[held[todo[open_]]], at[held[begin[todo[open_]] + mid]]
            mine = left[todo[open_]]
            # of equal strings those of the left run come first
            before = np.where(mine, less(data, poly, y, x), ~less(data, poly, x, y))
            lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
        moved = held.copy()
        new = begin[todo] + np.minimum(run[todo], run[todo] ^ 1) * width + (place[todo] - run[todo] * width) + (lo - low[todo])
        moved[new] = held[todo]
        held, width = moved, width * 2
    return held


def ordered(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """suffix_order, how many bytes each string shares with the one before it (0 at a group's start), and misled groups.

    The bytes of neighbours are compared: where they are in order, so is the group; elsewhere hashes had collided.
    """
    order, reach = suffix_order(data, at, group), np.arange(LENGTH)
    # comparisons that contradict each other may lose strings
    lost = group[np.bincount(order, minlength=len(order)) != 1]
    again = np.nonzero(np.isin(group, lost))[0] if len(lost) else lost
    order[again] = again
    shared, wrong = np.zeros(len(order), "i8"), [lost]
    places = np.nonzero(group[order[1:]] == group[order[:-1]])[0] + 1
    for i in range(0, len(places), 100_000):
        some = places[i : i + 100_000]
        x, y = data[at[order[some - 1], None] + reach], data[at[order[some], None] + reach]
        differ = x != y
        n = np.where(differ.any(1), differ.argmax(1), LENGTH)
        near, row = np.minimum(n, LENGTH - 1), np.arange(len(some))
        shared[some] = n
        wrong.append(group[order[some[x[row, near] > y[row, near]]]])
    return order, shared, np.unique(np.concatenate(wrong))


def smallest_holder(data: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each string (ordered by group) the smallest document with an equal string in its group."""
    _, number, count = np.unique(group, return_inverse=True, return_counts=True)
    some = count[number] > 1
    if not some.all():  # a string alone in its group has no equal
        out = doc.copy()
        if some.any():
            out[some] = smallest_holder(data, at[some], group[some], doc[some])
        return out
    if not len(at):
        return doc
    order, shared, wrong = ordered(data, at, group)
    new = shared < LENGTH
    out = np.empty(len(at), doc.dtype)
    out[order] = np.minimum.reduceat(doc[order], np.nonzero(new)[0])[np.cumsum(new) - 1]
    for g in wrong:
        own = np.nonzero(group == g)[0]
        _, inverse = np.unique(data[at[own, None] + np.arange(LENGTH)], axis=0, return_inverse=True)
        best = np.full(inverse.max() + 1, np.iinfo(doc.dtype).max)
        np.minimum.at(best, inverse.ravel(), doc[own])
        out[own] = best[inverse.ravel()]
    return out


def smallest_holders(data: np.ndarray, pivot: np.ndarray, group: np.ndarray, doc: np.ndarray, place: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """smallest_holder for all strings of spans (ordered by group) whose anchors are at `pivot`, and spans left open.

    Strings with the anchor at the same place are equal if the bytes from the anchor on are, and those before it. Both
    are sorted once for each span, the latter backwards, and not once for each string. What two spans share is the least
    of what neighbours between them share, so that a cut of both orders at each place gives the classes of equal strings.
    Left open are the spans of groups that collided hashes had put in a wrong order, or with strings outside the anchor.
    """
    n, reach = len(pivot), np.arange(LENGTH)
    around = np.concatenate([np.zeros(LENGTH, "u1"), data, np.zeros(LENGTH, "u1")])
    sides = np.concatenate([around[pivot[:, None] + LENGTH + reach], around[pivot[:, None] + LENGTH - 1 - reach]])
    behind = group.max() + 1 if n else 0
    order, shared, wrong = ordered(sides.ravel(), np.arange(2 * n) * LENGTH, np.concatenate([group, group + behind]))
    rank = np.empty(2 * n, "i8")
    rank[order] = np.arange(2 * n)
    begin, least = np.cumsum(windows) - windows, np.repeat(doc, windows)
    for where in range(WINDOW):
        some = np.nonzero((where <= place) & (where > place - windows))[0]
        if not len(some):
            continue
        after, before = np.cumsum(shared[:n] < LENGTH - where), np.cumsum(shared[n:] < where)
        key = after[rank[:n][some]] * (n + 1) + before[rank[n:][some] - n]
        sort = np.argsort(key)
        new = changes(key[sort])
        held = np.minimum.reduceat(doc[some][sort], np.nonzero(new)[0])[np.cumsum(new) - 1]
        least[(begin + place - where)[some][sort]] = held
    outside = group[(place >= WINDOW) | (place < windows - 1)]
    return least, np.isin(group, np.concatenate([wrong % behind if n else wrong, outside]))


# ---- the three steps on Spark


def first_answers(blocks: DataFrame, buckets: int) -> DataFrame:
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean_worker()
        for batch in batches:
            for row in batch.itertuples():
                _, _, _, r, some, _, least = block_runs(row)
                anchor, span = r["anchor"][some], r["span"][some]
                _, start = by_bucket(anchor, buckets)  # already in order
                rows = [(row.block, b, packed(anchor[i:j], True), span[i:j].astype("<u8").tobytes(), packed(least[i:j])) for b, (i, j) in enumerate(zip(start[:-1], start[1:], strict=True)) if j > i]
                yield pd.DataFrame(rows, columns=["block", "bucket", "anchor", "span", "doc"])

    def answer(key, rows: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        sizes = [len(x) // 8 for x in rows["span"]]
        a, s = np.concatenate([opened(x, True) for x in rows["anchor"]]), np.concatenate([np.frombuffer(x, "<u8") for x in rows["span"]])
        d = np.concatenate([opened(x) for x in rows["doc"]]).view("<i8")
        order = sorted_by(a, s)
        a, s, d = a[order], s[order], d[order]
        new, other = changes(a, s), changes(a)
        begin, number = np.nonzero(new)[0], np.cumsum(new) - 1
        least, most = np.minimum.reduceat(d, begin)[number], np.maximum.reduceat(d, begin)[number]
        several = (np.add.reduceat(new, np.nonzero(other)[0]) > 1)[np.cumsum(other) - 1]  # spans of each anchor
        out = np.empty(len(a), "u1")
        out[order] = np.where(least < d, 1, np.where(several, 2, np.where(most > d, 3, 0)))
        return pd.DataFrame({"block": rows["block"], "bucket": key[0], "answer": [zstandard.compress(x.tobytes(), 1) for x in np.split(out, np.cumsum(sizes)[:-1])]})

    asked = blocks.mapInPandas(ask, "block string, bucket int, anchor binary, span binary, doc binary")
    return asked.groupBy("bucket").applyInPandas(answer, "block string, bucket int, answer binary")


def ordered_answers(rows: pd.DataFrame) -> np.ndarray:
    parts = rows.sort_values("bucket")["answer"]
    return np.concatenate([np.frombuffer(zstandard.decompress(x), "u1") for x in parts]) if len(parts) else np.zeros(0, "u1")


def held_strings(anchor: np.ndarray, span: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray, code: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each string of each span, in order, 1 where a smaller document holds it.

    The strings of a span that answered 1 are held if the bytes of its first holder say so; the others are sorted.
    """
    begin, windows = np.cumsum(size) - size, size - LENGTH + 1
    order = sorted_by(anchor, span, doc)
    new = changes(anchor[order], span[order])
    holder = np.empty(len(order), "i8")
    holder[order] = order[new][np.cumsum(new) - 1]
    copies = np.nonzero(code == 1)[0]
    same = equal_bytes(data, begin[copies], begin[holder[copies]], size[copies], size[holder[copies]])
    same &= doc[holder[copies]] < doc[copies]
    settled = np.zeros(len(size), bool)
    settled[copies[same]] = True
    collided = np.isin(anchor, anchor[copies[~same]])
    todo = np.nonzero(((code == 2) | collided) & ~settled)[0]
    flags = np.repeat(settled.astype("u1"), windows)
    todo = todo[np.argsort(anchor[todo], kind="stable")]
    of = np.repeat(todo, windows[todo])
    step = np.arange(len(of)) - np.repeat(np.cumsum(windows[todo]) - windows[todo], windows[todo])
    least, left = smallest_holders(data, begin[todo] + place[todo], np.cumsum(changes(anchor[todo])), doc[todo], place[todo], windows[todo])
    if left.any():  # string by string
        rest = np.nonzero(np.repeat(left, windows[todo]))[0]
        # equal strings have the same anchor at the same place
        where = place[of[rest]] - step[rest]
        rest = rest[np.lexsort((where, anchor[of[rest]]))]
        group = np.cumsum(changes(anchor[of[rest]], place[of[rest]] - step[rest]))
        least[rest] = smallest_holder(data, begin[of[rest]] + step[rest], group, doc[of[rest]])
    flags[(np.cumsum(windows) - windows)[of] + step] = least < doc[of]
    return flags


def second_answers(blocks: DataFrame, first: DataFrame, buckets: int) -> DataFrame:
    """Rows (block, bucket, answer): which strings of the spans sent (bytes of 0 or 1) a smaller document holds."""
    names = ["bucket", "block", "anchor", "span", "doc", "shape", "bytes"]

    def send(key, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        if own.empty or answers.empty:
            return pd.DataFrame(columns=names)
        _, _, raw, r, some, _, least = block_runs(next(own.itertuples()))
        code = ordered_answers(answers)
        wanted = np.nonzero(code)[0]
        pick, raw = some[wanted], raw.tobytes()
        anchor, span, doc = r["anchor"][pick], r["span"][pick], least[wanted]
        from_, to = r["first"][pick], r["last"][pick] + LENGTH
        shape = np.stack([r["anchor_at"][pick] - from_, to - from_, code[wanted]]).astype("u1")
        _, start = by_bucket(anchor, buckets)  # already in order
        rows = []
        for b, (i, j) in enumerate(zip(start[:-1], start[1:], strict=True)):
            if j > i:
                spans = b"".join([raw[x:y] for x, y in zip(from_[i:j].tolist(), to[i:j].tolist(), strict=True)])
                rows.append((b, key[0], packed(anchor[i:j], True), span[i:j].astype("<u8").tobytes(), packed(doc[i:j]), shape[:, i:j].tobytes(), zstandard.compress(spans, 1)))
        return pd.DataFrame(rows, columns=names)

    def sort(key, rows: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        counts = [len(x) // 8 for x in rows["span"]]
        anchor, span = np.concatenate([opened(x, True) for x in rows["anchor"]]), np.concatenate([np.frombuffer(x, "<u8") for x in rows["span"]])
        doc = np.concatenate([opened(x) for x in rows["doc"]]).view("<i8")
        place, size, code = np.concatenate([np.frombuffer(x, "u1").reshape(3, -1) for x in rows["shape"]], axis=1).astype("i8")
        data = np.frombuffer(b"".join(map(zstandard.decompress, rows["bytes"])), "u1")
        flags = held_strings(anchor, span, doc, place, size, code, data)
        cuts = np.cumsum(size - LENGTH + 1)[np.cumsum(counts) - 1]
        return pd.DataFrame({"block": rows["block"], "bucket": key[0], "answer": [zstandard.compress(x.tobytes(), 1) for x in np.split(flags, cuts[:-1])]})

    sent = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInPandas(send, "bucket int, block string, anchor binary, span binary, doc binary, shape binary, bytes binary")
    return sent.groupBy("bucket").applyInPandas(sort, "block string, bucket int, answer binary")


def marked(row, first: np.ndarray, second: np.ndarray) -> tuple:
    """ids, starts, data and the mask of bytes to remove."""
    ids, starts, data, r, some, number, least = block_runs(row)
    cover = np.zeros(len(data) + LENGTH + 1, "i4")
    if len(some):
        # a smaller document of the block has a run's span: all of its strings are repeats
        whole = ids[r["doc"]] > least[number]
        cover[r["first"][whole]] += 1  # each start is in one run, so that no place comes twice
        cover[r["last"][whole] + LENGTH] -= 1
        windows = np.where(first > 0, (r["last"] - r["first"] + 1)[some], 0)
        begin = np.cumsum(windows) - windows
        part = np.nonzero(~whole & (first[number] > 0))[0]
        n = windows[number[part]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = second[np.repeat(begin[number[part]], n) + step] == 1
        at = (np.repeat(r["first"][part], n) + step)[hit]
        cover[at] += 1
        cover[at + LENGTH] -= 1
    return ids, starts, data, np.cumsum(cover)[: len(data)] > 0


def without_repeats(docs: DataFrame, block_bytes: int = 6_000_000, carry: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with carry also kept_text and the carried column.

    kept_text is the kept bytes as text; a character of which a byte was removed is left out.
    """
    import json

    shrink_executors(docs.sparkSession)
    blocks = written(packed_texts(docs, block_bytes, carry))
    n = blocks.count()
    buckets = bucket_count(n)
    first = written(first_answers(blocks, buckets))
    discard(docs.sparkSession)
    second = written(second_answers(blocks, first, buckets))
    discard(docs.sparkSession)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string, carried string" if carry else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def finish(key, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        lean_worker()
        if own.empty:
            return pd.DataFrame(columns=names)
        row = next(own.itertuples())
        one, two = (ordered_answers(answers[answers["step"] == k]) for k in (1, 2))
        ids, starts, data, gone = marked(row, one, two)
        present, extra = np.frombuffer(row.present, "?"), json.loads(row.extra) if carry else None
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = starts[:-1][starts[:-1] < len(data)]
        edge[inner] = gone[inner]  # a run ends with its document
        sums, edges = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(edge)])
        out = []
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            kept = data[a:b][~gone[a:b]].tobytes()
            one_row = (int(ids[i]) if present[i] else None, int(b - a), int(sums[b] - sums[a]), int(edges[b] - edges[a]), hashlib.sha256(kept).hexdigest())
            out.append((*one_row, kept.decode("utf-8", "ignore"), extra[i]) if carry else one_row)
        columns = dict(zip(names, zip(*out, strict=True), strict=True))
        return pd.DataFrame(columns | {"doc_id": pd.array(list(columns["doc_id"]), "Int64")})

    both = first.withColumn("step", F.lit(1)).unionByName(second.withColumn("step", F.lit(2)))
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(finish, schema)
