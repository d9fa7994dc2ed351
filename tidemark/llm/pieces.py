"""SentencePiece BPE encoding by a prefix table, and decoding with the library.

A piece sequence is what BPE makes of a text exactly if each two neighbours are what BPE makes of their joined
text. So every prefix of a text has one last piece: of the pieces that end there, the one that is compatible with
the last piece of the prefix before it. The table is filled from left to right with the matches of an Aho-Corasick
automaton over the vocabulary, and the ids are recovered backwards from the last entry. The answers of pair tests are
kept.

A pair is compatible if no merge across its boundary comes before the merges that make the two pieces. Undoing the
merges from the last one back shows all pairs of symbols that ever meet at the boundary; each is looked up. That holds
for pieces whose merges come in the order of their scores; pairs with another piece are merged to see what happens.

No piece holds a space mark after another character, so a text falls into units (space marks, then others) that are
encoded one by one, and a unit's ids are kept for its next occurrence. Characters outside the vocabulary are no part
of any merge; they become their UTF-8 bytes. Runs of one character, space marks above all, have merges of equal rank,
of which the leftmost comes first; that order is the same within a pair as within the text, so the table holds for
them too. Only a unit for which no last piece fits (not a vocabulary that BPE made) is merged directly, with a heap.

Edge cases: null and empty texts have the begin and end ids only; a null doc_id stays null; repeated rows are encoded
alike; an empty table gives no rows; texts of any length are encoded whole, each by itself, and results leave a worker
in batches of bounded bytes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import worker_stores

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Entries kept for units and for pairs in a worker; a full store is emptied. Longer units are not kept.
KEPT, LONGEST_KEPT = 300_000, 64
#: Bytes of ids after which a worker hands on its results.
BATCH_BYTES = 2_000_000


class PieceEncoder:
    """Encodes as the library does for a BPE model with identity normalization and byte fallback."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != 2 or spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with identity normalization and plain, control and byte pieces are known here")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.dummy = spec.normalizer_spec.add_dummy_prefix
        self.ids, self.score, self.byte = {}, {}, {}
        self.matches = ahocorasick.Automaton()
        for i, p in enumerate(spec.pieces):
            if p.type == NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.matches.add_word(p.piece, (len(p.piece), i, p.piece))
            elif p.type == BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
        self.matches.make_automaton()
        self.joined = {a + b for piece in self.score for a, b in zip(piece, piece[1:])}
        self.made: dict[str, tuple[float, str, str]] = {}  # when a piece is merged, and from what
        self.ordered: set[str] = set()  # pieces whose merges come in the order of their scores
        for piece in sorted(self.score, key=len):
            self.derive(piece)
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: join the neighbours that make the best-scored piece, leftmost first (n log n)."""
        parts: list[str | None] = list(text)
        before, after, score = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1)), self.score
        open_: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            s = score.get(parts[i] + parts[j])
            if s is not None:
                heapq.heappush(open_, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while open_:
            _, i, left, right = heapq.heappop(open_)
            j = after[i]
            if parts[i] != left or j == len(parts) or parts[j] != right:
                continue  # one of the two has been joined since
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in parts if x is not None]

    def derive(self, piece: str) -> None:
        """Finds a piece's last merge; shorter pieces are known."""
        if len(piece) == 1:
            self.made[piece] = (-1.0, "", "")
            self.ordered.add(piece)
            return
        parts, score = list(piece), self.score
        steps = []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return  # BPE does not make this piece
            steps.append(-best)
            last = (-best, parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.made[piece] = last
        if all(a <= b for a, b in zip(steps, steps[1:])) and last[1] in self.ordered and last[2] in self.ordered:
            self.ordered.add(piece)

    def compatible(self, left: str, right: str) -> bool:
        if left in self.ordered and right in self.ordered:
            return not self.crossed(left, right)
        return self.merged(left + right) == [left, right]

    def crossed(self, left: str, right: str) -> bool:
        """Whether a merge across the boundary comes first; of equal ones the left one does."""
        made, score, never = self.made, self.score, float("inf")
        end_left = end_right = never
        while True:
            s = score.get(left + right)
            if s is not None and -s < end_left and -s <= end_right:
                return True
            (at_left, _, inner_left), (at_right, inner_right, _) = made[left], made[right]
            if at_left < 0 and at_right < 0:
                return False
            if at_left > at_right:
                left, end_left = inner_left, at_left
            else:
                right, end_right = inner_right, at_right

    def last_pieces(self, text: str) -> list[tuple[int, int, str] | None]:
        """The last piece (length, id, text) of each prefix; None where the last character is not in the vocabulary.

        The automaton reports matches by their end, so that all shorter prefixes are done when one is looked at.
        """
        last: list[tuple[int, int, str] | None] = [None] * (len(text) + 1)
        pairs, made = self.pairs, self.made
        for end, found in self.matches.iter(text):
            if last[end + 1] is None:
                left = last[end + 1 - found[0]]
                if left is None:  # the start, or a character that merges with nothing
                    fits = found[2] in made
                else:
                    key = left[1] << 32 | found[1]
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= KEPT:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(left[2], found[2])
                if fits:
                    last[end + 1] = found
        return last

    def unit_ids(self, unit: str) -> bytes:
        out: list[int] = []
        i = len(unit)
        last = self.last_pieces(unit)
        if None in last[1:] and any(x is None and c in self.ids for x, c in zip(last[1:], unit)):
            # no compatible piece (not a vocabulary that BPE made): merged directly
            for piece in reversed(self.merged(unit)):
                number = self.ids.get(piece)
                out += [number] if number is not None else [self.byte[b] for b in reversed(piece.encode())]
            i = 0
        while i:  # backwards
            found = last[i]
            if found is None:
                i -= 1
                out += [self.byte[b] for b in reversed(unit[i].encode())]
            else:
                i -= found[0]
                out.append(found[1])
        return array("I", reversed(out)).tobytes()

    def unit(self, unit: str) -> bytes:
        """Ids of a unit. It falls into parts where two characters meet that meet in no piece; parts are kept as well."""
        known = self.units.get(unit)
        if known is None:
            cuts = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.joined]
            if cuts:
                known = b"".join(self.unit(unit[i:j]) for i, j in zip([0, *cuts], [*cuts, len(unit)]))
            else:
                known = self.unit_ids(unit)
            if len(unit) <= LONGEST_KEPT:
                if len(self.units) >= KEPT:
                    self.units.clear()
                self.units[unit] = known
        return known

    def encode(self, text: str) -> bytes:
        """All ids, begin and end included, as little-endian unsigned 32-bit integers."""
        body = b""
        if text:
            marked = (MARK if self.dummy else "") + text.replace(" ", MARK)
            if MARK + MARK in marked or not marked.startswith(MARK) or marked.endswith(MARK):
                units = re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)
            else:
                units = [MARK + x for x in marked[1:].split(MARK)]
            known = list(map(self.units.get, units))
            if None in known:
                known = [self.unit(x) if k is None else k for x, k in zip(units, known, strict=True)]
            body = b"".join(known)
        return self.begin.to_bytes(4, "little") + body + self.end.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_encoders: dict[str, PieceEncoder] = worker_stores.setdefault("pieces", {})


def encoder(model: bytes) -> PieceEncoder:
    """One encoder for each model and worker, so that later tasks find the units of earlier ones."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _encoders:
        _encoders[key] = PieceEncoder(model)
    return _encoders[key]


def encoded(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids (array<int>)."""
    with open(model_path, "rb") as file:
        model = file.read()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)

        def out(doc_ids: pa.Array, coded: list[bytes], digests: list[str]) -> pa.RecordBatch:
            sizes = np.array([len(x) // 4 for x in coded], "i8")
            columns = [doc_ids, pa.array(sizes), pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array(digests, pa.string())]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("i4")
                columns.append(pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(coded), "<i4")))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            begin, coded, digests, size = 0, [], [], 0
            for i in range(batch.num_rows):
                coded.append(own.encode(texts[i].as_py() or ""))
                digests.append(hashlib.sha256(own.decode(coded[-1]).encode()).hexdigest())
                size += len(coded[-1])
                if size >= BATCH_BYTES:
                    yield out(doc_ids.slice(begin, i + 1 - begin), coded, digests)
                    begin, coded, digests, size = i + 1, [], [], 0
            if coded:
                yield out(doc_ids.slice(begin, len(coded)), coded, digests)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
