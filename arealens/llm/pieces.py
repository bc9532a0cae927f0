"""SentencePiece encoding and decoding by backtracking over pieces.

A piece model merges adjacent symbols whose concatenation is a piece, best score first. Instead of
merging, the encoder takes the longest piece at each position (all matches of a text come from one
Aho-Corasick pass) and keeps it if it can stand beside the token before it: the two, merged anew from
single characters, must come out as the same two. If no piece fits, the position is marked in a
bitfield as failed and the token before it gives way to a shorter one. Pieces hold the space mark only
in front, so a text falls into units that are encoded apart, and units that repeat are looked up.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
REMEMBERED = 200  # characters of the longest unit that is looked up, so that the tables stay small
_UNITS = re.compile(f"{MARK}+[^{MARK}]*")


class PieceEncoder:
    """Encoder of one piece model; ``unit_limit`` and ``pair_limit`` bound the tables it keeps in memory."""

    def __init__(self, model_file: str, unit_limit: int = 600_000, pair_limit: int = 2_000_000) -> None:
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.unit_limit, self.pair_limit = unit_limit, pair_limit
        n = self.library.get_piece_size()
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.score = {self.library.id_to_piece(i): self.library.get_score(i) for i in plain}
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space inside; its texts don't fall into units")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            self.matcher.add_word(p, (len(p), p))
        self.matcher.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.units: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best score first, then the leftmost; the definition that pairs are checked against."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts) and (s := self.score.get(whole := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, whole, j))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, whole, j = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when their text is merged anew."""
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= self.pair_limit:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of ``text``, all of whose characters are pieces."""
        by_start: list[list[str]] = [[] for _ in text]
        for end, (length, piece) in self.matcher.iter(text):
            by_start[end - length + 1].append(piece)  # shorter first, as ends go up
        pairs = self.pairs
        found: list[str] = []
        tried: list[int] = []  # how many of the matches at each token's start have been passed over
        failed, at, skip, size, last = 0, 0, 0, len(text), ""
        while at < size:
            options = by_start[at]
            for k in range(len(options) - 1 - skip, -1, -1):
                piece = options[k]
                if failed >> (at + len(piece)) & 1:
                    continue
                if not last:
                    if len(piece) < size or self.merged(piece) == [piece]:
                        break
                elif (known := pairs.get((last, piece))) or (known is None and self.fits(last, piece)):
                    break
            else:
                if not last:
                    return self.merged(text)
                failed |= 1 << at
                at -= len(found.pop())
                skip = tried.pop() + 1
                last = found[-1] if found else ""
                continue
            found.append(piece)
            tried.append(len(options) - 1 - k)
            at += len(piece)
            skip, last = 0, piece
        return found

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of a part of a unit that no piece reaches out of; a character that is no piece becomes byte ids."""
        if (ids := self.parts.get(text)) is None:
            if len(text) == 1:
                ids = (self.ids[text],) if text in self.ids else tuple(self.bytes[b] for b in text.encode())
            else:
                # Runs of marks are pieces of one score; ties break the pair property, so those are merged.
                ids = tuple(self.ids[p] for p in (self.merged(text) if text.startswith(MARK * 2) else self.backtrack(text)))
            if len(self.parts) >= self.unit_limit:
                self.parts.clear()
            if len(text) <= REMEMBERED:
                self.parts[text] = ids
        return ids

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of a unit: space marks, then no more of them. It is cut where no piece holds the two characters that meet."""
        out: list[int] = []
        start, inside = 0, self.inside
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in inside:
                out += self.part(text[start:k])
                start = k
        out += self.part(text[start:])
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            parts = _UNITS.findall(MARK + text.replace(" ", MARK))
        else:
            parts = text.split(" ")  # units without their one mark
        known, out = self.units, []
        for p in parts:
            ids = known.get(p)
            if ids is None:
                if len(known) >= self.unit_limit:
                    known.clear()
                ids = self.unit(p if p[:1] == MARK else MARK + p)
                if len(p) <= REMEMBERED:
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_encoders: dict[str, PieceEncoder] = {}


def encoder(model_file: str) -> PieceEncoder:
    """The worker's encoder of a model, made once and reused by later tasks."""
    if model_file not in _encoders:
        _encoders[model_file] = PieceEncoder(model_file)
    return _encoders[model_file]


def sentencepiece_round_trip(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", slice_rows: int = 500) -> DataFrame:
    """``docs`` with ``ids`` (array<int>, no begin or end ids) and ``decoded`` (their text), whole texts.

    Null and empty text give no ids and an empty string. Rows are independent: repeated ones give equal
    results, an empty table gives none, and other columns pass through; columns of the new names are replaced.
    """
    docs = docs.drop(ids, decoded)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_file)
        for whole in batches:
            for i in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(i, slice_rows)
                coded = [own.encode(x or "") for x in batch.column(at).to_pylist()]
                columns = [pa.array(coded, pa.list_(pa.int32())), pa.array([own.decode(x) for x in coded], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, ids, decoded])

    return docs.mapInArrow(run, schema)
