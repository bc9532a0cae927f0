"""Alignment of two tokenizers' tokens over the bytes of whole texts, with corpus-wide counts of linked ids.

A space and the text are encoded by a byte-level vocabulary (A) and by a piece model (B). The character offsets of A's tokens and the
spans of B's pieces are coarse cuts: a token whose span holds just its bytes ends where the span ends. Tokens that share a character,
being parts of a multibyte character or fallback bytes, have one span in common; within it they are cut by their decoded bytes.
Places where tokens of both end cut the text into groups, and the two tokens that end there are linked.

No token of either crosses from a word into the white space behind it, nor (which is checked against the pieces) from a letter into the sign
behind it, so texts fall into units that are encoded apart; a worker looks up those it has met. Counts of linked id pairs are sums over all documents. Pairs that hold at least one in HEAVY_PAIRS
of all links are broadcast, which bounds their number; documents look up the others in a shuffled join.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.llm.joins import join_counted
from arealens.llm.text import list_slices, text_slices
from arealens.scratch import discard, stage

HEAVY_PAIRS = 1_000_000
SLICE_BYTES = 500_000  # of texts that are split at once
LEARNED_AT_ONCE = 5_000
MARK = "▁"
# Fixed: Unicode's white space, and four controls that some pattern libraries count with it.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTROLS = "\x1c\x1d\x1e\x1f"
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"  # letters between which and ASCII signs both kinds of tokens may be cut
REMEMBERED = 64  # characters of the longest unit that is looked up


def byte_level_bytes(entry: str) -> bytes:
    """Bytes of a byte-level vocabulary entry: printable bytes stand for themselves, the n-th other byte for the character 256 + n."""
    return bytes(_BYTE_OF[c] for c in entry)


_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: U+2581 as space, <0xHH> as that byte."""
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace(MARK, " ").encode()


def refined_ends(spans: list[tuple[int, int]], tokens: list[bytes], whole: bytes, at: list[int] | None) -> list[int] | None:
    """Byte ends of tokens whose spans run over positions with byte offsets ``at`` (None: the positions are bytes); None if the tokens
    don't make up ``whole``. A span that holds other bytes than its token is cut by the tokens' own bytes."""
    out, end = [], 0
    for (low, high), token in zip(spans, tokens, strict=True):
        if at is not None:
            low, high = at[low], at[high]
        end = high if low == end and whole[low:high] == token else end + len(token)
        out.append(end)
    return out if b"".join(tokens) == whole else None


class Aligner:
    """Units met so far, with their aligned tokens. Beyond ``unit_limit`` units those met more than once are kept, up to half as many."""

    def __init__(self, byte_file: str, piece_file: str, unit_limit: int = 200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for p, i in vocabulary.items():
            self.a_bytes[i] = byte_level_bytes(p) if all(c in _BYTE_OF for c in p) else p.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a space inside; its texts don't fall into units")
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.mark, self.newline = self.b.piece_to_id(MARK), self.b.piece_to_id("<0x0A>")
        odd = CONTROLS + "".join(c for c in SPACES if any(c in p[1:] for p in pieces))
        cut = "".join(c for c in SPACES if c not in odd)
        after_letter = {p[k] for p in pieces for k in range(1, len(p)) if re.match(LETTER, p[k - 1])}
        signs = "".join(c for c in string.punctuation if c not in after_letter)
        blank, cut, odd, signs = (re.escape(x) for x in (SPACES + CONTROLS, cut, odd, signs))
        rest = f"[^{blank}]*(?:[{odd}][{blank}]*[^{blank}]*)*"  # up to white space that nothing crosses into
        self.units = re.compile(f"[{cut}][{blank}]*{LETTER}+(?=[{signs}])|[{cut}][{blank}]*{rest}|[{signs}]{rest}")
        self.unit_limit = unit_limit
        self.known: dict[str, int] = {}
        self.texts: list[str] = []  # groups of a unit, written out
        self.numbers = np.zeros((0, 4), np.int32)  # tokens of A, tokens of B, groups, 1 if the tokens' bytes are not the unit's
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)  # linked ids of all units, one unit after the other: a << 32 | b
        self.met = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Drop units met once, and the least met beyond half the limit."""
        most = np.sort(self.met)[::-1]
        least = max(2, int(most[self.unit_limit // 2]) + 1 if len(most) > self.unit_limit // 2 else 2)
        keep = np.flatnonzero(self.met >= least)
        new = np.full(len(self.met), -1)
        new[keep] = np.arange(len(keep))
        sizes = np.diff(self.starts)[keep]
        self.pairs = self.pairs[_runs(self.starts[keep], sizes)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.texts, self.numbers, self.met = [self.texts[k] for k in keep.tolist()], self.numbers[keep], np.zeros(len(keep), np.int64)
        places = new.tolist()
        self.known = {u: places[k] for u, k in self.known.items() if places[k] >= 0}

    def pieces(self, units: list[str]) -> tuple[list[list[int]], list[list[tuple[int, int]] | list[int]]]:
        """Ids and byte spans of B's pieces in each unit. The model puts a space in front of what it encodes; a unit's own first space stands for
        it, and other units are encoded behind what nothing merges with, whose pieces are taken off. Of ASCII units only the spans' ends are given."""
        shown = [u[1:] if u[0] == " " else u if u[0] in SPACES else "\n" + u for u in units]
        found = self.b.encode(shown, return_type="proto", num_threads=1)
        ids, spans = [], []
        for u, x in zip(units, found, strict=True):
            parts = x.pieces
            own = [p.id for p in parts]
            if u == " ":  # the model has no pieces for an empty text
                own, at = [self.mark], [1]
            elif u[0] == " ":
                if u.isascii():
                    at = [p.end + 1 for p in parts]
                else:
                    at = [(p.begin + 1, p.end + 1) for p in parts]
                    at[0] = (0, at[0][1])
            else:
                at = [(p.begin, p.end) for p in parts]
                front = [self.mark] if u[0] in SPACES else [self.mark, self.newline]
                if own[: len(front)] != front:
                    raise ValueError(f"a piece crosses into a unit's front: {u!r}")
                own, at = own[len(front) :], [(low + 1 - len(front), high + 1 - len(front)) for low, high in at[len(front) :]]
                at = [high for _, high in at] if u.isascii() else at
            ids.append(own)
            spans.append(at)
        return ids, spans

    def ends(self, units: list[bytes], ids: list[list[int]], spans: list[list[tuple[int, int]] | list[int]], tokens: list[bytes], sizes: np.ndarray, offsets: list[list[int] | None]) -> tuple[np.ndarray, ...]:
        """(number of tokens of each unit, ids, byte ends, whether each unit's tokens make it up), all tokens in a row.

        Units of which every span holds as many bytes as its token are cut by their spans alone; others go through ``refined_ends``.
        """
        number = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, number.sum())
        plain = np.array([o is None for o in offsets])
        high = np.fromiter(chain.from_iterable(own if not own or isinstance(own[0], int) else [x for _, x in own] for own in spans), np.int64, number.sum())
        row, good = np.repeat(np.arange(len(ids)), number), np.ones(len(ids), bool)
        first = np.cumsum(number) - number
        before = np.concatenate([[0], high[:-1]])
        before[first[number > 0]] = 0
        plain &= np.bincount(row, high - before != sizes[flat], len(ids)) == 0
        for k in np.flatnonzero(~plain).tolist():
            own = [x if isinstance(x, tuple) else (0, x) for x in spans[k]]
            found = refined_ends(own, [tokens[i] for i in ids[k]], units[k], offsets[k])
            good[k] = found is not None
            high[first[k] : first[k] + number[k]] = found or 0
        whole = b"".join([u for u, p in zip(units, plain.tolist(), strict=True) if p])
        if b"".join([tokens[i] for i in flat[plain[row]].tolist()]) != whole:
            for k in np.flatnonzero(plain).tolist():
                good[k] = b"".join([tokens[i] for i in ids[k]]) == units[k]
        return number, flat, high, good

    def learn(self, units: list[str]) -> None:
        """Encode and align units, and put them behind those known."""
        raw = [u.encode() for u in units]
        offsets: list[list[int] | None] = [None if u.isascii() else [0, *accumulate(len(c.encode()) for c in u)] for u in units]
        found = self.a.encode_batch(units, add_special_tokens=False)
        na, a, a_ends, good = self.ends(raw, [x.ids for x in found], [x.offsets for x in found], self.a_bytes, self.a_sizes, offsets)
        nb, b, b_ends, also = self.ends(raw, *self.pieces(units), self.b_bytes, self.b_sizes, [None if o is None else [*range(len(w) + 1)] for o, w in zip(offsets, raw, strict=True)])
        good &= also
        base = np.concatenate([[0], np.cumsum([len(w) + 1 for w in raw])])
        ua, ub = np.repeat(np.arange(len(units)), na), np.repeat(np.arange(len(units)), nb)
        at_a, at_b = np.flatnonzero(good[ua]), np.flatnonzero(good[ub])
        _, ia, ib = np.intersect1d(base[ua[at_a]] + a_ends[at_a], base[ub[at_b]] + b_ends[at_b], assume_unique=True, return_indices=True)
        ia, ib = at_a[ia], at_b[ib]  # the last tokens of each group
        groups = np.bincount(ua[ia], minlength=len(units))
        lasts = np.cumsum(groups)
        opens = np.zeros(len(ia), bool)
        opens[(lasts - groups)[groups > 0]] = True
        first_a, first_b = (np.where(opens, (np.cumsum(n) - n)[u[i]], np.concatenate([[0], i[:-1] + 1])) for n, u, i in ((na, ua, ia), (nb, ub, ib)))
        name_a, name_b = (list(map(self.names.__getitem__, x.tolist())) for x in (a, b))
        shown = [
            f"{name_a[i]}|{name_b[j]}" if i == p and j == q else ",".join(name_a[p : i + 1]) + "|" + ",".join(name_b[q : j + 1])
            for p, i, q, j in zip(first_a.tolist(), ia.tolist(), first_b.tolist(), ib.tolist(), strict=True)
        ]
        self.texts += [";".join(shown[low:high]) for low, high in zip((lasts - groups).tolist(), lasts.tolist(), strict=True)]
        numbers = np.stack([np.where(good, na, 0), np.where(good, nb, 0), groups, ~good], axis=1).astype(np.int32)
        self.numbers = np.concatenate([self.numbers, numbers])
        self.starts = np.concatenate([self.starts, self.starts[-1] + lasts])
        self.pairs = np.concatenate([self.pairs, a[ia] << 32 | b[ib]])
        self.met = np.concatenate([self.met, np.zeros(len(units), np.int64)])

    def slice(self, texts: list[str | None]) -> pa.RecordBatch:
        """The columns of MEASURES for each text."""
        if len(self.texts) > self.unit_limit:
            self.forget()
        split = [self.units.findall(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        known, at, new = self.known, len(self.texts), list(set(flat) - self.known.keys())
        known.update(zip(new, range(at, at + len(new)), strict=True))
        for k in range(0, len(new), LEARNED_AT_ONCE):
            self.learn(new[k : k + LEARNED_AT_ONCE])
        where = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        self.met += np.bincount(where, minlength=len(self.met))
        for u in new:
            if len(u) > REMEMBERED:
                self.met[known.pop(u)] = 0
        sizes = [len(u) for u in split]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.numbers[where], axis=0, dtype=np.int64)])
        count = sums[ends[1:]] - sums[ends[:-1]]
        good = count[:, 3] == 0
        count[~good] = 0
        row = np.repeat(np.arange(len(texts)), sizes)
        linked = np.where(good[row], self.starts[where + 1] - self.starts[where], 0)
        distinct, named = np.unique(self.pairs[_runs(self.starts[where], linked)], return_inverse=True)
        keys, times = np.unique(np.repeat(row, linked) << 40 | named, return_counts=True)
        written, numbers = self.texts, where.tolist()
        shown = [";".join([written[i] for i in numbers[low:high]]) for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        digests = [hashlib.sha256(x.encode()).hexdigest() if ok and x else "" for x, ok in zip(shown, good.tolist(), strict=True)]
        return _batch([count[:, 0], count[:, 1], count[:, 2], count[:, 2], digests], keys >> 40, distinct[keys & (1 << 40) - 1], times)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of ``sizes`` that begin at ``starts``, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


MEASURES = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pairs": "array<long>", "times": "array<long>"}


def _batch(columns: list, row: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Rows of ``columns`` with lists of pairs and times, dealt to them by the ascending numbers in ``row``."""
    ends = np.searchsorted(row, np.arange(len(columns[0]) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (pairs, times)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + lists, [f"c{k}" for k in range(len(columns) + 2)])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_file: str, piece_file: str) -> Aligner:
    """The worker's aligner of two vocabularies, made once and reused by later tasks."""
    if (byte_file, piece_file) not in _aligners:
        _aligners[byte_file, piece_file] = Aligner(byte_file, piece_file)
    return _aligners[byte_file, piece_file]


def aligned(docs: DataFrame, byte_file: str, piece_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the columns of MEASURES): tokens, groups and links of each whole text, and its distinct linked pairs with their occurrences.

    groups_sha256 is the digest of the groups as ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and texts whose tokens' bytes of either kind
    do not make up a space and the text, have zeros, no pairs and an empty digest.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives back what a large batch took
        own = aligner(byte_file, piece_file)
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                made = own.slice(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *made.columns], [key, *MEASURES])

    return docs.select(key, text).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in {key: kind, **MEASURES}.items()))



def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold each pair over all rows of ``aligned``; best if no pair of the same B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in (p for whole in batches for p in list_slices(whole, 0)):
            keys = np.concatenate([keys, part.column(0).flatten().to_numpy(zero_copy_only=False)])
            keys, named = np.unique(keys, return_inverse=True)
            sums = np.bincount(named, np.concatenate([sums, part.column(1).flatten().to_numpy(zero_copy_only=False)]).astype(np.float64), len(keys)).astype(np.int64)
            if len(keys) > HEAVY_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "k"])
                keys, sums = keys[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "k"])

    counts = stage(rows.select("pairs", "times").mapInArrow(run, "pair long, k long").groupBy("pair").agg(F.sum("k").alias("count")), "pair_counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # one row a piece of the vocabulary
    return counts.join(F.broadcast(most), b == most["b"]).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))


def align_tokenizers(docs: DataFrame, byte_file: str, piece_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    n_best: links whose pair no other pair of the same B id outnumbers in all of ``docs``, ties included; count_sum: the sum of the links'
    counts. Rows are counted each by itself, repeated ones too; a null key keeps its row. Texts that ``aligned`` gives zeros for have zeros
    here. An empty table gives no rows; other columns are not read.
    """
    rows = stage(aligned(docs.select(F.col(key).alias("id"), F.col(text).alias("t")), byte_file, piece_file, "id", "t").withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(rows), "counted_pairs")
    total = counts.agg(F.sum("count")).first()[0] or 0
    light = counts.where(F.col("count") * HEAVY_PAIRS < total)
    heavy = counts.where(F.col("count") * HEAVY_PAIRS >= total).toArrow().sort_by("pair")  # at most HEAVY_PAIRS rows
    held = rows.sparkSession.sparkContext.broadcast(tuple(heavy.column(c).to_numpy() for c in ("pair", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = held.value
        for part in (p for whole in batches for p in list_slices(whole, 1)):
            n = _lengths(part.column(1))
            flat, times = (part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
            row, at = np.repeat(np.arange(len(n)), n), np.searchsorted(pair, flat)
            at = np.minimum(at, max(len(pair) - 1, 0))
            found = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            sums = [_sums(row[found], times[found] * x[at[found]], len(n)) for x in (best, count)]
            made = _batch(sums, row[~found], flat[~found], times[~found])
            yield pa.RecordBatch.from_arrays([part.column(0), *made.columns], ["rid", "n_best", "count_sum", "pairs", "times"])

    scored = rows.select("rid", "pairs", "times").mapInArrow(run, "rid long, n_best long, count_sum long, pairs array<long>, times array<long>")
    scored = stage(scored, "scored")
    rest = scored.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = join_counted(rest, light, "pair").groupBy("rid").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more"))
    sums = scored.select("rid", "n_best", "count_sum").join(rest, "rid", "left")
    added = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    joined = rows.drop("pairs", "times").join(sums.select("rid", added("n_best", "more_best"), added("count_sum", "more")), "rid")
    return joined.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _sums(row: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Whole-number sums of ``values`` by their ascending ``row``."""
    ends = np.searchsorted(row, np.arange(size + 1))
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False)
