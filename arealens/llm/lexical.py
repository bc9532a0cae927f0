"""Ranked lexical search over posting lists cut into blocks of like documents.

Each worker holds its documents in chunks as an inverted index over the terms that items ask for. A term's posting list is clustered by the
likeness of whole documents (inner products of small projections of their term weights with those of some of the list's own documents), and each
block's summary holds, for every term, the most that a document of the block has. The sum of a summary over an item's terms bounds the
score of all the block's documents, so a block is passed over only if that sum is less than the worst of the best scores found so far.
Lists are taken from the weightiest term down; an item is done with a chunk once the terms left can't add up to that score. Nothing is
estimated: bounds and scores are whole numbers, and ties are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealens.llm.text import list_slices, text_slices
from arealens.scratch import discard, stage

ITEMS_AT_ONCE = 500  # items ranked in one pass over the documents, about; more are split by hash
CHUNK_POSTINGS = 1_000_000
BLOCK = 32  # documents of a block, about
DIMENSIONS = 16  # of the projections that blocks are made by
BASE, RANGE = 10, 90  # shares of a document's length norm that are fixed and that follow its length, of 100

#: Bytes of terms (digits, letters, all beyond ASCII) with A-Z lower-cased; any other is a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a whole text, repeats included."""
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(TABLE).split() if raw else []


def term_vectors(docs: DataFrame, numbers: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, terms, tfs) of each text with a term: how many terms it has, which of ``numbers`` it holds (ascending) and how often."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value.get
        for batch in batches:
            for part in text_slices(batch, 1):
                split = [terms_of(x) for x in part.column(1).cast(pa.large_binary()).to_pylist()]
                found = [np.array([t for t in map(known, words) if t is not None], np.int64) for words in split]
                row = np.repeat(np.arange(len(split)), [len(x) for x in found])
                keys, times = np.unique(row << 32 | np.concatenate(found) if len(row) else np.zeros(0, np.int64), return_counts=True)
                ends = np.searchsorted(keys >> 32, np.arange(len(split) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys & 0xFFFFFFFF, times)]
                made = pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in split], pa.int64()), *lists], ["id", "n", "terms", "tfs"])
                yield made.filter(pa.array([bool(x) for x in split], pa.bool_()))

    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<int>")


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """How many rows hold each of ``size`` terms; every task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["t", "k"])

    counts = np.zeros(size, np.int64)
    for t, k in vectors.select("terms").mapInArrow(run, "t int, k long").groupBy("t").agg(F.sum("k")).collect():
        counts[t] = k
    return counts


class Chunk:
    """Some documents' weighted terms, by document and by term."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, projection: np.ndarray) -> None:
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.weights = terms, weights
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        self.rows = row[order]  # by term, the documents that hold it
        self.cuts = np.searchsorted(terms[order], np.arange(len(projection) + 1))
        filled = np.flatnonzero(np.diff(self.cuts))
        self.most = np.zeros(len(projection), np.int64)
        self.most[filled] = np.maximum.reduceat(weights[order], self.cuts[filled]) if len(filled) else 0
        spread = np.zeros((len(sizes), projection.shape[1]), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            spread[some] = np.add.reduceat(projection[terms] * weights[:, None].astype(np.float32), self.ends[some], axis=0)
        self.sketch = spread / np.maximum(np.linalg.norm(spread, axis=1, keepdims=True), 1e-30)

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the documents' entries, and for each entry the place of its document in ``rows``."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        place = np.repeat(np.arange(len(rows)), sizes)
        return np.arange(len(place)) + np.repeat(self.ends[rows] - (np.cumsum(sizes) - sizes), sizes), place

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The term's documents, block by block, and the number of each one's block: that of the likest of every BLOCK-th of them."""
        rows = self.rows[self.cuts[term] : self.cuts[term + 1]]
        if len(rows) <= BLOCK:
            return rows, np.zeros(len(rows), np.int64)
        nearest = np.argmax(self.sketch[rows] @ self.sketch[rows[::BLOCK]].T, axis=1)
        order = np.argsort(nearest, kind="stable")
        return rows[order], np.unique(nearest[order], return_inverse=True)[1]

    def summary(self, rows: np.ndarray, block: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
        """Per block and column the most that its documents have; ``column`` gives a term's column, -1 for none."""
        at, place = self.entries(rows)
        to = column[self.terms[at]]
        used = to >= 0
        out = np.zeros((block[-1] + 1, width), np.int64)
        np.maximum.at(out, (block[place[used]], to[used]), self.weights[at[used]])
        return out

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of documents for an item, whose terms are true in ``asked``."""
        at, place = self.entries(rows)
        sums = np.concatenate([[0], np.cumsum(np.where(asked[self.terms[at]], self.weights[at], 0))])
        ends = np.searchsorted(place, np.arange(len(rows) + 1))
        return sums[ends[1:]] - sums[ends[:-1]]


class Search:
    """Best k documents so far of each item, over the chunks that one task is given."""

    def __init__(self, items: list[np.ndarray], size: int, k: int) -> None:
        self.items, self.size, self.k = items, size, k
        self.asked = np.zeros((len(items), size), bool)
        self.holders: list[list[int]] = [[] for _ in range(size)]
        for q, terms in enumerate(items):
            self.asked[q, terms] = True
            for t in terms.tolist():
                self.holders[t].append(q)
        self.best: list[list[tuple]] = [[] for _ in items]
        self.least = np.ones(len(items), np.int64)  # scores below it can't be among the best
        self.scored = self.passed = 0  # documents scored, and passed over in blocks whose bound failed
        self.projection = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (size, DIMENSIONS))

    def add(self, ids: list, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        chunk = Chunk(sizes, terms, weights, self.projection)
        left = self.asked @ chunk.most  # of each item, what its terms not yet taken can add up to
        seen = np.zeros((len(self.items), len(ids)), bool)
        column = np.full(self.size, -1, np.int64)
        for t in np.argsort(-chunk.most, kind="stable").tolist():
            if chunk.most[t] == 0:
                break
            active = [q for q in self.holders[t] if left[q] >= self.least[q]]
            left[self.holders[t]] -= chunk.most[t]
            if not active:
                continue
            rows, block = chunk.blocks(t)
            wanted = np.flatnonzero(self.asked[active].any(axis=0))
            column[wanted] = np.arange(len(wanted))
            summary = chunk.summary(rows, block, column, len(wanted))
            for q in active:
                open_ = summary[:, column[self.items[q]]].sum(axis=1) >= self.least[q]
                some = rows[open_[block]]
                self.passed += len(rows) - len(some)
                some = some[~seen[q, some]]
                if len(some):
                    seen[q, some] = True
                    self.scored += len(some)
                    self.offer(q, ids, some, chunk.scores(some, self.asked[q]))
            column[wanted] = -1

    def offer(self, q: int, ids: list, rows: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least[q]
        if not good.any():
            return
        rows, scores = rows[good], scores[good]
        if len(rows) > self.k:
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            rows, scores = rows[keep], scores[keep]
        found = self.best[q] + [(-s, ids[r] is None, ids[r]) for s, r in zip(scores.tolist(), rows.tolist(), strict=True)]
        found.sort(key=lambda x: x if not x[1] else x[:2])
        self.best[q] = found[: self.k]
        if len(self.best[q]) == self.k:
            self.least[q] = -self.best[q][-1][0]


def _ranked(docs: DataFrame, items: list[tuple[object, list[bytes]]], item_kind: str, k: int, key: str, text: str) -> DataFrame:
    """Best documents of a bounded list of items, whose terms the workers are sent."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    words = sorted({t for _, terms in items for t in terms})
    numbers = {t: i for i, t in enumerate(words)}
    size = len(words)
    vectors = stage(term_vectors(docs, numbers, key, text), "term_vectors")
    n_docs, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_counts(vectors, size)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    asked = [np.array(sorted({numbers[t] for t in terms}), np.int64) for _, terms in items]
    held = spark.sparkContext.broadcast((weight, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asks = held.value
        search, waiting, postings = Search(asks, size, k), [], 0

        def take() -> None:
            ids = [i for w in waiting for i in w[0]]
            search.add(ids, *(np.concatenate([w[c] for w in waiting]) for c in (1, 2, 3)))
            waiting.clear()

        for batch in (part for whole in batches for part in list_slices(whole, 2, CHUNK_POSTINGS)):
            n, sizes = batch.column(1).to_numpy(), batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            norm = 100 - RANGE + (RANGE * n.astype(np.int64) * n_docs) // length
            waiting.append((batch.column(0).to_pylist(), sizes, terms, own[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(norm, sizes)))))
            postings += len(terms)
            if postings >= CHUNK_POSTINGS:
                take()
                postings = 0
        if waiting:
            take()
        found = [(q, i, -s) for q, best in enumerate(search.best) for s, _, i in best]
        columns = list(zip(*found, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], made_kind), pa.array(columns[2], pa.int64())], ["item", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    made_kind = to_arrow_type(docs.schema[key].dataType)
    found = vectors.mapInArrow(run, f"item int, id {kind}, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    best = stage(found.withColumn("rank", place).where(F.col("rank") <= k), "best")
    discard(vectors)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], f"item int, item_id {item_kind}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score, if it is above 0; equal scores by ascending key, null last.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a
    document's share of it (10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L; N and L are documents with a term and all their terms.
    Null and empty texts, and texts without a term, rank nowhere and ask for nothing. Repeated documents rank each by itself; items of one key
    ask for all their terms together, once each. Items without a match, empty tables of either kind give no rows; other columns are not read.
    """
    items = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t"))
    parts = -(-items.count() // ITEMS_AT_ONCE)
    out = None
    for part in range(parts):
        own: dict[object, list[bytes]] = {}
        for i, t in items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).toLocalIterator():
            own.setdefault(i, []).extend(terms_of(t))
        if any(own.values()):
            found = _ranked(docs, list(own.items()), items.schema["i"].dataType.simpleString(), k, key, text)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {items.schema['i'].dataType.simpleString()}, rank int, doc_id {docs.schema[key].dataType.simpleString()}, score long")
    return out
