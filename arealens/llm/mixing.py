"""Mixing sources to target weights with a splitting tree of block quotas.

The words of a source form a stream, its documents laid out by hash and key, and the stream is cut into
blocks of equal numbers of words. A source's target becomes an exact quota of blocks: whole passes over
the source and a part of one more. Quotas are split among output shards by a binary tree; at each node the
left half's blocks by source are a multivariate hypergeometric draw. Each pass permutes a source's blocks by a
keyed permutation, and consecutive runs of drawn blocks go to consecutive shards, so no block is drawn
twice in a pass and no list of blocks is ever built. Within a shard blocks are ordered by a hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.llm.draws import multivariate, permuted
from arealens.llm.joins import join_counted
from arealens.llm.text import words
from arealens.operators.ranks import running_sum
from arealens.scratch import stage

CAP = 3  # most times that a document is taken
DRAWS = "array<struct<pass:int,block:bigint,shard:int,begin:bigint,stop:bigint>>"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Each source's share of all sizes by weight, stopped at CAP times its size; what is over is shared anew.

    Weights go to sources by code point, a null source last, again and again. Empty input gives {}.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    found: dict[str | None, float] = {}
    free = list(names)
    while free:
        rest, total = sum(sizes.values()) - sum(found.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > CAP * sizes[s]]
        for s in over or free:
            found[s] = float(CAP * sizes[s]) if over else rest * weight[s] / total
        free = [s for s in free if s not in found]
    return found


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks by source (row) and shard (column): row sums are the quotas, column sums differ by one at most."""
    total, out = int(quotas.sum()), np.zeros((len(quotas), shards), np.int64)
    bounds = [total * k // shards for k in range(shards + 1)]

    def split(own: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = own
            return
        mid = (low + high) // 2
        left = multivariate(np.random.default_rng([seed, low, high]), own, bounds[mid] - bounds[low])
        split(left, low, mid)
        split(own - left, mid, high)

    split(quotas, 0, shards)
    return out


def mix_sources(docs: DataFrame, shards: int = 16, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size (long), target (double), draws and taken (long).

    draws holds, for each pass and block that takes part of the document, the pass, block and shard,
    the words from begin to before stop, and its order in the shard by place and at; taken is their sum. A source's blocks have a thousandth of its words, 1024 at most, so its
    taken words differ from the target by about that. Null and empty texts have size 0 and no draws; a
    null source is a source of its own; repeated rows are documents of their own; an empty table gives no rows.
    Other columns pass through, columns of the new names are replaced. Only sums by source reach the driver.
    """
    docs = docs.drop("size", "source_size", "target", "draws", "taken", "_start").withColumn("size", F.size(words(F.col(text))).cast("long"))
    sizes = {r[0]: r[1] for r in docs.groupBy(source).agg(F.sum("size")).collect()}
    target, names = targets(sizes), list(sizes)
    least = -(-sum(sizes.values()) // (5 * 10**8))  # so that all blocks can be counted in exact draws
    width = {s: max(1, min(1024, n // 1000), least) for s, n in sizes.items()}
    blocks = {s: -(-sizes[s] // width[s]) for s in names}
    quota = {s: min(CAP * blocks[s], round(target[s] / width[s])) for s in names}
    ends = docs.sparkSession.sparkContext.broadcast(split_quotas(np.array([quota[s] for s in names], np.int64), shards, seed).cumsum(axis=1) if names else np.zeros((0, shards)))
    table = [(s, i, sizes[s], target[s], width[s], blocks[s], quota[s], zlib.crc32(("" if s is None else "." + s).encode())) for i, s in enumerate(names)]
    plan = docs.sparkSession.createDataFrame(table, "_s string, _i int, source_size long, target double, _width long, _blocks long, _quota long, _key long")
    placed = running_sum(docs, [source], [key, "size"], "size", "_start").join(F.broadcast(plan) if len(table) <= 100_000 else plan, F.col(source).eqNullSafe(F.col("_s")), "left")

    @F.arrow_udf(DRAWS)
    def draws(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            of, start, size, width, count, wanted, key_of = (x.to_numpy(zero_copy_only=False) for x in p.flatten())
            found = [np.zeros((6, 0), np.int64)]
            for i in np.unique(of[size > 0]):
                own = np.flatnonzero((of == i) & (size > 0))
                w, n, q, k = (int(x[own[0]]) for x in (width, count, wanted, key_of))
                first, last = start[own] // w, (start[own] + size[own] - 1) // w
                row = np.repeat(np.arange(len(own)), last - first + 1)
                block = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
                begin, stop = np.maximum(0, block * w - start[own][row]), np.minimum(size[own][row], (block + 1) * w - start[own][row])
                for turn in range(-(-q // n)):
                    at = turn * n + permuted(block, n, (seed << 34) + (turn << 32) + k)
                    shard = np.searchsorted(ends.value[int(i)], at, side="right")
                    found.append(np.stack([own[row], np.full(len(row), turn), block, shard, begin, stop])[:, at < q])
            flat = np.concatenate(found, axis=1)
            flat = flat[:, np.argsort(flat[0], kind="stable")]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(flat[0], minlength=len(p)))])
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            structs = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(flat[1:], kinds, strict=True)], ["pass", "block", "shard", "begin", "stop"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)

    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["stop"] - d["begin"])
    drawn = placed.withColumn("draws", draws(F.struct("_i", "_start", "size", "_width", "_blocks", "_quota", "_key")))
    # The last shuffle: a part's place in its shard is a hash of its block and pass; the parts of one block follow their words in the source.
    place = lambda d: F.xxhash64(F.lit(seed), F.col(source), d["block"], d["pass"])
    drawn = drawn.withColumn("draws", F.transform("draws", lambda d: d.withField("place", place(d)).withField("at", d["begin"] + F.col("_start"))))
    return drawn.withColumn("taken", taken).select(*docs.columns, "source_size", "target", "draws", "taken")


def mixed_blocks(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The drawn parts of a mix as rows in shard order: shard, place and at (order within the shard), pass, begin, stop and ``text`` (words of the part).

    Rows are dealt out by shard and range of place, so a large shard takes several tasks.
    """
    parts = mixed.select("*", F.explode("draws").alias("_d")).drop("draws").select("*", "_d.*").drop("_d")
    parts = parts.withColumn(text, F.concat_ws(" ", F.slice(words(F.col(text)), (F.col("begin") + 1).cast("int"), (F.col("stop") - F.col("begin")).cast("int"))))
    return parts.repartitionByRange("shard", "place", "at").sortWithinPartitions("shard", "place", "at")


def mixed_documents(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix as documents: a row for each document and pass that takes any of it.

    A document taken whole keeps its text; of one taken in part, the words of each run of blocks are
    joined by spaces and the runs by line ends. n_chars, if there, is the new text's length.
    """
    turns = F.array_sort(F.array_distinct(F.transform("draws", lambda d: d["pass"])))
    rows = mixed.withColumn("_turn", F.explode(turns)).withColumn("_own", F.array_sort(F.filter("draws", lambda d: d["pass"] == F.col("_turn")), lambda a, b: F.signum(a["begin"] - b["begin"]).cast("int")))
    whole = F.aggregate("_own", F.lit(0).cast("long"), lambda a, d: a + d["stop"] - d["begin"]) == F.col("size")
    part = lambda d, i: F.concat(F.when(i == 0, "").when(F.get(F.col("_own"), i - 1)["stop"] == d["begin"], " ").otherwise("\n"), F.array_join(F.slice(F.col("_words"), (d["begin"] + 1).cast("int"), (d["stop"] - d["begin"]).cast("int")), " "))
    rows = rows.withColumn("_words", words(F.col(text))).withColumn(text, F.when(whole, F.col(text)).otherwise(F.array_join(F.transform("_own", part), "")))
    rows = rows.drop("_turn", "_own", "_words", "draws", "taken", "size", "source_size", "target")
    return rows.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in rows.columns else rows
