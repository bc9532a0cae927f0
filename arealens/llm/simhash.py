"""Near copies by SimHash fingerprints that differ in few bits, found by meeting in the middle of the ball between them.

A fingerprint's bit is the majority of that bit over the 64-bit hashes of a text's word shingles. Two fingerprints at a distance of
2k or less have a variant in common that lies within k bits of both, so each distinct fingerprint is sent to all its variants within k bits.
A variant has no more fingerprints near it than there are variants in a ball, however many texts share them, so no group grows with the
table, and all that meet at a variant lie within 2k bits of each other: each is linked to the least of them, which keeps every component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.llm.joins import join_heavy_apart
from arealens.llm.text import text_slices
from arealens.operators.graph import connected_components
from arealens.scratch import discard, stage

BITS = 64
SEED = 42
_LANES = np.uint64(0x0101010101010101)
_LANE_SUM = 255  # shingles whose bits add up in a byte


def shingle_hashes(text: bytes, width: int) -> tuple[bytes, int]:
    """Big-endian XXH64 of each run of ``width`` words, joined by spaces, and their number; of all words if there are fewer."""
    words = text.lower().split()  # ASCII only: A-Z, and space with \t\n\v\f\r
    if len(words) <= width:
        return (xxhash.xxh64_digest(b" ".join(words), SEED), 1) if words else (b"", 0)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]), len(starts)


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of consecutive runs of ``sizes`` hashes: bits that more than half of a run have; 0 for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    size = sizes[full]
    parts = -(-size // _LANE_SUM)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(size) - size, parts) + _LANE_SUM * (np.arange(parts.sum()) - np.repeat(first, parts))
    counts = np.empty((len(starts), 8, 8), np.int64)  # part, byte, bit
    for bit in range(8):  # eight bits a pass, each added up in its own byte
        counts[:, :, bit] = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts.reshape(-1, BITS), first, axis=0)
    out[full] = np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row's whole text with A-Z lower-cased; the 64 bits as a long, 0 for a text that is null or has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                made = [shingle_hashes(x or b"", width) for x in part.column(1).cast(pa.large_binary()).to_pylist()]
                hashes = np.frombuffer(b"".join([h for h, _ in made]), ">u8").astype(np.uint64)
                bits = majority_bits(hashes, np.array([n for _, n in made], np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64))], [key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint long")


def ball(half: int) -> list[int]:
    """Masks of at most ``half`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def near_fingerprints(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column ``fingerprint``) of ``radius`` or fewer differing bits that join the same
    components as all of them; each fingerprint of a variant's ball is linked to the least one there. ``radius`` is even."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius must be 0, 2 or 4: half of it is the radius of the variants")
    variants = distinct.select("fingerprint", F.explode(F.array(*[F.lit(m) for m in ball(radius // 2)])).alias("mask"))
    met = variants.groupBy(F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant")).agg(F.collect_list("fingerprint").alias("near"))
    pairs = met.where(F.size("near") > 1).select(F.array_min("near").alias("src"), F.explode("near").alias("dst")).where("src <> dst").distinct()
    return pairs.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius)


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``; ``fingerprint`` as a long.

    Rows whose fingerprints differ in ``radius`` or fewer bits are linked; component_id is the least key reachable by links, the row's own
    included. Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other. A null key keeps its row and
    carries links, but is no component_id unless all keys of the component are null. Rows of one key are judged each by its own text.
    An empty table gives no rows; other columns are not read.
    """
    rows = stage(fingerprints(docs, width, key, text).select(F.col(key).alias("id"), "fingerprint"), "fingerprints")
    distinct = stage(rows.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("held")), "distinct_fingerprints")
    links = stage(near_fingerprints(distinct.select("fingerprint"), radius), "links")
    found = stage(connected_components(links), "components")
    placed = distinct.join(found, distinct["fingerprint"] == found["id"], "left").select("fingerprint", "held", "least", F.coalesce("component", "fingerprint").alias("component"))
    placed = stage(placed, "placed")
    groups = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("parts"))
    shared = placed.join(groups, "component").where("parts > 1 or held > 1")  # any other fingerprint is its row's alone
    named = stage(shared.select("fingerprint", "held", "component_id"), "named")
    discard(distinct, links, found, placed)
    joined = join_heavy_apart(rows, named, "fingerprint", "held")
    mine = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(key), "fingerprint", mine.alias("component_id"))
