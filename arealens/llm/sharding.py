"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first: row by row, a multivariate
hypergeometric draw from the places still free. Each partition then deals out those labels in a random
order of its own, rows are exchanged, and each shard orders what it got by random keys. Every assignment
of rows to places is equally likely, and shard sizes differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealens.llm.draws import multivariate
from arealens.llm.joins import join_counted
from arealens.scratch import stage


def communication_matrix(counts: dict[int, int], shards: int, seed: int) -> dict[int, np.ndarray]:
    """Rows that each partition sends to each shard; column sums are the shard sizes."""
    rng, total = np.random.default_rng(seed), sum(counts.values())
    free = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = {}
    for part in sorted(counts):
        out[part] = multivariate(rng, free, counts[part])
        free = free - out[part]
    return out


def shuffle_to_shards(docs: DataFrame, shards: int = 24, seed: int = 11, bucket_rows: int = 10_000) -> DataFrame:
    """``docs`` with shard (int) and slot (long, gapless from 0 in each shard), rows laid out by shard and slot range.

    Every row is placed by itself whatever it holds, so nulls, empty texts and repeated rows need no care;
    an empty table gives none; columns named shard or slot are replaced. ``docs`` must yield the same rows in the
    same partitions each time, as a scan or a written table does: partitions are counted first, and a
    row beyond its partition's count raises. A shard is ordered in ranges of its random keys, about
    ``bucket_rows`` rows each, so shards of any size take bounded tasks. The driver holds partitions x shards counts.
    """
    docs = docs.drop("shard", "slot")
    place = F.monotonically_increasing_id()
    parts = docs.select(place.alias("_m")).groupBy(F.shiftright("_m", 33).cast("int").alias("p")).count()
    counts = {r["p"]: r["count"] for r in parts.collect()}
    matrix = docs.sparkSession.sparkContext.broadcast(communication_matrix(counts, shards, seed))
    buckets = max(1, -(-sum(counts.values()) // (shards * bucket_rows)))

    @F.pandas_udf("int")
    def label(m: pd.Series) -> pd.Series:
        part, at = m.to_numpy() >> 33, m.to_numpy() & ((1 << 33) - 1)
        out = np.empty(len(m), np.int32)
        for p in np.unique(part):
            if label_of.get("part") != (seed, p):
                labels = np.repeat(np.arange(shards, dtype=np.int32), matrix.value[int(p)])
                np.random.default_rng([seed, int(p)]).shuffle(labels)
                label_of.update(part=(seed, p), labels=labels)
            out[part == p] = label_of["labels"][at[part == p]]
        return pd.Series(out)

    label_of: dict = {}
    placed = docs.withColumn("_m", place).withColumn("shard", label("_m")).withColumn("_r", F.xxhash64(F.lit(seed), "_m"))
    placed = placed.withColumn("_b", F.shiftright(F.shiftrightunsigned("_r", 32) * F.lit(buckets), 32).cast("int"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", "_b").count()
    starts = stage(sizes.select("shard", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")), "starts")
    own = F.row_number().over(Window.partitionBy("shard", "_b").orderBy(F.shiftrightunsigned("_r", 1), "_m"))
    ranked = placed.withColumn("_n", own)
    return join_counted(ranked, starts, ["shard", "_b"]).select(*docs.columns, "shard", (F.col("_start") + F.col("_n") - 1).cast("long").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
