"""Nearest neighbours by a hierarchical k-means tree, leaves visited best bin first.

The tree is fitted on a bounded sample (FIT_ROWS vectors by least hash of their ids); every vector is then
dealt to a leaf. A query walks the tree through a priority queue of the branches not taken, which
yields leaves in order of their promise; how many it visits is set on CALIBRATE queries, whose true neighbours are found
by brute force over all vectors: visits are widened leaf by leaf until the recall of these queries reaches the aim.
Scores are added up component by component in double precision, so equal vectors score equally wherever they lie.

Leaves are searched in chunks of vectors. A task holds one chunk and streams the queries that visit it, so vectors are
moved once, however many queries there are; only a leaf with more than VISITS of them has its chunks repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealens.llm.joins import join_counted
from arealens.scratch import stage

FIT_ROWS = 20_000
CALIBRATE = 100
CHUNK = 2_000  # vectors of a leaf that one task holds at a time
VISITS = 50_000  # queries of a leaf that one chunk answers; beyond it the chunk is repeated


FOUND = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int64())])


class Tree:
    """A k-means tree: centres of inner nodes' children, leaves numbered from 0."""

    def __init__(self, points: np.ndarray, branch: int = 8, leaf: int = 200, seed: int = 3) -> None:
        self.rng, self.branch, self.leaf = np.random.default_rng(seed), branch, leaf
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf_of: dict[int, int] = {}
        self._grow(points)

    def _grow(self, points: np.ndarray) -> int:
        node = len(self.centres)
        self.centres.append(None)
        self.children.append([])
        distinct = np.unique(points, axis=0) if len(points) > self.leaf else points
        if len(points) <= self.leaf or len(distinct) <= self.branch:
            self.leaf_of[node] = len(self.leaf_of)
            return node
        centres = distinct[self.rng.choice(len(distinct), self.branch, replace=False)]
        for _ in range(12):
            own = self.nearest(points, centres)
            centres = np.array([points[own == k].mean(axis=0) if (own == k).any() else c for k, c in enumerate(centres)])
        own = self.nearest(points, centres)
        kept = [k for k in range(self.branch) if (own == k).any()]
        if len(kept) < 2:
            self.leaf_of[node] = len(self.leaf_of)
            return node
        self.centres[node] = centres[kept]
        self.children[node] = [self._grow(points[own == k]) for k in kept]
        return node

    @staticmethod
    def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf_of:
                out[rows] = self.leaf_of[node]
            else:
                own = self.nearest(points[rows], self.centres[node])
                todo += [(child, rows[own == k]) for k, child in enumerate(self.children[node]) if (own == k).any()]
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order: branches wait in a queue by their centre's distance to the query."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while node not in self.leaf_of:
                far = ((self.centres[node] - query) ** 2).sum(axis=1)
                best = int(far.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != best:
                        heapq.heappush(queue, (float(far[k]), child))
                node = self.children[node][best]
            yield self.leaf_of[node]


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, added up in the order of the components for every pair."""
    total = np.zeros((len(queries), len(vectors)))
    columns = np.ascontiguousarray(vectors.T)
    for d in range(queries.shape[1]):
        total += queries[:, d, None] * columns[d][None, :]
    return total


def _best(asking: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of ``vectors`` for each query; ``asking`` and ``rows`` number the rows of the table, so that only a query's own row is left out."""
    order = np.lexsort((rows, ids))
    rows, ids, vectors = rows[order], ids[order], vectors[order]
    out = []
    for at in range(0, len(queries), 64):
        own = asking[at : at + 64]
        scores = _scores(queries[at : at + 64], vectors)
        scores[own[:, None] == rows[None, :]] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(scores, top, axis=1)
        frame = pd.DataFrame({"query": np.repeat(own, top.shape[1]), "row": rows[top].ravel(), "vec_id": ids[top].ravel(), "score": found.ravel()})
        out.append(frame[np.isfinite(frame["score"])])
    return pd.concat(out) if out else pd.DataFrame({"query": [], "row": [], "vec_id": [], "score": []})


def _chunk_search(rows: DataFrame, k: int) -> DataFrame:
    """Best k of each (query, chunk): rows are vectors (side 0) and queries (side 1) of (leaf, chunk, block)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers, ids, vectors = None, np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)], axis=1)
            number, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 5))
            v = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else None
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(own) else []
            for rows in np.split(np.arange(len(own)), cuts) if len(own) else []:
                *group, side = keys[rows[0]].tolist()
                if side == 0:
                    fresh = held != group
                    numbers = number[rows] if fresh else np.concatenate([numbers, number[rows]])
                    ids = own[rows] if fresh else np.concatenate([ids, own[rows]])
                    vectors = v[rows] if fresh else np.concatenate([vectors, v[rows]])
                    held = group
                elif held == group:
                    yield pa.RecordBatch.from_pandas(_best(number[rows], v[rows], numbers, ids, vectors, k).assign(leaf=group[0]), schema=FOUND, preserve_index=False)

    keys = ["leaf", "chunk", "block"]
    sorted_rows = rows.select(*keys, "side", "row", "id", "v").repartition(*keys).sortWithinPartitions(*keys, "side")
    return sorted_rows.mapInArrow(search, "query long, row long, vec_id long, score double, leaf long")


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, leaves): the k largest inner products found for rows whose key is divisible by ``every``.

    Rows with a null key or a vector that is null, empty, zero, of another length than most, or holds null or non-finite
    components take no part. Ties go to the smaller vec_id; a query's own row is no candidate of it. Rows of
    one id are candidates each, also of one another, and those of a query's id are queries each, with a list of their own. If there are fewer than k candidates, or the aim asks for it, all leaves are visited. No rows, no
    result; other columns are not read.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    sound = sound.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, leaves int")
    widths = sound.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return empty
    sound = sound.where(F.size("v") == widths["w"])
    # Only about as many rows as are fitted are sent to be sorted: those whose hash falls in that share of its range.
    share = min(1.0, (1.2 * FIT_ROWS + 100) / widths["count"])
    few = sound.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 1) <= min(int(share * 2**63), 2**63 - 1))
    sample = few.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toPandas()
    if sample.empty:  # a few ids that are repeated very often
        sample = sound.limit(FIT_ROWS).toPandas()
    tree = Tree(np.array(sample["v"].tolist()))
    shared = spark.sparkContext.broadcast(tree)
    leaves = len(tree.leaf_of)

    @F.pandas_udf("long")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.leaves(np.array(v.tolist())) if len(v) else [], dtype="int64")

    index = stage(sound.withColumns({"leaf": leaf_of("v"), "row": F.monotonically_increasing_id()}), "index")
    # A leaf's rows are dealt over chunks by hash, as many as its size asks for: equal vectors all share one leaf.
    chunks = stage(index.groupBy("leaf").agg(F.count("*").alias("held"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks")
    held = dict(chunks.select("leaf", "held").toPandas().itertuples(index=False))  # one number a leaf of the tree
    dealt = join_counted(index, chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), "chunks").cast("int"))
    queries = index.where(F.col("id") % every == 0).select("row", "id", "v")

    def search(asked: DataFrame, widest: int) -> DataFrame:
        """Best k per (query, chunk) over the first ``widest`` leaves of each query, more if they hold too few vectors."""

        @F.pandas_udf("array<long>")
        def route(v: pd.Series) -> pd.Series:
            def leaves_of(x: list[float]) -> list[int]:
                seen, room = [], 0
                for leaf in shared.value.visits(np.array(x)):
                    if len(seen) >= widest and room > k:
                        break
                    seen.append(leaf)
                    room += held.get(leaf, 0)
                return seen

            return pd.Series([leaves_of(x) for x in v])

        routes = stage(asked.select("row", "id", "v", F.explode(route("v")).alias("leaf")), "routes")
        loads = routes.groupBy("leaf").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("blocks"))
        loads = stage(loads.join(chunks, "leaf").select("leaf", "chunks", "blocks"), "loads")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asking = join_counted(routes, loads, "leaf").withColumn("chunk", each("chunks")).withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
        asked_of = join_counted(dealt.drop("chunks"), loads.drop("chunks"), "leaf").withColumn("block", each("blocks"))
        side = lambda df, n: df.select(*[F.col(c).cast("long") for c in ("leaf", "chunk", "block")], F.lit(n).cast("long").alias("side"), "row", "id", "v")
        return _chunk_search(side(asked_of, 0).unionByName(side(asking, 1)), k)

    def top(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    probe = stage(queries.orderBy(F.xxhash64("id", F.lit(2)), "id", "row").limit(CALIBRATE), "probe")
    truth = top(search(probe, leaves)).select("query", "leaf").toPandas()
    order = {q: {leaf: at for at, leaf in enumerate(tree.visits(np.array(v)))} for q, v in probe.select("row", "v").toPandas().itertuples(index=False)}
    steps = np.sort([order[q][leaf] for q, leaf in truth.itertuples(index=False)])
    widest = int(steps[int(np.ceil(recall * len(steps))) - 1]) + 1 if len(steps) else leaves
    named = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return top(search(queries, widest)).join(named, "query").select("query_id", "rank", "vec_id", "score", F.lit(widest).alias("leaves"))
