"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.scratch import discard, stage


def _pull(edges: DataFrame) -> DataFrame:
    """Least neighbour (or the node itself) of each source, joined back to every edge of it."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return edges.join(least, "src")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _pull(both).where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    linked = _pull(down)
    return (
        linked.select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        .unionByName(linked.select("src", F.col("m").alias("dst")))
        .where("src <> dst")
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Components of an undirected graph given as rows ``(src, dst)`` of long ids.

    Returns ``(id, component)`` for every node of an edge, ``component`` being the least id that is
    reachable. Loops, repeated and reversed edges do not matter; rows with a null end are ignored; no
    edges give no rows. Work per round is linear in the edges, also at a node with very many of them,
    since neighbours are never gathered in one place. Rounds grow with the logarithm of a component's
    diameter; each is written to the shared folder, where it replaces the one before, and ``RuntimeError`` is raised after ``max_rounds``.
    """
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null")
    nodes = stage(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct(), "nodes")
    state = stage(edges.where("src <> dst").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        last, state = state, stage(_small_star(_large_star(state)), "edges")
        discard(last)
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(state.select(F.col("src").alias("id"), F.col("dst").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
