"""Connected components of an undirected graph, as DataFrame operations only.

Alternates large-star and small-star steps: every node points at the least node it
knows. Each step is one minimum (combined before its shuffle) and one join with it. A graph
that is counted small sends its minima to every task, and a round is one written table. In a
larger one each minimum is written before its join, as a join of two tables whose large keys
Spark can split, so a star of any size is no single task's work; were the minimum computed
in the join's own stage, its keys could not be split. The edge table never leaves the
executors; each round is written out, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.workspace import Written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


#: Edges of a graph whose minima are broadcast: two numbers for each node, of which there are at most twice as many.
BROADCAST_EDGES = 200_000

#: What makes a minimum ready for its join: written, or broadcast.
Ready = Callable[[DataFrame], DataFrame]


def _large_star(edges: DataFrame, ready: Ready) -> DataFrame:
    around = _both(edges)
    least = ready(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, ready: Ready) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ready(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _round(at: Written) -> Written:
    """Both stars of a small graph: one written table."""
    after = Written(_small_star(_large_star(at.df, F.broadcast), F.broadcast), "edges", few=True)
    at.drop()
    return after


def _long_round(at: Written) -> Written:
    """Both stars of a large graph, each minimum and each star written."""
    for star in (_large_star, _small_star):
        held: list[Written] = []

        def ready(least: DataFrame) -> DataFrame:
            held.append(Written(least, "least", few=True))
            return held[-1].df

        after = Written(star(at.df, ready), "edges", few=True)
        for table in (*held, at):
            table.drop()
        at = after
    return at


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, component)`` for every node with an edge to
    another node; ``component`` is the least node reachable. Self-loops and rows with
    a null end are ignored; no edges give an empty table."""
    at = Written(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
        few=True,
    )
    said = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = said(at.df)
    for _ in range(max_rounds):
        before = now
        at = _round(at) if before[0] <= BROADCAST_EDGES else _long_round(at)
        now = said(at.df)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = at.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
