"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fractile.llm.common import scratch

#: Edges, both ways each, that one task takes in place of further rounds.
FEW = 100_000


def _in_one_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of the edges with the smallest node that can be reached."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = y
        return x

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"from": nodes, "to": [top(x) for x in nodes]}, columns=["from", "to"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, component), component being the smallest node that can be reached; nodes without an edge are left out.

    Each round every node moves to the neighbour, or itself, that comes first in
    that round's hashed order, and edges are carried over to where their ends
    went; the hashed order makes the expected number of rounds logarithmic in
    the number of nodes. Each round's tables are written to the shared folder.
    Once at most FEW edges are left, one task joins their nodes.
    """
    both = edges.where("a <> b").select("a", "b")
    both = scratch(both.union(both.select("b", "a")).distinct(), "links")
    where = None
    step = 0
    while left := both.limit(FEW + 1).count():
        few = left <= FEW
        order = F.xxhash64(F.lit(step), F.col("b"))
        nearest = both.groupBy("a").agg(F.min(order).alias("h"), F.min_by("b", order).alias("to"))
        own = F.xxhash64(F.lit(step), F.col("a"))
        moves = nearest.select(F.col("a").alias("from"), F.when(own <= F.col("h"), F.col("a")).otherwise(F.col("to")).alias("to"))
        if few:
            moves = both.where("a < b").coalesce(1).mapInPandas(_in_one_task, "from long, to long")
        moves = scratch(moves, f"moves-{step}")
        if where is None:
            where = moves.select(F.col("from").alias("node"), "to")
        else:
            on = where.join(moves.withColumnRenamed("to", "next"), where["to"] == F.col("from"), "left")
            where = scratch(on.select("node", F.coalesce("next", "to").alias("to")), f"labels-{step}")
        if few:
            break
        moved = both.join(moves.select(F.col("from").alias("a"), F.col("to").alias("x")), "a").join(moves.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
        both = scratch(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"links-{step}")
        step += 1
    if where is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = where.groupBy("to").agg(F.min("node").alias("component"))
    return where.join(least, "to").select("node", "component")
