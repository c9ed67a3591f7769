"""Connected components by contraction, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import written

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in the links (a, b); a component is named by its least id.

    Each round every node joins the first of itself and its neighbours, and the graph shrinks to the
    nodes that were joined: by least id, which ends stars at once, and in every other round by a hash,
    which shrinks chains by a share. The number of rounds grows with the logarithm of the size; should links be left after all rounds,
    that is an error.
    """
    edges = written(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    names = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("label"))
    for turn in range(ROUNDS):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        rank = F.xxhash64(F.lit(turn), "b") if turn % 2 else F.col("b")
        own = F.xxhash64(F.lit(turn), "a") if turn % 2 else F.col("a")
        first = both.groupBy("a").agg(F.min(F.struct(rank.alias("rank"), F.col("b").alias("node"))).alias("best"))
        self_ = F.struct(own.alias("rank"), F.col("a").alias("node"))
        hop = first.select(F.col("a").alias("node"), F.least("best", self_)["node"].alias("to"))
        # Follow what was joined one step further: a star around any of its nodes is one node at once.
        on = hop.select(F.col("node").alias("to"), F.col("to").alias("further"))
        joins = written(hop.join(on, "to").select("node", F.col("further").alias("to")), "joins")
        names = names.join(joins, names["label"] == joins["node"], "left").select(
            "id", F.coalesce("to", "label").alias("label"))
        edges = written(
            edges.join(joins.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(joins.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        if not edges.isEmpty():
            raise RuntimeError(f"links are left after {ROUNDS} rounds")
    names = written(names, "labels")
    least = names.groupBy("label").agg(F.min("id").alias("component"))
    return names.join(least, "label").select("id", "component")
