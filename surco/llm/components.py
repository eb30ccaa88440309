"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surco.session import written_once


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; nodes of one component share the root.

    Each round every node moves onto the member of its neighbourhood that comes first in the round's
    pseudorandom order, and the edges are rewritten to those. The graph shrinks by a constant share a
    round whatever its shape, chains included; a clique is gone after one or two. Both tables of a
    round are written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    left = written_once(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        turn = F.lit(len(moves))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("to"))
        move = written_once(first.select(F.col("a").alias("node"), F.least("m", own)["to"].alias("root")))
        moves.append(move)
        left = written_once(
            left.join(move.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    if not moves:
        return spark.createDataFrame([], "node bigint, root bigint")
    out = moves[0]
    for move in moves[1:]:
        out = out.join(move.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select(
            "node", F.coalesce("further", "root").alias("root"))
    return out
