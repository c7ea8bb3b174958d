"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v: every node hands its least neighbour on."""
    ends = edges.unionByName(edges.selectExpr("v AS u", "u AS v")) if large else edges
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = ends.join(least, "u")
    if large:
        moved = joined.where("v > u").selectExpr("v AS u", "m AS v")
    else:
        moved = joined.selectExpr("v AS u", "m AS v").unionByName(least.selectExpr("u", "m AS v"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the least node of its component) of every node that has an edge.

    Edges with a null end and loops are left out; repeated and reversed edges count once; without
    edges the result is empty. Each round is written to the shared folder, so a lost executor costs
    one round; a node with very many neighbours is pre-aggregated and its join may be split.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = cut(e.distinct())
    while True:
        after = cut(_star(_star(e, True), False))
        mark = [x.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first() for x in (e, after)]
        e = after
        if mark[0] == mark[1]:
            break
    return e.selectExpr("u AS node", "v AS root").unionByName(e.selectExpr("v AS node", "v AS root").distinct())
