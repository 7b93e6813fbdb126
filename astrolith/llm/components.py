"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolith.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: of the neighbours of each u, those above u (large) or those up to u
    (small) are hung below the least label around u."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    around = both.join(least, "u")
    if large:
        out = around.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = around.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges`` (u long, v long), label the least node that
    it reaches. Alternating large-star and small-star steps: each is one aggregation and one
    join, the number of edges never grows, and rounds are logarithmic in practice.
    Every round is written to the shared folder, so a lost executor repeats one round."""
    now = materialise(edges.where("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    for _ in range(most):
        before, now = now, materialise(_star(_star(now, True), False), "edges")
        discard(before)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    own = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(own)
