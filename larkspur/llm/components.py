"""Connected components of an edge table, without collecting it.

Alternating large-star and small-star rounds: every node points its larger
(then its smaller-or-equal) neighbours at the smallest node of its
neighbourhood, until the edges form stars.  Every round is a few joins and
aggregations on the node id; its result is a written table, so that lineage
stays short and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import drop_table, join_counted, materialise


def _star(pairs: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v) with every u's smallest neighbour-or-self; the minima are a table of their own,
    so that a node with very many neighbours fills no task."""
    least = materialise(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), label)
    return join_counted(pairs, least, ["u"], "n"), least


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    edges: two long columns a and b, in any order and with repetitions; null ids,
    loops and an empty table are fine (a loop alone gives no row).
    """
    kept = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = materialise(kept.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:  # every round brings the edges nearer to stars, which a round leaves as they are
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        starred, least = _star(both, "least")
        large = materialise(starred.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        starred, lower = _star(large, "lower")
        small = starred.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(lower.select(F.col("u").alias("a"), F.col("m").alias("b")))
        then = materialise(small.distinct(), "edges")
        after = _mark(then)
        for old in (least, large, lower, now):
            drop_table(old)
        now, settled, mark = then, after == mark, after
        if settled:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge table: equal tables have equal marks."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(F.xxhash64("a", "b"), 24)), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(x or 0 for x in row)
