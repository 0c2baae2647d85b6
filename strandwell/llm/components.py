"""Connected components of an undirected graph by alternating star contractions.

Defined results: an edge with a null end or from a node to itself joins nothing; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwell.llm.common import forget, join_by_count, materialise


def _stars(edges: DataFrame, n: int, label: str) -> DataFrame:
    """One large-star and one small-star step over n stored edges (a, b), stored. Hubs, nodes of very many edges, don't travel to one task.

    What is read more than once is written first, so that plans stay short; it goes when the step is done."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("d")), f"{label}-least")
    pulled = join_by_count(both, least, "a", "d", 2 * n).filter(F.col("b") > F.col("a"))
    large = materialise(pulled.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), f"{label}-large")
    small = materialise(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d")), f"{label}-small")
    met = join_by_count(large, small, "a", "d", 2 * n)
    centre = met.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    after = materialise(centre.unionByName(small.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), label)
    for table in (least, large, small):
        forget(table)
    return after


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root (the least node of its component) for every node that has an edge and isn't the least itself.

    Edges have columns a and b of any ordered type; each round is written to the shared folder, so rounds don't pile up in the lineage, and
    the round before it is removed."""
    oriented = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = materialise(oriented, label), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen or not state["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, before = state, now
        now = _stars(now, state["n"], label)
        forget(before)
