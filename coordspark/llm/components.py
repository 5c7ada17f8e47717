"""Connected components of a table of links, by DataFrame rounds of hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in ``links`` (a long, b long).

    Alternating large-star and small-star steps: every id hands its smaller neighbours to the smallest of
    them. Each step is one aggregate and one join, linear in the links; the number of rounds grows with
    the logarithm of the longest path. Rounds are written to the shared folder, so lineage stays short.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        edges = written(edges, "components")
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = written(small.distinct(), "components")
        if not (edges.select("a", "b").exceptAll(after.select("a", "b")).take(1) or after.exceptAll(edges).take(1)):
            break
        edges = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
