"""Connected components of a graph given as edges, without gathering any component in one place."""

from pyspark.sql import DataFrame, functions as F

from postmill.session import written


def components(edges: DataFrame, label="components") -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its smallest node.

    Alternates the two star steps: every node's larger neighbours, then its smaller ones, are linked to the smallest node
    known to it, until only stars are left. Each step is a map-side minimum and a join that splits hot nodes. Steps are
    written to the shared folder, so a lost executor costs one step. Null ends and loops are ignored.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), label)
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if before == state:
            break
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(smallest.select("a", F.col("m").alias("b"))).distinct(), label)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
