"""Connected components of an undirected graph, by alternating large and small stars.

Every round writes its edges below ``spark.checkpoint.dir``, so a lost executor costs one round. Nodes with very many
neighbours are safe: minima are pre-aggregated and stored, and the joins with them are of the kind that adaptive execution
splits at hot keys.
"""

from pyspark.sql import DataFrame, functions as F

from sieveline.llm.common import stored


def _with_least(edges: DataFrame, name: str) -> DataFrame:
    """Edges (a, b) with m, the least of a and all its neighbours."""
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), name)
    return edges.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) of longs to (node, root): every node but the least of its component, with that least one."""
    def normal(e):
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    def facts(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stored(normal(edges), "links")
    before, after = None, facts(now)
    while after[0] and before != after:
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(
            now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        large = stored(_with_least(both, "least").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
                       .distinct(), "links")
        down = _with_least(large.select(F.col("u").alias("a"), F.col("v").alias("b")), "least")
        small = down.select(F.explode(F.array(F.struct(F.col("b").alias("u"), F.col("m").alias("v")),
                                              F.struct(F.col("a").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = stored(normal(small), "links")
        before, after = after, facts(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
