"""Connected components of an edge table by alternating large-star and small-star steps."""

from pyspark.sql import functions as F

from stepgrove.session import drop_table, store


def _stars(edges):
    """One large-star and one small-star step over edges (high, low) with high > low."""
    both = edges.select(F.col("high").alias("a"), F.col("low").alias("b")).unionByName(
        edges.select(F.col("low").alias("a"), F.col("high").alias("b"))
    )
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("least").alias("y")).distinct()
    lowest = large.groupBy("x").agg(F.min("y").alias("least"))
    pairs = large.join(lowest, "x")
    return (
        pairs.filter("y <> least").select(F.col("y").alias("high"), F.col("least").alias("low"))
        .unionByName(lowest.select(F.col("x").alias("high"), F.col("least").alias("low")))
        .distinct()
    )


def _state(edges):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(edges):
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of the component.

    Loops and repeated edges are allowed; no edges give an empty table. Each round is one written table, so lost
    executors cost a task, not the loop; minima are taken before the shuffle, and the edges of a hot node are only
    met in an equi-join that adaptive execution may split. The driver sees a count and a checksum per round.
    """
    spark = edges.sparkSession
    path, _ = store(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    )
    state = _state(spark.read.parquet(path))
    while state[0]:
        after, _ = store(_stars(spark.read.parquet(path)))
        drop_table(spark, path)
        path, before, state = after, state, _state(spark.read.parquet(after))
        if state == before:
            break
    found = spark.read.parquet(path)
    roots = found.select(F.col("low").alias("node")).distinct().withColumn("root", F.col("node"))
    return found.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)
