"""State graphs given as an edge table: reachability levels and values by backward induction."""

from pyspark.sql import functions as F

from ..session import drop_table, materialize, store


def reach(edges, start, limit=None):
    """(state, level) of everything reachable from ``start`` (column ``state``), by discovery level.

    ``edges`` has src and dst. Each level is written out before the next one. More than ``limit`` states
    is an error.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select("src", "dst").distinct())
    shape = start.select("state", F.lit(0).alias("level")).schema
    read = lambda *paths: spark.read.schema(shape).parquet(*paths)
    path, n = store(start.select("state").distinct().withColumn("level", F.lit(0)))
    paths, found = [path], n
    while n:
        if limit is not None and found > limit:
            raise ValueError(f"more than {limit} states are reachable")
        frontier = read(paths[-1]).select(F.col("state").alias("src"))
        step = edges.join(frontier, "src", "left_semi")
        fresh = step.select(F.col("dst").alias("state")).distinct()
        fresh = fresh.join(read(*paths).select("state"), "state", "left_anti")
        path, n = store(fresh.withColumn("level", F.lit(len(paths))))
        paths.append(path)
        found += n
    return read(*paths)


def backward_induction(edges, terminals):
    """Values of every state from the player to move: a state is worth its best negated child.

    ``edges``: src, action, dst, any graph without cycles. ``terminals``: state, value. A state gets its value in the
    round after its last child got one: rounds count solved children against the out-degree, so edges may skip levels.
    Returns (values: state, value) and (optimal edges: state, action, dst); all edges that reach the best value are
    kept. States without a value at the end (a cycle, or a leaf that isn't a terminal) are an error. A terminal with
    edges keeps its given value.
    """
    spark = edges.sparkSession
    ends = terminals.select("state", F.col("value").cast("int").alias("value"))
    shape = ends.schema
    path, n = store(ends)
    solved = [path]
    known = spark.read.schema(shape).parquet(path)
    moves = edges.select("src", "action", "dst").join(known.select(F.col("state").alias("src")), "src", "left_anti")
    moves = materialize(moves.distinct())
    open_path, waiting = store(
        moves.groupBy("src").agg(F.count(F.lit(1)).alias("left")).withColumn("best", F.lit(None).cast("int"))
    )
    while n and waiting:
        last = spark.read.schema(shape).parquet(solved[-1]).select(F.col("state").alias("dst"), (-F.col("value")).alias("worth"))
        met = moves.join(last, "dst").groupBy("src").agg(F.count(F.lit(1)).alias("met"), F.max("worth").alias("found"))
        still = spark.read.parquet(open_path).filter("left > 0")
        after, _ = store(still.join(met, "src", "left").select(
            "src", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"), F.greatest("best", "found").alias("best")
        ))
        drop_table(spark, open_path)
        open_path = after
        done = spark.read.parquet(open_path).filter("left = 0")
        path, n = store(done.select(F.col("src").alias("state"), F.col("best").alias("value")))
        solved.append(path)
        waiting -= n
    if waiting:
        raise ValueError(f"{waiting} states have no value: the graph has a cycle, or a leaf is not a terminal")
    values = spark.read.schema(shape).parquet(*solved)
    child = values.select(F.col("state").alias("dst"), (-F.col("value")).alias("worth"))
    best = values.select(F.col("state").alias("src"), "value")
    scored = moves.join(child, "dst").join(best, "src").filter("worth = value")
    return values, scored.select(F.col("src").alias("state"), "action", "dst")


def optimal_sets(optimal):
    """Optimal actions of each state as a sorted array; the actions of one state are few."""
    return optimal.groupBy("state").agg(F.array_sort(F.collect_set("action")).alias("optimal"))


def grid_edges(spark, rows, columns):
    """(position, neighbour) of a grid whose cells are numbered row by row: the cells above, left, right and below."""
    at, width = F.col("position"), F.lit(columns).cast("bigint")
    side = lambda test, step: F.when(test, at + step)
    near = F.array(side(at >= width, -width), side(at % width > 0, -1), side(at % width < width - 1, 1), side(at < (rows - 1) * width, width))
    return spark.range(rows * columns).select(F.col("id").alias("position")).select("position", F.explode(F.array_compact(near)).alias("neighbour"))


def neighbour_lists(edges):
    """The neighbours of every position, ascending."""
    return edges.groupBy("position").agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"))


def neighbourhood(rows, key, positions, allowed, edges, name="neighbours"):
    """``rows`` with the set of allowed positions next to one of ``positions``, ascending.

    ``positions`` and ``allowed`` are array columns of ``rows``, whose ``key`` (a list of columns) is unique and not null;
    ``edges`` has position and neighbour. Rows without such a neighbour, or with null arrays, get an empty set.
    """
    near = rows.select(*key, F.col(allowed).cast("array<bigint>").alias("_allowed"), F.explode(F.col(positions).cast("array<bigint>")).alias("position")).join(edges, "position")
    found = near.filter(F.array_contains("_allowed", F.col("neighbour"))).groupBy(*key).agg(F.array_sort(F.collect_set("neighbour")).alias(name))
    return rows.join(found, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
