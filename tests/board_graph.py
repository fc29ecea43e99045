"""The full board graph, generated level by level with Spark, as an edge table for tests."""

from functools import reduce

from pyspark.sql import functions as F

from stepgrove.plans.boards import LINES
from stepgrove.session import materialize

WON = " or ".join(
    "(" + " and ".join(f"substring(board, {p + 1}, 1) = '{who}'" for p in line) + ")" for who in "XO" for line in LINES
)


def board_graph(spark):
    """(states: state, board, mover, terminal, value; edges: src, action, dst)."""
    level = spark.createDataFrame([(".........",)], "board string")
    states, edges = [], []
    for ply in range(10):
        mover = "X" if ply % 2 == 0 else "O"
        here = materialize(level.select(
            "board", F.concat("board", F.lit(f":{mover}")).alias("state"), F.lit(mover).alias("mover"),
            F.expr(WON).alias("won"), (~F.contains("board", F.lit("."))).alias("full"),
        ))
        states.append(here)
        other = "O" if mover == "X" else "X"
        moves = (
            here.filter("not won and not full")
            .select("state", "board", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("action"))
            .filter(F.expr("substring(board, action + 1, 1)") == ".")
            .withColumn("next", F.expr(f"concat(left(board, action), '{mover}', substring(board, action + 2))"))
        )
        edges.append(moves.select(F.col("state").alias("src"), "action", F.concat("next", F.lit(f":{other}")).alias("dst")))
        level = moves.select(F.col("next").alias("board")).distinct()
    union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
    all_states = union(states).select(
        "state", "board", "mover", (F.col("won") | F.col("full")).alias("terminal"),
        F.when(F.col("won"), -1).otherwise(0).alias("value"),
    )
    return materialize(all_states), materialize(union(edges))
