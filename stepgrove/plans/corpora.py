"""Step corpora built from the event log and the conversation table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pairing_key
from ..operators import corpus as C
from .catalog import table

# The event types, in position order, and the two seats.
SYMBOLS = ["click", "error", "purchase", "signup", "view"]
PLAYERS = ["X", "O"]


@dataclass
class Corpus:
    """``steps`` (seq_id, ply, action, ...) and ``sequences`` (seq_id, length, result, winner, ...)."""

    steps: DataFrame
    sequences: DataFrame


def seat_player(ply):
    return F.when(ply % 2 == 0, F.lit(PLAYERS[0])).otherwise(F.lit(PLAYERS[1]))


def event_steps(spark, folder, keep=()):
    return C.number_steps(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type", keep)


def event_rows(spark, folder):
    """The events as steps without their number."""
    events = table(spark, folder, "events")
    return events.select(F.col("user_id").alias("seq_id"), F.col("event_type").alias("action"), "ts", "event_id")


def event_sequences(steps, pairs=True):
    """One row per user: a purchase at the end wins for the seat that made it, an error draws.

    Steps without a number give no fingerprint; the rest is the same and needs no ordering of whole sequences.
    ``pairs`` adds the pairing of the first two actions.
    """
    order = ("ts", "event_id")
    last = F.col("last_action")
    found = (
        C.sequence_summary(steps, order, "ply" in steps.columns)
        .withColumn("result", F.when(last == "purchase", "win").when(last == "error", "draw").otherwise("unfinished"))
        .withColumn("winner", F.when(last == "purchase", seat_player(F.col("length") - 1)))
    )
    if not pairs:
        return found
    return (
        found.join(C.nth_action(steps, 2, order, "second_action"), "seq_id", "left")
        .withColumn("strategies", F.array("first_action", "second_action"))
        .withColumn("pairing", pairing_key("strategies"))
    )


def event_corpus(spark, folder):
    return Corpus(event_steps(spark, folder), event_sequences(event_rows(spark, folder)))


def windows(steps, size):
    """Consecutive runs of ``size`` steps of a sequence as arrays (null where a sequence ends early)."""
    at = lambda i: F.max(F.when(F.col("ply") % size == i, F.col("action")))
    return steps.groupBy("seq_id", F.floor(F.col("ply") / size).cast("bigint").alias("window")).agg(
        F.array(*[at(i) for i in range(size)]).alias("actions"), F.count(F.lit(1)).alias("filled")
    )


def sliding(steps, size):
    """Every run of ``size`` steps of a sequence: seq_id, start (its first ply) and actions.

    A step is dealt to the runs that hold it and the runs are put together by (sequence, start), so a long sequence is
    as many small groups as it has steps.
    """
    starts = F.sequence(F.greatest(F.col("ply") - (size - 1), F.lit(0).cast("bigint")), F.col("ply"))
    dealt = steps.select("seq_id", "ply", "action", F.explode(starts).alias("start"))
    at = lambda i: F.max(F.when(F.col("ply") - F.col("start") == i, F.col("action")))
    found = dealt.groupBy("seq_id", "start").agg(F.array(*[at(i) for i in range(size)]).alias("actions"), F.count(F.lit(1)).alias("filled"))
    return found.filter(F.col("filled") == size).drop("filled")


STEPS_SQL = """steps AS (
  SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ply,
         event_type AS action, ts, event_id, value
  FROM events),
seqs AS (
  SELECT seq_id, count(*) AS length, min_by(action, ply) AS first_action, max_by(action, ply) AS last_action,
         list(action ORDER BY ply) AS actions,
         max(CASE WHEN ply = 1 THEN action END) AS second_action,
         CASE max_by(action, ply) WHEN 'purchase' THEN 'win' WHEN 'error' THEN 'draw' ELSE 'unfinished' END AS result,
         CASE WHEN max_by(action, ply) = 'purchase' THEN CASE (count(*) - 1) % 2 WHEN 0 THEN 'X' ELSE 'O' END END AS winner
  FROM steps GROUP BY seq_id)"""

TALLY_SQL = """count(*) FILTER (result = 'win') AS decisive, count(*) FILTER (result = 'draw') AS draws,
       count(*) FILTER (result = 'unfinished') AS unfinished, count(*) AS total"""
