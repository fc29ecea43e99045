"""Sequences and their steps.

``steps`` has one row per (seq_id, ply). ``sequences`` has one row per seq_id. A sequence that arrives as
an event log is never gathered into one row: its length, outcome and identity are plain aggregates.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import opening_length, step_source
from .ordering import ordinal, running


def number_steps(rows, seq, order, action, keep=(), **options):
    """Event log -> (seq_id, ply, action) with the order columns and ``keep`` carried along."""
    named = rows.select(F.col(seq).alias("seq_id"), F.col(action).alias("action"), *order, *keep)
    return ordinal(named, ["seq_id"], order, "ply", **options)


def expand_sequences(sequences, keep=("outcome", "length")):
    """Stored sequences (``actions`` array) -> one row per step, parent columns repeated."""
    return sequences.select("seq_id", *keep, F.posexplode("actions").alias("ply", "action")).withColumn(
        "ply", F.col("ply").cast("bigint")
    )


def sequence_fingerprint(ply, action):
    """Three sums that identify an ordered action list without gathering it: length and two 64-bit hashes."""
    wide = "decimal(38,0)"
    return F.struct(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(ply, action).cast(wide)).alias("h1"),
        F.sum(F.xxhash64(action, ply, F.lit("second")).cast(wide)).alias("h2"),
    )


def sequence_summary(steps, order=("ply",), fingerprint=True, **extra):
    """One row per sequence: length, first and last action, fingerprint of the whole action list.

    ``order`` names columns that order the steps of a sequence; with the order columns of the source the
    step number is only needed by the ``fingerprint``. ``extra`` adds aggregates by name.
    """
    at = F.struct(*order)
    return steps.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("length"),
        F.min_by("action", at).alias("first_action"),
        F.max_by("action", at).alias("last_action"),
        *([sequence_fingerprint(F.col("ply"), F.col("action")).alias("fingerprint")] if fingerprint else []),
        *[column.alias(name) for name, column in extra.items()],
    )


def nth_action(steps, n, order, name):
    """The ``n``-th action (from 1) of every sequence that has one. Tasks pass on ``n`` rows per sequence at most."""
    rank = F.row_number().over(Window.partitionBy("seq_id").orderBy(*order))
    first = steps.select("seq_id", F.col("action").alias(name), *order).withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return first.filter(F.col("_rank") == n).select("seq_id", name)


def attach_sequences(steps, sequences, columns):
    """Repeat sequence-level columns on every step."""
    return steps.join(sequences.select("seq_id", *columns), "seq_id")


def with_source(steps, fixed, random, actor_name):
    """Add ``opening_plies`` and ``chosen_by``; needs ``ply`` and ``length``."""
    return steps.withColumn("opening_plies", opening_length(F.col("length"), fixed, random)).withColumn(
        "chosen_by", step_source(F.col("ply"), F.col("opening_plies"), fixed, actor_name)
    )


def prefix_states(steps, symbols, *, order=("ply",), exclusive=True, state="state", **options):
    """State before (or after) every step: how often each symbol occurred so far, as an array."""
    measures = {f"_s{i}": (F.col("action") == s).cast("bigint") for i, s in enumerate(symbols)}
    counted = running(steps, ["seq_id"], list(order), measures, exclusive=exclusive, **options)
    return counted.withColumn(state, F.array(*measures)).drop(*measures)


def final_states(steps, symbols, state="state"):
    """State after the last step of every sequence."""
    return steps.groupBy("seq_id").agg(
        F.array(*[F.count_if(F.col("action") == s) for s in symbols]).alias(state)
    )


def fold_states(sequences, initial, merge, *, states="states", final="final_state"):
    """States before each step and the final state of stored ``actions`` arrays, by folding ``merge``."""
    actions = F.col("actions")
    grown = F.aggregate(
        actions,
        F.array(initial),
        lambda seen, action: F.concat(seen, F.array(merge(F.element_at(seen, -1), action))),
    )
    return (
        sequences.withColumn("_grown", grown)
        .withColumn(states, F.slice("_grown", 1, F.size(actions)))
        .withColumn(final, F.element_at("_grown", -1))
        .drop("_grown")
    )


def verify_steps(stored, derived, columns):
    """First mismatch per sequence between stored and re-derived steps; no rows means they agree.

    Columns are compared in the given order at each ply; a step missing on either side is a
    ``position count`` mismatch.
    """
    keys = ["seq_id", "ply"]
    left = stored.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns], F.lit(True).alias("_s"))
    right = derived.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in columns], F.lit(True).alias("_d"))
    both = left.join(right, keys, "full_outer")
    missing = F.col("_s").isNull() | F.col("_d").isNull()
    what = F.when(missing, F.lit("position count"))
    rank = F.when(missing, F.lit(-1))
    for i, c in enumerate(columns):
        differs = ~F.col(f"_s_{c}").eqNullSafe(F.col(f"_d_{c}"))
        what, rank = what.when(differs, F.lit(c)), rank.when(differs, F.lit(i))
    return (
        both.select("seq_id", "ply", what.alias("what"), rank.alias("rank"))
        .filter(F.col("what").isNotNull())
        .groupBy("seq_id")
        .agg(F.min(F.struct("ply", "rank", "what")).alias("first"), F.count(F.lit(1)).alias("mismatches"))
        .select("seq_id", F.col("first.ply").alias("ply"), F.col("first.what").alias("what"), "mismatches")
    )


def verify_sequences(stored, derived, columns):
    """Same check for sequence-level columns such as length and final state."""
    zero = F.lit(0).cast("bigint").alias("ply")
    return verify_steps(
        stored.select("seq_id", zero, *columns), derived.select("seq_id", zero, *columns), columns
    ).select("seq_id", "what")
