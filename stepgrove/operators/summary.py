"""Outcome tallies, diversity metrics and their pass/fail gates."""

from dataclasses import dataclass

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..session import materialize
from .ordering import running


def tally_columns(result=None):
    """Draws, unfinished, decisive and total of a ``result`` column."""
    result = F.col("result") if result is None else result
    return [
        F.count_if(result == "win").alias("decisive"),
        F.count_if(result == "draw").alias("draws"),
        F.count_if(result == "unfinished").alias("unfinished"),
        F.count(F.lit(1)).alias("total"),
    ]


def outcome_tally(rows, keys=()):
    """Outcomes per key; wins by winner are in :func:`wins_by_winner`."""
    return rows.groupBy(*keys).agg(*tally_columns())


def outcome_by_ply(sequences):
    """Outcomes of the sequences that reach each ply, 0 to the longest sequence's last.

    Sequences are tallied by length first, so no step is joined. The sequences that reach a ply are the sum of the tallies
    of all greater lengths: one running sum over the plies, so the work is the longest length, not the sum of all lengths.
    """
    names = ["decisive", "draws", "unfinished", "total"]
    seen = Observation()
    tallied = materialize(outcome_tally(sequences.filter(F.col("length") > 0), ["length"]).observe(seen, F.max("length").alias("longest")))
    longest = seen.get.get("longest") or 0
    plies = sequences.sparkSession.range(longest).withColumnRenamed("id", "ply")
    ends = tallied.select((F.col("length") - 1).cast("bigint").alias("ply"), *names)
    down = plies.join(ends, "ply", "left").select("ply", (-F.col("ply")).alias("_down"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return running(down, [], ["_down"], {n: F.col(n) for n in names}, max_group=longest).select("ply", *names)


def wins_by_winner(rows, keys=()):
    return rows.filter(F.col("result") == "win").groupBy(*keys, "winner").agg(F.count(F.lit(1)).alias("wins"))


def outcome_grouping_sets(sequences, dimensions):
    """Overall and per-dimension tallies of ``sequences`` in one aggregation."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = sequences.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        *tally_columns(), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions]
    )
    dimension, key = F.lit("overall"), F.lit("all")
    for d in dimensions:
        dimension = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dimension)
        key = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(key)
    return grouped.select(
        dimension.alias("dimension"), key.alias("key"), "decisive", "draws", "unfinished", "total"
    )


def distinct_states(steps, sequences, state="state", canonical="canonical_state"):
    """Exact number of distinct raw and canonical states over steps and final states."""
    both = steps.select(state, canonical).unionByName(sequences.select(state, canonical))
    return both.distinct().agg(
        F.countDistinct(state).alias("distinct_states"),
        F.countDistinct(canonical).alias("distinct_canonical_states"),
    )


#: Base-2 logarithm of a sketch's registers.
SKETCH_BITS = 12


def state_sketches(states, by, state="state", bits=SKETCH_BITS):
    """A mergeable sketch of the distinct states of each group: small rows that runs can store and later ones add to."""
    return states.groupBy(*by).agg(F.hll_sketch_agg(state, F.lit(bits)).alias("sketch"))


def sketched_states(sketches, by=()):
    """The estimated number of distinct states of the groups' stored sketches taken together."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimated_states"))


def sketch_error(bits=SKETCH_BITS, deviations=3):
    """The relative error that an estimate from merged sketches stays within: so many standard deviations."""
    return deviations * 1.04 / 2 ** (bits / 2)


@dataclass(frozen=True)
class Thresholds:
    min_canonical_coverage: float = 0.5
    min_decisive_fraction: float = 0.2
    min_distinct_fraction: float = 0.5


def diversity_metrics(sequences, states, known_canonical=None):
    """One row of corpus metrics from sequences (result, fingerprint) and a :func:`distinct_states` row."""
    known = F.lit(known_canonical).cast("bigint")
    found = states.select(F.struct("distinct_states", "distinct_canonical_states")).scalar()
    return (
        sequences.agg(
            F.count(F.lit(1)).alias("sequences"),
            F.sum("length").alias("steps"),
            F.countDistinct("fingerprint").alias("distinct_sequences"),
            F.count_if(F.col("result") == "win").alias("decisive"),
        )
        .withColumn("_states", found)
        .select("*", "_states.*")
        .drop("_states")
        .withColumns({
            "distinct_fraction": ratio("distinct_sequences", "sequences"),
            "decisive_fraction": ratio("decisive", "sequences"),
            "canonical_coverage": F.when(known.isNotNull(), ratio(F.col("distinct_canonical_states"), known)),
        })
    )


GATES = (
    ("canonical_coverage", "min_canonical_coverage"),
    ("decisive_fraction", "min_decisive_fraction"),
    ("distinct_fraction", "min_distinct_fraction"),
)


def diversity_gates(metrics, thresholds=Thresholds()):
    """One row per gate in fixed order: value, threshold, pass flag and the failure message."""
    rows = [
        F.struct(
            F.lit(i).alias("gate"),
            F.lit(name).alias("metric"),
            F.col(name).alias("value"),
            F.lit(float(getattr(thresholds, limit))).alias("threshold"),
        )
        for i, (name, limit) in enumerate(GATES)
    ]
    gate = metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    passed = F.col("value").isNull() | (F.col("value") >= F.col("threshold"))
    text = F.format_string("%s %.2f < %.2f", "metric", "value", "threshold")
    return gate.withColumn("passed", passed).withColumn("message", F.when(~passed, text))


def checks_pass(gates):
    """AND of every gate."""
    return gates.agg(F.bool_and("passed").alias("checks_pass"))
