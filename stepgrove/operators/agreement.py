"""Ground-truth labels on states: coverage, agreement rates, label cross-checks."""

from pyspark.sql import functions as F

from ..functions.scalars import ratio


def distinct_states(steps, state="state", order=("seq_id", "ply")):
    """States to label: one row each with its first appearance and number of occurrences.

    A plain aggregate, so a state that fills a third of the corpus collapses before the shuffle.
    """
    return (
        steps.groupBy(state)
        .agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("occurrences"))
        .select(state, "first.*", "occurrences")
    )


def attach_labels(states, labels, second, state="state"):
    """Left join a label table and a second labeller; ``agrees`` is null where the second has no answer."""
    return (
        states.join(labels, state, "left")
        .join(second, state, "left")
        .withColumn("agrees", F.array_contains("optimal", F.col("second_action")))
    )


def label_counts(annotations):
    """Rows, terminal rows and explicit disagreements (a null check is not a disagreement)."""
    return annotations.agg(
        F.count(F.lit(1)).alias("annotated"),
        F.count_if(F.col("terminal")).alias("terminal"),
        F.count_if(F.col("agrees") == F.lit(False)).alias("disagreements"),
    )


def uncovered(steps, annotations, state="state"):
    """Distinct step states without a label, with their number of steps."""
    counted = steps.groupBy(state).agg(F.count(F.lit(1)).alias("steps"))
    return counted.join(annotations.select(state), state, "left_anti")


def require_coverage(steps, annotations, state="state"):
    if not uncovered(steps, annotations, state).isEmpty():
        raise ValueError("annotations do not cover every step; annotate the corpus again")


def usual_moves(moves):
    """The most frequent actions of every state, ties kept, as a label table. A state has one row per distinct action."""
    counted = moves.groupBy("state", "action").agg(F.count(F.lit(1)).alias("n"))
    gathered = counted.groupBy("state").agg(F.max("n").alias("top"), F.collect_list(F.struct("action", "n")).alias("a"))
    best = F.filter("a", lambda x: x["n"] == F.col("top"))
    return gathered.select("state", F.array_sort(F.transform(best, lambda x: x["action"])).alias("optimal"))


def judged_counts(steps, annotations, by, state="state", carry=()):
    """Steps ⋈ annotations, counted per ``by``. Steps are pre-aggregated on (state, action, by), so the
    join sees each combination once however hot its state is."""
    grouped = steps.groupBy(state, "action", *by).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.array_contains("optimal", F.col("action"))
    joined = grouped.join(annotations.select(state, "optimal", F.lit(True).alias("_known"), *carry), state, "left")
    return joined.withColumns({
        "_hit": F.when(hit, F.col("_n")).otherwise(F.lit(0)),
        "_judged": F.when(F.col("_known"), F.col("_n")).otherwise(F.lit(0)),
    })


def rates():
    return [
        F.coalesce(F.sum("_judged"), F.lit(0)).cast("bigint").alias("positions"),
        F.coalesce(F.sum("_hit"), F.lit(0)).cast("bigint").alias("agreeing"),
        F.coalesce(F.sum(F.col("_n") - F.col("_judged")), F.lit(0)).cast("bigint").alias("uncovered"),
    ]


def agreement(steps, annotations, by=(), state="state", carry=()):
    """Judged, agreeing and uncovered positions and the rate, per ``by`` (step columns) or ``carry`` (label columns).

    Steps whose state has no label are counted as uncovered; their label columns are null.
    """
    judged = judged_counts(steps, annotations, list(by), state, list(carry))
    return judged.groupBy(*by, *carry).agg(*rates()).withColumn("rate", ratio("agreeing", "positions"))


def agreement_report(steps, annotations, dimensions=("chosen_by", "ply"), state="state"):
    """Overall and per-dimension agreement in one pass."""
    judged = judged_counts(steps, annotations, list(dimensions), state)
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = judged.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        *rates(), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions]
    )
    dimension, key = F.lit("overall"), F.lit("all")
    for d in dimensions:
        dimension = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(dimension)
        key = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(key)
    return grouped.select(
        dimension.alias("dimension"), key.alias("key"), "positions", "agreeing", "uncovered",
        ratio("agreeing", "positions").alias("rate"),
    )
