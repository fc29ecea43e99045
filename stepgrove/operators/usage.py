"""How much mined lists use given versus invented features."""

from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .features import TIERS

#: References and definitions of one task.
TASK_ROWS = 1 << 17


def undefined(references, definitions):
    """Referenced features a candidate does not define; must be empty."""
    return references.join(definitions, ["candidate", "feature"], "left_anti")


def _by_tier(rows, keys):
    counts = [F.count_if(F.col("tier") == t).alias(t) for t in TIERS]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("referenced"), *counts)
    return out.withColumns({f"{t}_fraction": ratio(t, "referenced") for t in TIERS})


def candidate_usage(references, definitions):
    """Distinct referenced features per candidate, counted by tier; every tier is a column.

    Names compress so well that partitions sized by their bytes would hold millions of rows; these are sized by rows.
    """
    parts = -(-(references.count() + definitions.count()) // TASK_ROWS) or 1
    dealt = lambda df, *more: df.select("candidate", "feature", *more).repartition(parts, "candidate", "feature")
    tiers = dealt(definitions, "tier").distinct()
    return _by_tier(tiers.join(dealt(references).hint("merge"), ["candidate", "feature"], "left_semi"), ["candidate"])


def overall_usage(references, definitions):
    """Usage of the union of all references; the first candidate (by ``ord``) defining a name sets its tier."""
    refs = references.select("feature").distinct()
    tiers = definitions.groupBy("feature").agg(F.min_by("tier", "ord").alias("tier"))
    return _by_tier(refs.join(tiers, "feature"), [])


def columns_by_tier(columns):
    """Number of columns of each tier, all three tiers present."""
    return columns.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in TIERS])


def with_labels(concepts, labels):
    """Attach an optional human label by concept name."""
    return concepts.join(labels.select("name", "label"), "name", "left")
