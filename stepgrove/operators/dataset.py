"""Labelled feature dataset: one row per canonical, non-terminal state."""

from pyspark.sql import functions as F

from ..functions import sets
from .features import TIERS, check_kinds

NO_LABEL = "none"


def collapse(annotations, key="canonical_state", order=("seq_id", "ply"), keep=()):
    """Non-terminal annotations, one row per ``key``: the first by ``order`` plus the occurrence count."""
    first = F.struct(*[F.col(c) for c in (*order, *keep)])
    return (
        annotations.filter(~F.col("terminal"))
        .groupBy(key)
        .agg(F.min_by(first, F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("occurrences"))
        .select(key, "_first.*", "occurrences")
    )


def canonical_mismatches(annotations, recomputed, stored="canonical_state"):
    """Rows whose stored canonical form is not the recomputed one; must be empty."""
    return annotations.filter(~F.col(stored).eqNullSafe(recomputed))


def require_canonical(annotations, recomputed, stored="canonical_state"):
    if not canonical_mismatches(annotations, recomputed, stored).isEmpty():
        raise ValueError("a stored canonical form differs from the one that is computed")


def qualify(classes, tiers, legal=None, optimal=None):
    """(qualifying, label) columns.

    ``classes`` are set-valued columns in vocabulary order and ``tiers`` their tiers. A class qualifies
    when its legal part is non-empty and all optimal; the label is the qualifying class of the highest
    tier, then the smallest legal part, then the lowest index.
    """
    legal = F.col("legal") if legal is None else legal
    optimal = F.col("optimal") if optimal is None else optimal
    entries = []
    for i, name in enumerate(classes):
        inside = F.array_intersect(legal, F.col(f"`{name}`"))
        entry = F.struct(
            F.lit(-TIERS.index(tiers[i])).alias("rank"),
            F.size(inside).alias("size"),
            F.lit(i).alias("index"),
            F.lit(name).alias("name"),
        )
        entries.append(F.when((F.size(inside) > 0) & sets.is_subset(inside, optimal), entry))
    found = F.array_compact(F.array(*entries))
    qualifying = F.transform(found, lambda e: e["name"])
    label = F.coalesce(F.array_min(found)["name"], F.lit(NO_LABEL))
    return qualifying, label


def build_dataset(states, vocabulary, extra=()):
    """Featurise and label collapsed states that carry ``legal`` and ``optimal`` position sets.

    A feature whose column has another Spark type than its kind allows is an error before any job.
    """
    tiers = {f.name: f.tier for f in vocabulary.features}
    classes = vocabulary.set_features()
    featured = check_kinds(vocabulary.evaluate(states), vocabulary.kinds())
    qualifying, label = qualify(classes, [tiers[c] for c in classes])
    keep = [c for c in states.columns if c not in vocabulary.kinds()]
    return featured.select(
        *keep, *extra, vocabulary.values().alias("values"), qualifying.alias("qualifying"), label.alias("label")
    )


def histogram(rows, column, keys=None, name="key"):
    """Rows per value of ``column``; listed ``keys`` are present even with 0 rows."""
    counted = rows.groupBy(F.col(column).cast("string").alias(name)).agg(F.count(F.lit(1)).alias("n"))
    if keys is None:
        return counted
    zero = rows.sparkSession.createDataFrame([(str(k), 0) for k in keys], f"{name} string, n bigint")
    return counted.unionByName(zero).groupBy(name).agg(F.sum("n").alias("n"))


def manifest(annotations, dataset):
    """Counters of a dataset build: annotated, nonterminal, rows, collapsed, unlabeled."""
    built = dataset.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("nonterminal"),
        F.count_if(F.col("label") == NO_LABEL).alias("unlabeled"),
    )
    total = annotations.agg(F.count(F.lit(1)).alias("n")).scalar()
    return built.select(
        total.alias("annotated"), "nonterminal", "rows",
        (F.col("nonterminal") - F.col("rows")).alias("collapsed"), "unlabeled",
    )


def require_rows(dataset):
    if dataset.isEmpty():
        raise ValueError("there is no open state to build a dataset from")
