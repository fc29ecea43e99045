"""Set columns: arrays kept sorted and distinct, so equality is array equality."""

from pyspark.sql import functions as F


def as_set(array):
    return F.array_sort(F.array_distinct(array))


def union(a, b):
    return F.array_sort(F.array_union(a, b))


def intersection(a, b):
    return F.array_sort(F.array_intersect(a, b))


def difference(a, b):
    return F.array_sort(F.array_except(a, b))


def is_subset(a, b):
    return F.size(F.array_except(a, b)) == 0


def jaccard_distance(a, b):
    """1 - |a and b| / |a or b|; two empty sets are at distance 0."""
    either = F.size(F.array_union(a, b))
    both = F.size(F.array_intersect(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(1.0 - both / F.when(either != 0, either))


def mismatch_share(sample_a, a, sample_b, b):
    """Share of positions where two signatures differ; null unless sample and length agree."""
    differing = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    share = F.when(F.size(a) == 0, F.lit(0.0)).otherwise(differing / F.when(F.size(a) != 0, F.size(a)))
    return F.when((sample_a == sample_b) & (F.size(a) == F.size(b)), share)


def depth_term(a, b):
    """Relative difference of two depths; both 0 is 0."""
    top = F.greatest(a, b)
    return F.when(top == 0, F.lit(0.0)).otherwise(F.abs(a - b) / F.when(top != 0, top))


def spec_distance(a, b):
    """Distance of two spec structs (kind, depth, epsilon, tie_break, rules) in [0, 1]."""
    search = F.greatest(
        depth_term(a["depth"], b["depth"]),
        F.abs(a["epsilon"] - b["epsilon"]),
        F.when(a["tie_break"] != b["tie_break"], F.lit(0.1)).otherwise(F.lit(0.0)),
    )
    return (
        F.when(a["kind"] != b["kind"], F.lit(1.0))
        .when(a["kind"] == "minimax", search)
        .when(a["kind"] == "heuristic-rules", jaccard_distance(a["rules"], b["rules"]))
        .otherwise(F.lit(0.0))
    )
