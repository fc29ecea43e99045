"""Running sums and ordinals per group that stay parallel when one group is huge.

A plain window puts a whole group in one task. Here every group is cut at sampled rows of its own order: a row is drawn
when a hash of its order columns says so, about one in ``sample``. Groups with drawn rows are cut there into ranges, the
window runs per (group, range), and the totals of the earlier ranges are added. The cuts follow the order itself, so
nulls, text, several columns and uneven clocks need no special care, and drawing by hash finds the same cuts whenever a
task runs again. It is one lazy plan for every size: nothing is counted or collected while it is built.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

#: Rows per drawn row. A group of n rows draws about n / SAMPLE of them; at most MAX_CUTS, evenly spread, become cuts.
SAMPLE = 65_536
MAX_CUTS = 1_024

RANGE = "_range"
_FAN = 32


def null_safe_join(rows, groups, keys, how="left"):
    """Join on ``keys``, null equal to null, keeping the keys of ``rows``."""
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    right = groups.withColumnsRenamed(named)
    equal = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in named.items()]
    return rows.join(right, reduce(lambda a, b: a & b, equal), how).drop(*named.values())


def _cuts(df, keys, order, sample):
    """Per group with drawn rows: the sorted cuts, and every 32nd of them to search in two steps."""
    drawn = F.pmod(F.xxhash64(*order), F.lit(sample)) == 0
    found = F.sort_array(F.collect_set(F.when(drawn, F.struct(*order))))
    some = df.groupBy(*keys).agg(found.alias("_found")).filter(F.size("_found") > 0)
    step = F.ceil(F.size("_found") / MAX_CUTS)
    thinned = some.withColumn("_cuts", F.filter("_found", lambda x, i: i % step == 0)).drop("_found")
    return thinned.withColumn("_coarse", F.filter("_cuts", lambda x, i: i % _FAN == 0))


def _ranged(df, keys, order, sample):
    """``df`` with RANGE, the number of cuts of the group up to the row, and ``_cuts``, null where there are none."""
    hot = _cuts(df, keys, order, sample)
    if keys:
        placed = null_safe_join(df, hot, keys)
    else:
        only = hot.select(F.struct("_cuts", "_coarse")).scalar()
        placed = df.withColumn("_only", only).select("*", "_only.*").drop("_only")
    at = F.struct(*order)
    upto = lambda cuts: F.size(F.filter(cuts, lambda x: x <= at))
    placed = placed.withColumn("_block", F.when(F.col("_cuts").isNull(), 0).otherwise(upto("_coarse")))
    first = (F.greatest(F.col("_block"), F.lit(1)) - 1) * _FAN
    inside = first + upto(F.slice("_cuts", first + 1, F.lit(_FAN)))
    return placed.withColumn(RANGE, F.when(F.col("_block") == 0, 0).otherwise(inside)).drop("_block", "_coarse")


def running(df, keys, order, measures, *, exclusive=False, total=None, keep_range=False, sample=SAMPLE, max_group=None):
    """Add one running sum per entry of ``measures`` (name -> Column), rows taken in ``order``.

    ``order`` names ascending columns, nulls first, that together give a total order inside a group; null keys are a
    group. ``exclusive`` leaves the row itself out. ``total`` names a column for the number of rows of the group.
    ``keep_range`` leaves the range of each row in the column RANGE. ``sample`` changes the plan's tasks, never its
    result. ``max_group`` is a bound on the rows of a group that the caller knows; up to ``sample`` rows need no cuts.
    """
    keys, order, names = list(keys), list(order), list(measures)
    staged = df.select("*", *[measures[m].alias(f"_m_{m}") for m in names])
    whole = max_group is not None and max_group <= sample
    placed = staged.withColumn(RANGE, F.lit(0)) if whole else _ranged(staged, keys, order, sample)

    by = [*keys, RANGE]
    last = -1 if exclusive else 0
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    out = placed.drop("_cuts").withColumns({m: F.coalesce(F.sum(f"_m_{m}").over(frame), F.lit(0)) for m in names})
    if total:
        out = out.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*by)))

    extra = ([total] if total else []) + ([RANGE] if keep_range else [])
    shown = [*[f"`{c}`" for c in df.columns if c not in names], *names, *extra]
    if whole:
        return out.select(*shown)
    group = Window.partitionBy(*keys)
    before = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.filter(F.col("_cuts").isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_m_{m}").alias(f"_t_{m}") for m in names])
        .select(*by, F.sum("_n").over(group).alias("_o_n"), *[F.sum(f"_t_{m}").over(before).alias(f"_o_{m}") for m in names])
    )
    out = null_safe_join(out, offsets, by)
    out = out.withColumns({m: F.col(m) + F.coalesce(F.col(f"_o_{m}"), F.lit(0)) for m in names})
    if total:
        out = out.withColumn(total, F.coalesce(F.col("_o_n"), F.col(total)))
    return out.select(*shown)


def ordinal(df, keys, order, name="ply", **options):
    """Zero-based position of every row inside its group."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, exclusive=True, **options)


SAMPLE_SIZE = 256


def stride_sample(df, keys, order, size=SAMPLE_SIZE, **options):
    """Rows at ordinals 0, s, 2s, ... with s = max(1, n div size), at most ``size`` per group."""
    numbered = ordinal(df, keys, order, "ordinal", total="group_rows", **options)
    stride = F.greatest(F.lit(1), F.floor(F.col("group_rows") / size)).cast("bigint")
    return (
        numbered.withColumn("stride", stride)
        .filter((F.col("ordinal") % F.col("stride") == 0) & (F.col("ordinal") < F.col("stride") * size))
    )
