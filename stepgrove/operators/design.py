"""Experiment designs: cells from factors, pairings, and reference checks."""

from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import ordinal


def design_cells(spark, factors):
    """Every combination of the factor levels with a dense ``index``; the last factor varies fastest.

    ``factors`` maps a name to its list of levels, or to a table of :func:`levels_of`. The cells are the numbers of a
    range, dealt over the tasks; the digits of a number, with the numbers of levels as bases, are the positions of its levels.
    Listed levels are part of the plan; those of a table are joined by their number, however many there are.
    """
    sizes = {}
    for name, levels in factors.items():
        table = isinstance(levels, DataFrame)
        sizes[name] = levels.count() if table else len(levels)
        if not sizes[name]:
            raise ValueError(f"factor `{name}` has no levels")
        if not table and len(set(map(str, levels))) != len(levels):
            raise ValueError(f"factor `{name}` lists a level more than once")
    cells = spark.range(prod(sizes.values())).withColumnRenamed("id", "index")
    width, digits = 1, {}
    for name in reversed(factors):
        digits[name] = F.floor(F.col("index") / width) % sizes[name]
        width *= sizes[name]
    for k, (name, levels) in enumerate(factors.items()):
        if isinstance(levels, DataFrame):
            numbered = levels.select(F.col("number").alias(f"_n{k}"), F.col("level").alias(f"_f{k}"))
            cells = cells.withColumn("_at", digits[name]).join(numbered, F.col("_at") == F.col(f"_n{k}")).drop("_at", f"_n{k}")
        else:
            array = F.array(*[F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v) for v in levels])
            cells = cells.withColumn(f"_f{k}", F.element_at(array, (digits[name] + 1).cast("int")))
    return cells.select("index", *[F.col(f"_f{k}").alias(name) for k, name in enumerate(factors)])


def all_pairings(names, slots):
    """Ordered tuples of names, earliest slot slowest: a list for a list, a numbered table for one of :func:`levels_of`."""
    if isinstance(names, DataFrame):
        places = [f"slot{k}" for k in range(slots)]
        cells = design_cells(names.sparkSession, dict.fromkeys(places, names))
        return cells.select(F.col("index").alias("number"), F.array(*places).alias("level"))
    out = [()]
    for _ in range(slots):
        out = [(*t, name) for t in out for name in names]
    return [list(t) for t in out]


def levels_of(df, column):
    """The distinct values of a column as factor levels: a stored table (number, level), numbered in ascending order, null first."""
    found = materialize(df.select(F.col(column).alias("level")).distinct())
    return materialize(ordinal(found, [], ["level"], "number").select("number", "level"))


def missing_references(rows, dimension, key, dimension_key=None):
    """Keys used in ``rows`` that the dimension lacks, with their number of rows."""
    used = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    known = dimension.select(F.col(dimension_key or key).alias(key))
    return used.join(known, key, "left_anti")


def duplicates(rows, key):
    """Keys that occur more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
