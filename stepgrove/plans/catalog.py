"""Registered queries with the SQL they are checked against."""

from pyspark.sql import functions as F

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def joined(array):
    """An array as comma-joined text."""
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


def r9(column):
    return F.round(F.col(column) if isinstance(column, str) else column, 9)
