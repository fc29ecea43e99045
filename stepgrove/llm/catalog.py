"""Registered queries of this subpackage, and helpers that several operators share."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stepgrove.session import materialize

QUERIES, ORACLES = {}, {}

#: White space of the contracts: space and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def query(name, sql=None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text):
    """The words of a text column as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def word_count(text):
    """The number of words without keeping them."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANK_RUN)
    blank = lambda i: F.when(F.element_at(parts, i) == "", 1).otherwise(0)
    return F.when(F.size(parts) == 1, 1 - blank(1)).otherwise(F.size(parts) - blank(1) - blank(-1)).cast("bigint")


def freeing(run):
    """A function for ``mapInArrow`` that gives its memory back to the system at its end: workers outlive their tasks."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def fraction_of_crc(column, modulus):
    """crc32 of the column as text, modulo ``modulus``; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def located(df, column):
    """``df`` with a column naming each row's place (file and row), and the stored form it belongs to.

    The place tells rows apart that agree in every column, and stays the same when a task runs again. A frame
    that isn't read from files is written to the shared folder first.
    """
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(column)
    try:
        return df.select("*", place)
    except AnalysisException:
        return materialize(df).select("*", place)
