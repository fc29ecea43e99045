"""JSON Lines and Parquet edges, and the schema-version gate."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .schemas import SCHEMA_VERSION


def read_jsonl(spark, path, schema):
    """JSON Lines with a given schema; blank lines are skipped and a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed_lines(spark, path, schema):
    """The lines that do not parse, with their file: run it after a FAILFAST error."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    parsed = F.from_json("line", f"{schema}, _corrupt_record STRING", {"mode": "PERMISSIVE"})
    return lines.filter(F.trim("line") != "").withColumn("_p", parsed).filter(
        F.col("_p._corrupt_record").isNotNull()
    ).select("file", "line")


def write_jsonl(df, path, mode="errorifexists"):
    """Write JSON Lines and return the number of rows written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).json(path)
    return seen.get["rows"]


def write_table(df, path, mode="errorifexists", partition_by=()):
    """Write Parquet and return the number of rows written."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).partitionBy(*partition_by)
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic")  # overwriting replaces the written partitions only
    writer.parquet(path)
    return seen.get["rows"]


def read_document(spark, path, schema):
    """One pretty-printed JSON document as a one-row DataFrame."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_document(df, path, mode="errorifexists"):
    """Write a table of exactly one row as one pretty-printed JSON document, which :func:`read_document` reads back."""
    if len(df.limit(2).collect()) != 1:
        raise ValueError("a document is exactly one row")
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"pretty": "true"})
    df.select(text.alias("value")).coalesce(1).write.mode(mode).text(path)


def require_version(df, name, version=SCHEMA_VERSION):
    """Every record must carry the supported schema version."""
    found = df.filter(~F.col("schema_version").eqNullSafe(F.lit(version))).select("schema_version").limit(1).collect()
    if found:
        raise ValueError(f"{name}: schema_version {found[0][0]} is not the supported {version}")
    return df


def checked_version(df, version=SCHEMA_VERSION):
    """The same check inside the plan, as a filter that stays when the column is not read on: no job of its own."""
    found = F.coalesce(F.col("schema_version").cast("string"), F.lit("null"))
    wrong = F.raise_error(F.concat(F.lit("unsupported schema_version "), found)).cast("boolean")
    return df.filter(F.when(F.col("schema_version") == version, F.lit(True)).otherwise(wrong))
