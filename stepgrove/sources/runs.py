"""A run directory: one sub-path per table, the manifest written last."""

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_table
from . import schemas
from .records import checked_version, require_version, write_table


@dataclass
class Run:
    """Tables of a stored run; ``annotations`` is None until it has been written."""

    run_id: str
    game: str
    sequences: DataFrame
    steps: DataFrame
    annotations: DataFrame | None = None


def write_run(path, run_id, game, sequences, steps):
    """Write sequences and steps partitioned by run, then the manifest row with their totals.

    Only the partitions of this run are replaced, so writing a run again leaves one copy of it.
    """
    spark = sequences.sparkSession
    tag = F.lit(run_id).alias("run_id")
    totals = {}
    for name, df in (("sequences", sequences), ("steps", steps)):
        columns = [c for c in df.columns if c != "run_id"]
        totals[name] = write_table(df.select(*columns, tag), f"{path}/{name}", "overwrite", ["run_id"])
    row = (schemas.SCHEMA_VERSION, run_id, game, totals["sequences"], totals["steps"])
    write_table(spark.createDataFrame([row], schemas.RUN), f"{path}/run", "overwrite", ["run_id"])
    return totals


def read_or_none(spark, path, schema=None):
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        df = reader.parquet(path)
        df.schema
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load_run(spark, path, run_id, game):
    """A stored run; a missing manifest, another game or another schema version is an error."""
    manifest = read_or_none(spark, f"{path}/run", schemas.RUN)
    rows = manifest.filter(F.col("run_id") == run_id).collect() if manifest is not None else []
    if not rows:
        raise FileNotFoundError(f"{path} has no finished run {run_id}")
    if rows[0]["game"] != game:
        raise ValueError(f"corpus at {path} belongs to `{rows[0]['game']}`, not `{game}`")
    require_version(manifest.filter(F.col("run_id") == run_id), f"{path}/run")
    part = lambda name: spark.read.parquet(f"{path}/{name}").filter(F.col("run_id") == run_id)
    run = Run(run_id, game, part("sequences"), part("steps"))
    checked = lambda df: checked_version(df) if "schema_version" in df.columns else df
    run.sequences, run.steps = checked(run.sequences), checked(run.steps)
    run.annotations = read_annotations(spark, path, run_id, game)
    return run


def write_annotations(path, run_id, game, mode, annotations):
    """Write the annotation set of a run, with a manifest row naming the game and the mode it was made for."""
    columns = [c for c in annotations.columns if c != "run_id"]
    n = write_table(annotations.select(*columns, F.lit(run_id).alias("run_id")), f"{path}/annotations", "overwrite", ["run_id"])
    row = (schemas.SCHEMA_VERSION, run_id, game, mode, n)
    write_table(annotations.sparkSession.createDataFrame([row], schemas.ANNOTATION_SET), f"{path}/annotation_set", "overwrite", ["run_id"])
    return n


def read_annotations(spark, path, run_id, game, mode=None):
    """The annotation set of a run, None if there is none; another game, mode or schema version is an error."""
    manifest = read_or_none(spark, f"{path}/annotation_set", schemas.ANNOTATION_SET)
    rows = manifest.filter(F.col("run_id") == run_id).collect() if manifest is not None else []
    if not rows:
        return None
    found = rows[0]
    if found["schema_version"] != schemas.SCHEMA_VERSION:
        raise ValueError(f"{path}/annotation_set: schema_version {found['schema_version']} is not supported")
    if found["game"] != game:
        raise ValueError(f"annotations at {path} belong to `{found['game']}`, not `{game}`")
    if mode is not None and found["mode"] != mode:
        raise ValueError(f"annotations at {path} are `{found['mode']}`, not `{mode}`")
    return spark.read.parquet(f"{path}/annotations").filter(F.col("run_id") == run_id)


def write_results(path, run_id, tables):
    """Write the outputs of an analysis below the run, one table each, and a manifest row per output with its rows.

    Writing the same run again replaces its outputs.
    """
    totals = {}
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "run_id"]
        totals[name] = write_table(df.select(*columns, F.lit(run_id).alias("run_id")), f"{path}/{name}", "overwrite", ["run_id"])
    rows = [(schemas.SCHEMA_VERSION, run_id, name, n) for name, n in totals.items()]
    if rows:
        spark = next(iter(tables.values())).sparkSession
        write_table(spark.createDataFrame(rows, schemas.OUTPUT), f"{path}/analyze", "overwrite", ["run_id"])
    return totals


def read_manifest(spark, path, run_id):
    """The outputs of an analysis and their rows, as the manifest has them."""
    return spark.read.schema(schemas.OUTPUT).parquet(f"{path}/analyze").filter(F.col("run_id") == run_id)


def _digest(df):
    """A sum over the rows' hashes: whatever their order, and repeated rows count."""
    return F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("digest")


def commit_run(path, run_id, game, tables):
    """Write all tables of a run, then one manifest that names them with their rows and digests.

    The run's earlier manifest is withdrawn first and the new one is written last, in one file: a run that stops
    half way has no manifest and can't be loaded. Tables are partitioned by run, so other runs are left alone, and
    writing a run again replaces it. Returns the rows per table.
    """
    spark = next(iter(tables.values())).sparkSession
    drop_table(spark, f"{path}/commit/run_id={run_id}")
    rows = []
    for name, df in tables.items():
        if name == "commit":
            raise ValueError("`commit` is the manifest's name")
        plain, seen = df.select(*[c for c in df.columns if c != "run_id"]), Observation()
        counted = plain.observe(seen, F.count(F.lit(1)).alias("rows"), _digest(plain))
        write_table(counted.withColumn("run_id", F.lit(run_id)), f"{path}/{name}", "overwrite", ["run_id"])
        rows.append((schemas.SCHEMA_VERSION, run_id, game, name, plain.schema.json(), seen.get["rows"], seen.get["digest"]))
    write_table(spark.createDataFrame(rows, schemas.COMMIT).coalesce(1), f"{path}/commit", "overwrite", ["run_id"])
    return {r[3]: r[5] for r in rows}


def read_commit(spark, path, run_id):
    """The manifest of a committed run; a run without one is an error."""
    manifest = read_or_none(spark, f"{path}/commit", schemas.COMMIT)
    found = manifest.filter(F.col("run_id") == run_id) if manifest is not None else None
    if found is None or found.isEmpty():
        raise FileNotFoundError(f"{path} has no finished run {run_id}")
    return found


def load_tables(spark, path, run_id, game, verify=False):
    """The tables of a committed run by name; another game or schema version is an error.

    ``verify`` reads every table and compares its rows and digest with the manifest: a missing, shortened or altered
    table is an error.
    """
    out = {}
    for r in read_commit(spark, path, run_id).collect():
        if r["schema_version"] != schemas.SCHEMA_VERSION:
            raise ValueError(f"{path}/commit: schema_version {r['schema_version']} is not supported")
        if r["game"] != game:
            raise ValueError(f"run at {path} belongs to `{r['game']}`, not `{game}`")
        fields = T.StructType.fromJson(json.loads(r["fields"]))
        stored = read_or_none(spark, f"{path}/{r['output']}", T.StructType([*fields.fields, T.StructField("run_id", T.StringType())]))
        if stored is None:
            raise ValueError(f"{path}: table {r['output']} of run {run_id} is missing")
        part = stored.filter(F.col("run_id") == run_id).drop("run_id")
        if verify and tuple(part.agg(F.count(F.lit(1)), _digest(part)).first()) != (r["rows"], r["digest"]):
            raise ValueError(f"{path}: table {r['output']} of run {run_id} is not what was committed")
        out[r["output"]] = part
    return out
