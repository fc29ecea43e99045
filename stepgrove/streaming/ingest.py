"""Incremental ingestion of stored sequences, and agreement kept up to date, with Structured Streaming."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import ratio
from ..operators.agreement import agreement_report
from ..operators.corpus import expand_sequences
from ..session import drop_table
from ..sources.records import write_table
from ..sources.runs import read_or_none


def _tagged(df, number):
    return df.withColumn("batch", F.lit(number).cast("bigint"))


def _unseen(batch, number, ids_path, key="seq_id"):
    """Rows of a batch whose id no earlier batch stored, one per id: the least in column order."""
    once = batch.groupBy(key).agg(F.min(F.struct(*batch.columns)).alias("r")).select("r.*")
    shape = T.StructType([T.StructField(key, batch.schema[key].dataType), T.StructField("batch", T.LongType())])
    known = read_or_none(batch.sparkSession, ids_path, shape)
    if known is not None:
        once = once.join(known.filter(F.col("batch") != number).select(key), key, "left_anti")
    return once


def ingest_sequences(spark, source, schema, steps_path, checkpoint, keep=("outcome", "length")):
    """Stream JSON Lines sequences into a steps table, each sequence once.

    The schema is explicit. Steps and the ids stored so far are written per batch, a batch that runs again replaces
    what it wrote, and only the ids are read to find what is new. Of rows that repeat an id the least one, in column
    order, is kept. Returns the streaming writer; start it with the trigger of choice.
    """
    incoming = spark.readStream.schema(schema).option("mode", "FAILFAST").json(source)
    keys_path = f"{steps_path.rstrip('/')}_ids"

    def append(batch, number):
        once = _unseen(batch, number, keys_path)
        write_table(_tagged(expand_sequences(once, keep), number), steps_path, "overwrite", ["batch"])
        write_table(_tagged(once.select("seq_id"), number), keys_path, "overwrite", ["batch"])

    return incoming.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


COUNTS = ("positions", "agreeing", "uncovered")
TOTALS = "dimension string, key string, " + "".join(f"{c} bigint, " for c in COUNTS) + "batch bigint"


def follow_agreement(incoming, annotations, path, checkpoint, steps_of, dimensions=("chosen_by", "ply"), key="seq_id"):
    """Keep :func:`~stepgrove.operators.agreement.agreement_report` of a stream of sequences; returns the streaming writer.

    ``incoming`` is a stream of rows with a unique ``key``; ``steps_of`` turns such rows into steps (state, action and
    ``dimensions``); ``annotations`` is the static label table. Below ``path``, ``totals`` holds the counts after each batch and
    ``ids`` what each batch brought. A batch counts only the rows that no earlier one brought and adds them to the counts
    after the batch before, so its work is its own rows, the ids and one report, however many batches there were. A batch
    that runs again starts from the same counts and replaces what it wrote. Only the last two versions of the counts stay.

    However equal rows are split into batches, the counts are those of one batch. Of different rows with one id
    the first batch's least one in column order counts. Rows with a null id are one row.
    """
    ids_path, totals_path = f"{path}/ids", f"{path}/totals"

    def fold(batch, number):
        spark = batch.sparkSession
        ids = batch.withColumn("_id", F.coalesce(F.to_json(F.struct(key)), F.lit("")))
        fresh = _unseen(ids, number, ids_path, "_id").persist()
        try:
            found = agreement_report(steps_of(fresh.drop("_id")), annotations, dimensions).drop("rate")
            before = read_or_none(spark, totals_path, TOTALS)
            if before is not None:
                last = before.filter(F.col("batch") < number)
                last = last.join(last.agg(F.max("batch").alias("batch")), "batch", "left_semi")
                found = found.unionByName(last.select(*found.columns))
            summed = found.groupBy("dimension", "key").agg(*[F.sum(c).alias(c) for c in COUNTS])
            write_table(_tagged(summed, number), totals_path, "overwrite", ["batch"])
            write_table(_tagged(fresh.select("_id"), number), ids_path, "overwrite", ["batch"])
        finally:
            fresh.unpersist()
        drop_table(spark, f"{totals_path}/batch={number - 2}")

    return incoming.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def followed_agreement(spark, path):
    """The report that :func:`follow_agreement` keeps below ``path``, after its last batch; None before the first."""
    totals = read_or_none(spark, f"{path}/totals", TOTALS)
    if totals is None:
        return None
    last = totals.join(totals.agg(F.max("batch").alias("batch")), "batch", "left_semi")
    return last.select("dimension", "key", *COUNTS, ratio("agreeing", "positions").alias("rate"))


def actions_seen(steps):
    """Running totals per action over an appended steps stream or table."""
    return steps.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
