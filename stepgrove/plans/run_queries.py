"""A stored analysis of the event corpus."""

import uuid

from pyspark.sql import functions as F

from ..operators import dataset as D
from ..session import checkpoint_folder
from ..sources.runs import read_manifest
from ..streaming.ingest import follow_agreement, followed_agreement
from . import boards as B
from .analyzers import Inputs, Options, analyze_run
from .catalog import joined, query, r9, table
from .corpora import STEPS_SQL, event_sequences
from .label_queries import DOC_STEPS_SQL, LABEL_SQL, RATE_SQL, label_annotations
from .sequence_queries import states_of


def corpus_inputs(spark, folder):
    """Steps and sequences with their states as text, and the collapsed boards."""
    steps, final = states_of(spark, folder)
    text = {"state": joined("state"), "canonical_state": joined("canonical_state")}
    sequences = event_sequences(steps).join(final.withColumns(text), "seq_id")
    once = D.collapse(
        B.canonical_states(B.event_boards(spark, folder)), "canonical_state", ("seq_id", "run"), ("cells", "mover", "value", "legal", "optimal")
    )
    labels = once.select("canonical_state", "optimal")
    return Inputs(steps.withColumns(text), sequences, labels, once)


@query("analysis_manifest", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {B.CANONICAL_SQL}, {LABEL_SQL},
pairs AS (SELECT *, concat_ws(' vs ', first_action, second_action) AS pairing FROM seqs)
SELECT 'events' AS run_id, 'summary' AS output, 3::BIGINT AS rows
UNION ALL SELECT 'events', 'outcomes', 1 + count(DISTINCT pairing) + count(DISTINCT length) FROM pairs
UNION ALL SELECT 'events', 'dataset', count(*) FROM labelled""")
def analysis_manifest(spark, folder):
    """Analyse the event corpus, store the outputs as a run, and read the manifest back."""
    path = f"{checkpoint_folder(spark)}/run-{uuid.uuid4().hex}"
    analyze_run(path, "events", corpus_inputs(spark, folder), ["summary", "dataset"], Options(vocabulary=B.board_vocabulary()))
    return read_manifest(spark, path, "events").select(F.col("run_id").cast("string").alias("run_id"), "output", "rows")


def document_calls(docs):
    """Documents as sequences of one step: long ones are called good."""
    called = F.when(F.col("n_chars") >= 1000, 1).otherwise(0)
    return docs.select(F.col("doc_id").alias("state"), called.alias("action"), "source", "lang")


@query("streamed_agreement", f"""WITH {DOC_STEPS_SQL}
SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'overall' END AS dimension,
  CASE WHEN grouping(source) = 0 THEN source WHEN grouping(lang) = 0 THEN lang ELSE 'all' END AS key,
  {RATE_SQL} FROM j GROUP BY GROUPING SETS ((source), (lang), ())""")
def streamed_agreement(spark, folder):
    """Agreement of a stream of documents after two deliveries: about half of them, then all; each counts once."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "source", "lang")
    place = f"{checkpoint_folder(spark)}/followed-{uuid.uuid4().hex}"
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    for delivery in (docs.filter(half), docs):
        delivery.write.mode("append").parquet(f"{place}/in")
        incoming = spark.readStream.schema(docs.schema).parquet(f"{place}/in")
        stream = follow_agreement(incoming, label_annotations(spark, folder), f"{place}/out", f"{place}/marks", document_calls, ("source", "lang"), "doc_id")
        stream.trigger(availableNow=True).start().awaitTermination()
    return followed_agreement(spark, f"{place}/out").withColumn("rate", r9("rate"))
