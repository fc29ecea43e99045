"""Exact deduplication with keyed streaming state.

Documents arrive as rows (digest, size, identifier, content locator). A streaming aggregation keeps one entry per
digest in a RocksDB state store, without watermark and so without expiry: the identifier and locator of the row that
stays and the number of rows seen. The state is read back as a table, and every hit is compared with the row that
stays byte by byte; texts that only share a digest are grouped anew by their bytes.

Everything is DataFrame and Structured Streaming; map-side aggregation meets a hot digest before the shuffle.
"""

import uuid

from pyspark.sql import functions as F

from stepgrove.session import checkpoint_folder, drop_table, materialize

from .catalog import BLANKS, located, query, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalized(text):
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text):
    return F.sha2(text.cast("binary"), 256)


def remember(spark, arrivals, state):
    """Stream the arrivals table through the keyed state below ``state``; return the state as a table.

    ``arrivals`` is the path of a table (digest, n_points, turned_id, place). Started again on the same state folder
    with more files, the stream only takes the new ones and the state goes on from where it was.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # one pass: a store is done when its task is
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = spark.read.parquet(arrivals).schema
    entries = (
        session.readStream.schema(schema)
        .parquet(arrivals)
        .groupBy("digest")
        .agg(F.max(F.struct("n_points", "turned_id", "place")).alias("best"), F.count(F.lit(1)).alias("seen"))
    )
    stream = (
        entries.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    kept = session.read.format("statestore").load(state).select("key.*", "value.*")
    best, seen = kept.columns[1:]
    path = f"{state}-entries-{uuid.uuid4().hex}"
    kept.select("digest", F.col(best).alias("best"), F.col(seen).alias("group_size")).write.parquet(path)
    return spark.read.parquet(path)


def exact_groups(docs, id="doc_id", text="text", digest=sha256, place=None):
    """One row per row of ``docs``: the id, place, digest, keep_id, group_size and kept.

    Texts are equal when identical without white space; null is empty, so empty and blank texts form one group. Of
    equal texts the one with the most code points stays, then the smallest id; a null id loses, and of rows that
    repeat both id and length exactly one stays. Other columns of ``docs`` play no part, whatever their names. An
    empty table gives an empty table. ``digest`` maps the normalised text to the state's key; its collisions cost
    time, never correctness. ``place`` names a column that tells the rows apart; by default it is the file and row number.
    """
    spark = docs.sparkSession
    plain = [F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")]
    rows = docs.select(*plain, F.col(place).alias("place")) if place else located(docs.select(*plain), "place")
    bare = normalized(F.col("text"))
    base = f"{checkpoint_folder(spark)}/dedup-{uuid.uuid4().hex}"
    rows.select(
        digest(bare).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).alias("n_points"),
        F.bitwise_not("id").alias("turned_id"),
        "place",
    ).write.parquet(f"{base}/arrivals")
    entries = remember(spark, f"{base}/arrivals", f"{base}/state")
    grouped = materialize(spark.read.parquet(f"{base}/arrivals").join(entries, "digest"))
    drop_table(spark, base)

    # Full bytes of every row whose digest was met before, beside those of the row that stays.
    shared = grouped.filter("group_size > 1").select("digest", "place", "best", "n_points", "turned_id")
    texts = materialize(rows.select("place", bare.alias("bare")).join(shared.hint("shuffle_hash"), "place"))
    staying = texts.filter("place = best.place").select("digest", F.col("bare").alias("staying"))
    hits = texts.filter("place <> best.place").join(staying, "digest")
    # Stored before they are made distinct: so the join may split a hot digest.
    apart = materialize(hits.filter(F.col("bare") != F.col("staying")).select("digest"))
    if not apart.isEmpty():
        apart = apart.distinct()
        mixed = texts.join(apart, "digest")
        by_bytes = mixed.groupBy("digest", "bare").agg(
            F.max(F.struct("n_points", "turned_id", "place")).alias("best"), F.count(F.lit(1)).alias("group_size")
        )
        again = mixed.drop("best").join(by_bytes, ["digest", "bare"]).select(grouped.columns)
        grouped = grouped.join(apart, "digest", "left_anti").unionByName(again)
    return grouped.select(
        F.bitwise_not("turned_id").alias(id),
        "place",
        "digest",
        F.bitwise_not("best.turned_id").alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("place") == F.col("best.place")).alias("kept"),
    )


def keep_first(docs, id="doc_id", text="text"):
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    name = f"place_{uuid.uuid4().hex}"
    rows = located(docs, name)
    kept = exact_groups(rows, id, text, place=name).filter("kept").select(F.col("place").alias(name))
    return rows.join(kept.hint("shuffle_hash"), name, "left_semi").drop(name)


SQL = r"""
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(bare) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS whole, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
      FROM documents)
WINDOW w AS (PARTITION BY bare ORDER BY length(whole) DESC, doc_id ASC NULLS LAST)
"""


@query("op1_exact_dedup", SQL)
def op1_exact_dedup(spark, folder):
    groups = exact_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
