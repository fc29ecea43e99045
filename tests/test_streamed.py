"""Agreement that follows a stream is the agreement of all rows at once, however they arrive."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from stepgrove.operators.agreement import agreement_report
from stepgrove.streaming.ingest import follow_agreement, followed_agreement

SHAPE = "seq_id bigint, actor string, actions array<int>"


def steps_of(rows):
    return rows.select("seq_id", F.col("actor").alias("chosen_by"), F.posexplode("actions").alias("ply", "action")).withColumn(
        "state", F.concat_ws(":", F.col("seq_id") % 5, "ply")
    )


def some_rows(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", None]), [rng.randrange(3) for _ in range(rng.randrange(5))]) for i in range(n)] + [(n, "a", None)]


def labels(spark):
    rows = [(f"{i}:{p}", [(i + p) % 3]) for i in range(5) for p in range(3)]
    return spark.createDataFrame(rows, "state string, optimal array<int>")


def as_set(df):
    return {tuple(r) for r in df.select("dimension", "key", "positions", "agreeing", "uncovered", "rate").collect()}


def deliver(spark, place, batches):
    """Every batch is a file of its own and its own trigger."""
    for rows in batches:
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{place}/in")
        incoming = spark.readStream.schema(SHAPE).parquet(f"{place}/in")
        stream = follow_agreement(incoming, labels(spark), f"{place}/out", f"{place}/marks", steps_of)
        assert stream.trigger(availableNow=True).start().awaitTermination(120) is not False
    return followed_agreement(spark, f"{place}/out")


@pytest.mark.parametrize("cuts", [[], [7], [3, 3, 20], [1, 2, 4, 30]])
def test_any_split_gives_the_report_of_one_batch(spark, tmp_path, cuts):
    rows = some_rows(40, len(cuts))
    edges = [0, *cuts, len(rows)]
    got = deliver(spark, str(tmp_path), [rows[a:b] for a, b in zip(edges, edges[1:])])
    assert as_set(got) == as_set(agreement_report(steps_of(spark.createDataFrame(rows, SHAPE)), labels(spark)))


def test_rows_that_come_again_change_nothing(spark, tmp_path):
    rows = some_rows(30, 9)
    once = as_set(agreement_report(steps_of(spark.createDataFrame(rows, SHAPE)), labels(spark)))
    assert as_set(deliver(spark, str(tmp_path), [rows[:20] + rows[:20], rows[10:], rows, []])) == once


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    rows = some_rows(30, 4)
    deliver(spark, str(tmp_path), [rows[:8], rows[8:20], rows[20:]])
    once = as_set(followed_agreement(spark, f"{tmp_path}/out"))
    # The engine forgets that the last batch was done, as after a failure between its writes and its commit.
    for name in ("2", ".2.crc"):
        shutil.move(tmp_path / "marks" / "commits" / name, tmp_path / f"gone{name}")
    assert as_set(deliver(spark, str(tmp_path), [[]])) == once
    assert once == as_set(agreement_report(steps_of(spark.createDataFrame(rows, SHAPE)), labels(spark)))


def test_nothing_has_come_yet(spark, tmp_path):
    assert followed_agreement(spark, str(tmp_path / "out")) is None
    empty = deliver(spark, str(tmp_path), [[], []])
    assert empty is None or empty.count() == 0


def test_repeated_null_ids_are_one_row(spark, tmp_path):
    got = as_set(deliver(spark, str(tmp_path), [[(None, "a", [0]), (None, "b", [1])], [(None, "a", [0])]]))
    assert {r[:2] + r[4:5] for r in got} == {("overall", "all", 1), ("chosen_by", "a", 1), ("ply", "0", 1)}
