import json

import pytest
from pyspark.sql import functions as F

from stepgrove.functions.scalars import outcome_class, parse_outcome
from stepgrove.operators.corpus import expand_sequences
from stepgrove.sources import archives, records, runs, schemas
from stepgrove.streaming.ingest import actions_seen, ingest_sequences


def write_lines(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_jsonl_skips_blank_lines_and_keeps_wide_numbers(spark, tmp_path):
    board = {"cells": ["X", None] + [None] * 7, "to_move": "O"}
    record = {
        "schema_version": 1, "run_id": "r", "game_id": "0:0", "game_index": 0, "seed": 2**64 - 1, "players": ["X", "O"],
        "cell": {"index": 0, "strategies": ["a", "b"], "evaluator": "e", "opening": "none", "random_opening_plies": 0},
        "opening_plies": 0, "actions": [0], "outcome": {"Win": "X"}, "length": 1, "final_state": board, "final_canonical_state": board,
    }
    path = write_lines(tmp_path / "games.jsonl", [json.dumps(record), "", json.dumps({**record, "outcome": "Draw"}), json.dumps({**record, "outcome": None})])
    df = records.read_jsonl(spark, path, schemas.sequences())
    assert df.count() == 3 and int(df.first()["seed"]) == 2**64 - 1
    got = [tuple(r["o"]) for r in df.select(parse_outcome(F.col("outcome")).alias("o")).collect()]
    assert got == [("win", "X"), ("draw", None), ("unfinished", None)]


def test_malformed_lines_are_named(spark, tmp_path):
    path = write_lines(tmp_path / "bad.jsonl", ['{"schema_version": 1}', "{broken"])
    with pytest.raises(Exception):
        records.read_jsonl(spark, path, "schema_version INT").collect()
    bad = records.malformed_lines(spark, path, "schema_version INT").collect()
    assert [r["line"] for r in bad] == ["{broken"] and bad[0]["file"].endswith("bad.jsonl")


def test_round_trip_counts_rows(spark, tmp_path):
    df = spark.range(7)
    assert records.write_jsonl(df, str(tmp_path / "j")) == 7
    assert records.write_table(df, str(tmp_path / "p")) == 7
    assert records.read_jsonl(spark, str(tmp_path / "j"), "id BIGINT").count() == 7


def test_document(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"schema_version": 1, "run_id": "x"}, indent=2))
    assert records.read_document(spark, str(tmp_path / "run.json"), schemas.RUN).first()["run_id"] == "x"


def test_version_gate(spark):
    good = spark.createDataFrame([(1,)], "schema_version int")
    assert records.require_version(good, "t").count() == 1 and records.checked_version(good).count() == 1
    bad = spark.createDataFrame([(1,), (2,)], "schema_version int")
    with pytest.raises(ValueError, match="schema_version 2"):
        records.require_version(bad, "t")
    with pytest.raises(Exception, match="unsupported schema_version"):
        records.checked_version(bad).collect()


@pytest.fixture
def games(spark):
    rows = [(1, "a", [4, 0], "win", 2), (1, "b", [1], "draw", 1)]
    return spark.createDataFrame(rows, "schema_version int, seq_id string, actions array<int>, outcome string, length bigint")


def test_run_directory(spark, tmp_path, games):
    path = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        runs.load_run(spark, path, "r1", "board")
    assert runs.write_run(path, "r1", "board", games, expand_sequences(games)) == {"sequences": 2, "steps": 3}
    runs.write_run(path, "r2", "board", games.limit(1), expand_sequences(games.limit(1)))
    assert runs.write_run(path, "r1", "board", games, expand_sequences(games)) == {"sequences": 2, "steps": 3}
    assert runs.load_run(spark, path, "r2", "board").sequences.count() == 1
    run = runs.load_run(spark, path, "r1", "board")
    assert (run.sequences.count(), run.steps.count(), run.annotations) == (2, 3, None)
    with pytest.raises(ValueError, match="belongs to"):
        runs.load_run(spark, path, "r1", "other")


def test_annotation_sets_are_checked(spark, tmp_path):
    path, rows = str(tmp_path / "run"), spark.createDataFrame([("s", 1)], "state string, value int")
    assert runs.read_annotations(spark, path, "r1", "board") is None
    runs.write_annotations(path, "r1", "board", "full", rows)
    assert runs.write_annotations(path, "r1", "board", "full", rows) == 1
    assert runs.read_annotations(spark, path, "r1", "board", "full").count() == 1
    for game, mode in (("other", None), ("board", "sampled")):
        with pytest.raises(ValueError, match="annotations at"):
            runs.read_annotations(spark, path, "r1", game, mode)


ENTRY = ("ord bigint, entry_id string, name string, kind string, depth int, epsilon double, tie_break string, rules array<string>, "
         f"provenance {schemas.PROVENANCE}, sample_id string, signature array<string>")


def entry(i, signature):
    return (i, f"id{i}", f"n{i}", "heuristic-rules", None, None, None, [f"r{i}"], None, "s", list(signature))


def test_archive_appends_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert archives.open_archive(spark, path, "board").count() == 0
    batch = spark.createDataFrame([entry(0, "ab"), entry(1, "ac")], ENTRY)
    assert archives.append_entries(spark, path, "board", batch) == 2
    assert archives.append_entries(spark, path, "board", batch) == 0
    more = spark.createDataFrame([entry(1, "ac"), entry(2, "ac")], ENTRY)
    assert archives.append_entries(spark, path, "board", more) == 1
    rows = {r["sequence"]: r for r in archives.open_archive(spark, path, "board").collect()}
    assert [rows[i]["entry_id"] for i in range(3)] == ["id0", "id1", "id2"]
    assert [(rows[i]["distance"], rows[i]["is_novel"], rows[i]["nearest_sequence"]) for i in range(3)] == [
        (1.0, True, None), (0.5, True, 0), (0.0, False, 1),
    ]
    with pytest.raises(ValueError, match="belongs to"):
        archives.open_archive(spark, path, "other")


def test_outcome_class(spark):
    rows = [("X", 1), ("X", -1), ("O", 1), ("O", -1), ("X", 0)]
    df = spark.createDataFrame(rows, "a string, v int").select(outcome_class(F.col("a"), F.col("v"), ["X", "O"]).alias("c"))
    assert [r["c"] for r in df.collect()] == ["X", "O", "O", "X", "draw"]


def test_streamed_sequences_arrive_once(spark, tmp_path):
    source, steps, marks = tmp_path / "in", str(tmp_path / "steps"), tmp_path / "marks"
    source.mkdir()
    line = lambda s, a: json.dumps({"seq_id": s, "actions": a, "outcome": "win", "length": len(a)})
    shape = "seq_id STRING, actions ARRAY<INT>, outcome STRING, length BIGINT"

    def drain():
        query = ingest_sequences(spark, str(source), shape, steps, str(marks)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    write_lines(source / "one.json", [line("a", [1, 2]), line("b", [1])])
    drain()
    write_lines(source / "two.json", [line("b", [1]), line("c", [2, 2])])
    drain()
    totals = {r["action"]: r["n"] for r in actions_seen(spark.read.parquet(steps)).collect()}
    assert totals == {1: 2, 2: 3}
