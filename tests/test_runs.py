"""Runs that are committed as one unit, the discover manifest, feature merges, neighbourhoods and sketches."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from stepgrove.functions.expr import FeatureError
from stepgrove.operators import features, graph, summary
from stepgrove.operators import rules as R
from stepgrove.plans.discover import manifest_rows
from stepgrove.sources.runs import commit_run, load_tables, read_commit


def tables(spark, n):
    return {
        "steps": spark.range(n).select("id", (F.col("id") % 3).alias("ply"), F.array("id").alias("legal")),
        "none": spark.createDataFrame([], "a string"), "nulls": spark.createDataFrame([(None, 1.5), (None, 1.5)], "a string, b double"),
    }


def test_a_run_comes_back_whole(spark, tmp_path):
    path = str(tmp_path / "run")
    assert commit_run(path, "a", "board", tables(spark, 10)) == {"steps": 10, "none": 0, "nulls": 2}
    commit_run(path, "b", "board", tables(spark, 4))
    commit_run(path, "a", "board", tables(spark, 7))
    got = {n: df.count() for n, df in load_tables(spark, path, "a", "board", verify=True).items()}
    assert got == {"steps": 7, "none": 0, "nulls": 2} and load_tables(spark, path, "b", "board", verify=False)["steps"].count() == 4
    with pytest.raises(ValueError, match="belongs to"):
        load_tables(spark, path, "a", "other")
    with pytest.raises(FileNotFoundError):
        read_commit(spark, path, "c")


def test_a_run_that_stops_half_way_cannot_be_loaded(spark, tmp_path):
    path = str(tmp_path / "run")
    commit_run(path, "a", "board", {"steps": tables(spark, 10)["steps"]})
    broken = spark.range(5).select(F.raise_error(F.lit("stopped")).cast("string").alias("x"))
    with pytest.raises(Exception, match="stopped"):
        commit_run(path, "a", "board", {"steps": tables(spark, 20)["steps"], "more": broken})
    with pytest.raises(FileNotFoundError):
        load_tables(spark, path, "a", "board")


def test_an_altered_table_is_found(spark, tmp_path):
    path = str(tmp_path / "run")
    commit_run(path, "a", "board", {"steps": tables(spark, 100)["steps"].repartition(4)})
    load_tables(spark, path, "a", "board", verify=True)
    os.remove(sorted(glob.glob(f"{path}/steps/run_id=a/*.parquet"))[0])
    with pytest.raises(ValueError, match="not what was committed"):
        load_tables(spark, path, "a", "board", verify=True)


def test_manifest_joins_candidates_to_their_evaluations(spark):
    lists = [R.DecisionList("x"), R.DecisionList("y")]
    entries = spark.createDataFrame([("x", "ex"), ("y", "ey")], "name string, entry_id string")
    agreement = spark.createDataFrame([("y", 4, 1, 0.25), ("x", 4, 3, 0.75)], "candidate string, positions bigint, agreeing bigint, agreement_rate double")
    archived = spark.createDataFrame([("ey", 1, 0.5, True), ("ex", 0, 1.0, True)], "entry_id string, sequence bigint, distance double, is_novel boolean")
    got = [tuple(r) for r in manifest_rows(spark, lists, entries, agreement, archived).orderBy("ord").collect()]
    assert got == [(0, "x", "ex", 0, 0, 4, 3, 0.75, 1.0, True), (1, "y", "ey", 1, 0, 4, 1, 0.25, 0.5, True)]
    with pytest.raises(Exception, match="no evaluation of candidate x"):
        manifest_rows(spark, lists, entries, agreement.filter("candidate = 'y'"), archived).collect()


def test_merged_right_side_wins(spark):
    left = spark.createDataFrame([(1, 10, True), (2, 20, None), (None, 30, False)], "k int, n bigint, b boolean")
    right = spark.createDataFrame([(1, 11, [1]), (3, 31, None), (None, None, [2])], "k int, n bigint, s array<int>")
    out = features.merged(left, right, ["k"], {"n": "int", "b": "bool"}, {"n": "int", "s": "set"})
    assert out.columns == ["k", "n", "b", "s"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(
        [(1, 11, True, [1]), (2, 20, None, None), (None, 30, False, [2]), (3, 31, None, None)], key=repr)


@pytest.mark.parametrize("kinds, right_kinds", [({"n": "bool"}, {}), ({"n": "int"}, {"n": "float"}), ({"gone": "int"}, {}), ({"n": "odd"}, {})])
def test_wrong_kinds_are_errors_before_any_job(spark, kinds, right_kinds):
    df = spark.createDataFrame([(1, 10)], "k int, n bigint")
    with pytest.raises(FeatureError):
        features.merged(df, df, ["k"], kinds, right_kinds)


def test_neighbours(spark):
    found = {r.position: r.neighbours for r in graph.neighbour_lists(graph.grid_edges(spark, 3, 3)).collect()}
    assert found == {p: sorted(q for q in range(9) if abs(p // 3 - q // 3) + abs(p % 3 - q % 3) == 1) for p in range(9)}
    rows = spark.createDataFrame([(1, [0, 4], [1, 2, 5]), (2, [], [1]), (3, None, None), (4, [8], [0])], "k int, mine array<int>, free array<int>")
    got = {r.k: r.near for r in graph.neighbourhood(rows, ["k"], "mine", "free", graph.grid_edges(spark, 3, 3), "near").collect()}
    assert got == {1: [1, 5], 2: [], 3: [], 4: []}


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("run"), (F.col("id") % 7_000).cast("string").alias("state"))
    sketches = summary.state_sketches(df, ["run"])
    guess = summary.sketched_states(sketches).first()[0]
    assert sketches.count() == 2 and abs(guess - 7_000) <= summary.sketch_error() * 7_000
