"""Known totals of the full board graph, from edges to mined lists."""

import pytest
from pyspark.sql import functions as F

from board_graph import board_graph
from stepgrove.functions.scalars import outcome_class
from stepgrove.functions.symmetry import move_positions
from stepgrove.operators import dataset as D
from stepgrove.operators import graph as G
from stepgrove.operators import rules as R
from stepgrove.operators.features import Feature, Vocabulary, occupancy_features, side_to_move
from stepgrove.plans import boards as B
from stepgrove.session import materialize


@pytest.fixture(scope="module")
def graph(spark):
    states, edges = board_graph(spark)
    assert states.count() == 5478 and edges.count() == 16167
    return states, edges


@pytest.fixture(scope="module")
def solved(spark, graph):
    states, edges = graph
    levels = G.reach(edges, spark.createDataFrame([(".........:X",)], "state string"), limit=1_000_000)
    values, optimal = G.backward_induction(edges, states.filter("terminal").select("state", "value"))
    return levels, values, materialize(G.optimal_sets(optimal))


@pytest.fixture(scope="module")
def annotations(graph, solved):
    states, _ = graph
    _, values, optimal = solved
    cells = F.transform(F.split("board", ""), lambda c: F.when(c != ".", c))
    rows = states.drop("value").join(values, "state").join(optimal, "state", "left").withColumn("cells", cells)
    places = F.sequence(F.lit(0), F.lit(8))
    rows = rows.withColumn("legal", F.filter(places, lambda p: F.element_at("cells", p + 1).isNull()))
    form = rows.withColumn("_f", B.canonical_board(F.col("cells")))
    return materialize(form.select(
        "state", "mover", "terminal", "value", F.col("_f.image").alias("cells"),
        F.concat(B.board_text(F.col("_f.image")), F.lit(":"), F.col("mover")).alias("canonical_state"),
        move_positions(F.col("legal"), F.col("_f.permutation")).alias("legal"),
        move_positions(F.coalesce("optimal", F.array().cast("array<int>")), F.col("_f.permutation")).alias("optimal"),
        F.col("_f.code").alias("code"),
    ))


def vocabulary(extended=False, supplied=True):
    out = Vocabulary([side_to_move(F.col("mover"), ["X", "O"])])
    out.extend(occupancy_features("cells", "mover", B.ORBITS, B.LINES, extended))
    return out.extend(B.supplied_features()) if supplied else out


@pytest.fixture(scope="module")
def labelled(spark, annotations):
    once = D.collapse(annotations, "canonical_state", ("state",), ("cells", "mover", "value", "legal", "optimal"))
    return materialize(D.build_dataset(once, vocabulary()))


def test_group():
    assert len(B.GROUP) == 8 and B.GROUP[0] == list(range(9))


def test_reachability_and_classes(graph, solved):
    states, _ = graph
    levels, values, _ = solved
    assert levels.count() == 5478 and states.filter("terminal").count() == 958
    named = states.drop("value").join(values, "state")
    classes = named.groupBy(outcome_class(F.col("mover"), F.col("value"), ["X", "O"]).alias("c")).count()
    assert {r["c"]: r["count"] for r in classes.collect()} == {"X": 2936, "draw": 1068, "O": 1474}


def test_reach_limit(spark, graph):
    with pytest.raises(ValueError):
        G.reach(graph[1], spark.createDataFrame([(".........:X",)], "state string"), limit=100)


def test_canonical_totals(annotations):
    assert annotations.select("canonical_state").distinct().count() == 765
    assert annotations.filter("not terminal").count() == 4520
    codes = {r["state"]: r["code"] for r in annotations.filter("state in ('........X:O', 'X........:O')").collect()}
    assert set(codes.values()) == {1}


def test_vocabulary_sizes():
    assert len(vocabulary(supplied=False).features) == 48
    assert len(vocabulary().features) == 70 and len(vocabulary().set_features()) == 17
    assert len(vocabulary(extended=True).features) == 104
    assert len(vocabulary(extended=True, supplied=False).features) == 82


def test_dataset(annotations, labelled):
    m = D.manifest(annotations, labelled).collect()[0]
    assert (m["annotated"], m["nonterminal"], m["rows"]) == (5478, 4520, 627)
    assert m["unlabeled"] / m["rows"] < 0.05
    assert labelled.filter("array_contains(qualifying, 'ttt.winning_cells')").count() >= 100
    sizes = {r["key"]: r["n"] for r in D.histogram(labelled, "value", [-1, 0, 1]).collect()}
    assert sum(sizes.values()) == 627 and set(sizes) == {"-1", "0", "1"}


def test_mined_list_is_sound_and_stable(labelled):
    first = R.mine_one(labelled, vocabulary(), 3, 1)
    second = R.mine_one(labelled.repartition(7), vocabulary(), 3, 1)
    assert first.evidence == second.evidence and first.scores == second.scores
    assert first.scores["train_rows"] == 627 and first.scores["train_soundness"] > 0.7
    assert [r.name for r in first.decisions.rules] == [e["rule"] for e in first.evidence]
    played = R.choose(R.apply_rules(labelled_states(labelled), first.decisions), 3, F.col("canonical_state"))
    assert played.filter("not array_contains(legal, action)").count() == 0
    assert played.filter("array_contains(optimal, action)").count() / 627 > 0.7


def labelled_states(labelled):
    return labelled.select("canonical_state", "cells", "mover", "legal", "optimal")


def test_values_on_edges_that_skip_levels(spark):
    edges = spark.createDataFrame([("a", 1, "b"), ("a", 2, "c"), ("b", 1, "c"), ("c", 1, "d")], "src string, action int, dst string")
    ends = spark.createDataFrame([("d", -1)], "state string, value int")
    values, optimal = G.backward_induction(edges, ends)
    assert {r["state"]: r["value"] for r in values.collect()} == {"a": 1, "b": -1, "c": 1, "d": -1}
    assert {tuple(r) for r in optimal.collect()} == {("a", 1, "b"), ("b", 1, "c"), ("c", 1, "d")}


def test_states_without_a_value_are_an_error(spark):
    cycle = spark.createDataFrame([("a", 1, "b"), ("b", 1, "a"), ("a", 2, "c")], "src string, action int, dst string")
    with pytest.raises(ValueError):
        G.backward_induction(cycle, spark.createDataFrame([("c", 0)], "state string, value int"))
    loose = spark.createDataFrame([("a", 1, "b"), ("a", 2, "c")], "src string, action int, dst string")
    with pytest.raises(ValueError):
        G.backward_induction(loose, spark.createDataFrame([("c", 0)], "state string, value int"))


def test_maximize_stays_inside_the_legal_actions(spark):
    df = spark.createDataFrame([(["x"], [("x", 1.0), ("y", 9.0)])], "legal array<string>, scored array<struct<action: string, score: double>>")
    picks = R.DecisionList("m", [R.Rule("go", 1, R.E.const(True), R.Selector("maximize", R.E.const(1)))])
    assert R.apply_rules(df, picks, scored={"go": F.col("scored")}).first()["candidates"] == ["x"]


def test_a_successor_without_features_is_an_error(spark):
    edges = spark.createDataFrame([("s", "x", "t"), ("s", "y", "u")], "state string, action string, next string")
    features = spark.createDataFrame([("t", 3)], "state string, n bigint")
    scored = R.scored_successors(edges, features, Vocabulary([Feature("n", "primitive", "int")]), R.E.ref("n"))
    with pytest.raises(Exception, match="no features"):
        scored.collect()
