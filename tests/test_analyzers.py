import pytest
from pyspark.sql import functions as F

from stepgrove.operators import agreement as A
from stepgrove.operators import dataset as D
from stepgrove.operators import design as P
from stepgrove.operators import rules as R
from stepgrove.operators import summary as S
from stepgrove.operators.features import Feature
from stepgrove.plans import analyzers as Z
from stepgrove.plans import boards as B
from stepgrove.plans import sequence_queries as Q
from stepgrove.plans.corpora import event_sequences
from stepgrove.plans.discover import discover

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("names, message", [
    ([], "empty"), (["nope"], "nope"), (["mine", "mine"], "more than once"), (["mine", "dataset"], "in this order"),
])
def test_names_are_checked(names, message):
    with pytest.raises(ValueError, match=message):
        Z.validate(names)


@pytest.fixture(scope="module")
def inputs(spark):
    steps, final = Q.states_of(spark, FOLDER)
    sequences = event_sequences(steps).join(final, "seq_id")
    named = steps.withColumn("state", F.concat_ws(",", F.transform("state", lambda x: x.cast("string")))).withColumn("chosen_by", F.lit("actor"))
    labels = named.groupBy("state").agg(F.array(F.max("action")).alias("optimal"))
    states = B.canonical_states(B.event_boards(spark, FOLDER))
    once = D.collapse(states, "canonical_state", ("seq_id", "run"), ("cells", "mover", "value", "legal", "optimal"))
    final_named = sequences.withColumn("state", F.concat_ws(",", F.transform("state", lambda x: x.cast("string"))))
    return Z.Inputs(named, final_named, labels, once)


def test_registry_runs_in_order(spark, inputs):
    options = Z.Options(vocabulary=B.board_vocabulary(), mining=R.MineParams((1,), 2))
    out = Z.analyze(inputs, ["summary", "agreement", "dataset", "mine", "vocabulary"], options)
    assert set(out.tables) >= {"summary", "agreement", "dataset", "mine", "vocabulary", "outcomes"}
    overall = out.tables["agreement"].filter("dimension = 'overall'").first()
    assert overall["positions"] == inputs.steps.count()
    assert out.tables["vocabulary"].filter("candidate = 'overall'").count() == 1
    rules = out.tables["mine"].collect()
    assert rules and all(0 <= r["soundness"] <= 1 for r in rules)


def test_missing_inputs_are_errors(inputs):
    with pytest.raises(ValueError, match="requires annotations"):
        Z.analyze(Z.Inputs(inputs.steps, inputs.sequences), ["agreement"])
    with pytest.raises(ValueError, match="`dataset` analyzer"):
        Z.analyze(inputs, ["mine"])
    with pytest.raises(ValueError, match="`mine` analyzer"):
        Z.analyze(inputs, ["vocabulary"])


def test_uncovered_steps_are_an_error(inputs):
    with pytest.raises(ValueError, match="cover"):
        A.require_coverage(inputs.steps, inputs.annotations.limit(3))


def test_identical_play_fails_two_gates(spark):
    rows = [(f"s{i}", 9, "draw", (9, 1, 1)) for i in range(16)]
    sequences = spark.createDataFrame(rows, "seq_id string, length bigint, result string, fingerprint struct<n: bigint, h1: bigint, h2: bigint>")
    states = spark.createDataFrame([(10, 10)], "distinct_states bigint, distinct_canonical_states bigint")
    m = S.diversity_metrics(sequences, states, 765)
    row = m.first()
    assert (row["sequences"], row["distinct_sequences"], row["decisive"]) == (16, 1, 0)
    failed = [r["message"] for r in S.diversity_gates(m).filter("not passed").orderBy("gate").collect()]
    assert failed == ["canonical_coverage 0.01 < 0.50", "decisive_fraction 0.00 < 0.20", "distinct_fraction 0.06 < 0.50"]
    unknown = S.diversity_gates(S.diversity_metrics(sequences, states)).filter("not passed").count()
    assert unknown == 2


def test_discover_archives_candidates_once(spark, tmp_path):
    states, rows, vocabulary = B.board_dataset(spark, FOLDER)
    mined = R.mine(rows, vocabulary, R.MineParams((1, 2), 1))
    provenance = {"game": "boards", "source": "discover", "evaluation_id": "e1", "candidate": "c"}
    open_states = states.filter("not terminal")
    table, appended = discover(open_states, mined, provenance, str(tmp_path / "archive"))
    rates = {r["candidate"]: r["agreement_rate"] for r in table.collect()}
    assert set(rates) == {"mined-d1-l1", "mined-d2-l1"} and appended == 2
    _, again = discover(open_states, mined, provenance, str(tmp_path / "archive"))
    assert again == 0


def test_lists_that_differ_in_a_definition_have_other_ids(spark):
    from stepgrove.plans.discover import list_entries

    def made(limit):
        d = R.DecisionList("same", [R.Rule("r", 1, R.E.ref("concept_1"), R.Selector())])
        d.definitions.push(Feature("size", "primitive", "int"))
        d.definitions.push(Feature("concept_1", "invented", "bool", "", None, R.E.compare("ge", R.E.ref("size"), R.E.const(limit))))
        return d

    signed = spark.createDataFrame([], "candidate string, sample_id string, signature array<string>")
    provenance = {"game": "boards", "source": "discover", "evaluation_id": "e1", "candidate": "c"}
    ids = [r["entry_id"] for r in list_entries(spark, [made(1), made(2), made(1)], signed, provenance).orderBy("ord").collect()]
    assert ids[0] != ids[1] and ids[0] == ids[2]


def test_design_checks(spark):
    assert P.all_pairings(["a", "b"], 2) == [["a", "a"], ["a", "b"], ["b", "a"], ["b", "b"]]
    cells = P.design_cells(spark, {"x": ["p", "q", "r"], "y": [0, 2]}).orderBy("index").collect()
    assert [(c["index"], c["x"], c["y"]) for c in cells] == [(0, "p", 0), (1, "p", 2), (2, "q", 0), (3, "q", 2), (4, "r", 0), (5, "r", 2)]
    with pytest.raises(ValueError, match="more than once"):
        P.design_cells(spark, {"x": ["a", "a"]})


def test_decision_list_checks():
    missing = R.DecisionList("d", [R.Rule("r", 1, R.E.ref("x"), R.Selector())])
    with pytest.raises(R.E.FeatureError, match="undefined"):
        missing.validate()
    missing.definitions.push(Feature("x", "primitive", "bool"))
    with pytest.raises(R.E.FeatureError, match="unavailable"):
        missing.validate(available=["y"])
    assert R.rule_from_dict(missing.rules[0].to_dict()) == missing.rules[0]

