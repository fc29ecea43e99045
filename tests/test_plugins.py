"""Registries, canonicalisers, extractors and generators of a user's own; design tables, documents, versions, plies."""

import pytest
from pyspark.sql import functions as F

from stepgrove.functions import expr as E
from stepgrove.functions import symmetry
from stepgrove.functions.expr import FeatureError
from stepgrove.operators import design
from stepgrove.operators import plugins as G
from stepgrove.operators import summary as S
from stepgrove.operators.features import Feature
from stepgrove.plans import analyzers as Z
from stepgrove.plans import plugin_queries as Q
from stepgrove.sources import records


def boards(spark, *rows):
    return spark.createDataFrame([(i, list(c) if c is not None else None, p) for i, (c, p) in enumerate(rows)], "id int, cells array<string>, legal array<int>")


def kinds(*pairs):
    return tuple(Feature(n, "supplied", k) for n, k in pairs)


def no_job(spark, call):
    """The call's error, and that it started no job."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    with pytest.raises(FeatureError) as caught:
        call()
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setJobGroup("tests", "")
    return str(caught.value)


def test_names_are_registered_once():
    one = G.Extractor("a", (), lambda rows: {})
    found = G.Registry("extractor", [one])
    assert found.get("a") is one and found.names() == ["a"]
    with pytest.raises(ValueError, match="registered already"):
        found.add(one)
    with pytest.raises(ValueError, match="known are a"):
        found.get("b")
    with pytest.raises(ValueError, match="known are none"):
        G.Registry("extractor").get("b")


@pytest.mark.parametrize("kind, value, wrong", [
    ("int", 1.5, "double"), ("bool", 1, "int"), ("set", "a", "string"), ("float", 1, "int"), ("text", 1, "unknown kind"),
])
def test_a_wrong_kind_is_an_error_before_any_job(spark, kind, value, wrong):
    rows = boards(spark, ("XO", [0]))
    plug = G.Extractor("x", kinds(("f", kind)), lambda rows: {"f": F.lit(value)})
    assert wrong in no_job(spark, lambda: G.extract(rows, [plug]))


def test_extractors_give_what_they_declare(spark):
    rows = boards(spark, ("XO", [0]))
    give = lambda *names: lambda rows: {n: F.lit(1) for n in names}
    assert "`b` missing" in no_job(spark, lambda: G.extract(rows, [G.Extractor("x", kinds(("a", "int"), ("b", "int")), give("a"))]))
    assert "`b` is not declared" in no_job(spark, lambda: G.extract(rows, [G.Extractor("x", kinds(("a", "int")), give("a", "b"))]))
    assert "column `legal` already" in no_job(spark, lambda: G.extract(rows, [G.Extractor("x", kinds(("legal", "int")), give("legal"))]))
    twice = [G.Extractor(n, kinds(("a", "int")), give("a")) for n in "xy"]
    assert "duplicate" in no_job(spark, lambda: G.extract(rows, twice))
    own = Feature("a", "supplied", "int", "", F.lit(1))
    assert "without a column" in no_job(spark, lambda: G.extract(rows, [G.Extractor("x", (own,), give("a"))]))
    same, vocabulary = G.extract(rows, [])
    assert same.columns == rows.columns and vocabulary.names() == []


def test_features_are_taken_in_the_canonical_frame(spark):
    given = [("XX.", [2]), (".XX", [0]), ("O.X", [1]), ("X.O", [1]), ("...", [0, 1, 2]), ("", []), (None, None), ("O.X", [1])]
    rows = boards(spark, *[([None if c == "." else c for c in cells] if cells is not None else None, legal) for cells, legal in given])
    first = G.Extractor("first", kinds(("first_free", "bool")), lambda rows: {"first_free": F.get("cells", 0).isNull()})
    both = Feature("closed", "invented", expr=E.negate(E.ref("first_free")))
    found, vocabulary = G.featurise(rows, "cells", [first], Q.MIRROR, ["legal"], [both])
    got = {r["id"]: ("".join(c or "." for c in r["cells"]) if r["cells"] is not None else None, r["permutation"], r["legal"], r["first_free"], r["closed"]) for r in found.collect()}
    assert vocabulary.names() == ["first_free", "closed"]
    assert got == {
        0: (".XX", [2, 1, 0], [0], True, False), 1: (".XX", [0, 1, 2], [0], True, False), 2: ("O.X", [0, 1, 2], [1], False, True),
        3: ("O.X", [2, 1, 0], [1], False, True), 4: ("...", [0, 1, 2], [0, 1, 2], True, False), 5: ("", [], [], True, False),
        6: (None, [], None, True, False), 7: ("O.X", [0, 1, 2], [1], False, True),
    }
    plain, _ = G.featurise(rows, "cells", [first], None, ["legal"])
    assert {r["id"]: r["permutation"] for r in plain.collect()}[0] == [0, 1, 2]
    assert G.featurise(rows.limit(0), "cells", [first], Q.MIRROR, ["legal"])[0].count() == 0


def test_a_group_is_a_canonicaliser(spark):
    rows = boards(spark, ("BCA", [0]), ("CAB", [2]))
    found, _ = G.featurise(rows, "cells", [], G.group_canonicaliser("turns", symmetry.cyclic_group(3)), ["legal"])
    assert [("".join(r["cells"]), r["legal"]) for r in found.orderBy("id").collect()] == [("ABC", [1]), ("ABC", [1])]
    assert G.frame_faults(rows, "cells", G.group_canonicaliser("turns", symmetry.cyclic_group(3))).count() == 0


def test_frames_are_checked(spark):
    rows = boards(spark, ("ABC", [0]), ("CAB", [0]), (None, None))
    made = lambda image, permutation: G.Canonicaliser("bad", lambda c: F.struct(image(c).alias("image"), permutation.alias("permutation")))
    identity = F.array(*map(F.lit, range(3)))
    assert "permutation is string" in no_job(spark, lambda: G.canonical_frame(rows, "cells", made(lambda c: c, F.lit("x"))))
    assert "image is int" in no_job(spark, lambda: G.canonical_frame(rows, "cells", made(F.size, identity)))
    only = G.Canonicaliser("bad", lambda c: F.struct(c.alias("image")))
    assert "permutation is missing" in no_job(spark, lambda: G.canonical_frame(rows, "cells", only))
    bad = {
        "sorted under the identity": made(F.array_sort, identity),
        "not a permutation": made(lambda c: c, F.array(*map(F.lit, [0, 0, 2]))),
        "too short": made(lambda c: c, F.array(F.lit(0), F.lit(1))),
    }
    for canonicaliser in bad.values():
        with pytest.raises(Exception, match="does not lead to the image"):
            G.canonical_frame(rows, "cells", canonicaliser).collect()
    faults = lambda c: {r["id"]: r["fault"] for r in G.frame_faults(rows, "cells", c).collect()}
    assert faults(bad["sorted under the identity"]) == {1: "permutation"}
    assert faults(bad["too short"]) == {0: "permutation", 1: "permutation"}
    turn = made(lambda c: F.concat(F.slice(c, 2, 2), F.slice(c, 1, 1)), F.array(*map(F.lit, [2, 0, 1])))
    assert faults(turn) == {0: "not idempotent", 1: "not idempotent"}
    with pytest.raises(FeatureError, match="already"):
        G.canonical_frame(rows.withColumn("_frame", F.lit(1)), "cells", Q.MIRROR)


@pytest.mark.parametrize("legal", [[3], [-1], [0, None]])
def test_a_position_without_a_place_is_an_error(spark, legal):
    with pytest.raises(Exception, match="no place under the permutation"):
        G.featurise(boards(spark, ("XO.", legal)), "cells", [], Q.MIRROR, ["legal"])[0].collect()


def test_generators(spark):
    vocabulary = Q.B.board_vocabulary()
    lists = G.generate(None, vocabulary, Q.GENERATORS, ["constant"])
    assert [m.name for m in lists] == [f"only-{n}" for n in vocabulary.set_features()]
    with pytest.raises(ValueError, match="given already"):
        G.generate(None, vocabulary, Q.GENERATORS, ["constant", "constant"])
    with pytest.raises(ValueError, match="no generator is called `x`"):
        G.generate(None, vocabulary, Q.GENERATORS, ["x"])
    with pytest.raises(ValueError, match="no candidate"):
        G.generate(None, vocabulary, Q.GENERATORS, [])
    foreign = G.Generator("foreign", lambda *_: Q.constant_lists(None, vocabulary, 0))
    with pytest.raises(FeatureError, match="unavailable"):
        G.generate(None, type(vocabulary)(), G.Registry("generator", [foreign]), ["foreign"])


def test_the_analyzer_runs_a_users_generator(spark):
    seen = []

    def told(dataset, vocabulary, seed):
        seen.append(seed)
        return Q.constant_lists(dataset, vocabulary, seed)

    folder = "/root/testdata/sf0.001"
    states = Q.B.canonical_states(Q.B.event_boards(spark, folder))
    once = Z.D.collapse(states, "canonical_state", ("seq_id", "run"), ("cells", "mover", "value", "legal", "optimal"))
    options = Z.Options(vocabulary=Q.B.board_vocabulary(), generators=G.Registry("generator", [G.Generator("told", told)]), generate=("told",), mining=Z.R.MineParams(seed=7))
    out = Z.analyze(Z.Inputs(once, once, once, once), ["dataset", "mine", "vocabulary"], options)
    assert seen == [7] and len(out.mined) == len(options.vocabulary.set_features())
    assert out.tables["mine"].count() == 0 and out.tables["vocabulary"].filter("candidate = 'overall'").count() == 1


def test_levels_of_a_table(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string")
    levels = design.levels_of(rows, "x")
    assert sorted((r["number"], r["level"]) for r in levels.collect()) == [(0, None), (1, "a"), (2, "b")]
    cells = design.design_cells(spark, {"p": design.all_pairings(levels, 2), "q": [0, 1], "r": levels}).orderBy("index").collect()
    names = [None, "a", "b"]
    want = [([a, b], q, r) for a in names for b in names for q in (0, 1) for r in names]
    assert [(c["p"], c["q"], c["r"]) for c in cells] == want and [c["index"] for c in cells] == list(range(54))
    many = design.design_cells(spark, {"n": design.levels_of(spark.range(5000), "id"), "two": ["x", "y"]})
    assert many.count() == 10_000 and many.filter("n = 4999 and two = 'y'").first()["index"] == 9_999
    with pytest.raises(ValueError, match="no levels"):
        design.design_cells(spark, {"x": design.levels_of(rows.limit(0), "x")})


def test_a_document_comes_back(spark, tmp_path):
    path = str(tmp_path / "one.json")
    one = spark.createDataFrame([(1, "a\n\"b\"", [1, 2], None)], "n int, s string, a array<int>, z double")
    records.write_document(one, path)
    assert records.read_document(spark, path, one.schema).collect() == one.collect()
    assert len(spark.read.text(path).collect()) > 3
    for wrong in (one.limit(0), one.union(one)):
        with pytest.raises(ValueError, match="exactly one row"):
            records.write_document(wrong, str(tmp_path / "no.json"))


def test_the_version_is_checked_when_the_column_is_not_read(spark):
    bad = records.checked_version(spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "schema_version int, x int"))
    with pytest.raises(Exception, match="unsupported schema_version"):
        bad.select("x").collect()


@pytest.mark.parametrize("lengths", [[3, 1, 1, 70_000], [2], [0], []])
def test_outcomes_by_ply(spark, lengths):
    rows = spark.createDataFrame([(n, ["win", "draw", "unfinished"][i % 3]) for i, n in enumerate(lengths)], "length bigint, result string")
    got = {r["ply"]: (r["decisive"], r["draws"], r["unfinished"], r["total"]) for r in S.outcome_by_ply(rows).collect()}
    reach = lambda p, k=None: sum(n > p and (k is None or i % 3 == k) for i, n in enumerate(lengths))
    assert set(got) == set(range(max(lengths, default=0)))
    for p in {0, 1, 2, 3, 65_536, 69_999} & set(got):
        assert got[p] == (reach(p, 0), reach(p, 1), reach(p, 2), reach(p))
