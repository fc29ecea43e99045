import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stepgrove.operators.corpus import expand_sequences, fold_states, sequence_summary, verify_steps, with_source
from stepgrove.operators import ordering
from stepgrove.operators.ordering import ordinal, running, stride_sample


@pytest.fixture(scope="module")
def log(spark):
    """Key 0 holds a third of the rows; times repeat, so the id breaks ties."""
    rows = [(0 if i % 3 == 0 else i % 50, (i * 7919) % 400, i, i % 4) for i in range(3000)]
    return spark.createDataFrame(rows, "k bigint, t bigint, id bigint, v bigint").persist()


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("keys", [["k"], []])
def test_hot_groups_give_the_same_sums(log, keys):
    measures = {"s": F.col("v"), "c": F.lit(1)}
    plain = running(log, keys, ["t", "id"], measures, total="n")
    cut = running(log, keys, ["t", "id"], measures, total="n", sample=7)
    assert "_range" not in cut.columns and same(plain, cut)
    assert same(
        running(log, keys, ["t", "id"], measures, exclusive=True),
        running(log, keys, ["t", "id"], measures, exclusive=True, sample=7),
    )


def test_equal_first_order_column_falls_back_to_the_next(log):
    flat = log.withColumn("t", F.lit(5).cast("bigint"))
    assert same(ordinal(flat, ["k"], ["t", "id"]), ordinal(flat, ["k"], ["t", "id"], sample=7))


@pytest.mark.parametrize("sample", [1, 3, 50, 10**6])
@pytest.mark.parametrize("parts", [1, 7])
def test_any_cut_equals_a_plain_window(spark, sample, parts):
    """Null order values, text order, one early outlier, null keys, ties in the first column."""
    rows = [(None if i % 11 == 0 else i % 3, None if i % 13 == 0 else f"t{(i * 37) % 101}", 0 if i == 5 else 10**9 + i % 400, i, i % 5) for i in range(1200)]
    df = spark.createDataFrame(rows, "k bigint, s string, t bigint, id bigint, v bigint").repartition(parts)
    for keys, order in ((["k"], ["s", "id"]), (["k"], ["t", "id"]), ([], ["s", "t", "id"])):
        w = Window.partitionBy(*keys).orderBy(*order)
        plain = df.withColumns({
            "c": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        })
        assert same(plain, running(df, keys, order, {"c": F.col("v")}, total="n", sample=sample))
        assert same(plain, running(df, keys, order, {"c": F.col("v")}, total="n", sample=sample, max_group=1200))
        assert same(df.withColumn("p", (F.row_number().over(w) - 1).cast("bigint")), ordinal(df, keys, order, "p", sample=sample))


def test_many_cuts_are_thinned(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_CUTS", 40)
    df = spark.range(5000).withColumn("v", F.lit(1).cast("bigint"))
    got = running(df, [], ["id"], {"c": F.col("v")}, sample=1, keep_range=True)
    assert got.filter("c <> id + 1").count() == 0 and 32 < got.select("_range").distinct().count() <= 41


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k bigint, t bigint")
    assert ordinal(empty, ["k"], ["t"]).count() == 0 and ordinal(empty, [], ["t"]).count() == 0


def test_partitioning_does_not_change_the_result(log):
    assert same(ordinal(log.repartition(1), ["k"], ["t", "id"]), ordinal(log.repartition(7), ["k"], ["t", "id"]))


def test_stride_sample(log):
    for options in ({}, {"sample": 7}):
        got = stride_sample(log, ["k"], ["t", "id"], size=8, **options)
        counts = {r["k"]: r["count"] for r in got.groupBy("k").count().collect()}
        assert counts[0] == 8 and all(c <= 8 for c in counts.values())


@pytest.fixture(scope="module")
def games(spark):
    rows = [("a", [4, 0, 8], "X", 3), ("b", [], None, 0), ("c", [1, 2], "draw", 2)]
    return spark.createDataFrame(rows, "seq_id string, actions array<int>, outcome string, length bigint")


def test_expand_sequences(games):
    got = sorted(tuple(r) for r in expand_sequences(games).select("seq_id", "ply", "action", "length").collect())
    assert got == [("a", 0, 4, 3), ("a", 1, 0, 3), ("a", 2, 8, 3), ("c", 0, 1, 2), ("c", 1, 2, 2)]


def test_fold_states(games):
    folded = fold_states(games, F.lit(0).cast("int"), lambda s, a: s * 10 + a)
    got = {r["seq_id"]: (r["states"], r["final_state"]) for r in folded.collect()}
    assert got == {"a": ([0, 4, 40], 408), "b": ([], 0), "c": ([0, 1], 12)}


def test_step_source(games):
    steps = with_source(expand_sequences(games), 1, 1, F.lit("actor"))
    got = [r["chosen_by"] for r in steps.filter("seq_id = 'a'").orderBy("ply").collect()]
    assert got == ["opening", "random-opening", "actor"]


def test_fingerprint_tells_order_apart(spark):
    rows = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "y"), ("b", 1, "x"), ("c", 0, "x"), ("c", 1, "y")]
    got = sequence_summary(spark.createDataFrame(rows, "seq_id string, ply bigint, action string"))
    prints = {r["seq_id"]: r["fingerprint"] for r in got.collect()}
    assert prints["a"] == prints["c"] != prints["b"]


def test_verify_steps_reports_the_first_mismatch(spark):
    shape = "seq_id string, ply bigint, action int, length int"
    derived = spark.createDataFrame([("a", 0, 4, 2), ("a", 1, 5, 2), ("b", 0, 1, 1), ("c", 0, 1, 1)], shape)
    stored = spark.createDataFrame([("a", 0, 4, 2), ("a", 1, 6, 9), ("b", 0, 1, 1), ("c", 0, 1, 1), ("c", 1, 1, 1)], shape)
    got = {r["seq_id"]: (r["ply"], r["what"]) for r in verify_steps(stored, derived, ["action", "length"]).collect()}
    assert got == {"a": (1, "action"), "c": (1, "position count")}
