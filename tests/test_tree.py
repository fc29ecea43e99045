import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stepgrove.operators import tree as T
from stepgrove.operators import rules as R
from stepgrove.operators.features import Feature, Vocabulary

SHAPE = "values array<double>, label int"


def brute(rows, classes, max_depth, min_leaf, path=""):
    """All nodes of the exact tree by plain recursion over integer fractions."""
    counts = [sum(r[1] == k for r in rows) for k in range(classes)]
    purity = lambda part: sum(sum(r[1] == k for r in part) ** 2 for k in range(classes))
    best = None
    if sum(c > 0 for c in counts) > 1 and (max_depth == 0 or len(path) < max_depth):
        for col in range(len(rows[0][0])):
            for v in sorted({r[0][col] for r in rows})[:-1]:
                left, right = [r for r in rows if r[0][col] <= v], [r for r in rows if r[0][col] > v]
                if min(len(left), len(right)) < min_leaf:
                    continue
                top, bottom = purity(left) * len(right) + purity(right) * len(left), len(left) * len(right)
                if best is None or top * best[1] > best[0] * bottom:
                    best = (top, bottom, col, v, left, right)
        if best and not best[0] * len(rows) > purity(rows) * best[1]:
            best = None
    here = (path, best[2] if best else None, best[3] if best else None, len(rows), counts.index(max(counts)))
    if best is None:
        return [here]
    return [here, *brute(best[4], classes, max_depth, min_leaf, path + "0"), *brute(best[5], classes, max_depth, min_leaf, path + "1")]


def key(nodes):
    return sorted(nodes, key=lambda n: n[0])


@pytest.mark.parametrize("depth, min_leaf, sample", [(2, 3, 10**6), (0, 1, 10**6), (2, 1, 2)])
def test_matches_brute_force(spark, depth, min_leaf, sample):
    rng = random.Random(depth * 10 + min_leaf)
    rows = [([float(rng.randint(0, 4)), float(rng.randint(0, 9)), float(rng.randint(0, 1))], rng.randint(0, 2)) for _ in range(50)]
    tree = T.fit(spark.createDataFrame(rows, SHAPE).repartition(5), 3, depth, min_leaf, sample=sample)
    assert key(T.node_rows(tree, [0, 1, 2])) == key(brute(rows, 3, depth, min_leaf))


def test_wide_arithmetic_gives_the_same_order(spark, monkeypatch):
    rng = random.Random(5)
    rows = [([float(rng.randint(0, 3)), float(rng.randint(0, 3))], rng.randint(0, 1)) for _ in range(40)]
    plain = T._arithmetic
    monkeypatch.setattr(T, "_arithmetic", lambda n: plain(10**11))
    assert plain(10**11)[0] == "decimal(38,0)"
    tree = T.fit(spark.createDataFrame(rows, SHAPE), 2, 2, 1)
    assert key(T.node_rows(tree, [0, 1])) == key(brute(rows, 2, 2, 1))


@pytest.mark.parametrize("n", [2_097_152, 3_600_000, 36_000_000, 10**9])
def test_tables_beyond_plain_integers_give_the_same_order(spark, monkeypatch, n):
    rng = random.Random(6)
    rows = [([float(rng.randint(0, 3)), float(rng.randint(0, 3))], rng.randint(0, 1)) for _ in range(40)]
    plain = T._arithmetic
    monkeypatch.setattr(T, "_arithmetic", lambda rows: plain(n))
    assert plain(n)[0] == "decimal(38,0)"
    tree = T.fit(spark.createDataFrame(rows, SHAPE), 2, 2, 1)
    assert key(T.node_rows(tree, [0, 1])) == key(brute(rows, 2, 2, 1))


def test_weights_of_many_rows(spark):
    """Splits whose scores differ in the last digits only, over more rows than plain integers compare."""
    m = 1_000_000
    rows = [([0.0, 1.0], 0, m), ([1.0, 0.0], 1, m), ([2.0, 2.0], 0, m + 1), ([3.0, 3.0], 1, m - 1)]
    tree = T.fit(spark.createDataFrame(rows, SHAPE + ", w bigint"), 2, 1, 1, weight="w")

    def score(left):
        parts = [[sum(w for _, k, w in part if k == c) for c in (0, 1)] for part in (left, [r for r in rows if r not in left])]
        return sum(Fraction(sum(n * n for n in p), sum(p)) for p in parts)

    cuts = [(c, v, [r for r in rows if r[0][c] <= v]) for c in (0, 1) for v in (0.0, 1.0, 2.0)]
    best = max(cuts, key=lambda cut: score(cut[2]))
    assert (tree.nodes[0].column, tree.nodes[0].threshold) == best[:2]


def test_large_tree_routing_agrees(spark, monkeypatch):
    rng = random.Random(9)
    rows = [([float(rng.randint(0, 9)), float(rng.randint(0, 9))], rng.randint(0, 2)) for _ in range(80)]
    df = spark.createDataFrame(rows, SHAPE)
    tree = T.fit(df, 3, 4, 1)
    small = [r[0] for r in df.select(tree.route()).collect()]
    monkeypatch.setattr(T, "SMALL_TREE", 0)
    assert small == [r[0] for r in df.select(tree.route()).collect()]


def test_weights_count_as_copies(spark):
    rows = [([0.0], 0, 3), ([1.0], 1, 2), ([2.0], 0, 1)]
    weighted = T.fit(spark.createDataFrame(rows, SHAPE + ", w int"), 2, 2, 1, weight="w")
    copies = [(v, l) for v, l, w in rows for _ in range(w)]
    assert T.node_rows(weighted, [0]) == T.node_rows(T.fit(spark.createDataFrame(copies, SHAPE), 2, 2, 1), [0])


TIE_FREE = [([1.0, 1.0, float(x)], 0 if x <= 1 else 1) for x in (0, 0, 1, 1, 2, 2, 3, 3)]


def test_engines_agree_on_tie_free_rows(spark):
    voc = Vocabulary([Feature("win", "supplied", "set"), Feature("block", "supplied", "set"), Feature("threats", "supplied", "int")])
    rows = [(f"s{i}", v, ("win", "block")[l], [("win", "block")[l]], 1, 1) for i, (v, l) in enumerate(TIE_FREE)]
    df = spark.createDataFrame(rows, "canonical_state string, values array<double>, label string, qualifying array<string>, occurrences bigint, value int")
    ours = R.mine_one(df, voc, 6)
    theirs = R.mine_one(df, voc, 6, engine="mllib")
    assert [r.condition.text() for r in ours.decisions.rules] == ["((threats <= 1))", "((threats > 1))"]
    assert [(r.condition, r.action) for r in ours.decisions.rules] == [(r.condition, r.action) for r in theirs.decisions.rules]
    assert ours.scores["train_accuracy"] == 1.0 and ours.scores["holdout_accuracy"] is None


def test_pure_rows_are_a_leaf(spark):
    tree = T.fit(spark.createDataFrame([([1.0], 1), ([2.0], 1)], SHAPE), 2)
    assert len(tree.nodes) == 1 and tree.modal_class(0) == 1 and tree.depth() == 0


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.25, 0.5, 0.99])
def test_holdout_has_the_exact_size(spark, fraction):
    rows = spark.range(137)
    held = rows.filter(R.holdout_condition(rows, F.col("id"), 7, fraction)).count()
    assert held == int(137 * fraction)


@pytest.mark.parametrize("bad", [{"depths": ()}, {"depths": (2, 2)}, {"min_leaf": 0}, {"holdout_fraction": 1.0}, {"engine": "x"}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        R.MineParams(**bad).validate()


def test_cut_equals_a_shallower_fit(spark):
    rng = random.Random(11)
    rows = [([float(rng.randint(0, 5)), float(rng.randint(0, 5))], rng.randint(0, 2)) for _ in range(90)]
    df = spark.createDataFrame(rows, SHAPE)
    whole = T.fit(df, 3, 0, 2)
    for depth in (0, 1, 2, 3, 50):
        assert key(T.node_rows(T.cut(whole, depth), [0, 1])) == key(T.node_rows(T.fit(df, 3, depth, 2), [0, 1]))
