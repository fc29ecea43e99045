import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stepgrove.functions import expr as E
from stepgrove.operators.features import Feature, Vocabulary

KINDS = {"b": "bool", "i": "int", "f": "float", "s": "set", "u": "set"}
ROWS = [(True, 3, 1.5, [0, 2], [2, 4]), (False, -1, 0.0, [], [1]), (True, 0, -2.5, [1, 2, 3], [])]

ints = st.one_of(st.just(E.ref("i")), st.integers(-3, 3).map(E.const))
floats = st.one_of(st.just(E.ref("f")), st.sampled_from([0.5, -1.0, 2.0]).map(E.const))
set_leaf = st.one_of(st.sampled_from([E.ref("s"), E.ref("u")]), st.sets(st.integers(0, 4), max_size=3).map(E.const))
set_tree = st.recursive(
    set_leaf, lambda c: st.builds(E.set_op, st.sampled_from(list(E.SET_OPS)), c, c), max_leaves=3
)
numbers = st.recursive(
    st.one_of(ints, floats, set_tree.map(E.count)),
    lambda c: st.builds(E.arith, st.sampled_from(list(E.ARITH)), c, c), max_leaves=3,
)
truths = st.recursive(
    st.one_of(
        st.just(E.ref("b")), st.booleans().map(E.const),
        st.builds(E.compare, st.sampled_from(list(E.COMPARE)), numbers, numbers),
        st.builds(E.compare, st.sampled_from(["eq", "ne"]), set_tree, set_tree),
        st.builds(E.contains, set_tree, ints),
    ),
    lambda c: st.one_of(c.map(E.negate), st.lists(c, max_size=3).map(lambda x: E.all_of(*x)), st.lists(c, max_size=3).map(lambda x: E.any_of(*x))),
    max_leaves=4,
)


def evaluate(e, row):
    args = [evaluate(a, row) for a in e.args]
    if e.op == "const":
        return e.value
    if e.op == "ref":
        return row[e.value]
    if e.op == "not":
        return not args[0]
    if e.op in ("and", "or"):
        return all(args) if e.op == "and" else any(args)
    if e.op == "count":
        return len(args[0])
    if e.op == "contains":
        return args[1] in args[0]
    a, b = args
    return {
        "eq": lambda: a == b, "ne": lambda: a != b, "lt": lambda: a < b, "le": lambda: a <= b, "gt": lambda: a > b,
        "ge": lambda: a >= b, "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b,
        "union": lambda: a | b, "intersection": lambda: a & b, "difference": lambda: a - b,
    }[e.operator]()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(truths, numbers, set_tree), min_size=8, max_size=8))
def test_columns_match_a_plain_evaluator(spark, trees):
    df = spark.createDataFrame(ROWS, "b boolean, i bigint, f double, s array<int>, u array<int>")
    got = df.select(*[e.column(KINDS).alias(f"c{k}") for k, e in enumerate(trees)]).collect()
    for row, found in zip(ROWS, got):
        env = {k: frozenset(v) if isinstance(v, list) else v for k, v in zip("bifsu", row)}
        for e, value in zip(trees, found):
            want = evaluate(e, env)
            assert (sorted(want) if isinstance(want, frozenset) else want) == value, e.text()


@settings(max_examples=60, deadline=None)
@given(st.one_of(truths, numbers, set_tree))
def test_stored_form_round_trips(e):
    assert E.from_dict(e.to_dict()) == e


def test_type_errors():
    for bad in (
        E.negate(E.ref("i")), E.count(E.ref("b")), E.compare("lt", E.ref("s"), E.ref("u")),
        E.compare("eq", E.ref("b"), E.ref("i")), E.arith("add", E.ref("b"), E.ref("i")), E.ref("missing"),
    ):
        with pytest.raises(E.FeatureError):
            bad.kind(KINDS)


def test_text():
    e = E.all_of(E.ref("a"), E.compare("ge", E.count(E.ref("b")), E.const(1)))
    assert e.text() == "(a and (count(b) >= 1))"
    assert E.contains(E.const({2, 0}), E.const(1)).text() == "(1 in {0, 2})"


def test_overflow_raises(spark):
    big = E.arith("mul", E.const(2**62), E.const(4))
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        spark.range(1).select(big.column({})).collect()


def test_vocabulary_order_and_closure():
    v = Vocabulary([Feature("a", "primitive", "int"), Feature("z", "primitive", "int")])
    v.push(Feature("b", "invented", expr=E.compare("gt", E.ref("a"), E.const(0))))
    v.push(Feature("c", "invented", expr=E.negate(E.ref("b"))))
    assert [f.name for f in v.closure(["c"])] == ["a", "b", "c"]
    with pytest.raises(E.FeatureError, match="duplicate"):
        v.push(Feature("a", "primitive", "int"))
    with pytest.raises(E.FeatureError, match="unknown"):
        v.push(Feature("d", "invented", expr=E.ref("later")))
