import random

import pytest
from pyspark.sql import functions as F

from stepgrove.functions import sets
from stepgrove.operators import archive as N

ENTRY = ("sequence bigint, entry_id string, kind string, depth int, epsilon double, tie_break string, "
         "rules array<string>, sample_id string, signature array<string>")


def minimax(depth, epsilon=0.0, tie="seeded"):
    return ("minimax", depth, epsilon, tie, None)


def rules(*names):
    return ("heuristic-rules", None, None, None, list(names))


RANDOM = ("random", None, None, None, None)


def spec_distance(a, b):
    """Plain reference for the pairwise distance."""
    if a[0] != b[0]:
        return 1.0
    if a[0] == "minimax":
        top = max(a[1], b[1])
        return max(abs(a[1] - b[1]) / top if top else 0.0, abs(a[2] - b[2]), 0.1 if a[3] != b[3] else 0.0)
    if a[0] == "heuristic-rules":
        x, y = set(a[4]), set(b[4])
        return 1 - len(x & y) / len(x | y) if x | y else 0.0
    return 0.0


def test_spec_distance_table(spark):
    pairs = [
        (minimax(9), minimax(9), 0.0), (RANDOM, RANDOM, 0.0), (RANDOM, minimax(9), 1.0), (minimax(9), rules(), 1.0),
        (minimax(3), minimax(9), 2 / 3), (minimax(9), minimax(9, 0.25), 0.25), (minimax(9), minimax(9, 0.0, "engine"), 0.1),
        (minimax(3, 0.0, "engine"), minimax(9), 2 / 3), (minimax(0), minimax(0), 0.0),
        (rules("fallback"), rules("fallback"), 0.0), (rules("r", "fallback"), rules("fallback"), 0.5), (rules(), rules(), 0.0),
    ]
    spec = "struct<kind: string, depth: int, epsilon: double, tie_break: string, rules: array<string>>"
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], f"i int, a {spec}, b {spec}")
    got = df.select("i", sets.spec_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == pytest.approx([d for _, _, d in pairs])


def test_behaviour_distance(spark):
    sig = "struct<sample_id: string, signature: array<string>>"
    rows = [
        (0, ("s", list("1234")), ("s", list("1235"))), (1, ("s", list("1234")), ("t", list("1234"))),
        (2, ("s", list("123")), ("s", list("1234"))), (3, ("s", []), ("s", [])),
    ]
    got = spark.createDataFrame(rows, f"i int, a {sig}, b {sig}").select("i", N.behaviour_distance().alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == [0.25, None, None, 0.0]


def random_entries(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        spec = rng.choice([minimax(rng.randint(0, 4), rng.choice([0.0, 0.5])), rules(*rng.sample("abcde", rng.randint(0, 4))), RANDOM])
        sample = rng.choice([None, "s", "t"])
        width = 4 if rng.random() < 0.8 else 3
        out.append((i, f"e{i}", *spec, sample, [rng.choice("xy") for _ in range(width)] if sample else None))
    return out


def brute_novelty(entries):
    out = {}
    for k, e in enumerate(entries):
        best, sd, bd = None, [], []
        for o in entries[:k]:
            s = spec_distance(e[2:7], o[2:7])
            b = None
            if e[7] is not None and e[7] == o[7] and len(e[8]) == len(o[8]):
                b = sum(x != y for x, y in zip(e[8], o[8])) / len(e[8])
                bd.append(b)
            sd.append(s)
            d = s if b is None else b
            if best is None or d < best[0]:
                best = (d, o[0])
        least = min(sd) if sd else 1.0
        out[k] = (best[1] if best else None, least, min(bd) if bd else None, min(bd) if bd else least)
    return out


@pytest.mark.parametrize("block_rows, first", [(7, 0), (2048, 0), (7, 20)])
def test_novelty_matches_brute_force(spark, block_rows, first):
    entries = random_entries(40)
    got = N.novelty(spark.createDataFrame(entries, ENTRY).repartition(3), first, block_rows).collect()
    want = brute_novelty(entries)
    assert sorted(r["sequence"] for r in got) == list(range(first, 40))
    for r in got:
        near, sd, bd, d = want[r["sequence"]]
        assert r["nearest_sequence"] == near
        assert (r["spec_distance"], r["distance"]) == pytest.approx((sd, d))
        assert r["behaviour_distance"] == (None if bd is None else pytest.approx(bd))
        assert r["is_novel"] == (d > 0)


def test_append_once(spark):
    old = spark.createDataFrame([("a", 0), ("b", 1)], "entry_id string, sequence bigint")
    new = spark.createDataFrame([("c", 5), ("a", 1), ("d", 3), ("c", 2)], "entry_id string, ord bigint")
    got = sorted((r["entry_id"], r["sequence"], r["ord"]) for r in N.append_once(old, new, ["ord"]).collect())
    assert got == [("c", 2, 2), ("d", 3, 3)]


def test_index_mismatches(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "sequence bigint, entry_id string")
    assert N.index_mismatches(a, a).count() == 0
    b = spark.createDataFrame([(0, "x"), (1, "z"), (2, "w")], "sequence bigint, entry_id string")
    assert N.index_mismatches(a, b).count() == 2


def test_novelty_copies_packed_blocks(spark):
    """What is copied for every pair of blocks is a block, not its entries with their lists."""
    found = N.novelty(spark.createDataFrame(random_entries(40), ENTRY), 0, 7)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    steps = found._jdf.queryExecution().explainString(mode).split("\n\n")
    copied = [x for x in steps if "hashpartitioning(_i" in x and "Exchange" in x]
    assert found.count() == 40 and copied and not any("signature" in x or "rules" in x for x in copied)


def test_novelty_of_long_signatures_and_many_rules(spark, monkeypatch):
    monkeypatch.setattr(N, "RULE_BITS", 64)
    monkeypatch.setattr(N, "TILE_ROWS", 16)
    rng, entries = random.Random(5), []
    for i in range(90):
        spec = rng.choice([minimax(rng.randint(0, 3), 0.5, None), rules(*(f"r{rng.randint(0, 150)}" for _ in range(40))), RANDOM])
        width = rng.choice([1, 254, 255, 300])
        entries.append((i, f"e{i}", *spec, rng.choice([None, "s"]), [rng.choice(["a", "b", "c", "d", "e"]) for _ in range(width)]))
    entries[60] = (60, "e60", *entries[60][2:7], "s", entries[12][8])
    got = N.novelty(spark.createDataFrame(entries, ENTRY).repartition(3), 0, 32).collect()
    expected = brute_novelty(entries)
    assert len(got) == 90
    for r in got:
        nearest, spec, behaviour = expected[r["sequence"]][:3]
        assert (r["nearest_sequence"], r["spec_distance"]) == (nearest, pytest.approx(spec)) and r["behaviour_distance"] == pytest.approx(behaviour)
