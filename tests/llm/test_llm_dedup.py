import hashlib
import re

import numpy as np
import pytest
from cases import documents, edge_rows, frame, linked, ordered, simhash_rows
from pyspark.sql import functions as F

from stepgrove.llm import exact_dedup, simhash
from stepgrove.llm.components import components


def brute(rows):
    bare = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    groups = {}
    for r, b in zip(rows, bare):
        groups.setdefault(b, []).append(r)
    best = {b: min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0] for b, g in groups.items()}
    return [(r[0], best[b], len(groups[b]), hashlib.sha256(b.encode()).hexdigest()) for r, b in zip(rows, bare)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_with_nulls_ties_and_collisions(spark, weak):
    rows = edge_rows()
    digest = (lambda c: F.substring(exact_dedup.sha256(c), 1, 1)) if weak else exact_dedup.sha256
    got = exact_dedup.exact_groups(frame(spark, rows), digest=digest).collect()
    want = brute(rows)
    assert ordered((r.doc_id, r.keep_id, r.group_size) for r in got) == ordered(w[:3] for w in want)
    if not weak:
        assert ordered((r.doc_id, r.digest) for r in got) == ordered((w[0], w[3]) for w in want)
        assert sum(r.kept for r in got) == len({w[3] for w in want})
        assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_state_goes_on_with_new_files(spark, tmp_path):
    rows = [("d1", 5, ~1, "p1"), ("d1", 9, ~2, "p2"), ("d2", 1, ~3, "p3")]
    arrivals, state = str(tmp_path / "arrivals"), str(tmp_path / "state")
    spark.createDataFrame(rows, "digest string, n_points int, turned_id bigint, place string").write.parquet(arrivals)
    exact_dedup.remember(spark, arrivals, state)
    more = [("d1", 9, ~7, "p4"), ("d3", 2, ~8, "p5")]
    spark.createDataFrame(more, "digest string, n_points int, turned_id bigint, place string").write.mode("append").parquet(arrivals)
    found = exact_dedup.remember(spark, arrivals, state)
    assert ordered((r.digest, ~r.best.turned_id, r.group_size) for r in found.collect()) == [("d1", 2, 3), ("d2", 3, 1), ("d3", 8, 1)]


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.keep_first(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns


def test_kept_rows_have_the_columns_of_documents(spark):
    docs = frame(spark, edge_rows())
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({w[3] for w in brute(edge_rows())})


def test_simhash_groups_on_edges(spark):
    rows = edge_rows()
    got = simhash.near_groups(frame(spark, rows)).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"), "component_id")
    assert ordered(got.collect()) == ordered(simhash_rows(rows))
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == len({(c, p if c is None else 0) for _, p, c in simhash_rows(rows)})


def test_simhash_query(spark):
    from cases import FOLDER

    assert ordered(simhash.op2_simhash_dups(spark, FOLDER).collect()) == ordered(simhash_rows(documents()))


def dense(n, seed):
    """Fingerprints in tight balls, chains and noise."""
    draw = np.random.default_rng(seed)
    noise = draw.integers(0, 2**63, n, dtype=np.uint64)
    ball = [noise[0] ^ np.uint64(sum(1 << int(b) for b in draw.integers(0, 64, draw.integers(0, 7)))) for _ in range(n)]
    chain, x = [], noise[1]
    for _ in range(n // 4):
        x ^= np.uint64(sum(1 << int(b) for b in draw.choice(64, 4, replace=False)))
        chain.append(x)
    return np.unique(np.concatenate((noise, np.array(ball, np.uint64), np.array(chain, np.uint64), np.array([0, 2**64 - 1], np.uint64))))


@pytest.mark.parametrize("options", [{}, {"least": 0}, {"least": 1, "leaf": 40}, {"least": 3, "block": 16, "visitors": 25}])
def test_links_find_every_pair_whatever_the_tree(spark, options):
    points = dense(300, 5)
    signed = points.view("<i8").tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint").repartition(3)
    edges = simhash.links(df, **options)
    roots = {r.node: r.root for r in components(edges).collect()}
    want = linked(points)
    got = {}
    for v, w in zip(signed, want):
        got.setdefault(w, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in got.values())
    assert len({min(g) for g in got.values()}) == len(got)


def test_links_give_forests_not_pairs(spark):
    points = np.unique([1 << a | 1 << b for a in range(40) for b in range(40)]).astype("<i8")
    df = spark.createDataFrame([(int(v),) for v in points], "fingerprint bigint")
    assert simhash.links(df).count() < 2 * len(points)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 5), (10, 9), (9, 8), (8, 7), (7, 6), (20, 21), (20, 22), (20, 23), (23, 24)]
    got = components(spark.createDataFrame(edges + edges, "a bigint, b bigint"))
    want = {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(6, 11), 6), **dict.fromkeys(range(20, 25), 20)}
    assert {r.node: r.root for r in got.collect()} == want and got.count() == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r.root for r in components(path).collect()} == {0}
