"""Exact CART over a distributed dataset, grown level by level.

Rows carry ``values`` (array of doubles), ``label`` (class index) and optionally a weight. Each level is
one job: route rows to their open node, count classes per (node, column, value), run prefix sums over the
values, and keep the best split of each node. Only one row per open node reaches the driver. Rows are
routed from the root each time, so nothing but the input is kept between levels.
"""

import json
import math
from dataclasses import dataclass, replace
from fractions import Fraction

from pyspark.sql import Window
from pyspark.sql import functions as F

from .ordering import RANGE, running


@dataclass
class Node:
    counts: list
    depth: int
    path: str = ""
    column: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1

    @property
    def is_leaf(self):
        return self.column < 0


class Tree:
    """A fitted tree; node 0 is the root."""

    def __init__(self, nodes):
        self.nodes = nodes

    def leaves(self):
        """Node ids of the leaves, depth first and left before right."""
        found = [i for i, n in enumerate(self.nodes) if n.is_leaf]
        return sorted(found, key=lambda i: self.nodes[i].path)

    def depth(self):
        return max(len(n.path) for n in self.nodes)

    def modal_class(self, node):
        counts = self.nodes[node].counts
        return counts.index(max(counts)) if counts else 0

    def route(self, values=None):
        """Column with the id of the node a row ends in (``<=`` goes left)."""
        values = F.col("values") if values is None else values
        return route(self.nodes, values)


SMALL_TREE = 127


def cut(tree, max_depth):
    """The tree that :func:`fit` grows with a smaller ``max_depth``: the upper levels, split choices being the same."""
    if max_depth == 0 or tree.depth() <= max_depth:
        return tree
    kept = [i for i, n in enumerate(tree.nodes) if len(n.path) <= max_depth]
    at = {old: new for new, old in enumerate(kept)}
    nodes = []
    for i in kept:
        n = tree.nodes[i]
        inner = not n.is_leaf and len(n.path) < max_depth
        nodes.append(Node(n.counts, n.depth, n.path, *((n.column, n.threshold, at[n.left], at[n.right]) if inner else ())))
    return Tree(nodes)


def route(nodes, values):
    """Node a row ends in: nested conditions for small trees, an array walk for large ones."""
    steps = max(len(n.path) for n in nodes)
    if len(nodes) <= SMALL_TREE:

        def branch(i):
            n = nodes[i]
            if n.is_leaf:
                return F.lit(i)
            return F.when(F.element_at(values, n.column + 1) <= n.threshold, branch(n.left)).otherwise(branch(n.right))

        return branch(0)
    table = json.dumps({
        "column": [n.column for n in nodes],
        "threshold": [n.threshold for n in nodes],
        "left": [n.left for n in nodes],
        "right": [n.right for n in nodes],
    })
    shape = "column array<int>, threshold array<double>, `left` array<int>, `right` array<int>"
    t = F.from_json(F.lit(table), shape)

    def step(node, _):
        column = F.element_at(t["column"], node + 1)
        goes_left = F.element_at(values, column + 1) <= F.element_at(t["threshold"], node + 1)
        child = F.when(goes_left, F.element_at(t["left"], node + 1)).otherwise(F.element_at(t["right"], node + 1))
        return F.when(column < 0, node).otherwise(child)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), step)


#: Decimal digits that a bigint holds: ``div`` gives one whatever it divides, and so does a literal.
LONG_DIGITS = 18


def _arithmetic(rows):
    """Integer type that holds N^3/4, and its power-of-ten headroom over N^2/4 as far as quotients are bigints."""
    largest = max(rows, 2) ** 2 // 4 + 1
    kind, room = ("bigint", 2**63 - 1) if max(rows, 2) ** 3 < 2**63 else ("decimal(38,0)", 10**38 - 1)
    return kind, min(LONG_DIGITS, int(math.log10(room // largest))), largest


def with_score(candidates, rows):
    """Add columns q0, q1, ... that order splits by (aL*nR + aR*nL) / (nL*nR), exactly.

    The quotient is written as an integer part and base-10^s digits by long division. Two different
    fractions with denominators up to D differ by at least 1/D^2, so digits down to 1/D^2 order them
    exactly and equal fractions get equal digits. Sums up to N^3/4 must fit decimal(38,0): N below about 7 * 10^12.
    """
    kind, digits, largest = _arithmetic(rows)
    if digits < 1:
        raise ValueError("too many rows for an exact split comparison")
    al, nl, ar, nr = (F.col(c).cast(kind) for c in ("a_left", "n_left", "a_right", "n_right"))
    out = candidates.withColumns({"_den": (nl * nr).cast(kind), "_num": (al * nr + ar * nl).cast(kind)})
    steps = math.ceil(2 * math.log10(largest) / digits)
    for i in range(steps + 1):
        shifted = ((F.col("_num") % F.col("_den")) * F.lit(10**digits).cast(kind)).cast(kind)
        out = out.withColumns({f"q{i}": F.expr("_num div _den"), "_num": shifted})
    return out.drop("_num", "_den"), [f"q{i}" for i in range(steps + 1)]


def split_table(counts, nodes, classes, rows, **options):
    """Every candidate split from class counts per (node, column, value): left counts, sizes, purities."""
    kind = _arithmetic(rows)[0]
    totals = F.from_json(F.lit(json.dumps([n.counts for n in nodes])), "array<array<bigint>>")
    left = {f"_l{k}": F.col(f"_k{k}") for k in range(classes)}
    summed = running(counts, ["node", "column"], ["value"], left, keep_range=True, **options)
    sides = summed.select(
        "node", "column", "value", RANGE,
        F.array(*left).alias("left_counts"),
        F.element_at(totals, F.col("node") + 1).alias("_total"),
    ).withColumn("_right", F.zip_with("_total", "left_counts", lambda t, l: t - l))
    add = lambda counts: F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, c: acc + c)
    squares = lambda counts: F.aggregate(
        counts, F.lit(0).cast(kind), lambda acc, c: (acc + c.cast(kind) * c.cast(kind)).cast(kind)
    )
    return sides.select(
        "node", "column", "value", RANGE, "left_counts",
        add("left_counts").alias("n_left"), add("_right").alias("n_right"),
        squares("left_counts").alias("a_left"), squares("_right").alias("a_right"),
    )


def best_splits(candidates, min_leaf, rows):
    """Best split per node; equal scores keep the lowest column, then the lowest value.

    A rounded score first drops what cannot be best in its own column (or range of it), so the exact
    comparison sees few rows. The margin is far above the rounding error.
    """
    valid = candidates.filter((F.col("n_right") > 0) & (F.least("n_left", "n_right") >= min_leaf))
    rounded = F.col("a_left").cast("double") / F.col("n_left") + F.col("a_right").cast("double") / F.col("n_right")
    peers = Window.partitionBy("node", "column", RANGE)
    near = valid.withColumn("_r", rounded).withColumn("_top", F.max("_r").over(peers))
    near = near.filter(F.col("_r") >= F.col("_top") * (1 - 1e-11)).drop("_r", "_top")
    scored, digits = with_score(near, rows)
    best = F.min(F.struct(
        *[(-F.col(q)).alias(q) for q in digits],
        "column", "value", "n_left", "n_right", "a_left", "a_right", "left_counts",
    ))
    return scored.groupBy("node").agg(best.alias("b")).select("node", "b.*").drop(*digits)


def value_counts(rows, nodes, open_nodes, classes):
    """Class counts per (node, column, value) over the rows of the open nodes."""
    is_open = F.from_json(F.lit(json.dumps([i in open_nodes for i in range(len(nodes))])), "array<boolean>")
    return (
        rows.select(route(nodes, F.col("values")).alias("node"), "values", "label", "weight")
        .filter(F.element_at(is_open, F.col("node") + 1))
        .select("node", "label", "weight", F.posexplode("values").alias("column", "value"))
        .groupBy("node", "column", "value")
        .agg(*[F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0)).alias(f"_k{k}") for k in range(classes)])
    )


def _improves(parent, split):
    """Strictly better than the parent, in exact Python integers."""
    n, a = sum(parent.counts), sum(c * c for c in parent.counts)
    nl, nr, al, ar = (int(split[c]) for c in ("n_left", "n_right", "a_left", "a_right"))
    return (al * nr + ar * nl) * n > a * nl * nr


def fit(rows, classes, max_depth=0, min_leaf=1, weight=None, **options):
    """Fit a tree on ``rows`` (values, label in 0..classes-1). ``max_depth`` 0 means unlimited.

    The fitted tree lives on the driver, one entry per node: its size is set by ``max_depth`` and ``min_leaf``.
    """
    rows = rows.select("values", "label", (F.lit(1) if weight is None else F.col(weight)).cast("bigint").alias("weight"))
    found = rows.groupBy("label").agg(F.sum("weight").alias("n")).collect()
    counts = [0] * classes
    for r in found:
        counts[r["label"]] = int(r["n"])
    total = sum(counts)
    nodes = [Node(counts, 0)]
    open_nodes = {0}
    while True:
        open_nodes = {
            i for i in open_nodes
            if sum(c > 0 for c in nodes[i].counts) > 1 and (max_depth == 0 or len(nodes[i].path) < max_depth)
        }
        if not open_nodes:
            return Tree(nodes)
        kept = value_counts(rows, nodes, open_nodes, classes).persist()
        largest = kept.groupBy("node", "column").count().agg(F.max("count")).first()[0]
        table = split_table(kept, nodes, classes, total, max_group=largest, **options)
        found = best_splits(table, min_leaf, total).collect()
        kept.unpersist()
        open_nodes = set()
        for split in sorted(found, key=lambda r: r["node"]):
            parent = nodes[split["node"]]
            if not _improves(parent, split):
                continue
            left = [int(c) for c in split["left_counts"]]
            right = [c - l for c, l in zip(parent.counts, left)]
            parent.column, parent.threshold = split["column"], split["value"]
            parent.left, parent.right = len(nodes), len(nodes) + 1
            nodes += [Node(left, parent.depth + 1, parent.path + "0"), Node(right, parent.depth + 1, parent.path + "1")]
            open_nodes |= {parent.left, parent.right}


def _purity(split):
    """The score of a split as an exact fraction."""
    nl, nr, al, ar = (int(split[c]) for c in ("n_left", "n_right", "a_left", "a_right"))
    return Fraction(al * nr + ar * nl, nl * nr)


def fit_trials(rows, classes, shared, trials, max_depth=0, min_leaf=1, **options):
    """One tree per trial, grown side by side: trial t sees the first ``shared`` columns and column ``shared + t``.

    Returns the trees in order and the tree of the shared columns alone; each equals what :func:`fit` grows on its own
    columns, with the trial's column after the shared ones. Nodes of different trees that rows reach by the same splits
    are one node whose counts are made once, so a level is one job for all trials, and its work grows only where their
    trees part. One row per open node and trial column reaches the driver.
    """
    rows = rows.select("values", "label", F.lit(1).cast("bigint").alias("weight"))
    counts = [0] * classes
    for r in rows.groupBy("label").agg(F.sum("weight").alias("n")).collect():
        counts[r["label"]] = int(r["n"])
    total, groups = sum(counts), trials + 1
    met, met_counts = {(): 0}, [counts]  # distinct nodes by the splits that lead to them
    grown = [[Node(counts, 0)] for _ in range(groups)]
    places = [[()] for _ in range(groups)]
    fresh = [{0} for _ in range(groups)]
    while True:
        for t, nodes in enumerate(grown):
            fresh[t] = {
                i for i in fresh[t]
                if sum(c > 0 for c in nodes[i].counts) > 1 and (max_depth == 0 or len(nodes[i].path) < max_depth)
            }
        wanted = sorted({met[places[t][i]] for t in range(groups) for i in fresh[t]})
        if not wanted:
            break
        number = {m: k for k, m in enumerate(wanted)}
        reached = []
        for t, nodes in enumerate(grown):
            ids = F.array(*[F.lit(number.get(met[places[t][i]], -1) if i in fresh[t] else -1) for i in range(len(nodes))])
            reached.append(F.element_at(ids, route(nodes, F.col("values")) + 1))
        # A group is a node with the shared columns, or with one trial column: their best splits are found apart.
        group = F.col("at") * groups + F.greatest(F.lit(0), F.col("column") - (shared - 1))
        found = (
            rows.select(F.explode(F.array_distinct(F.array(*reached))).alias("at"), "values", "label", "weight").filter("at >= 0")
            .select("at", "label", "weight", F.posexplode("values").alias("column", "value"))
            .groupBy(group.cast("int").alias("node"), "column", "value")
            .agg(*[F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0)).alias(f"_k{k}") for k in range(classes)])
        )
        kept = found.persist()
        largest = kept.groupBy("node", "column").count().agg(F.max("count")).first()[0]
        virtual = [Node(met_counts[m], 0) for m in wanted for _ in range(groups)]
        splits = {r["node"]: r for r in best_splits(split_table(kept, virtual, classes, total, max_group=largest, **options), min_leaf, total).collect()}
        kept.unpersist()
        for t, nodes in enumerate(grown):
            after = set()
            for i in sorted(fresh[t]):
                at = number[met[places[t][i]]] * groups
                own = [splits[g] for g in (at, *([at + 1 + t] if t < trials else [])) if g in splits]
                best = max(own, key=_purity, default=None)  # the first of equal ones: shared columns come first
                parent = nodes[i]
                if best is None or not _improves(parent, best):
                    continue
                left = [int(c) for c in best["left_counts"]]
                parent.column, parent.threshold = best["column"], best["value"]
                parent.left, parent.right = len(nodes), len(nodes) + 1
                for side, n in (("0", left), ("1", [c - l for c, l in zip(parent.counts, left)])):
                    place = (*places[t][i], (best["column"], best["value"], side))
                    if place not in met:
                        met[place] = len(met_counts)
                        met_counts.append(n)
                    places[t].append(place)
                    nodes.append(Node(n, parent.depth + 1, parent.path + side))
                after |= {parent.left, parent.right}
            fresh[t] = after
    return [Tree(nodes) for nodes in grown[:-1]], Tree(grown[-1])


def alone(tree, shared):
    """A tree of :func:`fit_trials` over the shared columns and its own trial column, which comes after them."""
    return Tree([replace(n, column=min(n.column, shared)) for n in tree.nodes])


def node_rows(tree, columns):
    """The tree as plain tuples: path, column name (or None), threshold, rows, modal class."""
    return [
        (n.path, None if n.is_leaf else columns[n.column], None if n.is_leaf else float(n.threshold),
         sum(n.counts), tree.modal_class(i))
        for i, n in enumerate(tree.nodes)
    ]


def fit_mllib(rows, classes, columns, max_depth=0, min_leaf=1, max_bins=256):
    """Second engine: MLlib's Gini tree (binned, midpoint thresholds), as the same :class:`Tree`.

    Agrees with :func:`fit` on tie-free data with few distinct values; depth 0 means MLlib's limit of 30.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("values").alias("features"), F.col("label").cast("double").alias("label"))
    model = DecisionTreeClassifier(
        impurity="gini", maxDepth=max_depth or 30, minInstancesPerNode=min_leaf, maxBins=max_bins
    ).fit(data)
    nodes = []

    def add(java_node, path):
        stats = [int(c) for c in java_node.impurityStats().stats()]
        nodes.append(Node(stats + [0] * (classes - len(stats)), len(path), path))
        node = nodes[-1]
        if java_node.subtreeDepth() > 0:
            node.column, node.threshold = java_node.split().featureIndex(), java_node.split().threshold()
            node.left = len(nodes)
            add(java_node.leftChild(), path + "0")
            node.right = len(nodes)
            add(java_node.rightChild(), path + "1")

    add(model._call_java("rootNode"), "")
    return Tree(nodes)
