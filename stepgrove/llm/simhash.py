"""SimHash near-duplicates found through a vantage-point tree.

The distinct fingerprints are dealt to the leaves of a vantage-point tree: each inner node has a vantage fingerprint
and a cut, and a fingerprint belongs inside when its Hamming distance to the vantage is at most the cut. Two
fingerprints within ``RADIUS`` bits can part at a node only if their distances to its vantage differ by at most
``RADIUS`` (triangle inequality), so one side of the band around the cut is also sent to the other side, as a visitor.
A visitor descends into every branch that the triangle bound leaves open. Each leaf then compares its own fingerprints
with each other and with its visitors, which finds every pair, and returns a spanning forest of the links, never the
pairs.

The tree is fitted on a bounded sample and only decides where pairs are compared; every fingerprint is dealt and every
pair within the radius is found whatever the sample was. Leaves too large for a task are cut into blocks and all pairs
of blocks are compared, so a dense group of near copies costs more tasks, not more memory.
"""

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stepgrove.session import materialize, store

from .catalog import located, query, table
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4

#: The tree: sampled fingerprints it is fitted on (at least 2 ** MAX_DEPTH), least and most levels, and the own
#: fingerprints of a leaf above which it gets more levels. Every level sends about 0.7 of the visitors both ways.
SAMPLE = 16_384
MIN_DEPTH = 6
MAX_DEPTH = 12
LEAF = 65_536
#: Own fingerprints and visitors of one comparison task.
BLOCK = 32_768
VISITORS = 32_768

MAX_SHINGLES = 65_536


def fingerprint(text, size=SHINGLE):
    """The 64-bit SimHash of a text given as UTF-8 bytes or None, as an unsigned int."""
    import xxhash

    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(size, len(tokens)) - 1
    starts, ends = starts[: len(tokens) - span], ends[span:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), MAX_SHINGLES):
        pieces = zip(starts[at : at + MAX_SHINGLES].tolist(), ends[at : at + MAX_SHINGLES].tolist())
        hashes = np.array([digest(joined[i:j], SEED) for i, j in pieces], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs, id="doc_id", text="text", place=None):
    """(id, fingerprint as a signed long) per row of ``docs``, and ``place`` where a column is named."""
    places = [F.col(place).alias("place")] if place else []
    plain = docs.select(F.col(id).cast("bigint").alias("id"), *places, F.col(text).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], "<u8")
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found.view("<i8"))], names=[*names, "fingerprint"])

    return plain.mapInArrow(run, f"id bigint, {'place string, ' if place else ''}fingerprint bigint")


class Tree:
    """Vantage points and cuts as arrays; children of node i are 2i + 1 (inside) and 2i + 2 (outside)."""

    def __init__(self, sample, depth, radius):
        n = 2**depth - 1
        self.depth, self.radius = depth, radius
        self.vantage, self.cut = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        self.inner_visits = np.zeros(n, bool)  # which side of the cut is sent across: the smaller band
        members = {0: sample}
        for i in range(n):
            points = members.pop(i)
            v, cut, inner = self._choose(points)
            self.vantage[i], self.cut[i], self.inner_visits[i] = v, cut, inner
            inside = np.bitwise_count(points ^ v) <= cut
            if 2 * i + 1 < n:
                members[2 * i + 1], members[2 * i + 2] = points[inside], points[~inside]

    def _choose(self, points):
        """The vantage and the cut that leave the least work: shares of both sides, and of the band sent across."""
        best = (math.inf, np.uint64(0), 32, True)
        for v in points[:: max(1, len(points) // 8)][:8]:
            counts = np.bincount(np.bitwise_count(points ^ v), minlength=65)
            total = np.concatenate((np.cumsum(counts), np.full(self.radius, len(points))))
            for cut in np.flatnonzero((total[:65] >= 0.25 * len(points)) & (total[:65] <= 0.75 * len(points))):
                below = total[cut] - (total[cut - self.radius] if cut >= self.radius else 0)
                above = total[cut + self.radius] - total[cut]
                side = total[cut] / len(points)
                work = side**2 + (1 - side) ** 2 + 2 * min(below, above) / len(points)
                if work < best[0]:
                    best = (work, v, int(cut), bool(below <= above))
        if best[0] == math.inf and len(points):
            v = points[0]
            best = (0, v, int(np.median(np.bitwise_count(points ^ v))), True)
        return best[1:]

    def route(self, points):
        """(leaf, index of the point, owned) of every leaf a point belongs to or visits."""
        n, found = len(self.vantage), []
        waiting = [(0, np.arange(len(points)), np.ones(len(points), bool))]
        while waiting:
            i, at, owned = waiting.pop()
            if not len(at):
                continue
            if i >= n:
                found.append((np.full(len(at), i - n, np.int32), at, owned))
                continue
            d = np.bitwise_count(points[at] ^ self.vantage[i]).astype(np.int64)
            inside, cut = d <= self.cut[i], self.cut[i]
            near_in, near_out = d <= cut + self.radius, d > cut - self.radius
            crosses = owned & (inside if self.inner_visits[i] else ~inside)
            into = (owned & inside) | (~owned & near_in) | (crosses & ~inside & near_in)
            outof = (owned & ~inside) | (~owned & near_out) | (crosses & inside & near_out)
            waiting.append((2 * i + 1, at[into], (owned & inside)[into]))
            waiting.append((2 * i + 2, at[outof], (owned & ~inside)[outof]))
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*found))


def _find(root, at):
    found = root[at]
    while True:
        above = root[found]
        if np.array_equal(above, found):
            root[at] = found
            return found
        found = above


def forest(own, others, radius):
    """Spanning forest of the links within ``own`` (``others`` None) or between both: two arrays of fingerprints."""
    whole = own if others is None else np.concatenate((own, others))
    shift = 0 if others is None else len(own)
    right = own if others is None else others
    root = np.arange(len(whole))
    for a in range(0, len(own), 64):
        left = own[a : a + 64, None]
        for b in range(a if others is None else 0, len(right), 4096):
            close = np.bitwise_count(left ^ right[None, b : b + 4096]) <= radius
            if not close.any():
                continue
            i, j = np.nonzero(close)
            i, j = i + a, j + b + shift
            while len(i):
                x, y = _find(root, i), _find(root, j)
                apart = x != y
                i, j, x, y = i[apart], j[apart], x[apart], y[apart]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
    top = _find(root, np.arange(len(whole)))
    linked = np.flatnonzero(top != np.arange(len(whole)))
    return whole[linked], whole[top[linked]]


def links(points, radius=RADIUS, least=MIN_DEPTH, leaf=LEAF, block=BLOCK, visitors=VISITORS):
    """Edges (a, b) that connect exactly the fingerprints within ``radius`` bits, directly or in steps.

    ``points`` has one column ``fingerprint`` of distinct signed longs and is read twice.
    """
    spark, n = points.sparkSession, points.count()
    depth = min(MAX_DEPTH, max(least, math.ceil(math.log2(max(1, n) / leaf))))
    taken = points.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(SAMPLE).collect() if depth else []
    tree = Tree(np.array([r[0] for r in taken], "<i8").view("<u8"), depth, radius)

    def deal(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            shard, at, owned = tree.route(own.view("<u8"))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(own[at]), pa.array(owned)], names=["leaf", "fingerprint", "owned"])

    dealt = materialize(points.mapInArrow(deal, "leaf int, fingerprint bigint, owned boolean"))
    # At most 2 ** MAX_DEPTH leaves: blocks of own fingerprints, then blocks of visitors.
    counts = dealt.groupBy("leaf").agg(F.count_if("owned").alias("n_own"), F.count_if(~F.col("owned")).alias("n_other"))
    blocks = F.broadcast(
        counts.select(
            "leaf",
            F.ceil(F.col("n_own") / block).cast("int").alias("rows"),
            F.ceil(F.col("n_other") / visitors).cast("int").alias("extra"),
        ).filter("rows > 0")
    )
    part = lambda n: F.pmod(F.xxhash64("fingerprint"), F.col(n)).cast("int")
    across = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    mine = F.transform(
        F.sequence(F.lit(0), F.col("rows") + F.col("extra") - 1),
        lambda k: F.when(
            k < F.col("rows"), F.struct(F.least(part("rows"), k).alias("i"), F.greatest(part("rows"), k).alias("k"), (part("rows") <= k).alias("own"))
        ).otherwise(F.struct(part("rows").alias("i"), k.alias("k"), F.lit(True).alias("own"))),
    )
    theirs = F.transform(across("rows"), lambda i: F.struct(i.alias("i"), (F.col("rows") + part("extra")).alias("k"), F.lit(False).alias("own")))
    cells = dealt.join(blocks, "leaf").select(
        "leaf", "fingerprint", F.explode(F.when(F.col("owned"), mine).otherwise(theirs)).alias("cell")
    ).select("leaf", "cell.i", "cell.k", "cell.own", "fingerprint")

    def compare(cell):
        import pandas as pd

        points, own = cell["fingerprint"].to_numpy().view("<u8"), cell["own"].to_numpy()
        diagonal = cell["i"].iloc[0] == cell["k"].iloc[0]
        a, b = forest(points[own], None if diagonal else points[~own], radius)
        return pd.DataFrame({"a": a.view("<i8"), "b": b.view("<i8")})

    return cells.groupBy("leaf", "i", "k").applyInPandas(compare, "a bigint, b bigint")


def near_groups(docs, id="doc_id", text="text", place=None, radius=RADIUS):
    """One row per row of ``docs``: id, fingerprint (signed long), root (a fingerprint), component_id (smallest id).

    Words are parted by white space and lower-cased in A-Z only; shingles count as often as they occur. Fewer than
    four words make one shingle, none (null, empty and blank texts) the fingerprint zero, which links like any other.
    Rows with equal fingerprints are one node, so copies cost nothing after the first shuffle. A null id is never the
    smallest unless all are null. An empty table gives an empty table; other columns play no part.
    """
    rows = materialize(fingerprints(docs, id, text, place))
    nodes = materialize(rows.groupBy("fingerprint").agg(F.min("id").alias("least")))
    roots = materialize(components(links(nodes.select("fingerprint"), radius)))
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = rooted.select("fingerprint", "root").join(smallest, "root")
    out = rows.join(placed, "fingerprint")
    return out.select(F.col("id").alias(id), *(["place"] if place else []), "fingerprint", "root", "component_id")


def keep_one(docs, id="doc_id", text="text"):
    """One row of each group of near copies, the one with the smallest id, with the columns of ``docs``."""
    name = f"place_{uuid.uuid4().hex}"
    rows = located(docs, name)
    groups = near_groups(rows, id, text, place=name)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col(id).isNull(), F.col(id), F.col("place"))).alias("first"))
    kept = first.select(F.col("first.place").alias(name))
    return rows.join(kept.hint("shuffle_hash"), name, "left_semi").drop(name)


@query("op2_simhash_dups")
def op2_simhash_dups(spark, folder):
    groups = near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
