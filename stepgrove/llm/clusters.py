"""Centroid clustering of integer vectors with a pivot table.

The distances of every vector to a few fixed pivots are measured once and stored beside the vector. In each round only
the centroids are measured against the pivots; by the triangle inequality the difference of the two distances to a
pivot is a lower bound of the distance of vector and centroid. A vector's bounds name its most promising centroid, its
exact distance is the one to beat, and only centroids whose bound isn't above it are measured exactly, in integers.

Bounds are compared with a margin for rounding, so the result is the one of measuring everything, whatever the pivots.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stepgrove.session import materialize

from .catalog import query, table

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Pivots, and the vectors (those of the smallest hashes) they are chosen from.
PIVOTS = 8
SAMPLE = 256
#: Squared distances of integers up to this magnitude fit a long.
LARGEST = 2**27
#: Vectors that a task measures at a time, and the relative margin of a bound.
BLOCK = 4096
MARGIN = 1e-9


def integers(vectors, scale=SCALE):
    """floor(scale * x) of an array of doubles."""
    return np.floor(vectors * float(scale)).astype(np.int64)


def squared(vectors, point):
    """Exact squared distances of integer vectors to one point."""
    apart = vectors - point
    return np.einsum("ij,ij->i", apart, apart)


def choose_pivots(sample, n=PIVOTS):
    """Up to ``n`` distinct rows of ``sample``, each the one farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [sample[0]]
    far = squared(sample, sample[0])
    while len(chosen) < n and far.max() > 0:
        chosen.append(sample[int(far.argmax())])
        far = np.minimum(far, squared(sample, chosen[-1]))
    return np.array(chosen)


def nearest(vectors, to_pivots, centroids, pivots):
    """(number of the nearest centroid, squared distance, exact distances measured) of each vector.

    ``to_pivots`` has the stored squared distances to the pivots, a column each. Ties go to the smaller number.
    """
    reach = np.sqrt(to_pivots.astype(np.float64))
    bound = np.zeros((len(vectors), len(centroids)))
    for p, pivot in enumerate(pivots):
        there = np.sqrt(squared(centroids, pivot).astype(np.float64))
        gap = np.abs(reach[:, p, None] - there) - MARGIN * (reach[:, p, None] + there)
        np.maximum(bound, gap, out=bound)
    first = bound.argmin(axis=1)
    best, number, measured = np.empty(len(vectors), np.int64), first.astype(np.int64), len(vectors)
    for c, centroid in enumerate(centroids):
        mine = np.flatnonzero(first == c)
        best[mine] = squared(vectors[mine], centroid)
    bound *= bound
    for c, centroid in enumerate(centroids):
        left = np.flatnonzero((bound[:, c] <= best * (1 + MARGIN)) & (first != c))
        exact = squared(vectors[left], centroid)
        wins = (exact < best[left]) | ((exact == best[left]) & (c < number[left]))
        best[left[wins]], number[left[wins]] = exact[wins], c
        measured += len(left)
    return number, best, measured


def _arrays(column, kind, width):
    return np.asarray(column.flatten(), kind).reshape(len(column), width)


def _lists(rows):
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if len(rows) else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))


def kept_vectors(df, id, vector, dimensions=DIMENSIONS, scale=SCALE):
    """(id, vector as doubles) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= F.lit(float(LARGEST // scale))))
    return df.select(F.col(id).cast("bigint").alias("id"), x.alias("x")).filter((F.size("x") == dimensions) & sound)


class Clusters:
    """The result: ``rows`` (id, cluster, distance) and the final ``centroids`` as lists of integers."""

    def __init__(self, rows, centroids):
        self.rows, self.centroids = rows, centroids


def cluster(df, id="vec_id", vector="embedding", k=CLUSTERS, rounds=ROUNDS, dimensions=DIMENSIONS, scale=SCALE, n_pivots=PIVOTS):
    """Clusters of the vectors of ``df`` by ``rounds`` exact rounds of centroid clustering.

    Vectors with exactly ``dimensions`` components take part, none null, NaN, infinite or beyond 2**27 / ``scale``
    in magnitude (their squared distances need not fit a long); other rows, and null vectors, have no row in the
    result. Rows that repeat are vectors each; a null id hashes like an empty one. Centroids start as the ``k`` vectors
    with the smallest sha256 of ``1:<id>``, ties by the vector; fewer vectors make fewer centroids, none an empty
    result. An empty cluster keeps its centroid. Other columns play no part.

    One row per centroid and task is shuffled in a round, and ``k`` x ``dimensions`` sums reach the driver.
    """
    spark = df.sparkSession
    kept = kept_vectors(df, id, vector, dimensions, scale)
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    whole = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))))
    first = kept.select(key.alias("key"), whole.alias("v")).orderBy("key", "v").limit(max(k, SAMPLE)).collect()
    sample = np.array([r["v"] for r in first], np.int64).reshape(-1, dimensions)
    centroids, pivots = sample[:k], choose_pivots(sample, n_pivots)
    width = len(pivots)

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = integers(_arrays(part.column(1), np.float64, dimensions), scale)
                to_pivots = np.stack([squared(v, p) for p in pivots], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(v.astype(np.int32)), _lists(to_pivots)], names=["id", "v", "to_pivots"])

    if not width:
        return Clusters(spark.createDataFrame([], "id bigint, cluster int, distance bigint").withColumnRenamed("id", id), [])
    stored = materialize(kept.mapInArrow(measure, "id bigint, v array<int>, to_pivots array<bigint>"))

    def blocks(batches, centroids):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = _arrays(part.column("v"), np.int64, dimensions)
                yield part, v, *nearest(v, _arrays(part.column("to_pivots"), np.int64, width), centroids, pivots)[:2]

    for _ in range(rounds):

        def sums(batches, centroids=centroids):
            total, count = np.zeros((len(centroids), dimensions), np.int64), np.zeros(len(centroids), np.int64)
            for _, v, number, _ in blocks(batches, centroids):
                for c in np.unique(number):
                    mine = v[number == c]
                    total[c] += mine.sum(axis=0)
                    count[c] += len(mine)
            met = np.flatnonzero(count)
            axis = np.tile(np.arange(dimensions, dtype=np.int32), len(met))
            columns = [pa.array(np.repeat(met, dimensions).astype(np.int32)), pa.array(axis), pa.array(total[met].reshape(-1)), pa.array(np.repeat(count[met], dimensions))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "axis", "total", "n"])

        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        found = stored.select("v", "to_pivots").mapInArrow(sums, "cluster int, axis int, total bigint, n bigint")
        centroids = centroids.copy()
        for r in found.groupBy("cluster", "axis").agg(exact("total"), exact("n")).collect():
            centroids[r["cluster"], r["axis"]] = int(r["total"]) // int(r["n"])

    def assign(batches, centroids=centroids):
        for part, _, number, best in blocks(batches, centroids):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(number.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    rows = materialize(stored.mapInArrow(assign, "id bigint, cluster int, distance bigint"))
    return Clusters(rows.withColumnRenamed("id", id), centroids.tolist())


def described(found, id="vec_id"):
    """The rows of ``found`` with cluster_inertia, inertia and the sha256 of the final centroid."""
    sums = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in sums}
    total, long = sum(inertia.values()), "cluster int, cluster_inertia string, centroid_sha256 string"
    named = [(c, str(inertia[c]), hashlib.sha256(",".join(map(str, found.centroids[c])).encode()).hexdigest()) for c in sorted(inertia)]
    about = F.broadcast(found.rows.sparkSession.createDataFrame(named, long))  # a row per centroid
    return found.rows.join(about, "cluster").select(
        id, "cluster", "distance", F.col("cluster_inertia").cast("bigint").alias("cluster_inertia"),
        F.lit(str(total)).cast("bigint").alias("inertia"), "centroid_sha256",
    )


def _sql():
    distance = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [f"""
WITH plain AS (SELECT vec_id, sha256('1:' || vec_id) AS h, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = {DIMENSIONS}),
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) AS r, vec_id, list_transform(x, lambda e: floor({SCALE} * e)::BIGINT) AS v FROM plain
  WHERE len(list_filter(x, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSIONS}),
c0 AS (SELECT r - 1 AS c, v AS m FROM kept WHERE r <= {CLUSTERS})"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT r, vec_id, v, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, vec_id, v, c, {distance} AS d FROM kept, c{i}) GROUP BY r, vec_id, v)""")
        if i < ROUNDS:
            parts.append(f"""
s{i} AS (SELECT best.c AS c, j, sum(v[j])::HUGEINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS j) GROUP BY ALL),
n{i} AS (SELECT c, list((((s - ((s % n) + n) % n)) // n)::BIGINT ORDER BY j) AS m FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} USING (c))""")
    return ",".join(parts) + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON best.c = c{ROUNDS}.c
"""


@query("op11_pivot_clusters", _sql())
def op11_pivot_clusters(spark, folder):
    return described(cluster(table(spark, folder, "embeddings")))
