"""Mix sources to target weights with hash-random keys and distributed prefix sums.

Every row gets a key from a hash of its id. The rows of a source in key order are cut where the source's budget ends:
whole epochs first, then the rows before the cut. Key ranges of equal width hold about as many rows each, so sums per
(source, range) and their prefix sums find the range of the cut, and only the rows of that one range are sorted. What
comes out is one small row per source, the cut, with which every document decides for itself; a source with a third of
all rows is summed in as many tasks as any other.
"""

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepgrove.session import materialize, store

from .catalog import located, query, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix"
#: Rows that a key range aims at, and most ranges (a power of two) of one source.
RANGE_ROWS = 4_096
MAX_RANGE_BITS = 18
#: Sources up to which their cuts are broadcast (a few hundred bytes each); beyond it they are joined.
BROADCAST_SOURCES = 10_000

_KEY_BITS = 60


def lot(source):
    """A source as a group key that tells null from every text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def random_key(id, seed):
    """60 hash bits of the id; a null id counts as empty text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def targets(sizes, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS):
    """``sizes`` (lot, source, source_size) with each source's target.

    Sources in code point order, null last, take the weights in turn; a target stops at ``most`` times the source's
    size and what is over goes to the others by weight. Rising water: the level is the largest of the levels that come
    out when the first sources by size per weight are full. One row per source is ordered here, not one per document.
    """
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighted = sizes.withColumn("weight", F.element_at(pattern, ((rank - 1) % len(weights) + 1).cast("int")))
    order = [F.col("source_size") / F.col("weight"), F.col("lot")]
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.lit(float(most)) * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - full) / F.sum("weight").over(later)
    return (
        weighted.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.col("level") * F.col("weight")))
        .drop("level")
    )


def cuts(rows, **options):
    """One row per source of ``rows`` (lot, source, key, id, size, place): its target, epochs and where the rest ends.

    ``part`` words of the row at the cut are taken beyond the epochs, all of the rows before it, none of those after.
    """
    path, n = store(rows)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    bits = min(MAX_RANGE_BITS, max(0, math.ceil(math.log2(max(1, n) / RANGE_ROWS))))
    ranged = rows.withColumn("range", F.shiftright("key", _KEY_BITS - bits))
    sums = materialize(ranged.groupBy("lot", "source", "range").agg(F.sum("size").alias("range_size")))
    goals = targets(sums.groupBy("lot", "source").agg(F.sum("range_size").alias("source_size")), **options)
    budget = F.floor("target").cast("bigint")
    some = F.col("source_size") > 0
    goals = materialize(
        goals.withColumn("epochs", F.when(some, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )
    by_range = Window.partitionBy("lot").orderBy("range")
    reached = sums.withColumn("upto", F.sum("range_size").over(by_range)).join(goals.select("lot", "rest"), "lot")
    cut = reached.filter("upto > rest").groupBy("lot").agg(F.min_by(F.struct("range", (F.col("upto") - F.col("range_size")).alias("before"), "rest"), "range").alias("cut"))
    cut = cut.select("lot", "cut.*")
    at_cut = ranged.join(cut, ["lot", "range"])
    by_key = Window.partitionBy("lot").orderBy("key", "id", "size", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = at_cut.withColumn("upto", F.col("before") + F.sum("size").over(by_key)).filter("upto > rest")
    mark = F.struct("key", "id", "size", "place")
    last = upto.groupBy("lot").agg(
        F.min(mark).alias("mark"), F.min_by(F.col("rest") - F.col("upto") + F.col("size"), mark).alias("part")
    )
    return goals.drop("source", "rest").join(last, "lot", "left"), rows


def mix(docs, id="doc_id", text="text", source="source", place=None, seed=SEED, **options):
    """One row per row of ``docs``: id, place, size, source_size, target, epochs, part and taken.

    The size of a text is its number of words. ``taken`` = ``epochs`` x size + ``part`` words, and the taken words of
    a source sum up to its target rounded down; a row is taken ``MOST_EPOCHS`` times at most. Null and blank texts have
    size 0 and are taken 0 words; a null source is a source, in the last place; a null id has the key of an empty one.
    Equal keys go by id, size and place, so reruns agree. An empty table gives an empty table; other columns play no
    part.
    """
    plain = [F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source")]
    named = docs.select(*plain, F.col(place).alias("place")) if place else located(docs.select(*plain), "place")
    rows = named.select(
        lot(F.col("source")).alias("lot"), "source", random_key(F.col("id"), seed).alias("key"),
        "id", word_count(F.col("text")).alias("size"), "place",
    )
    found, rows = cuts(rows, **options)
    found = materialize(found)
    if found.count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    mark = F.struct("key", "id", "size", "place")
    whole = F.col("mark").isNotNull() & (mark < F.col("mark"))
    part = F.when(whole, F.col("size")).when(mark == F.col("mark"), F.col("part")).otherwise(0).cast("bigint")
    taken = rows.join(found, "lot")
    return taken.select(
        F.col("id").alias(id), "place", "size", "source_size", "target", "epochs", part.alias("part")
    ).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mixed_documents(docs, id="doc_id", text="text", source="source", **options):
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Documents stay whole: the one at a cut comes once more if half of it or more lies before the cut.
    """
    name = f"place_{uuid.uuid4().hex}"
    rows = located(docs, name)
    taken = mix(rows, id, text, source, place=name, **options)
    copies = F.col("epochs") + F.when(2 * F.col("part") >= F.col("size"), 1).otherwise(0)
    times = taken.select(F.col("place").alias(name), copies.cast("int").alias(f"n_{name}")).filter(f"n_{name} > 0")
    again = F.explode(F.sequence(F.lit(1), F.col(f"n_{name}"))).alias(f"i_{name}")
    return rows.join(times.hint("shuffle_hash"), name).select(*docs_columns(docs), again).drop(f"i_{name}")


def docs_columns(docs):
    return [F.col(f"`{c}`") for c in docs.columns]


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(string_split_regex(trim(coalesce(text, ''), E' \t\n\x0B\f\r'), '[\x20\x09-\x0D]+'))
         - (trim(coalesce(text, ''), E' \t\n\x0B\f\r') = '')::INT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
goals AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM levels),
summed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT // greatest(source_size, 1) AS epochs, floor(target)::BIGINT % greatest(source_size, 1) AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - upto + size)))::BIGINT AS taken
FROM summed
"""


@query("op7_source_mix", SQL)
def op7_source_mix(spark, folder):
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
