"""A canonicaliser, extractors and a generator of a user's own over the boards of the event log."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import sets
from ..operators import dataset as D
from ..operators import plugins as G
from ..operators import rules as R
from ..operators.features import Feature
from ..session import materialize
from . import boards as B
from .catalog import joined, query, r9
from .corpora import STEPS_SQL
from .label_queries import CLASSES_SQL


def mirror_frame(cells):
    """The lesser of a row of cells and its mirror image by their texts; the cells themselves on a tie."""
    n = F.size(cells)
    same = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    mirrored = B.board_text(F.reverse(cells)) < B.board_text(cells)
    return F.struct(
        F.when(mirrored, F.reverse(cells)).otherwise(cells).alias("image"), F.when(mirrored, F.reverse(same)).otherwise(same).alias("permutation")
    )


MIRROR = G.Canonicaliser("mirror", mirror_frame)


def _filling(rows):
    held = F.size(F.filter("cells", lambda c: c.isNotNull()))
    return {"held": held.cast("bigint"), "share": held / F.size("cells")}


def _ends(rows):
    first, last = F.element_at("cells", 1), F.element_at("cells", -1)
    ends = F.array(F.lit(0), F.size("cells") - 1)
    return {
        "ends_differ": ~first.eqNullSafe(last), "free_ends": F.filter(ends, lambda p: F.element_at("cells", p + 1).isNull()),
    }


def _declared(*features):
    return tuple(Feature(n, "supplied", kind, text) for n, kind, text in features)


EXTRACTORS = G.Registry("extractor", [
    G.Extractor("filling", _declared(("held", "int", "cells with an owner"), ("share", "float", "their share of all cells")), _filling),
    G.Extractor("ends", _declared(("ends_differ", "bool", "first and last cell differ"), ("free_ends", "set", "free cells at an end")), _ends),
])
CROWDED = Feature("crowded", "invented", expr=E.all_of(E.compare("ge", E.ref("held"), E.const(5)), E.ref("ends_differ")))


def mirrored_boards(boards):
    extractors = [EXTRACTORS.get(n) for n in EXTRACTORS.names()]
    return G.featurise(boards, "cells", extractors, MIRROR, ["legal", "optimal"], [CROWDED])


MIRROR_SQL = f"""{STEPS_SQL}, {B.BOARDS_SQL},
raw AS (SELECT seq_id, run, legal, optimal, array_to_string(list_transform(cells, lambda c: coalesce(c, '.')), '') AS board FROM boards),
framed AS (SELECT *, reverse(board) < board AS turned, least(board, reverse(board)) AS image FROM raw),
moved AS (SELECT *, CASE WHEN turned THEN list_sort(list_transform(legal, lambda p: 8 - p)) ELSE legal END AS to_legal,
  CASE WHEN turned THEN list_sort(list_transform(optimal, lambda p: 8 - p)) ELSE optimal END AS to_optimal,
  length(replace(image, '.', '')) AS held, substr(image, 1, 1) <> substr(image, 9, 1) AS ends_differ,
  list_filter([0, 8], lambda p: substr(image, p + 1, 1) = '.') AS free_ends FROM framed)"""


@query("plugged_features", f"""WITH {MIRROR_SQL}
SELECT seq_id, run, image, CASE WHEN turned THEN 8 ELSE 0 END AS first_goes_to, array_to_string(to_legal, ',') AS legal,
  array_to_string(to_optimal, ',') AS optimal, held, round(held / 9, 9)::DOUBLE AS share, ends_differ,
  array_to_string(free_ends, ',') AS free_ends, held >= 5 AND ends_differ AS crowded FROM moved""")
def plugged_features(spark, folder):
    """Boards in the frame of a mirror canonicaliser, with the features of two user extractors and one derived from them."""
    rows, _ = mirrored_boards(B.event_boards(spark, folder))
    return rows.select(
        "seq_id", "run", B.board_text(F.col("cells")).alias("image"), F.element_at("permutation", 1).alias("first_goes_to"),
        joined("legal").alias("legal"), joined("optimal").alias("optimal"), "held", r9("share").alias("share"), "ends_differ",
        joined("free_ends").alias("free_ends"), "crowded",
    )


@query("plugged_frames", f"""WITH {MIRROR_SQL}
SELECT image, count(*) AS boards, count(DISTINCT board) AS raw_boards, count(*) FILTER (turned) AS turned, 0::BIGINT AS faults FROM moved GROUP BY 1""")
def plugged_frames(spark, folder):
    """Boards per image of the mirror canonicaliser, with the boards that break its contract: none."""
    boards = B.event_boards(spark, folder).withColumn("board", B.board_text(F.col("cells")))
    rows = G.canonical_frame(boards, "cells", MIRROR).withColumn("image", B.board_text(F.col("_frame.image")))
    faults = G.frame_faults(boards, "cells", MIRROR).groupBy(B.board_text(MIRROR.frame(F.col("cells"))["image"]).alias("image")).agg(F.count(F.lit(1)).alias("faults"))
    found = rows.groupBy("image").agg(
        F.count(F.lit(1)).alias("boards"), F.countDistinct("board").alias("raw_boards"), F.count_if(F.element_at("_frame.permutation", 1) != 0).alias("turned")
    )
    return found.join(faults, "image", "left").withColumn("faults", F.coalesce("faults", F.lit(0).cast("bigint")))


def constant_lists(dataset, vocabulary, seed):
    """One list without rules per set feature: play inside that set. What mined lists must beat."""
    out = []
    for name in vocabulary.set_features():
        decisions = R.DecisionList(f"only-{name}", [], R.Selector("target-in", E.ref(name)))
        decisions.definitions.extend(vocabulary.closure([name]))
        out.append(R.Mined(decisions.name, decisions, [], {}, None))
    return out


CONSTANT = G.Generator("constant", constant_lists)
GENERATORS = G.Registry("generator", [CONSTANT])


@query("plugged_candidates", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {B.CANONICAL_SQL},
classes AS (SELECT optimal, unnest([{CLASSES_SQL}]) AS c FROM once),
met AS (SELECT concat('only-', c.name) AS candidate, len(c.inside) > 0 AS fires, len(list_filter(c.inside, lambda p: NOT list_contains(optimal, p))) = 0 AS sound FROM classes)
SELECT candidate, count(*) AS states, count(*) FILTER (fires) AS fired, count(*) FILTER (fires AND sound) AS sound FROM met GROUP BY 1""")
def plugged_candidates(spark, folder):
    """Lists of a user's generator on the open boards: how often each fires, and how often all it allows is optimal."""
    states = B.canonical_states(B.event_boards(spark, folder))
    once = materialize(D.collapse(states, "canonical_state", ("seq_id", "run"), ("cells", "mover", "value", "legal", "optimal")))
    vocabulary = B.board_vocabulary()
    lists = G.generate(D.build_dataset(once, vocabulary), vocabulary, GENERATORS, ["constant"])
    fires = F.col("fired") == "fallback"
    played = [
        R.apply_rules(once, m.decisions).select(
            F.lit(m.name).alias("candidate"), fires.alias("fires"), (fires & sets.is_subset(F.col("candidates"), F.col("optimal"))).alias("sound")
        )
        for m in lists
    ]
    tallied = reduce(lambda a, b: a.unionByName(b), played).groupBy("candidate")
    return tallied.agg(F.count(F.lit(1)).alias("states"), F.count_if("fires").alias("fired"), F.count_if("sound").alias("sound"))
