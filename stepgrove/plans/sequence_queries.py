"""Sequence expansion, states, outcomes, diversity, verification."""

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import composite_id
from ..functions.symmetry import canonical_form, cyclic_group, least_image, move_back, orbit_of
from ..operators import agreement as A
from ..operators import corpus as C
from ..operators import summary as S
from ..operators.ordering import ordinal
from ..session import checkpoint_folder, materialize
from .catalog import joined, query, r9, table
from .corpora import SYMBOLS, TALLY_SQL, STEPS_SQL, event_corpus, event_rows, event_sequences, event_steps, seat_player, windows

POSITION_SQL = "list_position(['click','error','purchase','signup','view'], {0}) - 1"


@query("expand_steps", f"""WITH {STEPS_SQL}
SELECT s.seq_id, s.ply, concat_ws(':', s.seq_id, s.ply) AS step_id, s.action,
       CASE s.ply % 2 WHEN 0 THEN 'X' ELSE 'O' END AS actor,
       CASE WHEN s.ply < 1 THEN 'opening' WHEN s.ply < least(length, 3) THEN 'random-opening'
            WHEN s.ply % 2 = 0 THEN first_action ELSE second_action END AS chosen_by,
       least(length, 3) AS opening_plies, length, result, winner
FROM steps s JOIN seqs USING (seq_id)""")
def expand_steps(spark, folder):
    c = event_corpus(spark, folder)
    steps = C.attach_sequences(c.steps, c.sequences, ["length", "result", "winner", "strategies"])
    actor_name = F.element_at("strategies", (F.col("ply") % 2 + 1).cast("int"))
    return C.with_source(steps, 1, 2, actor_name).select(
        "seq_id", "ply", composite_id("seq_id", "ply").alias("step_id"), "action",
        seat_player(F.col("ply")).alias("actor"), "chosen_by", "opening_plies", "length", "result", "winner",
    )


COUNTS_SQL = ", ".join(
    f"count(*) FILTER (action = '{s}') OVER w AS c{i}" for i, s in enumerate(SYMBOLS)
)
PREFIX_SQL = f"""prefix AS (
  SELECT seq_id, ply, {COUNTS_SQL} FROM steps
  WINDOW w AS (PARTITION BY seq_id ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT seq_id, {", ".join(f"count(*) FILTER (action = '{s}') AS c{i}" for i, s in enumerate(SYMBOLS))}
  FROM steps GROUP BY seq_id)"""
STATE_SQL = "concat_ws(',', c0, c1, c2, c3, c4)"


def step_states(spark, folder):
    return C.prefix_states(event_steps(spark, folder), SYMBOLS, order=("ts", "event_id"))


@query("prefix_state", f"WITH {STEPS_SQL}, {PREFIX_SQL} SELECT seq_id, ply, {STATE_SQL} AS state FROM prefix")
def prefix_state(spark, folder):
    return step_states(spark, folder).select("seq_id", "ply", joined("state").alias("state"))


@query("final_state", f"WITH {STEPS_SQL}, {PREFIX_SQL} SELECT seq_id, {STATE_SQL} AS state FROM final")
def final_state(spark, folder):
    return C.final_states(event_steps(spark, folder), SYMBOLS).select("seq_id", joined("state").alias("state"))


@query("outcome_by_pairing", f"""WITH {STEPS_SQL}
SELECT concat_ws(' vs ', first_action, second_action) AS pairing, {TALLY_SQL} FROM seqs GROUP BY 1""")
def outcome_by_pairing(spark, folder):
    return S.outcome_tally(event_corpus(spark, folder).sequences, ["pairing"])


@query("wins_by_winner", f"""WITH {STEPS_SQL}
SELECT concat_ws(' vs ', first_action, second_action) AS pairing, winner, count(*) AS wins
FROM seqs WHERE result = 'win' GROUP BY 1, 2""")
def wins_by_winner(spark, folder):
    return S.wins_by_winner(event_corpus(spark, folder).sequences, ["pairing"])


@query("outcome_by_length", f"WITH {STEPS_SQL} SELECT length, {TALLY_SQL} FROM seqs GROUP BY 1")
def outcome_by_length(spark, folder):
    return S.outcome_tally(event_sequences(event_rows(spark, folder), pairs=False), ["length"])


@query("outcome_by_ply", f"WITH {STEPS_SQL} SELECT ply, {TALLY_SQL} FROM steps JOIN seqs USING (seq_id) GROUP BY 1")
def outcome_by_ply(spark, folder):
    return S.outcome_by_ply(event_sequences(event_rows(spark, folder), pairs=False))


REFLECTION = [[0, 1, 2, 3, 4], [4, 3, 2, 1, 0]]


@query("outcome_by_first_action", f"""WITH {STEPS_SQL}, p AS (SELECT *, {POSITION_SQL.format("first_action")} AS pos FROM seqs)
SELECT CAST(least(pos, 4 - pos) AS INTEGER) AS orbit, {TALLY_SQL} FROM p GROUP BY 1""")
def outcome_by_first_action(spark, folder):
    sequences = event_sequences(event_rows(spark, folder), pairs=False)
    position = (F.array_position(F.array(*[F.lit(s) for s in SYMBOLS]), F.col("first_action")) - 1).cast("int")
    return S.outcome_tally(sequences.withColumn("orbit", orbit_of(position, REFLECTION)), ["orbit"])


@query("outcome_grouping_sets", f"""WITH {STEPS_SQL}, p AS (SELECT *, concat_ws(' vs ', first_action, second_action) AS pairing FROM seqs)
SELECT CASE WHEN grouping(pairing) = 0 THEN 'pairing' WHEN grouping(length) = 0 THEN 'length'
            WHEN grouping(first_action) = 0 THEN 'first_action' ELSE 'overall' END AS dimension,
       CASE WHEN grouping(pairing) = 0 THEN pairing WHEN grouping(length) = 0 THEN length::VARCHAR
            WHEN grouping(first_action) = 0 THEN first_action ELSE 'all' END AS key, {TALLY_SQL}
FROM p GROUP BY GROUPING SETS ((pairing), (length), (first_action), ())""")
def outcome_grouping_sets(spark, folder):
    return S.outcome_grouping_sets(event_corpus(spark, folder).sequences, ["pairing", "length", "first_action"])


ROTATIONS_SQL = "[" + ", ".join(
    "[" + ", ".join(f"c{(j - k) % 5}" for j in range(5)) + "]" for k in range(5)
) + "]"
STATES_SQL = f"""states AS (SELECT c0, c1, c2, c3, c4 FROM prefix UNION ALL SELECT c0, c1, c2, c3, c4 FROM final),
shaped AS (SELECT {STATE_SQL} AS state, array_to_string(list_sort({ROTATIONS_SQL})[1], ',') AS canonical FROM states)"""


def states_of(spark, folder):
    """Steps with the state before each of them, stored since several summaries read them; final states."""
    group = cyclic_group(len(SYMBOLS))
    canonical = canonical_form(F.col("state"), group)["image"]
    steps = materialize(step_states(spark, folder).withColumn("canonical_state", canonical))
    return steps, C.final_states(steps, SYMBOLS).withColumn("canonical_state", canonical)


@query("distinct_states", f"""WITH {STEPS_SQL}, {PREFIX_SQL}, {STATES_SQL}
SELECT count(DISTINCT state) AS distinct_states, count(DISTINCT canonical) AS distinct_canonical_states FROM shaped""")
def distinct_states(spark, folder):
    return S.distinct_states(*states_of(spark, folder))


@query("distinct_states_sketched", f"""WITH {STEPS_SQL}, {PREFIX_SQL},
seen AS (SELECT CAST(seq_id % 2 AS VARCHAR) AS run, {STATE_SQL} AS state FROM prefix)
SELECT coalesce(run, 'both') AS run, count(DISTINCT state) AS distinct_states, true AS within_bound FROM seen GROUP BY GROUPING SETS ((run), ())""")
def distinct_states_sketched(spark, folder):
    """Exact numbers of states of two runs and of both, and if the estimate from stored sketches per ply is within its bound."""
    run = (F.col("seq_id") % 2).cast("string")
    steps = materialize(step_states(spark, folder).select(run.alias("run"), "ply", joined("state").alias("state")))
    path = f"{checkpoint_folder(spark)}/sketches-{uuid.uuid4().hex}"
    for one in ("0", "1"):  # each run stores its own
        S.state_sketches(steps.filter(F.col("run") == one), ["run", "ply"]).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    both = F.lit("both").alias("run")
    guessed = S.sketched_states(stored, ["run"]).unionByName(S.sketched_states(stored).select(both, "estimated_states"))
    exact = steps.groupBy("run").agg(F.countDistinct("state").alias("distinct_states"))
    exact = exact.unionByName(steps.agg(F.countDistinct("state").alias("distinct_states")).select(both, "distinct_states"))
    apart = F.abs(F.col("estimated_states") - F.col("distinct_states"))
    return exact.join(guessed, "run").select("run", "distinct_states", (apart <= F.ceil(S.sketch_error() * F.col("distinct_states"))).alias("within_bound"))


METRICS_SQL = f"""WITH {STEPS_SQL}, {PREFIX_SQL}, {STATES_SQL}, d AS (
  SELECT count(DISTINCT state) AS distinct_states, count(DISTINCT canonical) AS distinct_canonical_states FROM shaped),
m AS (SELECT count(*) AS sequences, CAST(sum(length) AS BIGINT) AS steps, count(DISTINCT actions) AS distinct_sequences,
         count(*) FILTER (result = 'win') AS decisive FROM seqs),
metrics AS (SELECT *, (SELECT distinct_states FROM d) AS distinct_states,
       (SELECT distinct_canonical_states FROM d) AS distinct_canonical_states,
       distinct_sequences / sequences AS distinct_fraction, decisive / sequences AS decisive_fraction,
       (SELECT distinct_canonical_states FROM d) / 20000 AS canonical_coverage FROM m)"""


def metrics_of(spark, folder):
    steps, final = states_of(spark, folder)
    return S.diversity_metrics(event_sequences(steps, pairs=False), S.distinct_states(steps, final), known_canonical=20000)


@query("diversity_metrics", METRICS_SQL + """
SELECT sequences, steps, distinct_sequences, decisive, distinct_states, distinct_canonical_states,
       round(distinct_fraction, 9) AS distinct_fraction, round(decisive_fraction, 9) AS decisive_fraction,
       round(canonical_coverage, 9) AS canonical_coverage FROM metrics""")
def diversity_metrics(spark, folder):
    rounded = {c: r9(c) for c in ("distinct_fraction", "decisive_fraction", "canonical_coverage")}
    return metrics_of(spark, folder).withColumns(rounded)


@query("diversity_failures", METRICS_SQL + """, gates AS (
  SELECT 0 AS gate, 'canonical_coverage' AS metric, canonical_coverage AS value, 0.5::DOUBLE AS threshold FROM metrics
  UNION ALL SELECT 1, 'decisive_fraction', decisive_fraction, 0.2 FROM metrics
  UNION ALL SELECT 2, 'distinct_fraction', distinct_fraction, 0.5 FROM metrics)
SELECT gate, metric, round(value, 9) AS value, threshold, value >= threshold AS passed FROM gates""")
def diversity_failures(spark, folder):
    gates = S.diversity_gates(metrics_of(spark, folder))
    return gates.select("gate", "metric", r9("value").alias("value"), "threshold", "passed")


@query("checks_pass", METRICS_SQL + """
SELECT canonical_coverage >= 0.5 AND decisive_fraction >= 0.2 AND distinct_fraction >= 0.5 AS checks_pass FROM metrics""")
def checks_pass(spark, folder):
    return S.checks_pass(S.diversity_gates(metrics_of(spark, folder)))


@query("verify_steps", """WITH d AS (
  SELECT conv_id AS seq_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ply FROM conversations),
m AS (SELECT seq_id, ply, CASE WHEN ply <> turn THEN 'turn'
        WHEN role <> CASE ply % 2 WHEN 0 THEN 'user' ELSE 'assistant' END THEN 'actor' END AS what FROM d)
SELECT seq_id, min(ply) AS ply, min_by(what, ply) AS what, count(*) AS mismatches FROM m WHERE what IS NOT NULL GROUP BY 1""")
def verify_steps(spark, folder):
    turns = table(spark, folder, "conversations").withColumnRenamed("conv_id", "seq_id").select("seq_id", "turn", "role")
    numbered = ordinal(turns, ["seq_id"], ["turn"], "ply")
    stored = numbered.select("seq_id", "ply", "turn", F.col("role").alias("actor"))
    expected = F.when(F.col("ply") % 2 == 0, "user").otherwise("assistant")
    derived = numbered.select("seq_id", "ply", F.col("ply").alias("turn"), expected.alias("actor"))
    return C.verify_steps(stored, derived, ["turn", "actor"])


WINDOW4_SQL = "win4 AS (SELECT seq_id, ply // 4 AS win, " + ", ".join(
    f"max(CASE WHEN ply % 4 = {i} THEN {POSITION_SQL.format('action')} END) AS p{i}" for i in range(4)
) + " FROM steps GROUP BY 1, 2)"


def position_windows(spark, folder, size):
    steps = event_steps(spark, folder)
    at = (F.array_position(F.array(*[F.lit(s) for s in SYMBOLS]), F.col("action")) - 1).cast("int")
    return windows(steps.withColumn("action", at), size)


@query("canonical_rotation", f"""WITH {STEPS_SQL}, {WINDOW4_SQL}, w AS (
  SELECT *, coalesce(p0, -1) AS a, coalesce(p1, -1) AS b, coalesce(p2, -1) AS c, coalesce(p3, -1) AS d FROM win4),
r AS (SELECT *, [[a, b, c, d], [d, a, b, c], [c, d, a, b], [b, c, d, a]] AS images FROM w),
k AS (SELECT *, list_sort(images)[1] AS image FROM r)
SELECT seq_id, win AS window, array_to_string(image, ',') AS image,
       CAST(list_position(images, image) - 1 AS INTEGER) AS element FROM k""")
def canonical_rotation(spark, folder):
    w = position_windows(spark, folder, 4)
    cells = F.transform("actions", lambda a: F.coalesce(a, F.lit(-1)))
    form = canonical_form(cells, cyclic_group(4))
    return w.withColumn("f", form).select(
        "seq_id", "window", joined(F.col("f.image")).alias("image"), F.col("f.ord").alias("element")
    )


@query("rotation_tally", f"""WITH {STEPS_SQL}, {WINDOW4_SQL}, w AS (
  SELECT coalesce(p0, -1) AS a, coalesce(p1, -1) AS b, coalesce(p2, -1) AS c, coalesce(p3, -1) AS d FROM win4),
k AS (SELECT list_sort([[a, b, c, d], [d, a, b, c], [c, d, a, b], [b, c, d, a]])[1] AS image FROM w)
SELECT array_to_string(image, ',') AS image, count(*) AS n FROM k GROUP BY 1""")
def rotation_tally(spark, folder):
    w = position_windows(spark, folder, 4)
    cells = F.transform("actions", lambda a: F.coalesce(a, F.lit(-1)))
    return w.groupBy(joined(canonical_form(cells, cyclic_group(4))["image"]).alias("image")).agg(F.count(F.lit(1)).alias("n"))


@query("set_orbits", f"""WITH {STEPS_SQL}, {WINDOW4_SQL}, s AS (
  SELECT {{'seq': seq_id, 'win': win}} AS set_id, list_sort(list_distinct(list_filter([p0, p1, p2, p3], lambda x: x IS NOT NULL))) AS s FROM win4),
i AS (SELECT set_id, s, list_sort([{", ".join(f"list_sort(list_transform(s, lambda x: (x + {k}) % 5))" for k in range(5))}])[1] AS image FROM s)
SELECT array_to_string(image, ',') AS image, (min(set_id)).seq AS class_seq, (min(set_id)).win AS class_window, count(*) AS sets, count(DISTINCT s) AS distinct_sets FROM i GROUP BY 1""")
def set_orbits(spark, folder):
    w = position_windows(spark, folder, 4)
    members = F.array_sort(F.array_distinct(F.filter("actions", lambda a: a.isNotNull())))
    sets = w.select(F.struct("seq_id", "window").alias("set_id"), members.alias("s"))
    image = least_image(F.col("s"), cyclic_group(5))
    classes = sets.groupBy(joined(image).alias("image")).agg(
        F.min("set_id").alias("_class"), F.count(F.lit(1)).alias("sets"), F.countDistinct("s").alias("distinct_sets")
    )
    return classes.select("image", F.col("_class.seq_id").alias("class_seq"), F.col("_class.window").alias("class_window"), "sets", "distinct_sets")


@query("positions_back", f"""WITH {STEPS_SQL}, {WINDOW4_SQL}, w AS (
  SELECT *, coalesce(p0, -1) AS a, coalesce(p1, -1) AS b, coalesce(p2, -1) AS c, coalesce(p3, -1) AS d FROM win4),
r AS (SELECT *, [[a, b, c, d], [d, a, b, c], [c, d, a, b], [b, c, d, a]] AS images FROM w),
k AS (SELECT *, list_position(images, list_sort(images)[1]) - 1 AS e FROM r)
SELECT seq_id, win AS window, array_to_string(list_sort([(0 - e + 4) % 4, (1 - e + 4) % 4]), ',') AS raw FROM k""")
def positions_back(spark, folder):
    """Raw positions of the first two canonical cells, through the inverse of the canonical permutation."""
    w = position_windows(spark, folder, 4)
    cells = F.transform("actions", lambda a: F.coalesce(a, F.lit(-1)))
    permutation = canonical_form(cells, cyclic_group(4))["permutation"]
    raw = move_back(F.array(F.lit(0), F.lit(1)), permutation)
    return w.select("seq_id", "window", joined(raw).alias("raw"))


@query("first_appearance", """SELECT md5(text) AS state, min(doc_id) AS doc_id, count(*) AS occurrences
FROM documents GROUP BY 1""")
def first_appearance(spark, folder):
    states = table(spark, folder, "documents").select(F.md5("text").alias("state"), "doc_id")
    return A.distinct_states(states, order=("doc_id",))
