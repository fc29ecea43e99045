"""Labels and agreement, features, labelled datasets."""

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import sets
from ..operators import agreement as A
from ..operators import dataset as D
from ..operators.features import Feature, Vocabulary, boolify
from ..session import materialize
from . import boards as B
from .catalog import joined, query, r9, table
from .corpora import STEPS_SQL, event_steps, sliding

DOC_STEPS_SQL = """s AS (SELECT doc_id AS state, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS action, lang, source FROM documents),
j AS (SELECT s.*, toxic, doc_id IS NOT NULL AS known, CASE WHEN action = quality THEN 1 ELSE 0 END AS hit FROM s LEFT JOIN labels ON doc_id = state)"""
RATE_SQL = """count(*) FILTER (known) AS positions, CAST(sum(hit) AS BIGINT) AS agreeing, count(*) FILTER (NOT known) AS uncovered,
  round(CASE WHEN count(*) FILTER (known) = 0 THEN 0.0 ELSE sum(hit) / count(*) FILTER (known) END, 9)::DOUBLE AS rate"""


def document_steps(spark, folder):
    """A length rule as the actor: long documents are called good."""
    called = F.when(F.col("n_chars") >= 1000, 1).otherwise(0)
    return table(spark, folder, "documents").select(F.col("doc_id").alias("state"), called.alias("action"), "lang", "source")


def label_annotations(spark, folder):
    return table(spark, folder, "labels").select(F.col("doc_id").alias("state"), F.array("quality").alias("optimal"), "toxic")


def _agree(spark, folder, by=(), carry=()):
    found = A.agreement(document_steps(spark, folder), label_annotations(spark, folder), by, carry=carry)
    return found.withColumn("rate", r9("rate"))


@query("agreement_overall", f"WITH {DOC_STEPS_SQL} SELECT {RATE_SQL} FROM j")
def agreement_overall(spark, folder):
    return _agree(spark, folder)


@query("agreement_by_source", f"WITH {DOC_STEPS_SQL} SELECT source, {RATE_SQL} FROM j GROUP BY 1")
def agreement_by_source(spark, folder):
    return _agree(spark, folder, ["source"])


@query("agreement_by_lang", f"WITH {DOC_STEPS_SQL} SELECT lang, {RATE_SQL} FROM j GROUP BY 1")
def agreement_by_lang(spark, folder):
    return _agree(spark, folder, ["lang"])


@query("agreement_by_value", f"WITH {DOC_STEPS_SQL} SELECT toxic, {RATE_SQL} FROM j GROUP BY 1")
def agreement_by_value(spark, folder):
    return _agree(spark, folder, carry=["toxic"])


@query("uncovered_rows", """SELECT doc_id AS state, count(*) AS steps FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1""")
def uncovered_rows(spark, folder):
    return A.uncovered(document_steps(spark, folder), label_annotations(spark, folder))


WINDOW4_SQL = """w AS (SELECT seq_id, ply, action, lag(action, 3) OVER o AS a0, lag(action, 2) OVER o AS a1, lag(action) OVER o AS a2
  FROM steps WINDOW o AS (PARTITION BY seq_id ORDER BY ply)),
m AS (SELECT concat_ws('>', a0, a1, a2) AS state, action, seq_id % 3 AS chosen_by, ply FROM w WHERE ply >= 3),
c AS (SELECT state, action, count(*) AS n FROM m GROUP BY 1, 2),
best AS (SELECT state, list_sort(list(action)) AS optimal FROM (SELECT *, rank() OVER (PARTITION BY state ORDER BY n DESC) AS r FROM c) WHERE r = 1 GROUP BY 1)"""


def next_moves(spark, folder):
    """Every step with three before it: those are the state, the step is the action."""
    w = sliding(event_steps(spark, folder), 4)
    return w.select(
        F.array_join(F.slice("actions", 1, 3), ">").alias("state"), F.element_at("actions", 4).alias("action"),
        (F.col("seq_id") % 3).alias("chosen_by"), (F.col("start") + 3).alias("ply"),
    )


@query("argmax_actions", f"WITH {STEPS_SQL}, {WINDOW4_SQL} SELECT state, array_to_string(optimal, ',') AS optimal FROM best")
def argmax_actions(spark, folder):
    return A.usual_moves(next_moves(spark, folder)).withColumn("optimal", joined("optimal"))


@query("agreement_report", f"""WITH {STEPS_SQL}, {WINDOW4_SQL},
j AS (SELECT m.*, true AS known, CASE WHEN list_contains(optimal, action) THEN 1 ELSE 0 END AS hit FROM m JOIN best USING (state))
SELECT CASE WHEN grouping(chosen_by) = 0 THEN 'chosen_by' WHEN grouping(ply) = 0 THEN 'ply' ELSE 'overall' END AS dimension,
       CASE WHEN grouping(chosen_by) = 0 THEN chosen_by::VARCHAR WHEN grouping(ply) = 0 THEN ply::VARCHAR ELSE 'all' END AS key,
       {RATE_SQL} FROM j GROUP BY GROUPING SETS ((chosen_by), (ply), ())""")
def agreement_report(spark, folder):
    moves = materialize(next_moves(spark, folder))
    found = A.agreement_report(moves, A.usual_moves(moves), ("chosen_by", "ply"))
    return found.withColumn("rate", r9("rate"))


@query("attach_labels", """SELECT d.doc_id AS state, quality, l.doc_id IS NULL AS missing,
  CASE WHEN n_chars % 3 = 0 THEN NULL ELSE quality = n_chars % 2 END AS agrees
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def attach_labels(spark, folder):
    return _attached(spark, folder).select(
        "state", F.element_at("optimal", 1).alias("quality"), F.col("optimal").isNull().alias("missing"), "agrees"
    )


def _attached(spark, folder):
    docs = table(spark, folder, "documents")
    second = docs.filter(F.col("n_chars") % 3 != 0).select(
        F.col("doc_id").alias("state"), (F.col("n_chars") % 2).cast("int").alias("second_action")
    )
    return A.attach_labels(docs.select(F.col("doc_id").alias("state")), label_annotations(spark, folder), second)


@query("label_counts", """SELECT count(*) AS annotated, count(*) FILTER (toxic = 1) AS terminal,
  count(*) FILTER (n_chars % 3 <> 0 AND quality <> n_chars % 2) AS disagreements
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def label_counts(spark, folder):
    return A.label_counts(_attached(spark, folder).withColumn("terminal", F.col("toxic") == 1))


@query("label_histogram", """SELECT k.key, count(l.doc_id) AS n FROM (VALUES ('-1'), ('0'), ('1')) k(key)
LEFT JOIN labels l ON l.quality::VARCHAR = k.key GROUP BY 1""")
def label_histogram(spark, folder):
    return D.histogram(table(spark, folder, "labels"), "quality", [-1, 0, 1])


BITS = "list_filter(range(0, 6), lambda i: (p_size >> i) & 1 = 1)"


def part_vocabulary():
    size_bits = F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("p_size").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)
    size, price, bits, cheap = E.ref("size"), E.ref("price"), E.ref("bits"), E.ref("cheap")
    low = E.const({0, 1, 2})
    derived = {
        "cheap": E.compare("lt", price, E.const(1000)),
        "scaled": E.arith("mul", E.arith("add", size, E.const(3)), E.const(2)),
        "worth": E.arith("sub", price, E.arith("mul", size, E.const(0.5))),
        "n_bits": E.count(bits),
        "low_bits": E.set_op("intersection", bits, low),
        "all_bits": E.set_op("union", bits, E.const({5})),
        "high_bits": E.set_op("difference", bits, low),
        "has_two": E.contains(bits, E.const(2)),
        "never": E.contains(bits, E.const(-1)),
        "mixed": E.all_of(E.negate(cheap), E.any_of(E.ref("has_two"), E.compare("ge", size, E.const(25)))),
        "same_bits": E.compare("eq", E.ref("low_bits"), bits),
        "odd_flag": E.compare("ne", cheap, E.ref("has_two")),
        "empty_and": E.all_of(),
        "empty_or": E.any_of(),
    }
    vocabulary = Vocabulary([
        Feature("size", "primitive", "int", "size of the part", F.col("p_size").cast("bigint")),
        Feature("price", "primitive", "float", "retail price", F.col("p_retailprice")),
        Feature("bits", "primitive", "set", "bits set in the size", size_bits),
    ])
    return vocabulary.extend(Feature(n, "invented", expr=e) for n, e in derived.items())


@query("feature_expressions", f"""WITH b AS (SELECT *, {BITS} AS bits FROM part),
c AS (SELECT *, p_retailprice < 1000 AS cheap, list_contains(bits, 2) AS has_two, list_filter(bits, lambda x: x <= 2) AS low FROM b)
SELECT p_partkey, cheap, (p_size::BIGINT + 3) * 2 AS scaled, round(p_retailprice - p_size * 0.5, 9)::DOUBLE AS worth,
  len(bits)::BIGINT AS n_bits, array_to_string(low, ',') AS low_bits,
  array_to_string(list_sort(list_distinct(list_append(bits, 5))), ',') AS all_bits,
  array_to_string(list_filter(bits, lambda x: x > 2), ',') AS high_bits, has_two, false AS never,
  NOT cheap AND (has_two OR p_size >= 25) AS mixed, low = bits AS same_bits, cheap <> has_two AS odd_flag,
  true AS empty_and, false AS empty_or FROM c""")
def feature_expressions(spark, folder):
    featured = part_vocabulary().evaluate(table(spark, folder, "part"))
    return featured.select(
        "p_partkey", "cheap", "scaled", r9("worth").alias("worth"), "n_bits",
        *[joined(c).alias(c) for c in ("low_bits", "all_bits", "high_bits")],
        "has_two", "never", "mixed", "same_bits", "odd_flag", "empty_and", "empty_or",
    )


@query("feature_matrix", f"""WITH b AS (SELECT *, {BITS} AS bits FROM part),
c AS (SELECT *, CASE WHEN p_retailprice < 1000 THEN 1 ELSE 0 END AS cheap, CASE WHEN list_contains(bits, 2) THEN 1 ELSE 0 END AS two FROM b)
SELECT p_partkey, p_size::DOUBLE AS size, round(p_retailprice, 9) AS price, len(bits)::DOUBLE AS bits, cheap::DOUBLE AS cheap,
  ((p_size + 3) * 2)::DOUBLE AS scaled, len(list_filter(bits, lambda x: x <= 2))::DOUBLE AS low_bits,
  len(bits) > 0 AS bits_true, p_size > 0 AS size_true FROM c""")
def feature_matrix(spark, folder):
    vocabulary = part_vocabulary()
    names = vocabulary.names()
    values = vocabulary.evaluate(table(spark, folder, "part")).withColumn("values", vocabulary.values())
    at = lambda n: F.element_at("values", names.index(n) + 1)
    return values.select(
        "p_partkey", r9(at("price")).alias("price"),
        *[at(n).alias(n) for n in ("size", "bits", "cheap", "scaled", "low_bits")],
        boolify(F.col("bits"), "set").alias("bits_true"), boolify(F.col("size"), "int").alias("size_true"),
    )


@query("set_algebra", """WITH s AS (SELECT user_id,
  list_sort(coalesce(list(DISTINCT event_type) FILTER (value >= 20), [])) AS a,
  list_sort(coalesce(list(DISTINCT event_type) FILTER (value < 5), [])) AS b FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u,
  array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS i, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS d,
  len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset, list_contains(a, 'error') AS has_error,
  round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE 1 - len(list_filter(a, lambda x: list_contains(b, x))) / len(list_distinct(list_concat(a, b))) END, 9) AS distance
FROM s""")
def set_algebra(spark, folder):
    value, kind = F.col("value"), F.col("event_type")
    s = table(spark, folder, "events").groupBy("user_id").agg(
        F.array_sort(F.collect_set(F.when(value >= 20, kind))).alias("a"),
        F.array_sort(F.collect_set(F.when(value < 5, kind))).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return s.select(
        "user_id", joined(sets.union(a, b)).alias("u"), joined(sets.intersection(a, b)).alias("i"),
        joined(sets.difference(a, b)).alias("d"), sets.is_subset(a, b).alias("subset"),
        F.array_contains(a, "error").alias("has_error"), r9(sets.jaccard_distance(a, b)).alias("distance"),
    )


KINDS = {"browse": (["click", "view"], "primitive"), "trouble": (["error"], "supplied"), "money": (["purchase", "signup"], "invented"), "all": (["click", "error", "purchase", "signup", "view"], "primitive")}
KINDS_SQL = ", ".join(
    f"{{'rank': {-['primitive', 'supplied', 'invented'].index(t)}, 'idx': {i}, 'name': '{n}', 'inside': list_filter(legal, lambda x: list_contains({m}, x))}}"
    for i, (n, (m, t)) in enumerate(KINDS.items())
)


@query("qualify_label", f"""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE value >= 5 GROUP BY 1, 2),
s AS (SELECT user_id, list_sort(list(event_type)) AS legal, list(event_type) FILTER (2 * n >= top) AS optimal FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS top FROM c) GROUP BY 1),
k AS (SELECT user_id, [{KINDS_SQL}] AS kinds, optimal FROM s),
q AS (SELECT user_id, list_filter(kinds, lambda k: len(k.inside) > 0 AND len(list_filter(k.inside, lambda x: NOT list_contains(optimal, x))) = 0) AS ok FROM k)
SELECT user_id, array_to_string(list_transform(ok, lambda k: k.name), ',') AS qualifying,
  coalesce(list_sort(list_transform(ok, lambda k: {{'rank': k.rank, 'n': len(k.inside), 'i': k.idx, 'name': k.name}}))[1].name, 'none') AS label FROM q""")
def qualify_label(spark, folder):
    """Classes of event types per user, in three tiers: the types seen are legal, those at least half as frequent as the top one optimal."""
    counted = table(spark, folder, "events").filter(F.col("value") >= 5).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    seen = counted.groupBy("user_id").agg(F.max("n").alias("top"), F.collect_list(F.struct("event_type", "n")).alias("a"))
    names = lambda a: F.array_sort(F.transform(a, lambda x: x["event_type"]))
    sets_of = {n: F.array(*map(F.lit, m)) for n, (m, _) in KINDS.items()}
    rows = seen.select(
        "user_id", names(F.col("a")).alias("legal"), names(F.filter("a", lambda x: 2 * x["n"] >= F.col("top"))).alias("optimal")
    ).withColumns(sets_of)
    qualifying, label = D.qualify(list(KINDS), [t for _, t in KINDS.values()])
    return rows.select("user_id", joined(qualifying).alias("qualifying"), label.alias("label"))


FEATURES = B.feature_sql(extended=True)
_VALUE = {"set": "len({0})", "int": "{0}"}


@query("occupancy_features", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, raw AS (
  SELECT seq_id, run, mover, list_transform(cells, lambda c: coalesce(c, '.')) AS cells FROM boards)
SELECT seq_id, run, array_to_string([{", ".join(_VALUE[k].format(s) for _, k, s in FEATURES)}], ',') AS values,
  array_to_string({dict((n, s) for n, _, s in FEATURES)["cells.mine1.theirs1.ge1"]}, ',') AS one_each FROM raw""")
def occupancy_features(spark, folder):
    vocabulary = B.board_vocabulary(extended=True)
    values = F.transform(vocabulary.values(), lambda v: v.cast("bigint"))
    featured = vocabulary.evaluate(B.event_boards(spark, folder))
    return featured.select("seq_id", "run", joined(values).alias("values"), joined(F.col("`cells.mine1.theirs1.ge1`")).alias("one_each"))


@query("canonical_board", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {B.CANONICAL_SQL}
SELECT seq_id, run, canonical_state, array_to_string(legal, ',') AS legal, array_to_string(optimal, ',') AS optimal FROM canonical""")
def canonical_board(spark, folder):
    states = B.canonical_states(B.event_boards(spark, folder))
    return states.select("seq_id", "run", "canonical_state", joined("legal").alias("legal"), joined("optimal").alias("optimal"))


BASE = B.feature_sql()
CLASSES_SQL = ", ".join(
    f"{{'name': '{n}', 'idx': {i}, 'inside': list_filter(legal, lambda p: list_contains({s}, p))}}"
    for i, (n, s) in enumerate((n, s) for n, k, s in BASE if k == "set")
)
LABEL_SQL = f"""classes AS (SELECT *, [{CLASSES_SQL}] AS classes FROM once),
found AS (SELECT *, list_filter(classes, lambda c: len(c.inside) > 0 AND len(list_filter(c.inside, lambda p: NOT list_contains(optimal, p))) = 0) AS ok FROM classes),
labelled AS (SELECT canonical_state, seq_id, run, mover, value, occurrences, cells, legal, optimal, list_transform(ok, lambda c: c.name) AS qualifying,
  coalesce(list_sort(list_transform(ok, lambda c: {{'n': len(c.inside), 'i': c.idx, 'name': c.name}}))[1].name, 'none') AS label FROM found)"""


@query("label_dataset", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {B.CANONICAL_SQL}, {LABEL_SQL}
SELECT canonical_state, seq_id, run, value, occurrences, array_to_string(qualifying, ',') AS qualifying, label,
  array_to_string([{", ".join(_VALUE[k].format(s) for _, k, s in BASE)}], ',') AS values FROM labelled""")
def label_dataset(spark, folder):
    _, rows, _ = B.board_dataset(spark, folder)
    return rows.select(
        "canonical_state", "seq_id", "run", "value", "occurrences", joined("qualifying").alias("qualifying"), "label",
        joined(F.transform("values", lambda v: v.cast("bigint"))).alias("values"),
    )


@query("dataset_manifest", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {B.CANONICAL_SQL}, {LABEL_SQL}
SELECT (SELECT count(*) FROM canonical) AS annotated, CAST(sum(occurrences) AS BIGINT) AS nonterminal, count(*) AS rows,
  CAST(sum(occurrences) - count(*) AS BIGINT) AS collapsed, count(*) FILTER (label = 'none') AS unlabeled FROM labelled""")
def dataset_manifest(spark, folder):
    states, rows, _ = B.board_dataset(spark, folder)
    return D.manifest(states, rows)


@query("dataset_labels", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {B.CANONICAL_SQL}, {LABEL_SQL}
SELECT label AS key, count(*) AS n FROM labelled GROUP BY 1""")
def dataset_labels(spark, folder):
    _, rows, _ = B.board_dataset(spark, folder)
    return D.histogram(rows, "label")


@query("canonical_mismatch", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {B.CANONICAL_SQL}, t AS (
  SELECT b.seq_id, b.run, concat(array_to_string(list_transform(b.cells, lambda x: coalesce(x, '.')), ''), ':', b.mover) AS stored, canonical_state
  FROM boards b JOIN canonical c USING (seq_id, run))
SELECT seq_id, run, stored, canonical_state FROM t WHERE stored <> canonical_state""")
def canonical_mismatch(spark, folder):
    """Boards whose raw form is not already canonical: the check a dataset build makes on stored forms."""
    raw = B.event_boards(spark, folder).select(
        "seq_id", "run", F.concat(B.board_text(F.col("cells")), F.lit(":"), F.col("mover")).alias("stored"),
        F.concat(B.board_text(B.canonical_board(F.col("cells"))["image"]), F.lit(":"), F.col("mover")).alias("canonical_state"),
    )
    return D.canonical_mismatches(raw, F.col("canonical_state"), "stored")
