"""Trees, decision lists, gains and concepts."""

import uuid
from types import SimpleNamespace

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.scalars import ratio
from ..operators import archive as N
from ..operators import graph as G
from ..operators import induce as I
from ..operators import rules as R
from ..operators import tree as T
from ..operators import usage as U
from ..operators.features import Feature, merged
from ..session import checkpoint_folder, materialize
from ..sources.runs import load_tables
from . import boards as B
from .catalog import joined, query, r9, table
from .corpora import STEPS_SQL, event_steps, sliding
from .discover import discover, list_agreement, play_lists
from .label_queries import LABEL_SQL

ITEM_COLUMNS = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
FLAGS = ["A", "N", "R"]


def item_rows(spark, folder):
    label = F.array_position(F.array(*[F.lit(f) for f in FLAGS]), F.col("l_returnflag")) - 1
    values = F.array(*[F.col(c).cast("double") for c in ITEM_COLUMNS])
    return table(spark, folder, "lineitem").select(values.alias("values"), label.cast("int").alias("label"))


def tree_frame(spark, tree, columns):
    rows = T.node_rows(tree, columns)
    return spark.createDataFrame(rows, "path string, column string, threshold double, rows bigint, class int")


def tree_sql(depth, min_leaf):
    """Level-by-level split search in SQL with exact HUGEINT long division."""
    k = range(len(FLAGS))
    cols = ", ".join(f"{c}::DOUBLE" for c in ITEM_COLUMNS)
    parts = [f"""d0 AS (SELECT list_position({FLAGS}, l_returnflag) - 1 AS label, [{cols}] AS v, '' AS path FROM lineitem)"""]
    for level in range(depth):
        parts.append(f"""e{level} AS (SELECT path, unnest(range(0, {len(ITEM_COLUMNS)})) AS col, unnest(v) AS val, label FROM d{level}),
g{level} AS (SELECT path, col, val, {", ".join(f"count(*) FILTER (label = {i}) AS c{i}" for i in k)} FROM e{level} GROUP BY ALL),
w{level} AS (SELECT path, col, val, {", ".join(f"(sum(c{i}) OVER w)::HUGEINT AS l{i}, (sum(c{i}) OVER p)::HUGEINT AS t{i}" for i in k)}
  FROM g{level} WINDOW w AS (PARTITION BY path, col ORDER BY val), p AS (PARTITION BY path, col)),
s{level} AS (SELECT path, col, val, {" + ".join(f"l{i}" for i in k)} AS nl, {" + ".join(f"(t{i} - l{i})" for i in k)} AS nr,
  {" + ".join(f"l{i} * l{i}" for i in k)} AS al, {" + ".join(f"(t{i} - l{i}) * (t{i} - l{i})" for i in k)} AS ar,
  {" + ".join(f"t{i}" for i in k)} AS n, {" + ".join(f"t{i} * t{i}" for i in k)} AS a FROM w{level}),
f{level} AS (SELECT path, col, val, al * nr + ar * nl AS num, nl * nr AS den FROM s{level}
  WHERE nr > 0 AND nl >= {min_leaf} AND nr >= {min_leaf} AND (al * nr + ar * nl) * n > a * nl * nr),
q{level} AS (SELECT *, num // den AS q0, (num % den) * 1000000000 // den AS q1, ((num % den) * 1000000000 % den) * 1000000000 // den AS q2,
  (((num % den) * 1000000000 % den) * 1000000000 % den) * 1000000000 // den AS q3 FROM f{level}),
b{level} AS (SELECT path, col, val FROM q{level}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY q0 DESC, q1 DESC, q2 DESC, q3 DESC, col, val) = 1),
d{level + 1} AS (SELECT label, v, path || CASE WHEN v[col + 1] <= val THEN '0' ELSE '1' END AS path FROM d{level} JOIN b{level} USING (path))""")
    nodes = []
    for level in range(depth + 1):
        counts = ", ".join(f"count(*) FILTER (label = {i})" for i in k)
        split = f"LEFT JOIN b{level} USING (path)" if level < depth else ""
        pick = f"{ITEM_COLUMNS}[col + 1] AS \"column\", val AS threshold" if level < depth else "NULL::VARCHAR AS \"column\", NULL::DOUBLE AS threshold"
        nodes.append(f"""SELECT path, {pick}, rows, CAST(list_position(c, list_max(c)) - 1 AS INTEGER) AS class
FROM (SELECT path, count(*) AS rows, [{counts}] AS c FROM d{level} GROUP BY 1) {split}""")
    return "WITH " + ",\n".join(parts) + "\n" + "\nUNION ALL\n".join(nodes)


@query("cart_root_split", tree_sql(1, 1))
def cart_root_split(spark, folder):
    return tree_frame(spark, T.fit(item_rows(spark, folder), len(FLAGS), 1, 1), ITEM_COLUMNS)


@query("cart_depth2", tree_sql(2, 25))
def cart_depth2(spark, folder):
    return tree_frame(spark, T.fit(item_rows(spark, folder), len(FLAGS), 2, 25), ITEM_COLUMNS)


# A hand-made tree over the same columns: quantity at 24, then discount at 0.05 or tax at 0.04.
GIVEN = T.Tree([
    T.Node([], 0, "", 1, 24.0, 1, 2), T.Node([], 1, "0", 2, 0.05, 3, 4), T.Node([], 1, "1", 3, 0.04, 5, 6),
    T.Node([], 2, "00"), T.Node([], 2, "01"), T.Node([], 2, "10"), T.Node([], 2, "11"),
])
LEAF_SQL = """r AS (SELECT *, CASE WHEN l_quantity <= 24 THEN CASE WHEN l_discount <= 0.05 THEN 3 ELSE 4 END
    ELSE CASE WHEN l_tax <= 0.04 THEN 5 ELSE 6 END END AS leaf,
  CASE WHEN l_quantity > 24 AND l_tax > 0.04 OR l_linestatus = 'O' AND l_linenumber = 1 THEN 'none' ELSE l_returnflag END AS label,
  CASE WHEN l_quantity > 24 AND l_tax > 0.04 THEN [] WHEN l_linestatus = 'O' THEN list_distinct([l_returnflag, 'N']) ELSE [l_returnflag] END AS qualifying,
  l_linenumber AS occurrences, l_linenumber % 3 - 1 AS value, l_tax >= 0.07 AS held FROM lineitem)"""


def routed_items(spark, folder):
    items = table(spark, folder, "lineitem")
    open_line = F.col("l_linestatus") == "O"
    nothing = (F.col("l_quantity") > 24) & (F.col("l_tax") > 0.04)  # a leaf without a qualifying class
    return items.select(
        GIVEN.route(F.array(*[F.col(c).cast("double") for c in ITEM_COLUMNS])).alias("leaf"),
        F.when(nothing | open_line & (F.col("l_linenumber") == 1), "none").otherwise(F.col("l_returnflag")).alias("label"),
        F.when(nothing, F.array().cast("array<string>")).when(open_line, F.array_distinct(F.array("l_returnflag", F.lit("N")))).otherwise(F.array("l_returnflag")).alias("qualifying"),
        F.col("l_linenumber").cast("bigint").alias("occurrences"),
        (F.col("l_linenumber") % 3 - 1).alias("value"), (F.col("l_tax") >= 0.07).alias("held"),
    )


LEAF_CLASS_SQL = """x AS (SELECT leaf, q, count(*) AS n FROM (SELECT leaf, unnest(qualifying) AS q FROM r WHERE NOT held) GROUP BY 1, 2),
cls AS (SELECT leaf, q AS class, n AS sound FROM x QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY n DESC, list_position(['A','N','R'], q)) = 1),
ev AS (SELECT r.leaf, coalesce(class, 'none') AS class, count(*) FILTER (NOT held) AS support, coalesce(any_value(sound), 0) AS sound,
  count(*) FILTER (NOT held AND label = coalesce(class, 'none')) AS label_matches, CAST(sum(occurrences) FILTER (NOT held) AS BIGINT) AS occurrences,
  count(*) FILTER (NOT held AND value = 1) AS win, count(*) FILTER (NOT held AND value = 0) AS draw, count(*) FILTER (NOT held AND value = -1) AS loss,
  count(*) FILTER (held) AS holdout_rows, count(*) FILTER (held AND label = coalesce(class, 'none')) AS holdout_correct,
  count(*) FILTER (held AND list_contains(qualifying, class)) AS holdout_sound
  FROM r LEFT JOIN cls USING (leaf) GROUP BY 1, 2)"""


@query("leaf_evidence", f"""WITH {LEAF_SQL}, {LEAF_CLASS_SQL}
SELECT *, round(sound / support, 9) AS soundness FROM ev""")
def leaf_evidence(spark, folder):
    found = R.leaf_evidence(routed_items(spark, folder), FLAGS, F.col("held"))
    return found.withColumn("soundness", r9("soundness"))


@query("list_scores", f"""WITH {LEAF_SQL}, {LEAF_CLASS_SQL}
SELECT count(*) FILTER (class <> 'none') AS rules, count(*) AS leaves, CAST(sum(support) AS BIGINT) AS train_rows, CAST(sum(holdout_rows) AS BIGINT) AS holdout_rows,
  round(sum(label_matches) / sum(support), 9) AS train_accuracy, round(sum(sound) / sum(support), 9) AS train_soundness,
  round(sum(holdout_correct) / sum(holdout_rows), 9) AS holdout_accuracy, round(sum(holdout_sound) / sum(holdout_rows), 9) AS holdout_soundness,
  CAST(coalesce(sum(support) FILTER (class = 'none'), 0) AS BIGINT) AS fallback_rows FROM ev""")
def list_scores(spark, folder):
    found = R.scores(R.leaf_evidence(routed_items(spark, folder), FLAGS, F.col("held")))
    rounded = ("train_accuracy", "train_soundness", "holdout_accuracy", "holdout_soundness")
    return found.withColumns({c: r9(c) for c in rounded})


@query("holdout_split", """SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '7', doc_id)), doc_id) > n - floor(n * 0.25) AS held
FROM documents, (SELECT count(*) AS n FROM documents)""")
def holdout_split(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    return docs.withColumn("held", R.holdout_condition(docs, F.col("doc_id"), 7, 0.25))


def board_list():
    """Win, block, centre, then corners; a hand-written list over the extended board features."""
    vocabulary = B.board_vocabulary(extended=True)
    has = lambda name: E.compare("gt", E.count(E.ref(name)), E.const(0))
    target = lambda name: R.Selector("target-in", E.ref(name))
    found = R.DecisionList("win-block", [
        R.Rule("corner", 1, E.compare("ge", E.ref("orbit0.empty"), E.const(2)), target("orbit0.free")),
        R.Rule("win", 3, has("cells.mine2.theirs0.ge1"), target("cells.mine2.theirs0.ge1")),
        R.Rule("block", 2, E.compare("gt", E.ref("lines.mine0.theirs2"), E.const(0)), target("cells.mine0.theirs2.ge1")),
        R.Rule("centre", 1, E.contains(E.ref("orbit2.free"), E.const(4)), target("orbit2.free")),
    ], target("orbit1.free"))
    found.definitions.extend(vocabulary.closure(found.references()))
    return found.validate()


_F = {n: s for n, _, s in B.feature_sql(extended=True)}
RULES_SQL = f"""raw AS (SELECT seq_id, run, mover, legal, optimal, value, list_transform(cells, lambda c: coalesce(c, '.')) AS cells FROM boards WHERE len(legal) > 0),
fired AS (SELECT *, CASE WHEN len({_F["cells.mine2.theirs0.ge1"]}) > 0 THEN 'win'
  WHEN {_F["lines.mine0.theirs2"]} > 0 AND len({_F["cells.mine0.theirs2.ge1"]}) > 0 THEN 'block'
  WHEN {_F["orbit0.empty"]} >= 2 THEN 'corner' WHEN cells[5] = '.' THEN 'centre'
  WHEN len({_F["orbit1.free"]}) > 0 THEN 'fallback' ELSE 'any-legal' END AS fired FROM raw),
cand AS (SELECT *, CASE fired WHEN 'win' THEN {_F["cells.mine2.theirs0.ge1"]} WHEN 'block' THEN {_F["cells.mine0.theirs2.ge1"]}
  WHEN 'corner' THEN {_F["orbit0.free"]} WHEN 'centre' THEN [4] WHEN 'fallback' THEN {_F["orbit1.free"]} ELSE legal END AS candidates FROM fired),
pick AS (SELECT *, candidates[(('0x' || substr(md5(concat_ws(':', '11', seq_id, run)), 1, 8))::BIGINT % len(candidates)) + 1] AS action FROM cand)"""


def open_boards(spark, folder):
    return B.event_boards(spark, folder).filter(F.size("legal") > 0)


@query("rule_list_apply", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {RULES_SQL}
SELECT seq_id, run, fired, array_to_string(candidates, ',') AS candidates FROM cand""")
def rule_list_apply(spark, folder):
    applied = R.apply_rules(open_boards(spark, folder), board_list())
    return applied.select("seq_id", "run", "fired", joined("candidates").alias("candidates"))


def played(spark, folder):
    applied = R.apply_rules(open_boards(spark, folder), board_list())
    chosen = R.choose(applied, 11, F.concat_ws(":", "seq_id", "run"))
    return chosen.select("seq_id", "run", "value", "optimal", "action")


@query("rule_list_agreement", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {RULES_SQL}
SELECT value, count(*) AS positions, count(*) FILTER (list_contains(optimal, action)) AS agreeing,
  round(count(*) FILTER (list_contains(optimal, action)) / count(*), 9) AS rate FROM pick GROUP BY 1""")
def rule_list_agreement(spark, folder):
    hit = F.count_if(F.array_contains("optimal", F.col("action"))).alias("agreeing")
    found = played(spark, folder).groupBy("value").agg(F.count(F.lit(1)).alias("positions"), hit)
    return found.withColumn("rate", F.round(ratio("agreeing", "positions"), 9))


@query("rule_list_signature", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {RULES_SQL},
o AS (SELECT action, row_number() OVER (ORDER BY seq_id, run) - 1 AS ordinal, count(*) OVER () AS n FROM pick),
s AS (SELECT *, greatest(1, n // 256) AS stride FROM o)
SELECT md5(concat_ws(':', n, stride)) AS sample_id, string_agg(action::VARCHAR, ',' ORDER BY ordinal) AS signature
FROM s WHERE ordinal % stride = 0 AND ordinal < 256 * stride GROUP BY n, stride""")
def rule_list_signature(spark, folder):
    signed = N.signatures(played(spark, folder), [], ["seq_id", "run"])
    return signed.select("sample_id", joined("signature").alias("signature"))


@query("evaluate_candidates", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {RULES_SQL},
stacked AS (SELECT 'win-block' AS candidate, value, optimal, action FROM pick UNION ALL
  SELECT 'any-legal', value, optimal, legal[(('0x' || substr(md5(concat_ws(':', '11', seq_id, run)), 1, 8))::BIGINT % len(legal)) + 1] FROM raw)
SELECT candidate, value, count(*) AS positions, count(*) FILTER (list_contains(optimal, action)) AS agreeing,
  round(count(*) FILTER (list_contains(optimal, action)) / count(*), 9) AS agreement_rate FROM stacked GROUP BY 1, 2""")
def evaluate_candidates(spark, folder):
    lists = [board_list(), R.DecisionList("any-legal")]
    states = open_boards(spark, folder)
    stacked = play_lists(states, lists, 11, F.concat_ws(":", "seq_id", "run"), ["value", "optimal"])
    return list_agreement(stacked, ["value"]).withColumn("agreement_rate", r9("agreement_rate"))


@query("discover_manifest", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {RULES_SQL},
stacked AS (SELECT 0 AS ord, 'win-block' AS candidate, optimal, action FROM pick UNION ALL
  SELECT 1, 'any-legal', optimal, legal[(('0x' || substr(md5(concat_ws(':', '11', seq_id, run)), 1, 8))::BIGINT % len(legal)) + 1] FROM raw)
SELECT ord::BIGINT AS ord, candidate, ord::BIGINT AS sequence, CASE ord WHEN 0 THEN 4 ELSE 0 END::BIGINT AS rules,
  count(*) AS positions, count(*) FILTER (list_contains(optimal, action)) AS agreeing,
  round(count(*) FILTER (list_contains(optimal, action)) / count(*), 9) AS agreement_rate FROM stacked GROUP BY stacked.ord, candidate""")
def discover_manifest(spark, folder):
    """Discover over the open boards, committed as a run; the manifest is loaded and verified."""
    base = f"{checkpoint_folder(spark)}/discover-{uuid.uuid4().hex}"
    lists = [SimpleNamespace(decisions=d) for d in (board_list(), R.DecisionList("any-legal"))]
    states = open_boards(spark, folder).withColumn("place", F.concat_ws(":", "seq_id", "run"))
    discover(states, lists, {"game": "boards", "source": "discover", "evaluation_id": "open"}, f"{base}/archive", 11, "place", f"{base}/out", "first")
    found = load_tables(spark, f"{base}/out", "first", "boards", verify=True)["candidates"]
    return found.select("ord", "candidate", "sequence", "rules", "positions", "agreeing", r9("agreement_rate").alias("agreement_rate"))


_MARKED = [f"coalesce({test} AND cells[p + {at}] = mover, false)" for test, at in (("p > 2", -2), ("p % 3 > 0", 0), ("p % 3 < 2", 2), ("p < 6", 4))]
_NEAR_SQL = f"list_filter(legal, lambda p: {' OR '.join(_MARKED)})"
NEAR_SQL = f"near AS (SELECT *, list_transform({_NEAR_SQL}, lambda p: p::BIGINT) AS near FROM boards)"


def near_boards(spark, folder):
    """The boards with the free cells next to a mark of the mover."""
    boards = B.event_boards(spark, folder)
    places = F.filter(F.sequence(F.lit(0), F.lit(8)), lambda p: F.coalesce(F.element_at("cells", p + 1) == F.col("mover"), F.lit(False)))
    return G.neighbourhood(boards.withColumn("mine", places), ["seq_id", "run"], "mine", "legal", G.grid_edges(spark, 3, 3), "near")


@query("free_neighbours", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {NEAR_SQL}
SELECT seq_id, run, array_to_string(near, ',') AS near, len(near)::BIGINT AS n FROM near""")
def free_neighbours(spark, folder):
    return near_boards(spark, folder).select("seq_id", "run", joined("near").alias("near"), F.size("near").cast("bigint").alias("n"))


@query("merged_features", f"""WITH {STEPS_SQL}, {B.BOARDS_SQL}, {NEAR_SQL}
SELECT seq_id, run, CASE WHEN len(near) > 0 THEN len(near) ELSE len(legal) END::BIGINT AS open, value::BIGINT AS lead,
       CASE WHEN len(near) > 0 THEN array_to_string(near, ',') END AS near FROM near""")
def merged_features(spark, folder):
    """Features of all boards, overridden by those of the boards with a free cell next to the mover's marks."""
    boards, key = near_boards(spark, folder), ["seq_id", "run"]
    left = boards.select(*key, F.size("legal").cast("bigint").alias("open"), F.col("value").cast("bigint").alias("lead"))
    right = boards.filter(F.size("near") > 0).select(*key, F.size("near").cast("bigint").alias("open"), "near")
    out = merged(left, right, key, {"open": "int", "lead": "int"}, {"open": "int", "near": "set"})
    return out.withColumn("near", joined("near"))


PAIR_SQL = """w AS (SELECT seq_id, ply, action, lag(action, 2) OVER o AS a0, lag(action) OVER o AS a1 FROM steps WINDOW o AS (PARTITION BY seq_id ORDER BY ply)),
e AS (SELECT DISTINCT concat_ws('>', a0, a1) AS state, action, concat_ws('>', a1, action) AS next FROM w WHERE ply >= 2),
f AS (SELECT concat_ws('>', a1, action) AS state, count(*) AS n, count(DISTINCT seq_id) AS users FROM w WHERE ply >= 1 GROUP BY 1),
v AS (SELECT e.state, action, (f.n - 2 * users)::DOUBLE AS score FROM e JOIN f ON f.state = e.next WHERE action <> 'error')"""


@query("maximize_successor", f"""WITH {STEPS_SQL}, {PAIR_SQL}
SELECT state, string_agg(action, ',' ORDER BY action) AS candidates FROM (SELECT *, max(score) OVER (PARTITION BY state) AS top FROM v)
WHERE score = top GROUP BY 1""")
def maximize_successor(spark, folder):
    """The next event that leads to the most visited pair, of every pair of events; errors are never legal."""
    steps = event_steps(spark, folder)
    at = lambda i: F.element_at("actions", i)
    pair = lambda i, j: F.concat_ws(">", at(i), at(j))
    edges = sliding(steps, 3).select(pair(1, 2).alias("state"), at(3).alias("action"), pair(2, 3).alias("next")).distinct()
    features = sliding(steps, 2).groupBy(pair(1, 2).alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seq_id").alias("users")
    )
    vocabulary = R.Vocabulary([Feature("n", "primitive", "int"), Feature("users", "primitive", "int")])
    score = E.arith("sub", E.ref("n"), E.arith("mul", E.const(2), E.ref("users")))
    scored = R.scored_successors(edges, features, vocabulary, score)
    picks = R.DecisionList("popular", [R.Rule("go", 1, E.const(True), R.Selector("maximize", score))], definitions=vocabulary)
    named = F.transform("scored", lambda s: s["action"])
    legal = scored.withColumn("legal", F.filter(named, lambda a: a != "error")).filter(F.size("legal") > 0)
    ready = legal.withColumns({"n": F.lit(0), "users": F.lit(0)})
    return R.apply_rules(ready, picks, scored={"go": F.col("scored")}).select(
        "state", F.array_join(F.array_sort("candidates"), ",").alias("candidates")
    )


# ---- gains and concepts on labelled documents ------------------------------------------------------

DOC_FEATURES = [
    Feature("long", "primitive", "bool"), Feature("english", "primitive", "bool"),
    Feature("size", "primitive", "int"), Feature("lines", "primitive", "int"), Feature("density", "primitive", "float"),
]
DOC_SQL = """docs AS (SELECT doc_id, n_chars >= 1000 AS long, lang = 'en' AS english, n_chars // 500 AS size,
  length(text) - length(replace(text, chr(10), '')) AS lines, quality, toxic
  FROM documents JOIN labels USING (doc_id))"""


def labelled_documents(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return docs.select(
        "doc_id", (F.col("n_chars") >= 1000).alias("long"), (F.col("lang") == "en").alias("english"),
        F.floor(F.col("n_chars") / 500).cast("bigint").alias("size"), newlines.cast("bigint").alias("lines"),
        (F.col("n_chars") / F.greatest(newlines, F.lit(1))).alias("density"), "quality", "toxic",
    )


BITS_SQL = """bits AS (SELECT doc_id, quality, unnest(['long', 'english', 'large', 'many_lines', 'single']) AS candidate,
  unnest([long, english, size >= 3, lines >= 4, lines = 0]) AS bit FROM docs)"""


def document_bits(spark, folder):
    tests = {
        "long": F.col("long"), "english": F.col("english"), "large": F.col("size") >= 3,
        "many_lines": F.col("lines") >= 4, "single": F.col("lines") == 0,
    }
    entries = [F.struct(F.lit(n).alias("candidate"), c.alias("bit")) for n, c in tests.items()]
    docs = labelled_documents(spark, folder)
    return docs.select("doc_id", "quality", F.explode(F.array(*entries)).alias("e")).select("doc_id", "quality", "e.*")


GAIN_SQL = f"""WITH {DOC_SQL}, {BITS_SQL},
c AS (SELECT candidate, bit, quality, count(*) AS n FROM bits GROUP BY ALL),
h AS (SELECT candidate, bit, sum(n) AS m, -sum(n / s * log2(n / s)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY candidate, bit) AS s FROM c) GROUP BY 1, 2),
b AS (SELECT candidate, sum(n) AS t, -sum(n / s * log2(n / s)) AS h FROM (SELECT candidate, quality, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY candidate) AS s FROM c GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT candidate, round(any_value(b.h) - sum(h.h * m / t), 9) AS gain FROM h JOIN b USING (candidate) GROUP BY 1)"""


@query("info_gain", GAIN_SQL + " SELECT * FROM g")
def info_gain(spark, folder):
    return I.info_gain(document_bits(spark, folder), "candidate", "bit", "quality").withColumn("gain", r9("gain"))


@query("gain_topk", GAIN_SQL + " SELECT * FROM g ORDER BY gain DESC, candidate LIMIT 3")
def gain_topk(spark, folder):
    return info_gain(spark, folder).orderBy(F.desc("gain"), "candidate").limit(3)


@query("extensional_dedupe", f"""WITH {DOC_SQL}, b AS (
  SELECT doc_id, unnest(range(0, 6)) AS candidate, unnest([long, n2, size >= 2, NOT long, lines >= 0, english]) AS bit
  FROM (SELECT *, size > 1 AS n2 FROM docs)),
s AS (SELECT candidate, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY doc_id) AS sig, count(*) FILTER (bit) AS n_true, count(*) AS n FROM b GROUP BY 1)
SELECT candidate, min(candidate) OVER (PARTITION BY sig) AS first_equal, n_true, n_true = 0 OR n_true = n AS is_constant FROM s""")
def extensional_dedupe(spark, folder):
    tests = [F.col("long"), F.col("size") > 1, F.col("size") >= 2, ~F.col("long"), F.col("lines") >= 0, F.col("english")]
    entries = [F.struct(F.lit(i).cast("bigint").alias("candidate"), t.alias("bit")) for i, t in enumerate(tests)]
    rows = labelled_documents(spark, folder).select("doc_id", F.explode(F.array(*entries)).alias("e")).select("doc_id", "e.*")
    return I.equal_candidates(rows, "candidate", F.col("doc_id"), "bit")


@query("smallest_thresholds", f"""WITH {DOC_SQL}, v AS (SELECT DISTINCT unnest(['size', 'lines']) AS feature, unnest([size, lines]) AS value FROM docs)
SELECT feature, value::DOUBLE AS value FROM v QUALIFY row_number() OVER (PARTITION BY feature ORDER BY value) <= 4""")
def smallest_thresholds(spark, folder):
    docs = labelled_documents(spark, folder)
    rows = docs.select(F.array(F.col("size").cast("double"), F.col("lines").cast("double")).alias("values"))
    found = I.smallest_values(rows, 4)
    return spark.createDataFrame(
        [(("size", "lines")[c], float(v)) for c, vs in found.items() for v in vs], "feature string, value double"
    )


@query("concept_similarity", f"""WITH {DOC_SQL}, a AS (SELECT unnest(['english', 'large', 'lines']) AS feature,
  unnest([avg((long = english)::INT), avg((long = (size >= 3))::INT), avg((long = (lines > 0))::INT)]) AS agreement FROM docs)
SELECT feature, round(agreement, 9) AS agreement, CAST(row_number() OVER (ORDER BY agreement DESC, feature) AS INTEGER) AS rank FROM a""")
def concept_similarity(spark, folder):
    targets = {"english": (F.col("english"), "bool"), "large": (F.col("size") >= 3, "bool"), "lines": (F.col("lines"), "int")}
    return I.similarity(labelled_documents(spark, folder), F.col("long"), targets).withColumn("agreement", r9("agreement"))


INDUCE = I.InductionParams(rounds=1, beam=16, top_k=25, min_train_gain=0.0005, min_holdout_gain=0.0, compare_atoms=True, seed=5)


def induction_rows(spark, folder):
    docs = labelled_documents(spark, folder)
    as_number = lambda n, k: F.col(n).cast("int").cast("double") if k == "bool" else F.col(n).cast("double")
    stored = materialize(docs.select(
        "doc_id", F.array(*[as_number(f.name, f.kind) for f in DOC_FEATURES]).alias("values"),
        F.col("toxic").alias("target"), F.col("quality").alias("label"),
    ))
    held = R.holdout_condition(stored, F.col("doc_id"), INDUCE.seed, INDUCE.holdout_fraction)
    return stored.withColumn("held", held)


ENUMERATE_SQL = f"""WITH {DOC_SQL},
r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '5', doc_id)), doc_id) > n - floor(n * 0.25) AS held
  FROM docs, (SELECT count(*) AS n FROM docs)),
num AS (SELECT doc_id, held, unnest([0, 1]) AS atom, unnest([size, lines]) AS v FROM r),
th AS (SELECT atom, t, row_number() OVER (PARTITION BY atom ORDER BY t) AS k FROM (SELECT DISTINCT atom, v AS t FROM num WHERE NOT held) QUALIFY k <= {INDUCE.max_thresholds}),
c1 AS (SELECT row_number() OVER (ORDER BY o1, atom, o2, k) - 1 AS seq, * FROM (
  SELECT 0 AS o1, 0 AS atom, 0 AS o2, 0 AS k, NULL AS t, 'long' AS expr UNION ALL SELECT 0, 1, 0, 0, NULL, 'english'
  UNION ALL SELECT 1, atom, 0, k, t, concat('(', ['size', 'lines'][atom + 1], ' == ', t, ')') FROM th
  UNION ALL SELECT 1, atom, 1, k, t, concat('(', ['size', 'lines'][atom + 1], ' >= ', t, ')') FROM th WHERE k > 1
  UNION ALL SELECT 2, 0, 0, 0, NULL, '(size > lines)' UNION ALL SELECT 2, 1, 0, 0, NULL, '(lines > size)')),
b1 AS (SELECT seq, expr, doc_id, toxic, quality, r.held, CASE WHEN o1 = 0 THEN CASE atom WHEN 0 THEN long ELSE english END
  WHEN o1 = 2 THEN CASE atom WHEN 0 THEN size > lines ELSE lines > size END WHEN o2 = 0 THEN CASE atom WHEN 0 THEN size ELSE lines END = t ELSE CASE atom WHEN 0 THEN size ELSE lines END >= t END AS bit FROM c1, r),
"""


def _gain_sql(source, out):
    """CTEs that score every candidate of ``source`` (seq, expr, doc_id, bit, toxic, quality, held)."""
    return f"""{out}_s AS (SELECT seq, expr, string_agg(bit::INT::VARCHAR, '' ORDER BY doc_id) AS sig, bool_or(bit) AND NOT bool_and(bit) AS varies FROM {source} GROUP BY 1, 2),
{out}_l AS (SELECT seq, held, kind, cls, bit, count(*) AS n FROM (SELECT seq, held, bit, unnest(['t', 'l']) AS kind, unnest([toxic, quality]) AS cls FROM {source}) GROUP BY ALL),
{out}_p AS (SELECT seq, held, kind, bit, sum(n) AS m, -sum(n / s * log2(n / s)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY seq, held, kind, bit) AS s FROM {out}_l) GROUP BY 1, 2, 3, 4),
{out}_w AS (SELECT seq, held, kind, sum(n) AS m, -sum(n / s * log2(n / s)) AS h FROM (SELECT seq, held, kind, cls, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY seq, held, kind) AS s FROM {out}_l GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
{out}_g AS (SELECT seq, held, max(gain) AS gain FROM (SELECT w.seq, w.held, w.kind, any_value(w.h) - sum(p.h * p.m / w.m) AS gain FROM {out}_w w JOIN {out}_p p USING (seq, held, kind) GROUP BY 1, 2, 3) GROUP BY 1, 2),
{out} AS (SELECT s.seq, expr, sig, varies, a.gain AS train_gain, b.gain AS holdout_gain FROM {out}_s s
  JOIN {out}_g a ON a.seq = s.seq AND NOT a.held JOIN {out}_g b ON b.seq = s.seq AND b.held)"""


ENUMERATE_SQL += _gain_sql("b1", "g1") + """,
ok1 AS (SELECT * FROM g1 WHERE varies QUALIFY row_number() OVER (PARTITION BY sig ORDER BY seq) = 1),
beam AS (SELECT *, row_number() OVER (ORDER BY round(train_gain, 12) DESC, seq) - 1 AS i FROM ok1 WHERE train_gain >= 0.0005 AND holdout_gain >= 0 QUALIFY i < """ + str(INDUCE.beam) + """),
pairs AS (SELECT a.seq AS sa, b.seq AS sb, a.expr AS ea, b.expr AS eb, row_number() OVER (ORDER BY a.i, b.i) - 1 AS k FROM beam a JOIN beam b ON a.i < b.i),
c2 AS (SELECT (SELECT count(*) FROM c1) + i AS seq, seq AS sa, seq AS sb, 'not' AS op, concat('(not ', expr, ')') AS expr FROM beam
  UNION ALL SELECT (SELECT count(*) FROM c1) + (SELECT count(*) FROM beam) + 2 * k, sa, sb, 'and', concat('(', ea, ' and ', eb, ')') FROM pairs
  UNION ALL SELECT (SELECT count(*) FROM c1) + (SELECT count(*) FROM beam) + 2 * k + 1, sa, sb, 'or', concat('(', ea, ' or ', eb, ')') FROM pairs),
b2 AS (SELECT c2.seq, c2.expr, x.doc_id, x.toxic, x.quality, x.held, CASE op WHEN 'not' THEN NOT x.bit WHEN 'and' THEN x.bit AND y.bit ELSE x.bit OR y.bit END AS bit
  FROM c2 JOIN b1 x ON x.seq = sa JOIN b1 y ON y.seq = sb AND y.doc_id = x.doc_id),
b12 AS (SELECT seq, expr, doc_id, toxic, quality, held, bit FROM b1 UNION ALL SELECT seq, expr, doc_id, toxic, quality, held, bit FROM b2),
""" + _gain_sql("b12", "g2") + """,
ok AS (SELECT * FROM g2 WHERE varies QUALIFY row_number() OVER (PARTITION BY sig ORDER BY seq) = 1),
passed AS (SELECT * FROM ok WHERE train_gain >= 0.0005 AND holdout_gain >= 0)
"""


@query("concept_shortlist", ENUMERATE_SQL + """SELECT row_number() OVER (ORDER BY round(holdout_gain, 12) DESC, round(train_gain, 12) DESC, seq) AS rank, expr,
  round(train_gain, 9) AS train_gain, round(holdout_gain, 9) AS holdout_gain FROM passed QUALIFY rank <= 25""")
def concept_shortlist(spark, folder):
    found = I.enumerate_and_score(induction_rows(spark, folder), DOC_FEATURES, INDUCE)
    rows = [(i, c.expr.text(), round(c.train_gain, 9), round(c.holdout_gain, 9)) for i, c in enumerate(found.shortlist, 1)]
    return spark.createDataFrame(rows, "rank bigint, expr string, train_gain double, holdout_gain double")


@query("enumeration_counters", ENUMERATE_SQL + """SELECT (SELECT count(*) FROM g2) AS enumerated, (SELECT count(*) FROM g2) - (SELECT count(*) FROM ok) AS deduplicated,
  (SELECT count(*) FROM ok) AS scored, (SELECT count(*) FROM passed) AS passed""")
def enumeration_counters(spark, folder):
    found = I.enumerate_and_score(induction_rows(spark, folder), DOC_FEATURES, INDUCE)
    row = (found.enumerated, found.deduplicated, found.scored, found.passed)
    return spark.createDataFrame([row], "enumerated bigint, deduplicated bigint, scored bigint, passed bigint")


MINE = R.MineParams((2, 6), 2, 0, 0.2)


def mined_sql(params):
    """Mining in SQL: split search level by level over the board features, then the leaves as rules with evidence."""
    base = B.feature_sql()
    classes = [n for n, k, _ in base if k == "set"]
    shown = [f"count({n})" if k == "set" else n for n, k, _ in base]
    width, k, deepest = len(base), range(len(classes) + 1), max(params.depths)
    values = ", ".join(f"{('len(' + s + ')') if kind == 'set' else s}::DOUBLE" for _, kind, s in base)
    parts = [f"""rowed AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '{params.seed}', canonical_state)), canonical_state) > n - floor(n * {params.holdout_fraction}) AS held
  FROM labelled, (SELECT count(*) AS n FROM labelled)),
d0 AS (SELECT canonical_state, coalesce(list_position({classes}, label), {len(classes) + 1}) - 1 AS y, label, qualifying, occurrences, value, [{values}] AS v, '' AS path, [] AS conds
  FROM rowed WHERE NOT held)"""]
    for level in range(deepest):
        total = lambda side: " + ".join(f"{side}{i}" for i in k)
        squares = lambda side: " + ".join(f"{side}{i} * {side}{i}" for i in k)
        text = f"'(' || {shown}[col + 1] || CASE WHEN v[col + 1] <= val THEN ' <= ' ELSE ' > ' END || floor(val)::BIGINT || ')'"
        parts.append(f"""e{level} AS (SELECT path, unnest(range(0, {width})) AS col, unnest(v) AS val, y FROM d{level}),
g{level} AS (SELECT path, col, val, {", ".join(f"count(*) FILTER (y = {i}) AS c{i}" for i in k)} FROM e{level} GROUP BY path, col, val),
w{level} AS (SELECT path, col, val, {", ".join(f"(sum(c{i}) OVER w)::HUGEINT AS l{i}, (sum(c{i}) OVER p - sum(c{i}) OVER w)::HUGEINT AS r{i}, (sum(c{i}) OVER p)::HUGEINT AS t{i}" for i in k)}
  FROM g{level} WINDOW w AS (PARTITION BY path, col ORDER BY val), p AS (PARTITION BY path, col)),
s{level} AS (SELECT path, col, val, {total("l")} AS nl, {total("r")} AS nr, {squares("l")} AS al, {squares("r")} AS ar, {total("t")} AS n, {squares("t")} AS a FROM w{level}),
f{level} AS (SELECT path, col, val, al * nr + ar * nl AS num, nl * nr AS den FROM s{level}
  WHERE nr > 0 AND nl >= {params.min_leaf} AND nr >= {params.min_leaf} AND (al * nr + ar * nl) * n > a * nl * nr),
q{level} AS (SELECT *, num // den AS q0, (num % den) * 1000000000 // den AS q1, ((num % den) * 1000000000 % den) * 1000000000 // den AS q2 FROM f{level}),
b{level} AS (SELECT path, col, val FROM q{level} QUALIFY row_number() OVER (PARTITION BY path ORDER BY q0 DESC, q1 DESC, q2 DESC, col, val) = 1),
d{level + 1} AS (SELECT canonical_state, y, label, qualifying, occurrences, value, v, path || CASE WHEN v[col + 1] <= val THEN '0' ELSE '1' END AS path,
  list_append(conds, {text}) AS conds FROM d{level} JOIN b{level} USING (path))""")
    lists = []
    for depth in params.depths:
        ends = [f"SELECT * FROM d{i} WHERE path NOT IN (SELECT path FROM b{i})" for i in range(depth)] + [f"SELECT * FROM d{depth}"]
        parts.append(f"""leaf{depth} AS ({" UNION ALL ".join(ends)}),
num{depth} AS (SELECT path, row_number() OVER (ORDER BY path) AS k, any_value(conds) AS conds FROM leaf{depth} GROUP BY path),
x{depth} AS (SELECT path, q, count(*) AS sound FROM (SELECT path, unnest(qualifying) AS q FROM leaf{depth}) GROUP BY 1, 2),
c{depth} AS (SELECT path, q AS class, sound FROM x{depth} QUALIFY row_number() OVER (PARTITION BY path ORDER BY sound DESC, list_position({classes}, q)) = 1)""")
        lists.append(f"""SELECT 'mined-d{depth}-l{params.min_leaf}' AS candidate, concat('rule', any_value(k)) AS rule, concat('(', array_to_string(any_value(num{depth}.conds), ' and '), ')') AS condition,
  class, count(*) AS support, any_value(sound) AS sound, round(any_value(sound) / count(*), 9) AS soundness, count(*) FILTER (label = class) AS label_matches,
  CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) FILTER (value = 1) AS win, count(*) FILTER (value = 0) AS draw, count(*) FILTER (value = -1) AS loss
FROM leaf{depth} JOIN c{depth} USING (path) JOIN num{depth} USING (path) GROUP BY path, class""")
    return f"WITH {STEPS_SQL}, {B.BOARDS_SQL}, {B.CANONICAL_SQL}, {LABEL_SQL}, " + ",\n".join(parts) + "\n" + "\nUNION ALL\n".join(lists)


@query("mined_rules", mined_sql(MINE))
def mined_rules(spark, folder):
    """Decision lists mined from the labelled board dataset at two depths, one row per rule with its evidence."""
    _, rows, vocabulary = B.board_dataset(spark, folder)
    found = R.mine(rows, vocabulary, MINE)
    shape = "candidate string, rule string, condition string, " + ", ".join(
        f"{c} {'string' if c == 'class' else 'double' if c == 'soundness' else 'bigint'}" for c in R.EVIDENCE
    )
    out = []
    for m in found:
        texts = {r.name: r.condition.text() for r in m.decisions.rules}
        out += [(e["candidate"], e["rule"], texts[e["rule"]], *[e[c] for c in R.EVIDENCE]) for e in m.evidence]
    return spark.createDataFrame(out, shape).withColumn("soundness", r9("soundness"))


@query("induced_concepts")
def induced_concepts(spark, folder):
    """Concepts proposed for the board dataset with the outcome of their probe."""
    _, rows, vocabulary = B.board_dataset(spark, folder)
    found = I.induce_concepts(rows, vocabulary, I.InductionParams())
    shape = "round int, expr string, train_gain double, holdout_gain double, outcome string"
    return spark.createDataFrame([tuple(o.values()) for o in found.outcomes], shape)


TIER_SQL = "CASE WHEN p_size <= 15 THEN 'primitive' WHEN p_size <= 40 THEN 'supplied' ELSE 'invented' END"
USAGE_SQL = "count(*) AS referenced, " + ", ".join(
    f"count(*) FILTER (tier = '{t}') AS {t}, round(count(*) FILTER (tier = '{t}') / count(*), 9) AS {t}_fraction"
    for t in ("primitive", "supplied", "invented")
)


def references(spark, folder):
    """Suppliers stand for candidates and the parts they ship for the features they reference."""
    items = table(spark, folder, "lineitem")
    refs = items.select(F.col("l_suppkey").alias("candidate"), F.col("l_partkey").alias("feature"))
    size = F.col("p_size")
    tier = F.when(size <= 15, "primitive").when(size <= 40, "supplied").otherwise("invented")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("feature"), tier.alias("tier"))
    defined = refs.join(parts, "feature").withColumn("ord", F.col("candidate"))
    return refs, defined


def _round_fractions(df):
    return df.withColumns({c: r9(c) for c in df.columns if c.endswith("_fraction")})


REFS_SQL = f"u AS (SELECT DISTINCT l_suppkey AS candidate, l_partkey AS feature, {TIER_SQL} AS tier FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query("vocab_usage", f"WITH {REFS_SQL} SELECT candidate, {USAGE_SQL} FROM u GROUP BY 1")
def vocab_usage(spark, folder):
    return _round_fractions(U.candidate_usage(*references(spark, folder)))


@query("vocab_usage_overall", f"WITH {REFS_SQL}, o AS (SELECT DISTINCT feature, tier FROM u) SELECT {USAGE_SQL} FROM o")
def vocab_usage_overall(spark, folder):
    return _round_fractions(U.overall_usage(*references(spark, folder)))


@query("columns_by_tier", f"""SELECT {", ".join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in ("primitive", "supplied", "invented"))}
FROM (SELECT {TIER_SQL} AS tier FROM part)""")
def columns_by_tier(spark, folder):
    size = F.col("p_size")
    tier = F.when(size <= 15, "primitive").when(size <= 40, "supplied").otherwise("invented")
    return U.columns_by_tier(table(spark, folder, "part").withColumn("tier", tier))
