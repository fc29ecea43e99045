"""Contests, designs, signatures, novelty, archive, graphs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sets
from ..functions.scalars import content_id
from ..operators import agreement as A
from ..operators import archive as N
from ..operators import contest as K
from ..operators import design as D
from ..operators import graph as G
from .catalog import joined, query, r9, table
from .corpora import STEPS_SQL

CONTEST_SQL = """c AS (SELECT c_mktsegment AS candidate, n_name AS opponent, o_orderkey % 2 AS seat,
  CASE WHEN o_orderstatus = 'P' THEN 'unfinished' WHEN o_orderstatus = 'O' THEN 'draw'
       WHEN (o_orderpriority IN ('1-URGENT', '2-HIGH')) = (o_orderkey % 2 = 0) THEN 'win' ELSE 'loss' END AS result,
  month(o_orderdate) AS plies
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def contests(spark, folder):
    """Orders as contests: the market segment plays the nation; status and priority decide the outcome."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"
    )
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    joined_rows = orders.join(customer, "c_custkey").join(nation, "n_nationkey")
    seat = F.col("o_orderkey") % 2
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    rows = joined_rows.select(
        F.col("c_mktsegment").alias("candidate"), F.col("n_name").alias("opponent"), seat.alias("seat"),
        F.when(seat == 0, "X").otherwise("O").alias("player"),
        F.when(F.col("o_orderstatus") == "F", F.when(urgent, "X").otherwise("O")).alias("winner"),
        (F.col("o_orderstatus") != "P").alias("finished"),
        F.month("o_orderdate").cast("bigint").alias("plies"),
    )
    return K.with_result(rows)


COUNT_SQL = "count(*) AS games, " + ", ".join(
    f"count(*) FILTER (result = '{r}') AS n_{r}" for r in ("win", "draw", "loss", "unfinished")
) + ", CAST(sum(plies) AS BIGINT) AS plies"
RATES_SQL = ", ".join(f"round(count(*) FILTER (result = '{r}') / count(*), 9) AS {r}_rate" for r in ("win", "draw", "loss"))


def _rounded(df):
    return df.withColumns({c: r9(c) for c in df.columns if c.endswith("_rate") or c == "loss_rate_vs_reference"})


@query("tally_rollup", f"""WITH {CONTEST_SQL}
SELECT candidate, opponent, seat, {COUNT_SQL}, CAST(grouping(opponent) + grouping(seat) AS INTEGER) AS level, {RATES_SQL}
FROM c GROUP BY GROUPING SETS ((candidate, opponent, seat), (candidate, opponent), (candidate))""")
def tally_rollup(spark, folder):
    return _rounded(K.tally_rollup(contests(spark, folder)))


@query("contest_tally", f"WITH {CONTEST_SQL} SELECT candidate, {COUNT_SQL}, {RATES_SQL} FROM c GROUP BY 1")
def contest_tally(spark, folder):
    return _rounded(K.tally(contests(spark, folder), ["candidate"]))


HEADLINE_SQL = f"""WITH {CONTEST_SQL}, t AS (SELECT candidate, {COUNT_SQL}, {RATES_SQL} FROM c GROUP BY 1),
m AS (SELECT candidate, round(count(*) FILTER (result = 'loss') / count(*), 9) AS met FROM c WHERE opponent = 'NATION_7' GROUP BY 1),
h AS (SELECT candidate, 'NATION_7' AS reference, coalesce(met, 0.0) AS loss_rate_vs_reference, win_rate, draw_rate, loss_rate, games, n_unfinished AS unfinished
FROM t LEFT JOIN m USING (candidate))"""


@query("headline_vs_reference", HEADLINE_SQL + " SELECT *, NULL::DOUBLE AS agreement_rate FROM h")
def headline_vs_reference(spark, folder):
    return _rounded(K.headline(K.tally_rollup(contests(spark, folder)), "NATION_7"))


USUAL_SQL = f"""{HEADLINE_SQL}, a AS (SELECT c_mktsegment AS candidate, o_orderpriority AS state, o_orderstatus AS action
  FROM orders JOIN customer ON c_custkey = o_custkey),
u AS (SELECT state, list(action) AS optimal FROM (SELECT state, action, rank() OVER (PARTITION BY state ORDER BY count(*) DESC) AS r FROM a GROUP BY 1, 2) WHERE r = 1 GROUP BY 1),
g AS (SELECT candidate, round(count(*) FILTER (list_contains(optimal, action)) / count(*), 9) AS agreement_rate FROM a JOIN u USING (state) GROUP BY 1)"""


@query("headline_with_agreement", USUAL_SQL + " SELECT h.*, agreement_rate FROM h LEFT JOIN g USING (candidate)")
def headline_with_agreement(spark, folder):
    """Headlines beside the share of a segment's orders that have the usual status of their priority."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("state"), F.col("o_orderstatus").alias("action")
    )
    moves = orders.join(table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("candidate")), "c_custkey")
    agreed = A.agreement(moves, A.usual_moves(moves), ["candidate"]).withColumnRenamed("rate", "agreement_rate")
    return _rounded(K.headline(K.tally_rollup(contests(spark, folder)), "NATION_7", agreed))


@query("strict_failures", HEADLINE_SQL + """ SELECT candidate, loss_rate_vs_reference, 0.15::DOUBLE AS max_loss_rate
FROM h WHERE loss_rate_vs_reference > 0.15""")
def strict_failures(spark, folder):
    found = K.strict_failures(K.headline(K.tally_rollup(contests(spark, folder)), "NATION_7"), 0.15)
    return _rounded(found).drop("message")


@query("design_cells", """WITH s AS (SELECT DISTINCT c_mktsegment AS s FROM customer), p AS (SELECT DISTINCT o_orderpriority AS p FROM orders),
t AS (SELECT DISTINCT o_orderstatus AS t FROM orders),
cells AS (SELECT row_number() OVER (ORDER BY a.s, b.s, p, t) - 1 AS index, concat(a.s, ' vs ', b.s) AS pairing, p AS priority, t AS status
  FROM s a, s b, p, t)
SELECT index, pairing, priority, status, coalesce(n, 0) AS recorded FROM cells
LEFT JOIN (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2) USING (priority, status)""")
def design_cells(spark, folder):
    """Every segment pairing x priority x status, with the orders recorded for the last two factors."""
    orders = table(spark, folder, "orders")
    segments = D.levels_of(table(spark, folder, "customer"), "c_mktsegment")
    cells = D.design_cells(spark, {
        "pairing": D.all_pairings(segments, 2),
        "priority": D.levels_of(orders, "o_orderpriority"),
        "status": D.levels_of(orders, "o_orderstatus"),
    })
    recorded = orders.groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).count()
    return cells.join(recorded, ["priority", "status"], "left").select(
        "index", F.array_join("pairing", " vs ").alias("pairing"), "priority", "status",
        F.coalesce("count", F.lit(0)).alias("recorded"),
    )


@query("missing_refs", """SELECT vec_id, count(*) AS rows FROM embeddings
WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = vec_id) GROUP BY 1""")
def missing_refs(spark, folder):
    """Embeddings without a label."""
    return D.missing_references(table(spark, folder, "embeddings"), table(spark, folder, "labels"), "vec_id", "doc_id")


@query("duplicate_keys", """SELECT concat_ws(':', l_orderkey, l_linenumber) AS key, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def duplicate_keys(spark, folder):
    items = table(spark, folder, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"))
    return D.duplicates(items, "key")


SIGNATURE_SQL = """n AS (SELECT seq_id, ply, action, count(*) OVER (PARTITION BY seq_id) AS n FROM steps),
s AS (SELECT *, greatest(1, n // 16) AS stride FROM n),
sig AS (SELECT seq_id, md5(concat_ws(':', n, stride)) AS sample_id, list(action ORDER BY ply) AS signature
  FROM s WHERE ply % stride = 0 AND ply < 16 * stride GROUP BY seq_id, n, stride)"""


def user_signatures(spark, folder):
    events = table(spark, folder, "events").select(F.col("user_id").alias("seq_id"), F.col("event_type").alias("action"), "ts", "event_id")
    return N.signatures(events, ["seq_id"], ["ts", "event_id"], size=16)


@query("stride_signature", f"""WITH {STEPS_SQL}, {SIGNATURE_SQL}
SELECT seq_id, sample_id, array_to_string(signature, ',') AS signature FROM sig""")
def stride_signature(spark, folder):
    return user_signatures(spark, folder).select("seq_id", "sample_id", joined("signature").alias("signature"))


@query("behaviour_distance", f"""WITH {STEPS_SQL}, {SIGNATURE_SQL}
SELECT a.seq_id, CASE WHEN a.sample_id = b.sample_id AND len(a.signature) = len(b.signature) THEN
  round(len(list_filter(range(1, len(a.signature) + 1), lambda i: a.signature[i] <> b.signature[i])) / len(a.signature), 9) END AS distance
FROM sig a JOIN sig b ON b.seq_id = a.seq_id + 1""")
def behaviour_distance(spark, folder):
    """Each user against the next one."""
    signed = user_signatures(spark, folder).select("seq_id", F.struct("sample_id", "signature").alias("a"))
    after = signed.select((F.col("seq_id") - 1).alias("seq_id"), F.col("a").alias("b"))
    return signed.join(after, "seq_id").select("seq_id", r9(N.behaviour_distance()).alias("distance"))


SPEC_SQL = """spec AS (SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'minimax' WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'heuristic-rules' ELSE 'random' END AS kind,
  p_size % 10 AS depth, (p_partkey % 7) / 8 AS epsilon, CASE WHEN p_partkey % 2 = 0 THEN 'engine' ELSE 'seeded' END AS tie_break,
  string_split(p_name, ' ') AS rules FROM part)"""


def part_specs(spark, folder):
    kind = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "minimax").when(F.col("p_type").isin("LARGE", "MEDIUM"), "heuristic-rules")
    return table(spark, folder, "part").select(
        "p_partkey", kind.otherwise("random").alias("kind"), (F.col("p_size") % 10).alias("depth"),
        ((F.col("p_partkey") % 7) / 8).alias("epsilon"),
        F.when(F.col("p_partkey") % 2 == 0, "engine").otherwise("seeded").alias("tie_break"),
        F.split("p_name", " ").alias("rules"),
    )


_SPEC_DISTANCE_SQL = """CASE WHEN a.kind <> b.kind THEN 1.0
  WHEN a.kind = 'minimax' THEN greatest(CASE WHEN greatest(a.depth, b.depth) = 0 THEN 0.0 ELSE abs(a.depth - b.depth) / greatest(a.depth, b.depth) END,
    abs(a.epsilon - b.epsilon), CASE WHEN a.tie_break <> b.tie_break THEN 0.1 ELSE 0.0 END)
  WHEN a.kind = 'heuristic-rules' THEN 1 - len(list_intersect(a.rules, b.rules)) / len(list_distinct(list_concat(a.rules, b.rules))) ELSE 0.0 END"""


@query("spec_distance", f"""WITH {SPEC_SQL} SELECT a.p_partkey, round({_SPEC_DISTANCE_SQL}, 9)::DOUBLE AS distance
FROM spec a JOIN spec b ON b.p_partkey = a.p_partkey + 1""")
def spec_distance(spark, folder):
    """Each part's spec against the next one."""
    specs = part_specs(spark, folder)
    spec = F.struct("kind", "depth", "epsilon", "tie_break", "rules")
    a = specs.select("p_partkey", spec.alias("a"))
    b = specs.select((F.col("p_partkey") - 1).alias("p_partkey"), spec.alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", r9(sets.spec_distance(F.col("a"), F.col("b"))).alias("distance"))


ENTRY_SQL = """e AS (SELECT vec_id AS sequence, concat('e', vec_id) AS entry_id,
  CASE WHEN label < 4 THEN 'minimax' WHEN label < 8 THEN 'heuristic-rules' ELSE 'random' END AS kind,
  (vec_id % 9)::BIGINT AS depth, (vec_id % 5) / 8 AS epsilon, CASE WHEN vec_id % 2 = 0 THEN 'engine' ELSE 'seeded' END AS tie_break,
  list_transform(list_filter(range(1, 65), lambda i: embedding[i] > 0.2), lambda i: concat('d', i)) AS rules,
  CASE WHEN label % 3 = 0 THEN NULL ELSE concat('s', label % 3) END AS sample_id,
  list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '+' ELSE '-' END) AS signature FROM embeddings)"""


def vector_entries(spark, folder):
    """Embeddings as archive entries: signs are the behaviour, strong dimensions the rules."""
    vec, label = F.col("vec_id"), F.col("label")
    strong = F.filter(F.sequence(F.lit(1), F.lit(64)), lambda i: F.element_at("embedding", i) > F.lit(0.2))
    return table(spark, folder, "embeddings").select(
        vec.alias("sequence"), F.concat(F.lit("e"), vec).alias("entry_id"),
        F.when(label < 4, "minimax").when(label < 8, "heuristic-rules").otherwise("random").alias("kind"),
        (vec % 9).alias("depth"), ((vec % 5) / 8).alias("epsilon"),
        F.when(vec % 2 == 0, "engine").otherwise("seeded").alias("tie_break"),
        F.transform(strong, lambda i: F.concat(F.lit("d"), i)).alias("rules"),
        F.when(label % 3 != 0, F.concat(F.lit("s"), label % 3)).alias("sample_id"),
        F.transform("embedding", lambda x: F.when(x >= 0, "+").otherwise("-")).alias("signature"),
    )


_JACCARD = "CASE WHEN len(a.rules) + len(b.rules) = 0 THEN 0.0 ELSE 1 - len(list_intersect(a.rules, b.rules)) / len(list_distinct(list_concat(a.rules, b.rules))) END"


NEAREST_SQL = f"""WITH {ENTRY_SQL}, p AS (
  SELECT a.sequence, b.sequence AS other, {_SPEC_DISTANCE_SQL.replace("1 - len(list_intersect(a.rules, b.rules)) / len(list_distinct(list_concat(a.rules, b.rules)))", _JACCARD)} AS sd,
    CASE WHEN a.sample_id = b.sample_id THEN len(list_filter(range(1, 65), lambda i: a.signature[i] <> b.signature[i])) / 64 END AS bd
  FROM e a JOIN e b ON b.sequence < a.sequence),
n AS (SELECT sequence, min(sd) AS sd, min(bd) AS bd, arg_min(other, coalesce(bd, sd) * 1000000000 + other / 1000000) AS other FROM p GROUP BY 1)"""


@query("novelty_nearest", NEAREST_SQL + """
SELECT e.sequence, e.entry_id, n.other AS nearest_sequence, round(coalesce(sd, 1.0), 9)::DOUBLE AS spec_distance, round(bd, 9) AS behaviour_distance,
  round(coalesce(bd, sd, 1.0), 9)::DOUBLE AS distance, coalesce(bd, sd, 1.0) > 0 AS is_novel
FROM e LEFT JOIN n USING (sequence)""")
def novelty_nearest(spark, folder):
    found = N.novelty(vector_entries(spark, folder))
    return found.withColumns({c: r9(c) for c in ("spec_distance", "behaviour_distance", "distance")})


@query("novelty_nearest_id", NEAREST_SQL + """
SELECT e.sequence, CASE WHEN n.other IS NOT NULL THEN concat('e', n.other) END AS nearest_entry_id FROM e LEFT JOIN n USING (sequence)""")
def novelty_nearest_id(spark, folder):
    """The nearest earlier entry by name, by behaviour where two entries compare and by spec elsewhere."""
    entries = vector_entries(spark, folder)
    return N.with_nearest_id(N.novelty(entries), entries).select("sequence", "nearest_entry_id")


@query("archive_append", """WITH x AS (SELECT md5(text) AS entry_id, item_id AS sequence FROM benchmark),
n AS (SELECT md5(text) AS entry_id, min(doc_id) AS doc_id FROM documents GROUP BY 1)
SELECT entry_id, doc_id, row_number() OVER (ORDER BY doc_id) + (SELECT max(sequence) FROM x) AS sequence
FROM n WHERE entry_id NOT IN (SELECT entry_id FROM x)""")
def archive_append(spark, folder):
    existing = table(spark, folder, "benchmark").select(F.md5("text").alias("entry_id"), F.col("item_id").alias("sequence"))
    new = table(spark, folder, "documents").select(F.md5("text").alias("entry_id"), "doc_id")
    return N.append_once(existing, new, ["doc_id"])


@query("archive_index_check", """SELECT doc_id AS sequence, md5(text) AS index_id, md5(lower(text)) AS entry_id
FROM documents WHERE md5(text) <> md5(lower(text))""")
def archive_index_check(spark, folder):
    docs = table(spark, folder, "documents")
    index = docs.select(F.col("doc_id").alias("sequence"), F.md5("text").alias("entry_id"))
    entries = docs.select(F.col("doc_id").alias("sequence"), F.md5(F.lower("text")).alias("entry_id"))
    return N.index_mismatches(index, entries)


@query("content_ids", """SELECT p_partkey, md5(concat('{"kind":"', p_type, '","size":', p_size, '}')) AS entry_id FROM part""")
def content_ids(spark, folder):
    return table(spark, folder, "part").select("p_partkey", content_id(kind=F.col("p_type"), size=F.col("p_size")).alias("entry_id"))


EDGE_SQL = """edges AS (SELECT DISTINCT concat('s', l_suppkey) AS src, concat('p', l_partkey) AS dst FROM lineitem 
  UNION SELECT DISTINCT concat('p', l_partkey), concat('s', l_suppkey) FROM lineitem)"""


@query("graph_reach", f"""WITH RECURSIVE {EDGE_SQL}, walk(state, level) USING KEY (state) AS (
  SELECT 's0', 0 UNION SELECT dst, min(level) + 1 FROM walk JOIN edges ON src = walk.state
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk AS r WHERE r.state = dst) GROUP BY dst)
SELECT state, level FROM walk""")
def graph_reach(spark, folder):
    """Parts and suppliers linked by shipments, from supplier 0."""
    big = table(spark, folder, "lineitem")
    s, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    edges = big.select(s.alias("src"), p.alias("dst")).unionByName(big.select(p.alias("src"), s.alias("dst"))).distinct()
    start = spark.createDataFrame([("s0",)], "state string")
    return G.reach(edges, start)


TREE_SQL = """RECURSIVE t AS (SELECT conv_id, turn, role, string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn) AS state,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS depth, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
edges AS (SELECT DISTINCT CASE WHEN depth = 1 THEN 'start' ELSE left(state, length(state) - length(role) - 1) END AS src, role AS action, state AS dst FROM t),
leaf AS (SELECT state, any_value(depth) AS depth, CAST(count(*) % 3 - 1 AS INTEGER) AS value FROM t WHERE turn = last AND state NOT IN (SELECT src FROM edges) GROUP BY 1),
solved AS (SELECT state, value, depth FROM leaf WHERE depth = (SELECT max(depth) FROM leaf)
  UNION ALL (SELECT src, max(-value), any_value(solved.depth) - 1 FROM solved JOIN edges ON dst = solved.state GROUP BY src
    UNION ALL SELECT l.state, l.value, l.depth FROM leaf l WHERE l.depth = (SELECT max(depth) - 1 FROM solved)))"""


def role_tree(spark, folder):
    """Conversations as paths in a tree of roles: (edges, values of the leaves).

    A state is the list of roles so far. A leaf nobody continues is worth its number of conversations mod 3, minus 1.
    """
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("seq_id"), "turn", "role")
    so_far = Window.partitionBy("seq_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.collect_list("role").over(so_far)
    parent = F.when(F.size("path") == 1, "start").otherwise(F.array_join(F.slice("path", 1, F.size("path") - 1), ">"))
    stepped = turns.withColumn("path", path).select("seq_id", "turn", F.col("role").alias("action"), F.array_join("path", ">").alias("dst"), parent.alias("src"))
    edges = stepped.select("src", "action", "dst").distinct()
    ends = stepped.groupBy("seq_id").agg(F.max_by("dst", "turn").alias("state"))
    leaves = ends.groupBy("state").agg((F.count(F.lit(1)) % 3 - 1).cast("int").alias("value"))
    return edges, leaves.join(edges.select(F.col("src").alias("state")), "state", "left_anti")


def _induction(spark, folder):
    return G.backward_induction(*role_tree(spark, folder))


@query("backward_induction", f"WITH {TREE_SQL} SELECT state, value FROM solved")
def backward_induction(spark, folder):
    return _induction(spark, folder)[0]


@query("optimal_actions", f"""WITH {TREE_SQL} SELECT e.src AS state, string_agg(action, ',' ORDER BY action) AS optimal
FROM edges e JOIN solved c ON c.state = dst JOIN solved p ON p.state = src WHERE -c.value = p.value GROUP BY 1""")
def optimal_actions(spark, folder):
    return G.optimal_sets(_induction(spark, folder)[1]).withColumn("optimal", F.array_join("optimal", ","))
