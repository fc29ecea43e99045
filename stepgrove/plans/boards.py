"""Nine-cell boards laid out from runs of nine events, their symmetry group, lines and labels."""

from pyspark.sql import functions as F

from ..functions.symmetry import canonical_form, digits_code, move_positions
from ..operators import dataset as D
from ..operators.features import Feature, Vocabulary, occupancy_features, realizable
from .corpora import PLAYERS, event_steps

# Generators of the board symmetry and the win lines.
ROTATION = [2, 5, 8, 1, 4, 7, 0, 3, 6]
REFLECTION = [2, 1, 0, 5, 4, 3, 8, 7, 6]
LINES = [[0, 1, 2], [3, 4, 5], [6, 7, 8], [0, 3, 6], [1, 4, 7], [2, 5, 8], [0, 4, 8], [2, 4, 6]]


def closed_group():
    """Identity first, then the other products of the generators in sorted order."""
    identity = list(range(9))
    found, fresh = [identity], [identity]
    while fresh:
        fresh = [
            p for g in fresh for s in (ROTATION, REFLECTION) for p in [[s[g[i]] for i in range(9)]] if p not in found
        ]
        fresh = [p for k, p in enumerate(fresh) if p not in fresh[:k]]
        found += fresh
    return [identity] + sorted(p for p in found if p != identity)


GROUP = closed_group()
#: Positions that the symmetries carry into each other, by least position.
ORBITS = sorted({tuple(sorted({g[p] for g in GROUP})) for p in range(9)})
ORBITS = [list(o) for o in ORBITS]


def board_code(cells):
    return digits_code(cells, PLAYERS)


def canonical_board(cells):
    """Canonical form of the cells: least base-3 code over the eight symmetries."""
    return canonical_form(cells, GROUP, board_code)


def board_text(cells):
    return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit("."))), "")


def event_boards(spark, folder):
    """One board per run of nine events: purchases are X, errors are O, the rest is empty.

    ``optimal`` are the free positions of the events worth at least 10; positions past the end of a
    sequence stay empty.
    """
    steps = event_steps(spark, folder, ["value"])
    slot = F.col("ply") % 9
    owner = F.when(F.col("action") == "purchase", "X").when(F.col("action") == "error", "O")
    cell = lambda i: F.max(F.when(slot == i, owner))
    worth = lambda i: F.max(F.when((slot == i) & owner.isNull(), F.col("value")))
    runs = steps.groupBy("seq_id", F.floor(F.col("ply") / 9).cast("bigint").alias("run")).agg(
        F.array(*[cell(i) for i in range(9)]).alias("cells"), F.array(*[worth(i) for i in range(9)]).alias("worth")
    )
    held = lambda p: F.size(F.filter("cells", lambda c: c == p))
    places = F.sequence(F.lit(0), F.lit(8))
    free = F.filter(places, lambda p: F.element_at("cells", p + 1).isNull())
    optimal = F.filter(free, lambda p: F.coalesce(F.element_at("worth", p + 1) >= 10, F.lit(False)))
    return runs.select(
        "seq_id", "run", "cells",
        F.when(held("X") <= held("O"), "X").otherwise("O").alias("mover"),
        free.alias("legal"), optimal.alias("optimal"), (F.size(free) == 0).alias("terminal"),
        F.signum(held("X") - held("O")).cast("int").alias("value"),
    )


def canonical_states(boards):
    """Boards carried into their canonical frame, legal and optimal positions with them."""
    form = boards.withColumn("_f", canonical_board(F.col("cells")))
    return form.select(
        "seq_id", "run", "mover", "terminal", "value",
        F.col("_f.image").alias("cells"),
        F.concat(board_text(F.col("_f.image")), F.lit(":"), F.col("mover")).alias("canonical_state"),
        move_positions(F.col("legal"), F.col("_f.permutation")).alias("legal"),
        move_positions(F.col("optimal"), F.col("_f.permutation")).alias("optimal"),
    )


def board_vocabulary(extended=False, supplied=()):
    vocabulary = Vocabulary().extend(occupancy_features("cells", "mover", ORBITS, LINES, extended))
    return vocabulary.extend(supplied)


def supplied_features():
    """Worked example of a supplied (tier 2) feature set: line counts per player, threats and key cells."""

    def native(name, kind, sql, description, *helpers):
        return Feature(name, "supplied", kind, description, F.expr(f"cast({sql} as bigint)" if kind == "int" else sql), None, helpers)

    held = lambda line, who: f"size(filter(array({', '.join(map(str, line))}), p -> coalesce(cells[p] = {who}, false)))"
    other = "if(mover = 'X', 'O', 'X')"
    shape = {
        "_ours": F.expr(f"array({', '.join(held(line, 'mover') for line in LINES)})"),
        "_others": F.expr(f"array({', '.join(held(line, other) for line in LINES)})"),
    }
    open_line = lambda mine, theirs, n: [f"{mine}[{k}] = {n} and {theirs}[{k}] = 0" for k in range(len(LINES))]
    through = lambda tests, p: " + ".join(f"if({t}, 1, 0)" for t, line in zip(tests, LINES) if p in line)
    cells = lambda tests, n: "filter(array({}), p -> p is not null)".format(
        ", ".join(f"if(cells[{p}] is null and {through(tests, p)} >= {n}, {p}, null)" for p in range(9))
    )
    out = [
        native(f"ttt.line{k}.{who.lower()}", "int", held(line, f"'{who}'"), f"{who} marks on line {k}")
        for k, line in enumerate(LINES) for who in PLAYERS
    ]
    ours, others, single = open_line("_ours", "_others", 2), open_line("_others", "_ours", 2), open_line("_ours", "_others", 1)
    total = lambda tests: " + ".join(f"if({t}, 1, 0)" for t in tests)
    return out + [
        native("ttt.threats.mine", "int", total(ours), "lines the mover can complete", shape),
        native("ttt.threats.theirs", "int", total(others), "lines the opponent can complete", shape),
        native("ttt.winning_cells", "set", cells(ours, 1), "cells that complete a line", shape),
        native("ttt.blocking_cells", "set", cells(others, 1), "cells that stop a line", shape),
        native("ttt.fork_cells", "set", cells(single, 2), "cells that make two threats", shape),
        native("ttt.win_available", "bool", f"size({cells(ours, 1)}) > 0", "a line can be completed", shape),
    ]


def board_dataset(spark, folder, extended=False):
    """(collapsed states, labelled dataset, vocabulary) of the event boards."""
    states = canonical_states(event_boards(spark, folder))
    once = D.collapse(states, "canonical_state", ("seq_id", "run"), ("cells", "mover", "value", "legal", "optimal"))
    vocabulary = board_vocabulary(extended)
    return states, D.build_dataset(once, vocabulary), vocabulary


# ---- the same in SQL -------------------------------------------------------------------------------

_CELL = "max(CASE WHEN ply % 9 = {0} THEN CASE action WHEN 'purchase' THEN 'X' WHEN 'error' THEN 'O' END END)"
_WORTH = "max(CASE WHEN ply % 9 = {0} AND action NOT IN ('purchase', 'error') THEN value END)"
BOARDS_SQL = f"""runs AS (
  SELECT seq_id, ply // 9 AS run, [{", ".join(_CELL.format(i) for i in range(9))}] AS cells,
         [{", ".join(_WORTH.format(i) for i in range(9))}] AS worth
  FROM steps GROUP BY 1, 2),
held AS (SELECT *, len(list_filter(cells, lambda c: c = 'X')) AS nx, len(list_filter(cells, lambda c: c = 'O')) AS no FROM runs),
boards AS (
  SELECT seq_id, run, cells, CASE WHEN nx <= no THEN 'X' ELSE 'O' END AS mover,
         list_filter(range(0, 9), lambda p: cells[p + 1] IS NULL) AS legal,
         list_filter(range(0, 9), lambda p: cells[p + 1] IS NULL AND coalesce(worth[p + 1] >= 10, false)) AS optimal,
         CAST(sign(nx - no) AS INTEGER) AS value
  FROM held)"""


def _image_sql(permutation):
    back = [permutation.index(i) for i in range(9)]
    return "concat(" + ", ".join(f"coalesce(cells[{b + 1}], '.')" for b in back) + ")"


_CODE = "translate({0}, '.XO', '012')"
CANONICAL_SQL = f"""images AS (SELECT *, [{", ".join(_image_sql(g) for g in GROUP)}] AS images,
  {[list(g) for g in GROUP]} AS perms FROM boards),
picked AS (SELECT *, list_position(list_transform(images, lambda s: {_CODE.format("s")}),
  list_sort(list_transform(images, lambda s: {_CODE.format("s")}))[1]) AS k FROM images),
canonical AS (SELECT seq_id, run, mover, value, len(legal) = 0 AS terminal, images[k] AS image,
  concat(images[k], ':', mover) AS canonical_state,
  list_sort(list_transform(legal, lambda p: perms[k][p + 1])) AS legal,
  list_sort(list_transform(optimal, lambda p: perms[k][p + 1])) AS optimal FROM picked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY canonical_state ORDER BY seq_id, run) AS rn,
  count(*) OVER (PARTITION BY canonical_state) AS occurrences FROM canonical WHERE NOT terminal),
once AS (SELECT *, string_split(image, '') AS cells FROM ranked WHERE rn = 1)"""


def feature_sql(extended=False):
    """(name, kind, SQL over ``cells`` text list and ``mover``) of the occupancy features, in order."""
    test = {"free": "cells[p + 1] = '.'", "mine": "cells[p + 1] = mover", "theirs": "cells[p + 1] <> '.' AND cells[p + 1] <> mover"}
    out = [(k, "set", f"list_filter(range(0, 9), lambda p: {t})") for k, t in test.items()]
    for label, groups in (("orbit", ORBITS), ("line", LINES)):
        for k, g in enumerate(groups):
            out.append((f"{label}{k}.free", "set", f"list_filter({g}, lambda p: {test['free']})"))
            for name, t in (("mine", "mine"), ("theirs", "theirs"), ("empty", "free")):
                out.append((f"{label}{k}.{name}", "int", f"len(list_filter({g}, lambda p: {test[t]}))"))
    if extended:
        count = lambda g, t: f"len(list_filter({g}, lambda p: {test[t]}))"
        shows = lambda line, a, b: f"(CASE WHEN {count(line, 'mine')} = {a} AND {count(line, 'theirs')} = {b} THEN 1 ELSE 0 END)"
        for a, b in realizable(LINES):
            out.append((f"lines.mine{a}.theirs{b}", "int", " + ".join(shows(line, a, b) for line in LINES)))
        for a, b in realizable(LINES, True):
            for k in range(1, 5):
                cells = [
                    f"CASE WHEN cells[{p + 1}] = '.' AND ({' + '.join(shows(line, a, b) for line in LINES if p in line)}) >= {k} THEN {p} END"
                    for p in range(9)
                ]
                out.append((f"cells.mine{a}.theirs{b}.ge{k}", "set", f"list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL)"))
    return out
