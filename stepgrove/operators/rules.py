"""Decision lists: mined from a fitted tree, scored with evidence, applied to rows."""

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import sets
from ..functions.scalars import ratio, seeded_hash
from ..session import materialize
from . import tree as trees
from .dataset import NO_LABEL
from .features import Vocabulary


@dataclass(frozen=True)
class Selector:
    """How a fired rule picks actions: ``any-legal``, ``target-in`` a set, or ``maximize`` a number."""

    select: str = "any-legal"
    expr: E.Expr | None = None

    def references(self):
        return self.expr.references() if self.expr else []

    def to_dict(self):
        return {"select": self.select, **({"expr": self.expr.to_dict()} if self.expr else {})}


@dataclass(frozen=True)
class Rule:
    name: str
    priority: int
    condition: E.Expr
    action: Selector

    def to_dict(self):
        return {"name": self.name, "priority": self.priority,
                "condition": self.condition.to_dict(), "action": self.action.to_dict()}


@dataclass
class DecisionList:
    """Rules tried by falling priority (ties keep list order), then the fallback, then any legal action."""

    name: str
    rules: list = field(default_factory=list)
    fallback: Selector = Selector()
    definitions: Vocabulary = field(default_factory=Vocabulary)

    def ordered(self):
        return sorted(self.rules, key=lambda r: -r.priority)

    def references(self):
        used = {n for r in self.rules for n in r.condition.references() + r.action.references()}
        return sorted(used | set(self.fallback.references()))

    def validate(self, available=None):
        """Every referenced name must be defined, and every native one available on the input."""
        missing = [n for n in self.references() if self.definitions.get(n) is None]
        if missing:
            raise E.FeatureError(f"undefined features: {', '.join(missing)}")
        if available is not None:
            native = [f.name for f in self.definitions.features if f.expr is None]
            absent = [n for n in native if n not in available]
            if absent:
                raise E.FeatureError(f"unavailable features: {', '.join(absent)}")
        return self

    def rule_texts(self):
        """Canonical JSON of every rule and the fallback: the set compared by rule-list distance."""
        dump = lambda d: json.dumps(d, sort_keys=True, separators=(",", ":"))
        return sorted({dump(r.to_dict()) for r in self.rules} | {"fallback:" + dump(self.fallback.to_dict())})


    def definition_texts(self):
        """Canonical JSON of every feature that the list references, directly or through another definition."""
        dump = lambda f: json.dumps(
            {"name": f.name, "tier": f.tier, "kind": f.kind, "expr": f.expr.to_dict() if f.expr else None}, sort_keys=True, separators=(",", ":")
        )
        return sorted(dump(f) for f in self.definitions.closure(self.references()))


def rule_from_dict(d):
    return Rule(d["name"], d["priority"], E.from_dict(d["condition"]), selector_from_dict(d["action"]))


def selector_from_dict(d):
    return Selector(d["select"], E.from_dict(d["expr"]) if "expr" in d else None)


def split_predicates(name, kind, threshold):
    """Conditions of the left and right branch of a split."""
    feature = E.ref(name)
    if kind == "bool":
        return E.negate(feature), feature
    if kind == "set":
        feature = E.count(feature)
    bound = E.const(float(threshold) if kind == "float" else math.floor(threshold))
    return E.compare("le", feature, bound), E.compare("gt", feature, bound)


def leaf_conditions(tree, features):
    """Leaf node id -> conjunction of the branch conditions on its path, leaves depth first."""
    found = {}

    def walk(i, path):
        node = tree.nodes[i]
        if node.is_leaf:
            found[i] = E.all_of(*path)
            return
        f = features[node.column]
        left, right = split_predicates(f.name, f.kind, node.threshold)
        walk(node.left, [*path, left])
        walk(node.right, [*path, right])

    walk(0, [])
    return found


def leaf_evidence(rows, classes, holdout=None):
    """One row per ``leaf``: its class and the evidence for it, from a single pass over ``rows``.

    The class is the one that qualifies for most training rows (ties: lowest index; none: ``none``).
    Needs ``leaf``, ``label``, ``qualifying``, ``occurrences`` and ``value``.
    """
    held = F.lit(False) if holdout is None else holdout
    # Rows alike in all that counts are one row with their number; that leaves few, however many classes there are.
    part = rows.select("leaf", "label", "qualifying", "occurrences", "value", held.alias("_held"))
    alike = part.groupBy("leaf", "label", "qualifying", "value", "_held").agg(
        F.count(F.lit(1)).alias("n"), F.sum("occurrences").alias("seen")
    )
    # Each of them tells its leaf (no class), its label, and every class it qualifies for.
    entry = lambda name, kind: F.struct(name.cast("string").alias("class"), F.lit(kind).alias("kind"))
    entries = F.concat(
        F.transform("qualifying", lambda c: entry(c, "sound")), F.array(entry(F.col("label"), "label"), entry(F.lit(None), "leaf"))
    )
    told = alike.select("leaf", "value", "_held", "n", "seen", F.explode(entries).alias("e")).select("*", "e.*")
    train, held_out = ~F.col("_held"), F.col("_held")
    of = lambda kind, side, n="n": F.coalesce(F.sum(F.when((F.col("kind") == kind) & side, F.col(n))), F.lit(0))
    totals = {
        "support": of("leaf", train), "occurrences": of("leaf", train, "seen"), "holdout_rows": of("leaf", held_out),
        **{name: of("leaf", train & (F.col("value") == v)) for name, v in (("win", 1), ("draw", 0), ("loss", -1))},
    }
    counted = told.groupBy("leaf", "class").agg(
        of("sound", train).alias("sound"), of("label", train).alias("label_matches"),
        of("sound", held_out).alias("holdout_sound"), of("label", held_out).alias("holdout_correct"),
        *[c.alias(n) for n, c in totals.items()],
    )
    names = F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<string>")
    place = F.array_position(names, F.col("class"))
    figures = F.struct("class", "sound", "label_matches", "holdout_sound", "holdout_correct")
    ranked = F.when((place > 0) & (F.col("sound") > 0), F.struct((-F.col("sound")).alias("n"), place.alias("i"), figures.alias("f")))
    zero = F.lit(0).cast("bigint")
    best = counted.groupBy("leaf").agg(
        F.min(ranked).alias("best"), *[F.max(n).alias(n) for n in totals],
        *[F.max(F.when(F.col("class") == NO_LABEL, F.col(c))).alias(f"_none_{c}") for c in ("label_matches", "holdout_correct")],
    )
    some = F.col("best").isNotNull()
    pick = lambda c, other=zero: F.when(some, F.col(f"best.f.{c}")).otherwise(other)
    none = lambda c: pick(c, F.coalesce(F.col(f"_none_{c}"), zero))
    return best.select(
        "leaf", pick("class", F.lit(NO_LABEL)).alias("class"), "support", pick("sound").alias("sound"),
        none("label_matches").alias("label_matches"), "occurrences", "win", "draw", "loss", "holdout_rows",
        none("holdout_correct").alias("holdout_correct"), pick("holdout_sound").alias("holdout_sound"),
    ).withColumn("soundness", ratio("sound", "support"))


def scores(evidence):
    """Accuracy, soundness and fallback rows of a whole list; holdout figures are null without a holdout."""
    out = evidence.agg(
        *[F.sum(c).alias(c) for c in ("support", "sound", "label_matches", "holdout_rows", "holdout_correct", "holdout_sound")],
        F.sum(F.when(F.col("class") == NO_LABEL, F.col("support")).otherwise(0)).alias("fallback_rows"),
        F.count_if(F.col("class") != NO_LABEL).alias("rules"),
        F.count(F.lit(1)).alias("leaves"),
    )
    held = F.col("holdout_rows") > 0
    return out.select(
        "rules", "leaves", F.col("support").alias("train_rows"), "holdout_rows",
        ratio("label_matches", "support").alias("train_accuracy"),
        ratio("sound", "support").alias("train_soundness"),
        F.when(held, ratio("holdout_correct", "holdout_rows")).alias("holdout_accuracy"),
        F.when(held, ratio("holdout_sound", "holdout_rows")).alias("holdout_soundness"),
        "fallback_rows",
    )


def label_index(classes):
    names = F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<string>")
    at = F.coalesce(F.array_position(names, F.col("label")), F.lit(0))
    return F.when(at > 0, at - 1).otherwise(F.lit(len(classes))).cast("int")


@dataclass(frozen=True)
class MineParams:
    depths: tuple = (6,)
    min_leaf: int = 1
    seed: int = 0
    holdout_fraction: float = 0.0
    engine: str = "cart"

    def validate(self):
        if self.engine not in ("cart", "mllib"):
            raise ValueError(f"engine `{self.engine}` is not one of: cart, mllib")
        if not self.depths:
            raise ValueError("no depth is given")
        if len(set(self.depths)) != len(self.depths):
            raise ValueError("a depth is given twice")
        if self.min_leaf < 1:
            raise ValueError("min_leaf must be >= 1")
        if not 0.0 <= self.holdout_fraction < 1.0:
            raise ValueError("holdout_fraction must be in [0, 1)")
        return self


@dataclass
class Mined:
    """A mined candidate: the list, its evidence per rule and its scores."""

    name: str
    decisions: DecisionList
    evidence: list
    scores: dict
    tree: trees.Tree


def fit_tree(dataset, vocabulary, depth, min_leaf=1, holdout=None, engine="cart"):
    """The tree of the rows that aren't held out, over the index of their label."""
    classes = vocabulary.set_features()
    train = dataset.filter(~(F.lit(False) if holdout is None else holdout)).select("values", label_index(classes).alias("label"))
    if engine == "mllib":
        return trees.fit_mllib(train, len(classes) + 1, len(vocabulary.features), depth, min_leaf)
    return trees.fit(train, len(classes) + 1, depth, min_leaf)


def mine_one(dataset, vocabulary, depth, min_leaf=1, holdout=None, engine="cart", name=None, fitted=None):
    """Fit one tree, unless it is given, and turn it into a decision list. ``holdout`` is a boolean column."""
    classes = vocabulary.set_features()
    held = F.lit(False) if holdout is None else holdout
    fitted = fitted or fit_tree(dataset, vocabulary, depth, min_leaf, holdout, engine)
    routed = dataset.withColumn("leaf", fitted.route())
    rows = {r["leaf"]: r for r in leaf_evidence(routed, classes, held).collect()}
    return _mined(fitted, vocabulary, rows, name or (f"mined-d{depth}-l{min_leaf}" if engine == "cart" else f"mined-{engine}-d{depth}-l{min_leaf}"))


def mine_trials(dataset, vocabulary, extras, depth, min_leaf=1):
    """One list per extra feature, mined with it as the last feature of the vocabulary, and the list without any.

    ``extras`` are (feature, column of its values). All trees grow in one job per level, and one more job gives the
    evidence of all leaves; each list equals that of :func:`mine_one` with its vocabulary.
    """
    shared, classes = len(vocabulary.features), vocabulary.set_features()
    wide = dataset.withColumn("values", F.concat("values", F.array(*[c.cast("double") for _, c in extras]).cast("array<double>")))
    rows = wide.select("values", label_index(classes).alias("label"))
    grown, plain = trees.fit_trials(rows, len(classes) + 1, shared, len(extras), depth, min_leaf)
    every = [*grown, plain]
    largest = max(len(t.nodes) for t in every)
    leaves = F.array(*[t.route() + k * largest for k, t in enumerate(every)])
    found = {r["leaf"]: r for r in leaf_evidence(wide.withColumn("leaf", F.explode(leaves)), classes).collect()}
    out = []
    for k, t in enumerate(every):
        own = Vocabulary([*vocabulary.features, *([extras[k][0]] if k < len(extras) else [])])
        mine = {leaf - k * largest: r for leaf, r in found.items() if leaf // largest == k}
        out.append(_mined(trees.alone(t, shared), own, mine, f"mined-d{depth}-l{min_leaf}"))
    return out[:-1], out[-1]


def _mined(fitted, vocabulary, rows, name):
    """The decision list of a tree from the evidence of its leaves."""
    conditions = leaf_conditions(fitted, vocabulary.features)
    found = DecisionList(name)
    evidence = []
    for k, (leaf, condition) in enumerate(conditions.items(), start=1):
        row = rows.get(leaf)
        if row is None or row["class"] == NO_LABEL:
            continue
        found.rules.append(
            Rule(f"rule{k}", len(conditions) - k, condition, Selector("target-in", E.ref(row["class"])))
        )
        evidence.append({"candidate": name, "rule": f"rule{k}", **{c: row[c] for c in EVIDENCE}})
    found.definitions.extend(vocabulary.closure(found.references()))
    found.validate()
    total = summarize_scores(rows.values())
    total.update(leaves=len(conditions), rules=len(found.rules), depth=fitted.depth())
    return Mined(name, found, evidence, total, fitted)


EVIDENCE = ("class", "support", "sound", "soundness", "label_matches", "occurrences", "win", "draw", "loss")


def summarize_scores(rows):
    """:func:`scores` for the few leaf rows already on the driver."""
    add = lambda c, keep=lambda r: True: sum(r[c] or 0 for r in rows if keep(r))
    rows = list(rows)
    n, held = add("support"), add("holdout_rows")
    share = lambda a, b: a / b if b else 0.0
    return {
        "train_rows": n, "holdout_rows": held,
        "train_accuracy": share(add("label_matches"), n), "train_soundness": share(add("sound"), n),
        "holdout_accuracy": add("holdout_correct") / held if held else None,
        "holdout_soundness": add("holdout_sound") / held if held else None,
        "fallback_rows": add("support", lambda r: r["class"] == NO_LABEL),
    }


LEARNED = ("values", "label", "qualifying", "occurrences", "value")


def stored_dataset(dataset, key):
    """The columns learning reads, written out once: every level and round scans them again."""
    return materialize(dataset.select(key, *LEARNED))


def mine(dataset, vocabulary, params=MineParams(), key="canonical_state", stored=False):
    """One candidate per requested depth over the same train/holdout split.

    ``stored`` says that ``dataset`` is already a plain table, so it need not be written out.
    """
    params.validate()
    dataset = dataset if stored else stored_dataset(dataset, key)
    holdout = None
    if params.holdout_fraction:
        holdout = holdout_condition(dataset, F.col(key), params.seed, params.holdout_fraction)
    deepest = 0 if 0 in params.depths else max(params.depths)
    whole = fit_tree(dataset, vocabulary, deepest, params.min_leaf, holdout) if params.engine == "cart" else None
    grown = lambda d: trees.cut(whole, d) if whole else None
    return [mine_one(dataset, vocabulary, d, params.min_leaf, holdout, params.engine, fitted=grown(d)) for d in params.depths]


HEX_DIGITS = 3


def holdout_condition(rows, key, seed, fraction):
    """Boolean column that is true for exactly floor(n * fraction) rows: the last ones in seeded order.

    ``key`` must be unique. The cut-off hash is found by radix selection: count rows per hash prefix,
    step into the prefix that holds the cut-off, repeat. At most 16^HEX_DIGITS counts reach the driver.
    """
    digest = seeded_hash(seed, key)
    hashed = rows.select(digest.alias("h"))
    prefix, wanted, at = "", None, 0
    while True:
        counts = (
            hashed.filter(F.col("h").startswith(prefix))
            .groupBy(F.substring("h", at + 1, HEX_DIGITS).alias("p"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"))
            .collect()
        )
        if wanted is None:
            wanted = math.floor(sum(r["n"] for r in counts) * fraction)
            if wanted == 0:
                return F.lit(False)
        for r in sorted(counts, key=lambda r: r["p"], reverse=True):
            if r["n"] >= wanted:
                break
            wanted -= r["n"]
        if r["n"] == wanted or len(prefix) >= 32 - HEX_DIGITS:
            return digest >= F.lit(r["low"])
        prefix, at = prefix + r["p"], at + HEX_DIGITS


def candidate_targets(selector, kinds, legal, scored=None):
    """Legal actions a selector keeps; ``scored`` names an array<struct(action, score)> for maximize."""
    if selector.select == "any-legal":
        return legal
    if selector.select == "target-in":
        return sets.intersection(legal, selector.expr.column(kinds))
    allowed = F.filter(scored, lambda s: F.array_contains(legal, s["action"]))
    top = F.array_max(F.transform(allowed, lambda s: s["score"]))
    return F.transform(F.filter(allowed, lambda s: s["score"] == top), lambda s: s["action"])


def apply_rules(rows, decisions, legal="legal", scored=None):
    """Add ``fired`` (rule name, ``fallback`` or ``any-legal``) and ``candidates`` (allowed actions).

    A rule fires when its condition holds and its selector keeps at least one legal action. ``scored``
    maps a rule name (or ``fallback``) of a maximize selector to its scored-successor column.
    """
    kinds = decisions.definitions.kinds()
    rows = decisions.definitions.evaluate(rows)
    legal = F.col(legal)
    scored = scored or {}
    chosen = None
    steps = [(r.name, r.condition.column(kinds), r.action) for r in decisions.ordered()]
    steps.append(("fallback", F.lit(True), decisions.fallback))
    for name, holds, action in steps:
        targets = candidate_targets(action, kinds, legal, scored.get(name))
        hit = holds & (F.size(targets) > 0)
        entry = F.struct(F.lit(name).alias("fired"), targets.alias("candidates"))
        chosen = F.when(hit, entry) if chosen is None else chosen.when(hit, entry)
    chosen = chosen.otherwise(F.struct(F.lit("any-legal").alias("fired"), legal.alias("candidates")))
    return rows.withColumn("_c", chosen).withColumns(
        {"fired": F.col("_c.fired"), "candidates": F.col("_c.candidates")}
    ).drop("_c")


def scored_successors(edges, features, vocabulary, expr, state="state"):
    """Scores of every legal action: ``edges`` (state, action, next) joined to the features of ``next``.

    The value is read in the successor, so from the next mover's view. One state's actions are few. A successor without
    features is an error when the scores are read: no legal action may be lost.
    """
    score = expr.column(vocabulary.kinds()).cast("double")
    valued = vocabulary.evaluate(features).select(F.col(state).alias("next"), score.alias("score"))
    told = F.when(F.col("score").isNotNull(), F.col("score")).otherwise(
        F.raise_error(F.concat(F.lit("no features for the successor "), F.col("next").cast("string"))).cast("double")
    )
    return (
        edges.join(valued, "next", "left")
        .groupBy(state)
        .agg(F.array_sort(F.collect_list(F.struct("action", told.alias("score")))).alias("scored"))
    )


def choose(rows, seed, key):
    """Add ``action``: one candidate picked by seed and row key."""
    number = F.conv(F.substring(seeded_hash(seed, key), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("action", F.element_at("candidates", (number % F.size("candidates") + 1).cast("int")))
