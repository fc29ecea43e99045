"""Concept induction: boolean features invented by information gain, promoted by a mining probe.

Rows are never copied per candidate. One pass counts, for every candidate (or pair of beam members), how
many rows of each target make it true, together with a linear fingerprint of its truth vector. Counts of
``not``, ``and`` and ``or`` follow from those sums, so the driver only sees numbers per candidate.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as E
from . import rules as R
from .features import Feature, Vocabulary, boolify, encode

SKIPPED_ATOM = "side_to_move"
FINGERPRINT_PARTS, PART_BITS = 6, 21


@dataclass(frozen=True)
class InductionParams:
    rounds: int = 2
    max_thresholds: int = 4
    beam: int = 64
    top_k: int = 8
    max_promoted: int = 4
    min_train_gain: float = 0.01
    min_holdout_gain: float = 0.005
    holdout_fraction: float = 0.25
    probe_depth: int = 6
    soundness_tolerance: float = 0.005
    min_soundness_gain: float = 0.001
    compare_atoms: bool = False
    seed: int = 0

    def validate(self):
        for name in ("rounds", "max_thresholds", "beam", "top_k", "max_promoted"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be >= 1")
        for name in ("min_train_gain", "min_holdout_gain", "soundness_tolerance", "min_soundness_gain"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must be >= 0")
        if not 0.0 <= self.holdout_fraction < 1.0:
            raise ValueError("holdout_fraction must be in [0, 1)")
        return self


# --- gain as DataFrame operators -------------------------------------------------------------------


def entropy_bits(counts_by, rows, count="n"):
    """Entropy in bits of the counts in ``rows`` inside each ``counts_by`` group, with the group size."""
    w = Window.partitionBy(*counts_by)
    p = F.col(count) / F.sum(count).over(w)
    term = F.when(F.col(count) > 0, -p * F.log2(p)).otherwise(F.lit(0.0))
    return rows.select(*counts_by, count, term.alias("_h")).groupBy(*counts_by).agg(
        F.sum("_h").alias("entropy"), F.sum(count).alias("size")
    )


def info_gain(rows, candidate, bit, target):
    """Information gain of boolean ``bit`` about ``target`` per ``candidate`` (long rows)."""
    counts = rows.groupBy(candidate, bit, target).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(candidate, target).agg(F.sum("n").alias("n"))
    base = entropy_bits([candidate], whole).select(candidate, F.col("entropy").alias("base"), F.col("size").alias("total"))
    split = entropy_bits([candidate, bit], counts)
    joined = split.join(base, candidate)
    inside = F.sum(F.col("entropy") * F.col("size") / F.col("total"))
    return joined.groupBy(candidate).agg((F.max("base") - inside).alias("gain"))


def equal_candidates(rows, candidate, row_key, bit):
    """First candidate (lowest id) with the same truth vector, per candidate of long (candidate, row, bit) rows.

    Truth vectors are compared by size and two 64-bit linear fingerprints; constants are marked.
    """
    true = F.col(bit)
    h = lambda salt: F.sum(F.when(true, F.xxhash64(F.lit(salt), row_key)).otherwise(0).cast("decimal(38,0)"))
    prints = rows.groupBy(candidate).agg(
        F.count_if(true).alias("n_true"), F.count(F.lit(1)).alias("n"), h("a").alias("h1"), h("b").alias("h2")
    )
    firsts = prints.groupBy("n_true", "h1", "h2").agg(F.min(candidate).alias("first_equal"))
    constant = (F.col("n_true") == 0) | (F.col("n_true") == F.col("n"))
    return prints.join(firsts, ["n_true", "h1", "h2"]).select(
        candidate, "first_equal", "n_true", constant.alias("is_constant")
    )


def smallest_values(rows, k):
    """The k smallest distinct values per position of ``values``, in one pass: the tasks keep k per position each."""

    def least(batches):
        found = {}
        for batch in batches:
            if len(batch):
                for j, column in enumerate(np.stack(batch["values"].to_numpy()).T):
                    found[j] = np.unique(np.concatenate((found.get(j, column[:0]), column)))[:k]
        for j, values in found.items():
            yield pd.DataFrame({"column": j, "value": values})

    few = rows.select("values").mapInPandas(least, "column int, value double").distinct()
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    out = {}
    for r in few.withColumn("rank", rank).filter(F.col("rank") <= k).orderBy("column", "value").collect():
        out.setdefault(r["column"], []).append(r["value"])
    return out


# --- counting pass ---------------------------------------------------------------------------------


def _fingerprint_parts():
    """Random 21-bit integers per feature pattern, from two hashes of the values."""
    out = []
    for h in (F.xxhash64("values", "label", "target"), F.xxhash64(F.lit("second"), "values", "label", "target")):
        for i in range(FINGERPRINT_PARTS // 2):
            out.append(F.shiftright(h, PART_BITS * i).bitwiseAND(F.lit(2**PART_BITS - 1)))
    return F.array(*out)


def _counter(pairs):
    """Per partition: sums of bit products by (split, target, label), and by fingerprint weight."""

    def count(batches):
        sums = {}
        for batch in batches:
            if not len(batch):
                continue
            bits = np.stack(batch["bits"].to_numpy()).astype(np.float64)
            parts = np.stack(batch["parts"].to_numpy()).astype(np.float64)
            groups = [(("f", k, 0), parts[:, k]) for k in range(parts.shape[1])]
            for kind in ("target", "label"):
                held, found = batch["held"].to_numpy(), batch[kind].to_numpy()
                for h in np.unique(held):
                    for c in np.unique(found[held == h]):
                        groups.append(((kind[0], int(c), int(h)), ((found == c) & (held == h)).astype(np.float64)))
            for key, weight in groups:
                weighted = bits * weight[:, None]
                got = weighted.T @ bits if pairs else weighted.sum(axis=0)
                got = np.rint(got).astype(np.int64)
                sums[key] = sums[key] + got if key in sums else got
        for (kind, target, held), total in sums.items():
            total = np.triu(total) if pairs else total
            at = np.nonzero(total)
            i, j = (at[0], at[1]) if pairs else (at[0], at[0])
            yield pd.DataFrame({"kind": kind, "target": target, "held": held, "i": i, "j": j, "n": total[at]})

    return count


def count_bits(rows, bits, pairs=False):
    """Sums over rows of bit_i (or bit_i * bit_j) per target, label, split and fingerprint part.

    ``rows`` carry values, target, label and held. Returned as {(i, j): {(kind, target, held): n}};
    one entry per candidate or beam pair. The candidate after the last one is constantly true.
    """
    every = F.array(*[b.cast("tinyint") for b in bits], F.lit(1).cast("tinyint"))
    table = rows.select(
        every.alias("bits"), _fingerprint_parts().alias("parts"), "target", "label", F.col("held").cast("int").alias("held")
    ).mapInPandas(_counter(pairs), "kind string, target int, held int, i int, j int, n bigint")
    out = {}
    for r in table.groupBy("i", "j", "kind", "target", "held").agg(F.sum("n").alias("n")).collect():
        out.setdefault((r["i"], r["j"]), {})[(r["kind"], r["target"], r["held"])] = r["n"]
    return out


def _minus(a, b):
    return {k: a.get(k, 0) - b.get(k, 0) for k in set(a) | set(b)}


def _plus(a, b):
    return {k: a.get(k, 0) + b.get(k, 0) for k in set(a) | set(b)}


def _entropy(counts):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in sorted(counts) if c > 0) if n else 0.0


def _gain(inside, total, kind, held):
    cells = sorted(k for k in total if k[0] == kind and k[2] == held)
    whole = [total[k] for k in cells]
    true = [inside.get(k, 0) for k in cells]
    false = [w - t for w, t in zip(whole, true)]
    n = sum(whole)
    if n == 0:
        return 0.0
    return _entropy(whole) - (sum(false) / n * _entropy(false) + sum(true) / n * _entropy(true))


def _fingerprint(sums):
    return tuple(sums.get(("f", k, 0), 0) for k in range(FINGERPRINT_PARTS))


def _size(sums):
    return sum(n for k, n in sums.items() if k[0] == "t")


@dataclass
class Candidate:
    expr: E.Expr
    sums: dict
    train_gain: float
    holdout_gain: float | None
    seq: int

    def rank(self):
        """Shortlist order; gains are rounded so equal gains tie whatever order their terms were added in."""
        shown = self.train_gain if self.holdout_gain is None else self.holdout_gain
        return (-round(shown, 12), -round(self.train_gain, 12), self.seq)


@dataclass
class Round:
    """Counters of one enumeration pass and its shortlist."""

    enumerated: int = 0
    deduplicated: int = 0
    scored: int = 0
    passed: int = 0
    shortlist: list = field(default_factory=list)


def atoms(features):
    """Column position, expression and kind of every feature usable as an atom."""
    out = []
    for j, f in enumerate(features):
        if f.name != SKIPPED_ATOM and f.kind in ("bool", "int", "set"):
            out.append((j, E.count(E.ref(f.name)) if f.kind == "set" else E.ref(f.name), f.kind))
    return out


def level_one(features, thresholds, compare_atoms):
    """(expression, bit column over ``values``) of the level-1 candidates in enumeration order."""
    value = lambda j: F.element_at("values", j + 1)
    found = atoms(features)
    numeric = [(j, e) for j, e, kind in found if kind != "bool"]
    out = [(e, value(j) != 0.0) for j, e, kind in found if kind == "bool"]
    for j, e in numeric:
        cuts = [int(v) for v in thresholds.get(j, [])]
        out += [(E.compare("eq", e, E.const(t)), value(j) == float(t)) for t in cuts]
        out += [(E.compare("ge", e, E.const(t)), value(j) >= float(t)) for t in cuts[1:]]
    if compare_atoms:
        out += [(E.compare("gt", a, b), value(i) > value(j)) for i, a in numeric for j, b in numeric if i != j]
    return out


def enumerate_and_score(rows, features, params):
    """One round: enumerate, drop constants and equal truth vectors, score, shortlist.

    ``rows`` carry values, target, label and held (boolean).
    """
    found = Round()
    thresholds = smallest_values(rows.filter(~F.col("held")), params.max_thresholds)
    first = level_one(features, thresholds, params.compare_atoms)
    counted = count_bits(rows, [bit for _, bit in first])
    total = counted[(len(first), len(first))]
    n = _size(total)
    has_holdout = any(k[2] == 1 for k in total)
    seen = set()

    def admit(expr, sums):
        seq = found.enumerated
        found.enumerated += 1
        key = _fingerprint(sums)
        if _size(sums) in (0, n) or key in seen:
            found.deduplicated += 1
            return None
        seen.add(key)
        found.scored += 1
        gain = lambda held: max(_gain(sums, total, "t", held), _gain(sums, total, "l", held))
        train, holdout = gain(0), gain(1) if has_holdout else None
        if train < params.min_train_gain or (holdout is not None and holdout < params.min_holdout_gain):
            return None
        found.passed += 1
        return Candidate(expr, sums, train, holdout, seq)

    one = []
    bits = {}
    for i, (expr, bit) in enumerate(first):
        c = admit(expr, counted.get((i, i), {}))
        if c:
            one.append(c)
            bits[c.seq] = bit
    beam = sorted(one, key=lambda c: (-round(c.train_gain, 12), c.seq))[: params.beam]
    two = [admit(E.negate(c.expr), _minus(total, c.sums)) for c in beam]
    if len(beam) > 1:
        joint = count_bits(rows, [bits[c.seq] for c in beam], pairs=True)
        for i, a in enumerate(beam):
            for j in range(i + 1, len(beam)):
                b, both = beam[j], joint.get((i, j), {})
                two.append(admit(E.all_of(a.expr, b.expr), both))
                two.append(admit(E.any_of(a.expr, b.expr), _minus(_plus(a.sums, b.sums), both)))
    passed = one + [c for c in two if c]
    found.shortlist = sorted(passed, key=Candidate.rank)[: params.top_k]
    return found


def promotion_accepts(referenced, before_rules, after_rules, before_soundness, after_soundness, params):
    """A concept must be used, and either shorten the list at equal soundness or make it sounder."""
    shorter = after_rules < before_rules and after_soundness >= before_soundness - params.soundness_tolerance
    sounder = after_rules <= before_rules and after_soundness >= before_soundness + params.min_soundness_gain
    return referenced and (shorter or sounder)


def similarity(rows, concept_bit, targets):
    """Share of rows where a concept equals each given feature's truth, best first.

    ``targets`` maps a feature name to (column, kind).
    """
    shares = [
        F.coalesce(F.avg((concept_bit == boolify(c, kind)).cast("double")), F.lit(0.0)).alias(f"_a{i}")
        for i, (c, kind) in enumerate(targets.values())
    ]
    one = rows.agg(*shares)
    entries = [F.struct(F.lit(n).alias("feature"), F.col(f"_a{i}").alias("agreement")) for i, n in enumerate(targets)]
    return (
        one.select(F.explode(F.array(*entries)).alias("s"))
        .select("s.*")
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("agreement"), "feature")))
    )


@dataclass
class Concept:
    name: str
    expr: E.Expr
    round: int
    train_gain: float
    holdout_gain: float | None
    rules_before: int
    rules_after: int
    soundness_before: float
    soundness_after: float

    def definition(self):
        return f"{self.name} [tier-3] = {self.expr.text()} -- invented concept (round {self.round})"


@dataclass
class Induction:
    rounds: list
    outcomes: list
    concepts: list
    vocabulary: Vocabulary
    dataset: object


def induce_concepts(dataset, vocabulary, params=InductionParams(), key="canonical_state", stored=False):
    """Greedy rounds: enumerate, probe each shortlisted concept with a mined list, promote what helps.

    ``dataset`` holds values, label, qualifying, occurrences and value (-1, 0, 1). A promoted concept is
    appended to ``values`` and to the vocabulary, so later rounds can build on it. All concepts that a round has
    left are probed together, again after each promotion. ``stored`` says that ``dataset`` is already a plain table.
    """
    params.validate()
    dataset = dataset if stored else R.stored_dataset(dataset, key)
    classes = vocabulary.set_features()
    held = F.lit(False)
    if params.holdout_fraction:
        held = R.holdout_condition(dataset, F.col(key), params.seed, params.holdout_fraction)
    current = dataset.withColumn("_held", held)
    given = Vocabulary(list(vocabulary.features))
    out = Induction([], [], [], given, dataset)

    for round_ in range(1, params.rounds + 1):
        rows = current.select(
            "values", (F.col("value") + 1).cast("int").alias("target"),
            R.label_index(classes).alias("label"), F.col("_held").alias("held"),
        )
        found = enumerate_and_score(rows, given.features, params)
        out.rounds.append({"round": round_, "columns": len(given.features), "enumerated": found.enumerated,
                           "deduplicated": found.deduplicated, "scored": found.scored, "passed": found.passed,
                           "shortlisted": len(found.shortlist), "promoted": 0})
        if not found.shortlist:
            break
        name = lambda: f"concept_{len(out.concepts) + 1}"
        invented = lambda c: Feature(name(), "invented", "bool", f"invented concept (round {round_})", None, c.expr)
        promoted, prints, left, after = 0, set(), list(found.shortlist), {}
        while left and promoted < params.max_promoted:
            c = left[0]
            entry = {"round": round_, "expr": c.expr.text(), "train_gain": c.train_gain, "holdout_gain": c.holdout_gain}
            if _fingerprint(c.sums) in prints:
                out.outcomes.append({**entry, "outcome": "duplicate"})
                left.pop(0)
                continue
            if not after:  # all that are left are tried at once over the features of now
                tried = [x for x in left if _fingerprint(x.sums) not in prints]
                extras = [(invented(x), encode(on_values(x.expr, given), "bool")) for x in tried]
                probed, plain = R.mine_trials(current, given, extras, params.probe_depth)
                before, after = plain.scores, {x.seq: p for x, p in zip(tried, probed)}
            left.pop(0)
            mined, feature = after[c.seq], invented(c)
            accepted = promotion_accepts(
                feature.name in mined.decisions.references(), before["rules"], mined.scores["rules"],
                before["train_soundness"], mined.scores["train_soundness"], params,
            )
            out.outcomes.append({**entry, "outcome": f"promoted:{feature.name}" if accepted else "rejected-downstream"})
            if accepted:
                out.concepts.append(Concept(
                    feature.name, c.expr, round_, c.train_gain, c.holdout_gain, before["rules"], mined.scores["rules"],
                    before["train_soundness"], mined.scores["train_soundness"],
                ))
                current = current.withColumn("values", F.concat("values", F.array(encode(on_values(c.expr, given), "bool"))))
                given = Vocabulary(list(given.features)).push(feature)
                prints.add(_fingerprint(c.sums))
                promoted, after = promoted + 1, {}
        out.rounds[-1]["promoted"] = promoted
        if promoted == 0:
            break
    out.vocabulary, out.dataset = given, current.drop("_held")
    return out


def on_values(expr, vocabulary):
    """An expression over bool, int and counted set features, read from the ``values`` array."""
    index = {f.name: i for i, f in enumerate(vocabulary.features)}
    kinds = vocabulary.kinds()

    def number(e):
        if e.op == "count":
            return F.element_at("values", index[e.args[0].value] + 1)
        if e.op == "ref":
            return F.element_at("values", index[e.value] + 1)
        return F.lit(float(e.value))

    def truth(e):
        if e.op == "not":
            return ~truth(e.args[0])
        if e.op in ("and", "or"):
            a, b = (truth(x) for x in e.args)
            return a & b if e.op == "and" else a | b
        if e.op == "cmp":
            a, b = number(e.args[0]), number(e.args[1])
            return {"eq": a == b, "ge": a >= b, "gt": a > b}[e.operator]
        return number(e) != 0.0

    expr.kind(kinds)
    return truth(expr)
