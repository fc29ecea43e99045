"""Named analyzers over a corpus, run in a checked order."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import dataset as D
from ..operators import induce as I
from ..operators import plugins as G
from ..operators import rules as R
from ..operators import summary as S
from ..operators import usage as U
from ..operators.features import Vocabulary
from ..session import materialize
from ..sources.runs import write_results


@dataclass
class Inputs:
    """What analyzers read: steps and sequences with states, annotations, and collapsed labelled states."""

    steps: DataFrame
    sequences: DataFrame
    annotations: DataFrame | None = None
    states: DataFrame | None = None


@dataclass
class Options:
    """``generate`` names the generators of the registry ``generators`` that ``mine`` runs; none: the exact tree."""

    thresholds: S.Thresholds = S.Thresholds()
    known_canonical: int | None = None
    vocabulary: Vocabulary | None = None
    induction: I.InductionParams | None = None
    mining: R.MineParams = R.MineParams()
    key: str = "canonical_state"
    generators: G.Registry | None = None
    generate: tuple = ()


@dataclass
class Results:
    """Outputs by analyzer name, and the objects later analyzers build on."""

    tables: dict = field(default_factory=dict)
    dataset: DataFrame | None = None
    vocabulary: Vocabulary | None = None
    mined: list = field(default_factory=list)
    checks_pass: bool = True


@dataclass(frozen=True)
class Analyzer:
    name: str
    description: str
    run: Callable
    requires_annotations: bool = False


def _summary(inputs, options, results):
    states = S.distinct_states(inputs.steps, inputs.sequences)
    gates = S.diversity_gates(S.diversity_metrics(inputs.sequences, states, options.known_canonical), options.thresholds)
    results.checks_pass &= S.checks_pass(gates).collect()[0][0]
    results.tables["outcomes"] = S.outcome_grouping_sets(inputs.sequences, ["pairing", "length"])
    return gates


def _agreement(inputs, options, results):
    A.require_coverage(inputs.steps, inputs.annotations)
    return A.agreement_report(inputs.steps, inputs.annotations)


def _dataset(inputs, options, results):
    if options.vocabulary is None or inputs.states is None:
        raise ValueError("analyzer `dataset` requires a vocabulary and collapsed states")
    D.require_rows(inputs.states)
    results.vocabulary = options.vocabulary
    results.dataset = materialize(D.build_dataset(inputs.states, options.vocabulary))
    return results.dataset


def _need_dataset(results, name):
    if results.dataset is None:
        raise ValueError(f"analyzer `{name}` requires the `dataset` analyzer to run first")


def _concepts(inputs, options, results):
    if options.induction is None:
        raise ValueError("analyzer `concepts` requires induction parameters")
    _need_dataset(results, "concepts")
    found = I.induce_concepts(results.dataset, results.vocabulary, options.induction, options.key, stored=True)
    results.dataset, results.vocabulary = found.dataset, found.vocabulary
    rows = [(c.name, c.definition(), c.round, c.train_gain, c.holdout_gain, c.rules_before, c.rules_after,
             c.soundness_before, c.soundness_after) for c in found.concepts]
    return inputs.steps.sparkSession.createDataFrame(
        rows, "name string, definition string, round int, train_gain double, holdout_gain double, rules_before int, "
        "rules_after int, soundness_before double, soundness_after double",
    )


def _mine(inputs, options, results):
    _need_dataset(results, "mine")
    tree = G.tree_generator(options.mining, options.key, stored=True)
    generators, names = (options.generators, options.generate) if options.generate else (G.Registry("generator", [tree]), [tree.name])
    results.mined = G.generate(results.dataset, results.vocabulary, generators, names, options.mining.seed)
    return evidence_frame(inputs.steps.sparkSession, results.mined)


def evidence_frame(spark, mined):
    rows = [
        (e["candidate"], e["rule"], rule.priority, rule.condition.text(), *[e[c] for c in R.EVIDENCE])
        for m in mined for e, rule in zip(m.evidence, m.decisions.rules)
    ]
    kinds = {"class": "string", "soundness": "double"}
    return spark.createDataFrame(
        rows, "candidate string, rule string, priority int, condition string, "
        + ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in R.EVIDENCE),
    )


def usage_frames(spark, mined):
    """(references, definitions) of mined lists as long tables."""
    refs = [(m.name, n) for m in mined for n in m.decisions.references()]
    defined = [(m.name, f.name, f.tier, k) for k, m in enumerate(mined) for f in m.decisions.definitions.features]
    return (
        spark.createDataFrame(refs, "candidate string, feature string"),
        spark.createDataFrame(defined, "candidate string, feature string, tier string, ord int"),
    )


def _vocabulary(inputs, options, results):
    if not results.mined:
        raise ValueError("analyzer `vocabulary` requires the `mine` analyzer to run first")
    refs, defined = usage_frames(inputs.steps.sparkSession, results.mined)
    overall = U.overall_usage(refs, defined).select(F.lit("overall").alias("candidate"), "*")
    return U.candidate_usage(refs, defined).unionByName(overall)


REGISTRY = {
    a.name: a
    for a in (
        Analyzer("summary", "outcome tallies and diversity gates", _summary),
        Analyzer("agreement", "agreement of played actions with labels, by actor and ply", _agreement, True),
        Analyzer("dataset", "labelled feature dataset of canonical states", _dataset, True),
        Analyzer("concepts", "boolean concepts induced over the dataset", _concepts, True),
        Analyzer("mine", "decision lists mined from the dataset", _mine, True),
        Analyzer("vocabulary", "use of given and invented features by mined lists", _vocabulary),
    )
}
ORDER = ("dataset", "concepts", "mine", "vocabulary")


def validate(names, registry=None):
    """Known, unrepeated, non-empty, and in the order their results are needed."""
    registry = registry or REGISTRY
    if not names:
        raise ValueError("the list of analyzers is empty")
    for i, name in enumerate(names):
        if name not in registry:
            raise ValueError(f"no analyzer is called `{name}`; known are {', '.join(sorted(registry))}")
        if name in names[:i]:
            raise ValueError(f"analyzer `{name}` is listed more than once")
    at = [names.index(n) for n in ORDER if n in names]
    if at != sorted(at):
        raise ValueError("analyzers go in this order: " + " < ".join(ORDER))


def analyze(inputs, names=("summary",), options=None, registry=None):
    """Run the named analyzers in order; outputs stay lazy DataFrames wherever they can."""
    registry = registry or REGISTRY
    options = options or Options()
    names = list(names)
    validate(names, registry)
    results = Results()
    for name in names:
        if registry[name].requires_annotations and inputs.annotations is None:
            raise ValueError(f"analyzer `{name}` requires annotations")
        results.tables[name] = registry[name].run(inputs, options, results)
    return results


def analyze_run(path, run_id, inputs, names=("summary",), options=None, registry=None):
    """:func:`analyze`, with every output and the manifest written below ``path``; returns (results, rows by output)."""
    results = analyze(inputs, names, options, registry)
    return results, write_results(path, run_id, results.tables)
