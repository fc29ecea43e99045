"""A user's own canonicalisers, feature extractors and candidate generators, checked before they are used.

What can be seen in the plan (columns there, kinds against Spark types, names declared once) is an error before any
job. What depends on a row (a permutation that isn't one, an image that it doesn't lead to) is an error of that row, and
:func:`frame_faults` lists such rows instead of failing.
"""

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ..functions import symmetry
from ..functions.expr import FeatureError
from . import rules as R
from .features import Vocabulary, check_kinds


class Registry:
    """Plug-ins of one sort by name; a name is given once and the order is kept."""

    def __init__(self, sort, plugins=()):
        self.sort, self._known = sort, {}
        for plugin in plugins:
            self.add(plugin)

    def add(self, plugin):
        if plugin.name in self._known:
            raise ValueError(f"{self.sort} `{plugin.name}` is registered already")
        self._known[plugin.name] = plugin
        return self

    def get(self, name):
        if name not in self._known:
            raise ValueError(f"no {self.sort} is called `{name}`; known are {', '.join(self._known) or 'none'}")
        return self._known[name]

    def names(self):
        return list(self._known)


@dataclass(frozen=True)
class Extractor:
    """``definitions``: native features (name, tier, kind) in output order. ``extract``: DataFrame -> {name: Column}."""

    name: str
    definitions: tuple
    extract: Callable


@dataclass(frozen=True)
class Canonicaliser:
    """``frame``: column of cells -> struct column with ``image`` (the cells of the representative) and ``permutation``.

    Cell ``i`` of a state is cell ``permutation[i]`` of its image. Further struct fields are allowed.
    """

    name: str
    frame: Callable


@dataclass(frozen=True)
class Generator:
    """``generate``: (dataset, vocabulary, seed) -> list of :class:`~stepgrove.operators.rules.Mined`."""

    name: str
    generate: Callable


def group_canonicaliser(name, group, code=lambda image: image):
    """The least image over a symmetry group."""
    return Canonicaliser(name, lambda cells: symmetry.canonical_form(cells, group, code))


def _places(cells):
    """0, 1, ... for every cell; empty for null or no cells."""
    none = F.array().cast("array<int>")
    return F.when(F.size(cells) > 0, F.sequence(F.lit(0), F.size(cells) - 1)).otherwise(none)


def _lead_to(frame, cells):
    """If the permutation is one of all cells and carries them to the image; null cells must have a null frame or an empty one."""
    permutation, image = frame["permutation"], frame["image"]
    moved = F.transform(_places(cells), lambda j: F.get(cells, (F.array_position(permutation, j) - 1).cast("int")))
    whole = F.array_sort(permutation).eqNullSafe(_places(cells))
    return F.when(cells.isNull(), image.isNull()).otherwise(whole & moved.eqNullSafe(image))


def canonical_frame(rows, cells, canonicaliser=None, name="_frame"):
    """``rows`` with the struct ``name``: image and permutation of the array column ``cells``.

    Without a canonicaliser the cells are their own image under the identity. A frame without the two fields, or with an image of
    another type than the cells, is an error at once; a row whose permutation does not lead from its cells to its image is
    an error when it is computed. Null cells have a null image and an empty permutation.
    """
    if name in rows.columns:
        raise FeatureError(f"the rows have a column `{name}` already")
    column = F.col(f"`{cells}`")
    if canonicaliser is None:
        return rows.withColumn(name, F.struct(column.alias("image"), _places(column).alias("permutation")))
    made = canonicaliser.frame(column)
    kinds = dict(rows.select(made.alias("f")).select("f.*").dtypes)
    want = {"image": (dict(rows.dtypes)[cells],), "permutation": ("array<int>", "array<bigint>")}
    for field, types in want.items():
        if kinds.get(field) not in types:
            raise FeatureError(f"canonicaliser `{canonicaliser.name}`: {field} is {kinds.get(field, 'missing')}, not {types[0]}")
    image = made["image"].alias("image")
    frame = F.when(column.isNotNull(), F.struct(image, made["permutation"].cast("array<int>").alias("permutation")))
    frame = F.coalesce(frame, F.struct(F.lit(None).cast(want["image"][0]).alias("image"), _places(column).alias("permutation")))
    wrong = F.raise_error(F.lit(f"canonicaliser `{canonicaliser.name}`: the permutation does not lead to the image"))
    framed = rows.withColumn(name, frame)
    return framed.withColumn(name, F.when(_lead_to(F.col(name), column), F.col(name)).otherwise(wrong))


def frame_faults(rows, cells, canonicaliser):
    """Rows that the canonicaliser gets wrong, with ``fault``: ``permutation``, or ``not idempotent`` where the image has
    another image, or reaches itself by a permutation that isn't the identity. Must be empty."""
    column = F.col(f"`{cells}`")
    framed = rows.filter(column.isNotNull()).withColumn("_frame", canonicaliser.frame(column))
    image = F.col("_frame")["image"]
    again = framed.withColumn("_again", canonicaliser.frame(image))
    still = F.col("_again")["image"].eqNullSafe(image) & F.col("_again")["permutation"].cast("array<int>").eqNullSafe(_places(image))
    first = F.struct(image.alias("image"), F.col("_frame")["permutation"].cast("array<int>").alias("permutation"))
    fault = F.when(~F.coalesce(_lead_to(first, column), F.lit(False)), "permutation").when(~F.coalesce(still, F.lit(False)), "not idempotent")
    return again.withColumn("fault", fault).filter("fault is not null").drop("_frame", "_again")


def extract(rows, extractors):
    """``rows`` with the features of every extractor, and the vocabulary that declares them.

    An extractor gives exactly the columns it declares, each of a Spark type that its kind allows; a name that another
    extractor or the rows have is an error. All of this is checked on the plan.
    """
    vocabulary, columns = Vocabulary(), {}
    for extractor in extractors:
        found = extractor.extract(rows)
        declared = [d.name for d in extractor.definitions]
        for missing in (n for n in declared if n not in found):
            raise FeatureError(f"extractor `{extractor.name}`: feature `{missing}` missing from extraction")
        for extra in (n for n in found if n not in declared):
            raise FeatureError(f"extractor `{extractor.name}`: feature `{extra}` is not declared")
        for d in extractor.definitions:
            if d.expr is not None or d.column is not None:
                raise FeatureError(f"extractor `{extractor.name}`: `{d.name}` must be declared without a column or an expression")
            if d.name in rows.columns:
                raise FeatureError(f"extractor `{extractor.name}`: the rows have a column `{d.name}` already")
            vocabulary.push(d)
            columns[d.name] = found[d.name]
    return check_kinds(rows.withColumns(columns) if columns else rows, vocabulary.kinds()), vocabulary


def featurise(rows, cells, extractors, canonicaliser=None, positions=(), derived=()):
    """(featured rows, vocabulary): states carried into their canonical frame, then featurised there.

    ``positions`` are array columns of positions of ``rows`` (legal, optimal) that move with the cells; one that is null
    or that the cells don't have is an error. The permutation stays in the column ``permutation``. ``derived`` are
    features over those of the extractors.
    """
    framed = canonical_frame(rows, cells, canonicaliser)
    permutation = F.col("_frame")["permutation"]
    moved = {p: symmetry.checked_positions(F.col(f"`{p}`"), permutation) for p in positions}
    framed = framed.withColumns({**moved, cells: F.col("_frame")["image"], "permutation": permutation}).drop("_frame")
    featured, vocabulary = extract(framed, extractors)
    vocabulary.extend(derived)
    return vocabulary.evaluate(featured), vocabulary


def generate(dataset, vocabulary, generators, names, seed=0):
    """Candidates of the named generators, in order. Every list is valid for ``vocabulary`` and every name is given once."""
    out = []
    for name in names:
        for candidate in generators.get(name).generate(dataset, vocabulary, seed):
            if any(candidate.name == c.name for c in out):
                raise ValueError(f"generator `{name}`: candidate `{candidate.name}` is given already")
            candidate.decisions.validate(vocabulary.names())
            out.append(candidate)
    if not out:
        raise ValueError("the generators gave no candidate")
    return out


def tree_generator(params, key="canonical_state", name="tree", stored=False):
    """Decision lists cut from the exact tree; the seed given replaces that of ``params``."""
    return Generator(name, lambda dataset, vocabulary, seed: R.mine(dataset, vocabulary, replace(params, seed=seed), key, stored))
