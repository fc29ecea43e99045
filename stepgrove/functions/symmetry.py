"""Permutations of array positions. A group is a list of permutations, identity first.

``p[i]`` is the position that element ``i`` moves to.
"""

import json

from pyspark.sql import functions as F


def inverse(permutation):
    out = [0] * len(permutation)
    for i, p in enumerate(permutation):
        out[p] = i
    return out


def permute(cells, permutation):
    """Array with ``out[p[i]] = cells[i]``."""
    return F.array(*[F.element_at(cells, i + 1) for i in inverse(permutation)])


def group_literal(group):
    """The group as an array<struct(perm, back)> constant, ``back`` being the inverse."""
    table = [{"perm": list(g), "back": inverse(g)} for g in group]
    return F.from_json(F.lit(json.dumps(table)), "array<struct<perm: array<int>, back: array<int>>>")


def canonical_form(cells, group, code=lambda image: image):
    """struct(code, ord, image, permutation) of the least image over the group.

    Ties keep the earlier group element, so the identity (first) wins over every other. An empty group
    leaves the cells as they are.
    """
    if not group:
        same = F.sequence(F.lit(0), F.size(cells) - 1)
        return F.struct(code(cells).alias("code"), F.lit(0).alias("ord"), cells.alias("image"), same.alias("permutation"))

    def option(g, k):
        image = F.transform(g["back"], lambda i: F.element_at(cells, i + 1))
        return F.struct(code(image).alias("code"), k.alias("ord"), image.alias("image"), g["perm"].alias("permutation"))

    return F.array_min(F.transform(group_literal(group), option))


def digits_code(cells, symbols):
    """Base-n number of the cells, most significant first; a cell not in ``symbols`` counts as 0."""
    names = F.array(*[F.lit(s) for s in symbols])
    base = len(symbols) + 1
    digit = lambda x: F.coalesce(F.array_position(names, x), F.lit(0).cast("bigint"))
    return F.aggregate(cells, F.lit(0).cast("bigint"), lambda acc, x: acc * base + digit(x))


def move_positions(positions, permutation):
    """Positions carried through a permutation column, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.transform(positions, lambda p: F.element_at(permutation, p + 1))))


def checked_positions(positions, permutation):
    """:func:`move_positions`, where a position that is null or that the permutation lacks is an error; null stays null."""
    known = lambda p: p.isNotNull() & (p >= 0) & (p < F.size(permutation))
    wrong = F.raise_error(F.lit("a position has no place under the permutation"))
    return F.when(positions.isNull() | F.forall(positions, lambda p: F.coalesce(known(p), F.lit(False))), move_positions(positions, permutation)).otherwise(wrong)


def move_back(positions, permutation):
    """Positions carried through the inverse of a permutation column."""
    return F.array_sort(F.transform(positions, lambda p: (F.array_position(permutation, p) - 1).cast("int")))


def least_image(positions, group):
    """Least sorted image of a position set over the group: equal exactly for sets in one orbit."""

    image = lambda g: F.array_sort(F.transform(positions, lambda p: F.element_at(g["perm"], p + 1)))
    return F.array_min(F.transform(group_literal(group), image))


def orbit_of(position, group):
    """Index of the orbit that holds ``position``; orbits are ordered by their least member."""
    n = len(group[0])
    least = [min(g[i] for g in group) for i in range(n)]
    rank = {m: k for k, m in enumerate(sorted(set(least)))}
    return F.element_at(F.array(*[F.lit(rank[m]) for m in least]), position + 1)


def cyclic_group(n):
    """All rotations of n positions, identity first."""
    return [[(i + k) % n for i in range(n)] for k in range(n)]
