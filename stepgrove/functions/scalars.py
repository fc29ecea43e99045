"""Scalar columns shared by the operators."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator, denominator):
    """Share as a double, exactly 0.0 when the denominator is 0."""
    n, d = F.col(numerator) if isinstance(numerator, str) else numerator, (
        F.col(denominator) if isinstance(denominator, str) else denominator
    )
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / F.when(d != 0, d))


def pairing_key(names):
    """`a vs b` from an array of names."""
    return F.array_join(names, " vs ")


def composite_id(*parts):
    return F.concat_ws(":", *parts)


def opening_length(length, fixed, random):
    """Plies of a sequence that belong to its opening."""
    return F.least(length, F.lit(fixed) + F.lit(random))


def step_source(ply, opening_plies, fixed, name):
    """Who chose a step: the fixed opening, the random opening, or the named actor."""
    return (
        F.when(ply < F.lit(fixed), F.lit("opening"))
        .when(ply < opening_plies, F.lit("random-opening"))
        .otherwise(name)
    )


def result_for(actor, winner, finished):
    """Contest result seen by ``actor``: a missing outcome is unfinished, no winner is a draw."""
    return (
        F.when(~finished, F.lit("unfinished"))
        .when(winner.isNull(), F.lit("draw"))
        .when(winner == actor, F.lit("win"))
        .otherwise(F.lit("loss"))
    )


def outcome_class(actor, value, players):
    """Name of the outcome a value in {-1, 0, 1} means for a two-player actor."""
    first, second = players
    other = F.when(actor == first, F.lit(second)).otherwise(F.lit(first))
    return F.when(value == 0, F.lit("draw")).when(value > 0, actor).otherwise(other)


def parse_outcome(text):
    """`"Draw"` or `{"Win":"X"}` (JSON text, null when unfinished) as struct(result, winner)."""
    winner = F.get_json_object(text, "$.Win")
    result = F.when(text.isNull(), "unfinished").when(winner.isNull(), "draw").otherwise("win")
    return F.struct(result.alias("result"), winner.alias("winner"))


def content_id(**fields):
    """Identity of a record: md5 of its JSON with fields in name order."""
    ordered = [value.alias(name) for name, value in sorted(fields.items())]
    return F.md5(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}))


def seeded_hash(seed, key):
    """Order rows by this to shuffle them by a seed, the same way on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def all_of(*conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
