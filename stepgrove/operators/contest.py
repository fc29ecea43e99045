"""Contest results rolled up: seat -> opponent -> total, headline figures and strict checks."""

from pyspark.sql import functions as F

from ..functions.scalars import ratio, result_for


def with_result(contests, actor="player", winner="winner", finished="finished"):
    """Add the result of every contest seen from the tested actor's seat."""
    return contests.withColumn("result", result_for(F.col(actor), F.col(winner), F.col(finished)))


def _counts():
    return [
        F.count(F.lit(1)).alias("games"),
        *[F.count_if(F.col("result") == r).alias(f"n_{r}") for r in ("win", "draw", "loss", "unfinished")],
        F.coalesce(F.sum("plies"), F.lit(0)).cast("bigint").alias("plies"),
    ]


def with_rates(tallies):
    """Win, draw and loss rates over all games; unfinished games count in none of them."""
    return tallies.withColumns({f"{r}_rate": ratio(f"n_{r}", "games") for r in ("win", "draw", "loss")})


def tally(contests, keys):
    return with_rates(contests.groupBy(*keys).agg(*_counts()))


def tally_rollup(contests):
    """Per candidate: every (opponent, seat), every opponent, and the total, in one aggregation.

    ``level`` is 0 for a seat, 1 for an opponent, 2 for the total.
    """
    c, o, s = F.col("candidate"), F.col("opponent"), F.col("seat")
    grouped = contests.groupingSets([[c, o, s], [c, o], [c]], c, o, s).agg(
        *_counts(), (F.grouping("opponent") + F.grouping("seat")).cast("int").alias("level")
    )
    return with_rates(grouped)


def headline(rollup, reference, agreement=None):
    """One row per candidate: totals, and the loss rate against the reference opponent (0.0 if not met).

    ``agreement`` optionally has (candidate, agreement_rate).
    """
    totals = rollup.filter(F.col("level") == 2)
    met = rollup.filter((F.col("level") == 1) & (F.col("opponent") == reference)).select(
        "candidate", F.col("loss_rate").alias("_met")
    )
    out = totals.join(met, "candidate", "left").select(
        "candidate", F.lit(reference).alias("reference"),
        F.coalesce("_met", F.lit(0.0)).alias("loss_rate_vs_reference"),
        "win_rate", "draw_rate", "loss_rate", "games", F.col("n_unfinished").alias("unfinished"),
    )
    if agreement is None:
        return out.withColumn("agreement_rate", F.lit(None).cast("double"))
    return out.join(agreement.select("candidate", "agreement_rate"), "candidate", "left")


def strict_failures(headlines, max_loss_rate=0.0):
    """Candidates that lose to the reference more often than allowed, with a message."""
    over = headlines.filter(F.col("loss_rate_vs_reference") > max_loss_rate)
    text = F.format_string(
        "reference loss rate exceeded: %s %.3f > %.3f", "candidate", "loss_rate_vs_reference", F.lit(float(max_loss_rate))
    )
    return over.select("candidate", "loss_rate_vs_reference", F.lit(float(max_loss_rate)).alias("max_loss_rate"), text.alias("message"))
