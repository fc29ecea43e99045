"""The stored archive of evaluated candidates."""

from pyspark.sql import functions as F

from ..operators.archive import append_once, novelty
from . import schemas
from .records import require_version, write_table
from .runs import read_or_none


def open_archive(spark, path, game):
    """Archived entries, an empty table if there are none; another game's archive is an error."""
    entries = read_or_none(spark, path, schemas.ARCHIVE)
    if entries is None:
        return spark.createDataFrame([], schemas.ARCHIVE)
    other = entries.filter(F.col("game") != game).select("game").limit(1).collect()
    if other:
        raise ValueError(f"archive at {path} belongs to `{other[0][0]}`, not `{game}`")
    return require_version(entries, path)


def append_entries(spark, path, game, new, order=("ord",)):
    """Append entries not archived yet, with sequence and novelty; returns the number appended.

    ``new`` has the identity, spec, signature and provenance columns and an ``ord`` for the batch order.
    Running it again with the same entries appends nothing.
    """
    existing = open_archive(spark, path, game)
    fresh = append_once(existing, new, list(order)).drop(*order).withColumns(
        {"game": F.lit(game), "schema_version": F.lit(schemas.SCHEMA_VERSION)}
    )
    start = existing.agg(F.coalesce(F.max("sequence") + 1, F.lit(0))).collect()[0][0]
    keep = [c for c in existing.columns if c in fresh.columns]
    measured = novelty(existing.select(*keep).unionByName(fresh.select(*keep)), first_new=start)
    full = fresh.join(measured.drop("entry_id"), "sequence")
    return write_table(full.select(*existing.columns).to(existing.schema), path, "append")
