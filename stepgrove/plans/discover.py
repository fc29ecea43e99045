"""Evaluate decision lists on labelled states, and archive them with provenance and novelty."""

import json
from functools import reduce

from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import archive as N
from ..operators import rules as R
from ..session import materialize
from ..sources.archives import append_entries, open_archive
from ..sources.runs import commit_run
from ..sources.schemas import PROVENANCE


def play_lists(states, lists, seed, key, keep):
    """Choices of every list on every state, stacked by ``candidate``; needs ``legal``."""
    played = []
    for d in lists:
        chosen = R.choose(R.apply_rules(states, d), seed, key)
        played.append(chosen.select(F.lit(d.name).alias("candidate"), *keep, "action"))
    return reduce(lambda a, b: a.unionByName(b), played)


def list_agreement(played, by=()):
    """Agreement of each candidate's choices with ``optimal``, optionally by label value."""
    hit = F.count_if(F.array_contains("optimal", F.col("action"))).alias("agreeing")
    found = played.groupBy("candidate", *by).agg(F.count(F.lit(1)).alias("positions"), hit)
    return found.withColumn("agreement_rate", ratio("agreeing", "positions"))


def list_entries(spark, lists, signatures, provenance, first=0):
    """Archive entries of decision lists: identity from game, rules, definitions and evaluation, spec and signature."""
    identity = lambda d: json.dumps(
        {"game": provenance["game"], "evaluation": provenance["evaluation_id"], "rules": d.rule_texts(), "definitions": d.definition_texts()},
        sort_keys=True, separators=(",", ":"),
    )
    rows = [(first + i, d.name, "heuristic-rules", d.rule_texts(), identity(d)) for i, d in enumerate(lists)]
    spec = spark.createDataFrame(rows, "ord bigint, name string, kind string, rules array<string>, identity string")
    entry = F.md5("identity")
    signed = signatures.select(F.col("candidate").alias("name"), "sample_id", F.transform("signature", lambda a: a.cast("string")).alias("signature"))
    source = F.from_json(F.lit(json.dumps(provenance)), PROVENANCE)
    return spec.join(signed, "name", "left").select(
        "ord", entry.alias("entry_id"), "name", "kind", F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("double").alias("epsilon"), F.lit(None).cast("string").alias("tie_break"), "rules",
        source.alias("provenance"), "sample_id", "signature",
    )


def manifest_rows(spark, lists, entries, agreement, archived):
    """One row per candidate: its evaluation, joined by name, and its place in the archive, joined by identity.

    A candidate that was not evaluated or not archived is an error when the rows are read. Candidates of one identity
    share an entry.
    """
    candidates = spark.createDataFrame([(i, d.name, len(d.rules)) for i, d in enumerate(lists)], "ord bigint, candidate string, rules bigint")
    found = candidates.join(entries.select(F.col("name").alias("candidate"), "entry_id"), "candidate", "left").join(agreement, "candidate", "left")
    found = found.join(archived.select("entry_id", "sequence", F.col("distance").alias("novelty"), "is_novel"), "entry_id", "left")
    lacking = F.when(F.col("positions").isNull(), "evaluation").when(F.col("sequence").isNull(), "archive entry")
    failed = F.raise_error(F.concat(F.lit("no "), lacking, F.lit(" of candidate "), F.col("candidate")))
    return found.select(
        "ord", F.when(lacking.isNotNull(), failed.cast("string")).otherwise(F.col("candidate")).alias("candidate"),
        "entry_id", "sequence", "rules", "positions", "agreeing", "agreement_rate", "novelty", "is_novel",
    )


def discover(states, mined, provenance, archive_path, seed=0, key="canonical_state", out=None, run_id=None):
    """Play the mined lists on the labelled states, measure them, and append them to the archive.

    With ``out`` and ``run_id`` the manifest of the candidates is committed there as a run with the one table
    ``candidates``. Returns (agreement table, number of entries appended).
    """
    spark = states.sparkSession
    lists = [m.decisions for m in mined]
    # Stored, since signatures and agreement both read it, and the archive reads the entries several times.
    played = materialize(play_lists(states, lists, seed, F.col(key), ["seq_id", "run", "optimal", "value"]))
    signed = N.signatures(played, ["candidate"], ["seq_id", "run"])
    entries = materialize(list_entries(spark, lists, signed, provenance))
    appended = append_entries(spark, archive_path, provenance["game"], entries)
    agreement = list_agreement(played)
    if out:
        rows = manifest_rows(spark, lists, entries, agreement, open_archive(spark, archive_path, provenance["game"]))
        commit_run(out, run_id, provenance["game"], {"candidates": rows})
    return agreement, appended
