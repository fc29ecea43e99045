"""Usage counts whose tasks hold a bounded number of rows."""

from pyspark.sql import functions as F

from stepgrove.operators import usage as U


def test_usage_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(U, "TASK_ROWS", 100)
    refs = spark.range(1000).select((F.col("id") % 3).alias("candidate"), (F.col("id") % 50).alias("feature"))
    tier = F.when(F.col("feature") < 20, "primitive").when(F.col("feature") < 30, "supplied").otherwise("invented")
    defined = spark.range(120).select((F.col("id") % 4).alias("candidate"), F.floor(F.col("id") / 3).alias("feature")).withColumn("tier", tier)
    found = U.candidate_usage(refs, defined)
    wanted = defined.join(refs.distinct(), ["candidate", "feature"]).distinct().groupBy("candidate", "tier").count().collect()
    got = {r["candidate"]: r for r in found.collect()}
    assert {(r["candidate"], r["tier"]): r["count"] for r in wanted} == {(c, t): r[t] for c, r in got.items() for t in U.TIERS if r[t]}
    assert all(r["referenced"] == sum(r[t] for t in U.TIERS) for r in got.values())
    assert "hashpartitioning(candidate" in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert plan.count(", 12), REPARTITION_BY_NUM") == 2
