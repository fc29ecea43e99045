"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8). Each query runs once to warm up, then three times;
the median counts. The result is written to the noop sink, so nothing is gathered on the driver.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stepgrove.plans import QUERIES  # noqa: E402
from stepgrove.session import local_session  # noqa: E402

HEADLINE = [
    "outcome_grouping_sets", "outcome_by_first_action", "outcome_by_ply", "diversity_metrics", "expand_steps",
    "prefix_state", "agreement_report", "label_dataset", "cart_root_split", "cart_depth2", "leaf_evidence",
    "holdout_split", "rule_list_apply", "concept_shortlist", "tally_rollup", "headline_vs_reference",
    "stride_signature", "novelty_nearest", "archive_append", "graph_reach", "vocab_usage",
    "mined_rules", "backward_induction",
]


def run(spark, name, folder):
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name, folder)
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(3)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
