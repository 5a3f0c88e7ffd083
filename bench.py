"""Benchmark of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trialspark.queries import QUERIES  # noqa: E402
from trialspark.session import local_session  # noqa: E402

HEADLINE = [
    "experiment_verdicts", "welch_test", "cuped_welch_test", "ratio_metric_test", "proportion_test",
    "segment_effects", "srm_check", "srm_diagnose", "srm_trend", "guardrail_health", "unit_metrics",
    "metric_dispatch", "percentile_metrics", "winsorize_spec", "join_exposure", "sequential_path",
    "adjust_pvalues", "beta_binomial_test", "power_mean", "profile_columns", "sample_values",
    "redact_text", "content_lock", "chain_check", "catalog_index", "run_monitor", "walk_tree",
    "stream_srm_trend",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session pays for class loading and code generation.
    QUERIES["welch_test"](spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
