"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS: local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sparkqual.session import build_session  # noqa: E402
from sparkqual.suite import all_queries  # noqa: E402

HEADLINES = (
    "profile_scalars",
    "profile_estimates",
    "profile_text",
    "table_counts",
    "frequency_all",
    "frequency_every_column",
    "frequency_top15",
    "mask_distribution",
    "outlier_shares",
    "corr_pearson",
    "association_mixed",
    "cramers_v",
    "rule_scores",
    "rule_violations",
    "group_scorecard",
    "reference_violations",
    "impute_mean",
    "impute_median",
    "dedup_first",
    "dup_members_lines",
    "mask_pii_unicode",
    "golden_two",
    "golden_n",
    "classify_columns",
    "candidate_keys",
    "latest_upload",
    "corr_spearman",
    "corr_kendall",
    "iterative_impute",
    "profile_document",
    "model_accuracy",
    "io_row_ids",
    "group_scorecard",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("table_counts")  # start the JVM, the file system and code generation
    times = {name: round(run(name), 3) for name in HEADLINES}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
