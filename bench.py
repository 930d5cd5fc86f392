"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from locigrid.plans.catalog import load_all  # noqa: E402
from locigrid.session import build_session  # noqa: E402

HEADLINE = [
    "contamination_scorecard",
    "evidence_filter",
    "group_shares",
    "group_summary",
    "box_statistics",
    "argmax_rows",
    "global_rank",
    "rank_in_large_groups",
    "exact_sample",
    "eligible_contigs",
    "holdout_replicates",
    "contamination_benchmark",
    "inclusion_benchmark",
    "mean_depth_of_windows",
    "covered_segments",
    "fixed_windows",
    "motif_occurrences",
    "motif_scores",
    "imputed_within_bins",
    "neighbour_edges",
    "vote_tiers",
]


def run(name: str, spark, sf_dir: str) -> float:
    """Seconds to plan and run a query whole; the rows go to a sink that drops them."""
    began = time.perf_counter()
    load_all()[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session
    seconds = {}
    for name in names:
        # the second run is free of class loading and compilation
        first = run(name, spark, sf_dir)
        seconds[name] = round(min(first, run(name, spark, sf_dir)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
