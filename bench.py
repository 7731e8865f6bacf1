"""Times headline queries: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import time

from contactloom.plans.all import QUERIES
from contactloom.session import local_session

HEADLINES = (
    "fragment_assignment", "valid_pairs", "parse_counters", "dedup_pairs", "extreme_filter", "cis_to_total_filter", "quasi_duplicates_greedy",
    "heatmap_all", "heatmap_by_chrom", "heatmap_overlap", "heatmap_fragment", "remove_poor", "trunc_trans", "balance_converged", "balance_3_distributed",
    "scaling_curve", "obs_exp", "saddle", "pileup", "directionality", "cis_eigenvectors", "pair_sides", "fill_sites",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    QUERIES["heatmap_all"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles what all share
    took = {}
    for name in HEADLINES:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "contact query total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
