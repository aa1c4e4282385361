"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder with the test tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from surveyloom.plans import queries
from surveyloom.session import build_session

HEADLINE = [
    "agg1_missing_rate",
    "agg8_summary_se",
    "agg9_scale_scores",
    "agg14_infrequency",
    "agg23_five_number",
    "agg24_density",
    "rnk2_average_rank",
    "rnk9_impute_median",
    "inf2_welch_t_by",
    "inf6_bootstrap_diff",
    "inf6_bootstrap_diff_poisson",
    "inf6_bootstrap_diff_buckets",
    "inf8_permute_null",
    "inf9_p_value",
    "inf9_p_value_buckets",
    "inf12_cor_pairwise",
    "rel2_cronbach_alpha",
    "ras2_item_difficulty",
    "ras3_person_theta",
    "mul1_knn_impute",
    "mul5_factor_loadings",
    "clu1_kmeans",
    "mul6_parallel_analysis",
    "smp3_smote",
    "smp4_rose",
    "mlc2_random_forest",
    "mlc5_knn_classify",
    "mlc6_repeated_cv",
    "mlc7_auc_importance",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores, **{"spark.ui.showConsoleProgress": "false"})
    known = queries()
    known["agg4_group_count"](spark, folder).collect()  # start the JVM and code paths
    times = {}
    wanted = sys.argv[1:]  # optional name prefixes
    for name in [n for n in HEADLINE if not wanted or n.startswith(tuple(wanted))]:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
