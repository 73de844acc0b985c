"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS``
the local cores. Every query is built and written to the no-op sink, so all rows
and columns are computed; the best of two runs counts, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ringfence.plans.catalog import QUERIES  # noqa: E402
from ringfence.session import build_session  # noqa: E402

HEADLINE = [
    "prep_clip_log_invert", "scale_population", "window_features", "group_kfold", "holdout_tail",
    "score_fixed_refs", "threshold_flags", "fit_models", "fit_single", "fit_merged_rounds", "fit_by_key_flags",
    "update_models", "roc_auc", "pr_points", "auc_by_group", "session_p95_auc", "cv_folds", "ewma_threshold",
    "buffer_last_n", "iforest", "pca2", "corr_matrix", "feature_screen", "latency_summary",
    "stream_window_counts", "stream_score_only", "stream_adaptive",
]


def timed(fn, spark, sf) -> float:
    start = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def rates(spark, sf) -> dict[str, float]:
    """Rows per second of training and scoring alone, over the whole line item table."""
    from ringfence.operators.fit import fit_by_key
    from ringfence.operators.score import score
    from ringfence.plans.catalog import ITEM_FEATURES, ITEM_TIES, _item_vectors
    from ringfence.session import cut

    rows = cut(_item_vectors(spark, sf, ["l_returnflag"]), "bench")
    n = rows.count()
    start = time.perf_counter()
    models = fit_by_key(rows, ITEM_FEATURES, ["l_returnflag"], "l_orderkey", ITEM_TIES, 1.66)
    fitted = time.perf_counter()
    score(rows, models, ITEM_FEATURES, ["l_returnflag"], keep=["l_orderkey", "l_linenumber"]).write.format("noop").mode("overwrite").save()
    return {"fit_rows_per_s": round(n / (fitted - start)), "score_rows_per_s": round(n / (time.perf_counter() - fitted))}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    timed(QUERIES["fit_models"], spark, sf)
    times = {}
    for name in HEADLINE:
        times[name] = round(min(timed(QUERIES[name], spark, sf) for _ in range(2)), 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")), **rates(spark, sf),
    }))


if __name__ == "__main__":
    main()
