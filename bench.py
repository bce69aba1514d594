"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quantframe.plans import QUERIES
from quantframe.session import clear_stage, get_session

HEADLINE = [
    "bars", "log_returns", "rsi", "dist_sma", "dist_ema", "macd", "rolling_beta", "feature_panel",
    "quantile_thresholds", "portfolio_metrics", "tuning_score", "position_state", "fold_thresholds",
    "next_close_asof", "reconcile", "range_replace", "mask_pii", "validate_news", "chunk_documents", "chunk_fixed",
    "embed_text", "knn", "rag_context", "semantic_cache_lookup", "apply_alert_changes", "alert_match",
    "credit_ledger", "stream_bars",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()  # start the JVM
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    clear_stage(spark)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
