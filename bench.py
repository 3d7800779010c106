"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barflow.plans import registry  # noqa: E402
from barflow.session import local  # noqa: E402

QUERIES = (
    "bars", "bars_intraday", "universe_top1", "rsi_14", "macd", "adx_14", "bollinger", "supertrend", "sr_distance", "order_flow_score", "pattern_score", "cluster_levels", "rule_anomaly",
    "regime_persistence", "max_pain", "options_features", "flow_rolling", "lexicon_score", "sentiment_window", "global_verdict", "fundamental_features", "gate3_rank", "alignment_grade", "stabilise",
    "signal_changed", "position_size", "barrier_outcome", "non_overlapping", "ledger", "equity_curve", "attribution", "backtest_metrics", "behaviour_grade", "information_value", "psi", "asof_backward", "stream_bars",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local(cpus, shuffle=int(cpus) if cpus.isdigit() else 8, name="barflow-bench", memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    run = lambda k: queries[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("bars")  # JVM and codegen warm-up
    took = {}
    for k in QUERIES:
        t0 = time.perf_counter()
        run(k)
        took[k] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
