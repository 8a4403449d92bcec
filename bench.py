"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans import load
from tidemark.session import build_session

HEADLINE = [
    "a3_read_filings_tsv", "b3_resample_ohlcv", "b13_days_to_next_event", "c2_atr", "c9_compute_features", "c16_beta_residual", "d1_known_asof", "d8_membership_mask",
    "d12_event_window_agg", "d15_universe_return", "e1_donchian_breakout", "e16_liquidity_sweep", "f3_momentum_12_1", "f8_sector_reversal", "f9_sector_washout", "g1_insider_cluster",
    "g5_insider_opportunistic", "g11_insider_underwater", "h3_short_rank", "i1_headline_score", "i5_news_on_sessions", "j1_discrete_quarters", "k3_iv_at_tenor", "l3_barrier_outcomes",
    "m1_equity_stats", "n1_monthly_ic", "n5_plateau", "n8_null_max", "p2_order_diff", "q2_stream_bars",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    catalog = load()
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["m1_equity_stats"](spark, sf_dir).count()  # warm the JVM
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
