"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barline.catalog.all import load  # noqa: E402
from barline.session import local_session, use_utc  # noqa: E402

HEADLINE = [
    "flagship_bars_zscore_asof",
    "b01_resample",
    "b05_volume_bars",
    "b07_range_bars",
    "j01_asof",
    "j15_interval_join",
    "j16_interval_overlap",
    "a03_bucket_quantiles",
    "a16_daily_matrix",
    "w01_rolling",
    "w05_affine_scan",
    "w09_percent_rank",
    "w11_mad_zscore",
    "w08_tick_order_statistics",
    "ind_tick_bollinger",
    "ind_wide_features",
    "feat_causal_set",
    "e10_first_passage",
    "x01_strength_spread",
    "t01_ic_spearman",
    "t04_sign_flip",
    "t06_block_bootstrap",
    "l03_equity_curve",
    "l12_peak_concurrency",
    "l17_financing",
    "g03_tumbling_bars",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    use_utc(spark)
    registry = load()
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or [n for n in HEADLINE if n in registry]:
        t0 = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
