"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is executed completely (all columns, no-op sink), once to warm up at the small
scale and then timed once at the target scale.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ntuple.plans.catalog import QUERIES
from ntuple.session import local_session

HEADLINE = [
    "train_counts",
    "train_counts_lineitem",
    "train_counts_per_label",
    "classify_bleaching",
    "classify_bleaching_join",
    "classify_per_label_mapping",
    "classify_lineitem_confusion",
    "rank_soft_bleaching",
    "fit_percentile",
    "fit_gaussian",
    "fit_entropy_weighted",
    "encode_circular",
    "kernel_canvas",
    "train_bloom_h3",
    "rank_bloom",
    "classify_tuned_bloom",
    "train_regression",
    "predict_ratio_mean",
    "refine_regression",
    "tuple_weights_entropy",
    "mental_images",
    "classify_lut_network",
    "classify_bloom_ensemble",
    "stratified_split",
    "window_models",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("OFF")
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times = {}
    for name in names:
        if os.path.isdir(warm):
            run(QUERIES[name], spark, warm)
        times[name] = round(run(QUERIES[name], spark, sf_dir), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    rates = {
        n: round(items / times[n])
        for n in ("train_counts_lineitem", "classify_lineitem_confusion")
        if n in times
    }
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
                "lineitem_rows_per_sec": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
