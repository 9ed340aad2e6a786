"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query wall time (seconds).

Each query's whole plan is executed through the ``noop`` sink (no collect to
the driver); iterative operators run their own passes inside the builder.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "articles_per_section",      # pages: URL rules + section + frequency
    "clean_report",              # locale / duration parsing pipeline
    "metric_match",              # null-safe many-to-many equi-join
    "first_event_per_user",      # keep-first dedup (partial aggregate)
    "user_value_acf",            # distributed index + lag join
    "customer_order_band",       # frequency quartile bands
    "lineitem_items",            # exact quantile discretisation + items
    "doc_emotions",              # lexicon scoring over all documents
    "doc_emotion_rates",         # sentence-level emotion rates
    "page_titles",               # HTML extraction (Arrow batches)
    "chi_square_pairs",          # all column pairs, one job
    "quantity_kde",              # kernel density without a cross product
    "association_rules",         # FP-growth + rule measures
    "pruned_rules",              # subset-key redundancy prune
    "poisson_priority_coefficients",  # IRLS passes over a cached design
    "negbin_segment_coefficients",    # NB with θ by ML
    "chi_square_wide",           # 990 pairs of 45 columns, one scan
    "stage_modelling",           # exports and pages to the modelling table
    "stage_models",              # ... and on to the count models
]
#: also timed at the next smaller scale, for their growth
RATIO = ["chi_square_pairs", "chi_square_wide", "association_rules", "pruned_rules", "doc_emotions", "doc_emotion_rates"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from quill.plans import catalog
    from quill.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="quill-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = catalog.builders()
    # warm-up: JVM, Python workers, parquet footers
    qs["event_type_freq"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in (only or HEADLINE):
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    ratios = {}
    if os.path.basename(sf_dir.rstrip("/")) == "sf0.1" and os.path.isdir(small):
        for name in (n for n in RATIO if n in times):
            t0 = time.time()
            qs[name](spark, small).write.format("noop").mode("overwrite").save()
            ratios[name] = round(times[name] / (time.time() - t0), 2)  # ten times the rows
            print(f"{name}: {ratios[name]} x its time at sf0.01", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "ratio_to_sf0.01": ratios, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
