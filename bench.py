"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "top_words",
    "top_categories",
    "frequent_itemsets",
    "jaccard_pairs",
    "pearson_items",
    "pearson_users",
    "predict_by_items",
    "predict_by_users",
    "tfidf_top_terms",
    "cosine_scores",
    "co_edges",
    "label_propagation",
    "nearest_centroid",
    "kmeans_step",
]


def main() -> None:
    from tessera.plans import catalogue
    from tessera.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    every = catalogue.queries()
    every["row_count"](spark, sf_dir).collect()  # starts the executors and warms the readers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))


if __name__ == "__main__":
    main()
