"""Headline queries, timed once each after a session warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinfold.plans.catalog import QUERIES  # noqa: E402
from kinfold.session import local_session  # noqa: E402

HEADLINE = [
    "cluster_purity", "cluster_purity_large", "cluster_purity_summary", "ec_split_summary", "split_compare_counts",
    "method_delta", "cluster_size_ccdf", "cluster_size_log_histogram", "cluster_ordinals", "clean_sequences",
    "dedup_first_wins", "train_val_split", "label_map", "resume_pending", "greedy_bucket_batches", "greedy_stream_batches",
    "epoch_batches", "mean_pool", "knn_core_distance", "supcon_loss", "proxy_anchor_loss", "project_head",
    "embed_sequences", "fasta_records", "stream_ingest", "hdbscan_clusters", "hdbscan_family_purity",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    only = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else HEADLINE
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
