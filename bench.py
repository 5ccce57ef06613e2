"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quillspark.catalog.registry import all_queries
from quillspark.session import build_session

HEADLINE = (
    "retrieve_all", "strategy_lookup", "knn_topk", "quantized_rescore", "rrf_fusion", "graph_search_by_vector",
    "graph_neighbors_top3", "web_fallback", "context_and_answer", "filter_cascade", "ingest_children",
    "ingest_counters", "parent_child_chunks", "strip_html", "keyed_upsert", "enrich_points", "point_batches",
    "stratified_sample", "eval_summary", "token_overlap_hit", "memory_window", "memory_compaction",
    "rate_limit", "circuit_breaker_state", "arg_max_dedup",
)


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"},
    )
    registered = all_queries()
    registered["chunk_statistics"].run(spark, folder).collect()  # start the JVM and the Python workers
    registered["strip_html"].run(spark, folder).count()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or list(HEADLINE))
