"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2; the
best run counts, so that one-off start-up of the JVM and the Python workers is left out).
"""

from __future__ import annotations

import json
import os
import time

from bidlake import build_session
from bidlake.plans.catalogue import REGISTRY

HEADLINE = (
    "r1_vector_topk", "r9_centroid_search", "r9_batch_search", "r2_keyword", "r3_hybrid_max", "r3_hybrid_many",
    "r14_bm25", "r7_answer_context", "t8_search_with_context", "j1_tender_with_lots", "j2_chunk_context",
    "j3_related_tenders", "j3_related_all", "j7_no_lots", "j9_mandatory_requirements", "a2_label_counts",
    "a3_top_by_chunks", "a5_common_texts", "a6_portfolio", "a12_metrics", "c4_partial_update", "c5_upsert",
    "c5_ingest_blocks", "d2_chunks", "d3_section_tokens", "u3_change_detection",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
