"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from corvane.catalogue import QUERIES
from corvane.session import local_session

#: Three scales of operators: dense search, graph building, iteration, text, windows.
HEADLINES = (
    "dense_topk", "dense_topk_per_query", "knn_synonymy_edges", "cooccurrence_edges", "graph_assemble", "overlap_score", "ppr_power", "beam_depth2", "local_search_blend",
    "content_hash_dedupe", "token_f1", "token_stride_chunks", "greedy_chunks", "vocab_constrain", "system_metrics", "sliding_rate", "rate_admission", "latest_wins", "stream_usage",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("/sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
