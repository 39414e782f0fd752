"""Bench: wall time of the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "benchmark_best_chunks",
    "lexical_top_k",
    "fuse_candidates",
    "route_answers",
    "chunk_documents",
    "parse_sections",
    "section_retrieval_text",
    "markup_titles_and_tags",
    "missing_vector_keys",
    "latest_documents",
    "normalise_terms",
    "vector_top_k",
    "answer_scope",
    "follow_up_context",
    "silence_sessions",
    "frame_gaps",
    "resample_signal",
    "fold_captures",
    "assemble_answers",
)


def main() -> None:
    from gleaner import plans
    from gleaner.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, spark__ui__showConsoleProgress="false")
    queries, _ = plans.all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
