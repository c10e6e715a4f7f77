"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "ws_normalize dedupe_consecutive_lines dedupe_sentences clean_records chunk_overlap tokens answer_clean "
    "split_by_heading split_dispatch sanitize_chunks md_postprocess ocr_corrections md_tables md_inline_spans "
    "vector_topk routed_topk build_context select_contexts "
    "eval_common eval_win_loss score_by_difficulty "
    "ocr_sections section_entries reading_order "
    "jsonl_records coerce_records format_text index_upsert resume_pending "
    "chunk_images images_near_line pipeline_metrics"
).split()


def main() -> None:
    from folioworks.plans import catalog
    from folioworks.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("max(length(text))").collect()

    took = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
