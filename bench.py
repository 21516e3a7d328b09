"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from textloom.plans.catalog import QUERIES
from textloom.session import SETTINGS

HEADLINE = (
    "knn_cosine", "multi_collection_topk", "ann_ivf_topk", "ann_graph_topk", "bm25_topk", "rrf_hybrid", "pgtrgm_title_lookup", "enrich_nested_left_join",
    "dedup_keep_longest", "chunk_word_windows", "chunk_recursive", "guard_first_failure", "guard_pii", "cache_fuzzy_hit", "aligned_token_score", "listing_chain", "keyword_vector_search",
    "mrr_recall_precision", "component_counters", "outage_islands", "events_window_counts", "page_text_strip_noise", "answer_cascade",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-")
    conf = SETTINGS | {
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.local.dir": f"{scratch}/local",
        "spark.sql.warehouse.dir": f"{scratch}/warehouse",
        "spark.checkpoint.dir": f"file://{scratch}/shared",
    }
    spark = SparkSession.builder.appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = {name: QUERIES[name] for name in HEADLINE}
    try:
        from textloom.llm.queries import QUERIES as more
    except ImportError:
        pass
    else:
        run |= more
    QUERIES["count_by_type"](spark, sf_dir).collect()  # the session's own start
    seconds = {}
    for name, query in run.items():
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
