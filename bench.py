"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidewire import catalogue
from tidewire.session import local_session

HEADLINE = [
    "feed_recent", "feed_foryou", "feed_merged", "visitor_totals", "visitor_daily_dense", "user_activity", "llm_by_model", "llm_daily", "llm_totals", "trend_rollup", "story_topic_mode",
    "history_changes", "corrections", "topn_per_source", "progress_fold", "reading_stats", "kg_degrees", "kg_edges_merge", "kg_cascade", "kg_paths", "chain_confidence", "shock_simulation",
    "idf", "same_source_dups", "doc_numbers", "html_to_text", "event_groups", "brief",
    "trend_reconcile_fuzzy", "trend_dedupe", "gazetteer_match", "story_subjects", "story_upsert", "impact_links", "distinct_chains", "variant_terms",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, max(8, int(cpus)), **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["feed_recent"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
