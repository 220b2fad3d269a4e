"""Time the headline queries; prints one JSON line.

Every query is run once unmeasured at the smallest scale, so that the first one does not pay
for the start of the JVM, then once measured over the whole tables of ``BENCH_SF_DIR``.
"""

import json
import os
import time

from flowlake.queries import registry
from flowlake.session import build_session

HEADLINE = [
    "class_balance", "clean_flows", "label_distribution", "drop_rare", "quality_report",
    "dedup_rows", "canonicalize", "cap_per_file", "duplicate_columns",
    "split_per_file", "split_temporal", "split_file_holdout", "split_random", "stratified_folds",
    "correlation_pairs", "confusion", "summary_metrics", "roc_auc_ovr", "impute_score_input",
    "alerts", "top_probs", "alert_json", "flow_segments", "flow_assembly", "flow_features",
    "train_binary", "scored",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="8g",
                          spark__sql__objectHashAggregate__sortBased__fallbackThreshold="100000")
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.queries()
    seconds = {}
    for n in names:
        if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
            queries[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
        begin = time.time()
        queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[n] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
