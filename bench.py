"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from vernissage.plans import catalog
from vernissage.session import local_session

HEADLINE = (
    "weak_label_accuracy", "confusion_pairs", "null_profile", "category_top30", "keyword_flags",
    "feature_matrix", "stratified_folds", "oof_encode", "test_encode", "material_flags", "rule_accuracy",
    "image_features", "seed_blend", "override_top_k", "attribution_rules", "batch_plan", "ngram_vocab",
    "tfidf_weights", "embedding_svd", "training_matrix", "oof_trees_alt",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
