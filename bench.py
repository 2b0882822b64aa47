"""Times the headline queries and prints one JSON line.

Every query starts from the given tables: written intermediate tables of earlier queries are forgotten first.
"""

from __future__ import annotations

import json
import os
import time

from diffsieve.plans.queries import QUERIES, forget_reviews
from diffsieve.session import local_session

HEADLINES = [
    "blocked_reviews",
    "rule_scan",
    "extract_functions",
    "match_patterns",
    "quality_findings",
    "findings_for_file",
    "apply_verdicts",
    "first_n_fixes",
    "summary",
    "comment_markdown",
    "review_request_text",
    "confusion_matrix",
    "roc_auc",
    "upper_median",
    "distinct_sources_of_code",
    "train_text_classifier",
    "read_pr_events",
    "job_status",
    "events_since",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["blocked_reviews"](spark, folder).count()  # starts the engine; not timed
    seconds = {}
    for name in HEADLINES:
        forget_reviews()
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 2), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cpus": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
