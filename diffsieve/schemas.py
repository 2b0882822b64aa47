"""Explicit schemas of the tables (Spark DDL); nothing is inferred on read."""

CHANGED_FILE = (
    "filename STRING, language STRING, content STRING, patch STRING, additions INT, deletions INT"
)
REVIEW_REQUEST = f"review_id BIGINT, pr_url STRING, files ARRAY<STRUCT<{CHANGED_FILE}>>"
PR_FILES = f"review_id BIGINT, file_ord INT, {CHANGED_FILE}"

# The order of a finding inside a review. It is kept as columns, never as a dense number over a whole review,
# so that no task has to see all findings of one (possibly huge) review.
FINDING_ORDER = ["file_ord", "layer", "seq", "sub"]
FINDING_COLUMNS = [
    "review_id", "file_ord", "layer", "seq", "sub", "id", "filename", "line", "severity", "category",
    "cwe_id", "owasp", "description", "source", "code_snippet", "false_positive", "fp_reason",
]
QUALITY_ORDER = ["file_ord", "check", "seq", "sub"]
QUALITY_COLUMNS = [
    "review_id", "file_ord", "check", "seq", "sub", "id", "filename", "line", "severity", "category",
    "description", "metric",
]

RULE_SCANNER_RESULT = (
    "results ARRAY<STRUCT<test_id STRING, test_name STRING, issue_severity STRING, issue_text STRING, "
    "line_number INT, code STRING, filename STRING>>"
)
PATTERN_SCANNER_RESULT = (
    "results ARRAY<STRUCT<check_id STRING, path STRING, start STRUCT<line INT>, "
    "extra STRUCT<severity STRING, message STRING, lines STRING>>>"
)

# Entries are read as maps because a struct cannot tell a missing key from a null value.
REVIEW_ANSWER = (
    "reviewed ARRAY<MAP<STRING,STRING>>, additional_issues ARRAY<MAP<STRING,STRING>>"
)
QUALITY_ANSWER = "issues ARRAY<MAP<STRING,STRING>>"
FIX_ANSWER = "description STRING, original STRING, fixed STRING, explanation STRING"
TEST_ANSWER = "filename STRING, content STRING, covers ARRAY<STRING>"

LABELLED_ITEM = "id STRING, code STRING, label STRING, kind STRING"

HOOK_PAYLOAD = (
    "action STRING, pull_request STRUCT<html_url STRING, number INT, files ARRAY<STRUCT<filename STRING, "
    "contents_url STRING, raw_url STRING, patch STRING, additions INT, deletions INT>>>, "
    "repository STRUCT<full_name STRING>"
)
HOOK_DELIVERY = "review_id BIGINT, event STRING, signature STRING, payload STRING"
HOOK_ARRIVAL = f"{HOOK_DELIVERY}, delivery_id STRING, ts TIMESTAMP"
JOB_EVENT = "review_id BIGINT, seq BIGINT, status STRING, error STRING, ts TIMESTAMP"
PROGRESS_EVENT = "review_id BIGINT, agent STRING, message STRING, ts DOUBLE"
