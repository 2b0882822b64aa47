"""Scanner results (JSON documents in a table) -> findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schemas
from ..functions.severity import evaluation_severity, lookup, pattern_scanner_severity, rule_scanner_severity
from ..functions.text import last_part, title_case


def _stripped(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")


def _results(bodies: DataFrame, schema: str) -> DataFrame:
    """One row per entry of `results`; a body that is not JSON or has none gives no rows."""
    keys = [c for c in bodies.columns if c != "body"]
    parsed = bodies.withColumn("results", F.from_json("body", schema)["results"])
    return parsed.select(*keys, F.posexplode("results").alias("pos", "r"))


def normalize_rule_scanner(bodies: DataFrame) -> DataFrame:
    """Rule scanner results (columns file_id, filename, body)."""
    rule = F.coalesce("r.test_id", F.lit(""))
    return _results(bodies, schemas.RULE_SCANNER_RESULT).select(
        "file_id",
        "pos",
        "filename",
        F.coalesce("r.line_number", F.lit(0)).alias("line"),
        rule_scanner_severity(F.coalesce("r.issue_severity", F.lit("LOW"))).alias("severity"),
        title_case(F.coalesce("r.test_name", F.lit("Unknown"))).alias("category"),
        lookup(rule, fv.CWE_OF_RULE).alias("cwe_id"),
        lookup(rule, fv.OWASP_OF_RULE).alias("owasp"),
        F.coalesce("r.issue_text", F.lit("")).alias("description"),
        F.lit(fv.SOURCE_RULES).alias("source"),
        _stripped(F.col("r.code")).alias("code_snippet"),
    )


def normalize_pattern_scanner(bodies: DataFrame) -> DataFrame:
    """Pattern scanner results (columns file_id, filename, body)."""
    return _results(bodies, schemas.PATTERN_SCANNER_RESULT).select(
        "file_id",
        "pos",
        "filename",
        F.coalesce("r.start.line", F.lit(0)).alias("line"),
        pattern_scanner_severity(F.coalesce("r.extra.severity", F.lit("WARNING"))).alias("severity"),
        title_case(last_part(F.coalesce("r.check_id", F.lit("")), ".")).alias("category"),
        F.lit(None).cast("string").alias("cwe_id"),
        F.lit(None).cast("string").alias("owasp"),
        F.coalesce("r.extra.message", F.lit("")).alias("description"),
        F.lit(fv.SOURCE_PATTERNS).alias("source"),
        _stripped(F.col("r.extra.lines")).alias("code_snippet"),
    )


def batch_scan_rows(bodies: DataFrame, tool: str) -> DataFrame:
    """Results of a whole-folder scan as (name, sev, id), keyed by the base name of the scanned file.

    Rows, not one list per name: a base name such as ``__init__.py`` may occur in a large share of all files.
    """
    if tool == "rules":
        rows = _results(bodies, schemas.RULE_SCANNER_RESULT)
        path, raw, rule = F.col("r.filename"), F.col("r.issue_severity"), F.col("r.test_id")
    else:
        rows = _results(bodies, schemas.PATTERN_SCANNER_RESULT)
        path, raw = F.col("r.path"), F.coalesce("r.extra.severity", F.lit("INFO"))
        rule = last_part(F.col("r.check_id"), ".")
    return rows.select(
        last_part(path, "/").alias("name"), evaluation_severity(raw).alias("sev"), rule.alias("id")
    )
