"""Quality findings: gates on unit and file metrics, and issues answered from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schemas
from ..functions.answers import parse_answer
from ..functions.severity import quality_answer_severity
from ..functions.text import short_id
from ..staging import stage
from .units import FILE, blocks, complexity, functions_of, maintainability


def _issue(sub: int, line: Column, severity: Column, category: str, description: Column, metric: Column) -> Column:
    return F.struct(
        F.lit(sub).alias("sub"), line.cast("int").alias("line"), severity.alias("severity"),
        F.lit(category).alias("category"), description.alias("description"), metric.cast("string").alias("metric"),
    )


def _two_steps(value: Column, is_high: Column) -> Column:
    return F.when(is_high, F.lit("high")).otherwise(F.lit("medium"))


def _emit(rows: DataFrame, check: int, seq: Column, issues: list[Column]) -> DataFrame:
    """One row per issue that applies; the outer explode evaluates the gates once."""
    hits = rows.select(
        *FILE, F.lit(check).alias("check"), seq.cast("int").alias("seq"),
        F.explode_outer(F.array_compact(F.array(*issues))).alias("i"),
    )
    return hits.filter(F.col("i").isNotNull()).select(*FILE, "check", "seq", "i.*")


def complexity_issues(all_blocks: DataFrame) -> DataFrame:
    value = F.col("complexity")
    is_high = value >= fv.COMPLEXITY_HIGH
    word = F.when(is_high, F.lit("very high")).otherwise(F.lit("high"))
    issue = _issue(
        1, F.col("start_line"), _two_steps(value, is_high), "High Complexity",
        F.format_string(fv.COMPLEXITY_TEXT, "name", value, word), F.format_string("cyclomatic_complexity=%d", value),
    )
    return _emit(complexity(all_blocks), 1, F.col("start_line"), [F.when(value >= fv.COMPLEXITY_FLAG, issue)])


def maintainability_issues(per_file: DataFrame) -> DataFrame:
    value = F.col("mi")
    is_high = value <= fv.MAINTAINABILITY_HIGH
    shown = F.call_function("format_number", value, F.lit("0.0"))
    word = F.when(is_high, F.lit("very low")).otherwise(F.lit("low"))
    issue = _issue(
        1, F.lit(1), _two_steps(value, is_high), "Low Maintainability",
        F.format_string(fv.MAINTAINABILITY_TEXT, shown, word), F.concat(F.lit("maintainability_index="), shown),
    )
    return _emit(per_file, 2, F.lit(1), [F.when(value <= fv.MAINTAINABILITY_FLAG, issue)])


def function_issues(units: DataFrame) -> DataFrame:
    n_lines = F.col("end_line") - F.col("start_line") + 1
    medium = F.lit("medium")
    at_start = F.col("start_line")
    gates = [
        F.when(n_lines > fv.MAX_LINES, _issue(
            1, at_start, medium, "Long Function",
            F.format_string(fv.LENGTH_TEXT, "name", n_lines), F.format_string("lines=%d", n_lines))),
        F.when(~F.col("has_docstring") & ~F.startswith("name", F.lit("_")), _issue(
            2, at_start, F.lit("low"), "Missing Docstring",
            F.format_string(fv.DOCSTRING_TEXT, "name"), F.lit(None))),
        F.when(F.col("params") > fv.MAX_PARAMETERS, _issue(
            3, at_start, medium, "Too Many Parameters",
            F.format_string(fv.PARAMETER_TEXT, "name", "params"), F.format_string("params=%d", "params"))),
        F.when(F.col("nesting_depth") > fv.MAX_NESTING, _issue(
            4, F.col("nesting_line"), medium, "Deep Nesting",
            F.format_string(fv.NESTING_TEXT, "name", "nesting_depth"),
            F.format_string("nesting_depth=%d", "nesting_depth"))),
    ]
    return _emit(units, 3, F.col("unit_ord"), gates)


def metric_gates(all_blocks: DataFrame) -> DataFrame:
    """All static quality issues of a blocks table, in the quality schema."""
    rows = (
        complexity_issues(all_blocks)
        .unionByName(maintainability_issues(maintainability(all_blocks)))
        .unionByName(function_issues(functions_of(all_blocks)))
    )
    return as_quality(rows)


def as_quality(rows: DataFrame) -> DataFrame:
    parts = [F.col(c).cast("string") for c in
             ("review_id", "filename", "line", "category", "file_ord", "check", "seq", "sub")]
    return rows.withColumn("id", short_id(*parts)).select(*schemas.QUALITY_COLUMNS)


def append_quality_answers(files: DataFrame, answers: DataFrame) -> DataFrame:
    """Issues answered for files with content, any language; an unreadable answer gives none."""
    with_content = files.filter(F.col("content") != "").select(*FILE)
    parsed = parse_answer(F.col("answer"), schemas.QUALITY_ANSWER)["issues"]
    entries = answers.select("review_id", "filename", F.posexplode(parsed).alias("pos", "e"))
    entry = F.col("e")
    rows = with_content.join(entries, ["review_id", "filename"]).select(
        *FILE,
        F.lit(4).alias("check"),
        (F.col("pos") + 1).alias("seq"),
        F.lit(1).alias("sub"),
        F.coalesce(entry["line"].try_cast("int"), F.lit(1)).alias("line"),
        quality_answer_severity(F.coalesce(entry["severity"], F.lit("low"))).alias("severity"),
        F.coalesce(entry["category"], F.lit("Quality Issue")).alias("category"),
        F.coalesce(entry["description"], F.lit("")).alias("description"),
        F.lit(None).cast("string").alias("metric"),
    )
    return as_quality(rows)


def quality_findings(parsed: DataFrame) -> DataFrame:
    """Static quality findings of all files, from their sources."""
    return metric_gates(stage(blocks(parsed)))
