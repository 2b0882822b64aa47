"""From raw changed files to accepted, typed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.python_checks import syntax_valid
from ..functions.severity import lookup
from ..sources.files import with_file_defaults


def detect_language(filename: Column) -> Column:
    """Language by ending; ignored endings come first and are matched with their exact letter case."""
    ignored = F.lit(False)
    for suffix in fv.IGNORED_SUFFIXES:
        ignored = ignored | filename.endswith(suffix)
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    return F.when(ignored, F.lit("unknown")).otherwise(
        lookup(extension, fv.EXTENSION_LANGUAGE, F.lit("unknown"))
    )


def _well_formed() -> Column:
    declared = F.coalesce(F.col("language"), F.lit("unknown"))
    return F.col("filename").isNotNull() & F.col("content").isNotNull() & declared.isin(fv.LANGUAGES)


def reject_malformed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed files, quarantined files). A bad file never takes its review with it."""
    return files.filter(_well_formed()), files.filter(~_well_formed())


def parse_files(files: DataFrame) -> DataFrame:
    """Well-formed files of a known language; the detected language replaces the declared one."""
    good, _ = reject_malformed(files)
    detected = good.withColumn("language", detect_language(F.col("filename")))
    return with_ast_flag(with_file_defaults(accept_files(detected)))


def accept_files(files: DataFrame) -> DataFrame:
    """Drop files of unknown language."""
    return files.filter(F.col("language") != "unknown")


def with_ast_flag(files: DataFrame) -> DataFrame:
    """True for Python with content, whether or not the source parses."""
    return files.withColumn("ast_available", _has_python())


def _has_python() -> Column:
    return (F.col("language") == "python") & (F.col("content") != "")


def parseable(files: DataFrame) -> DataFrame:
    """Files without the Python ones that do not parse, for users who want no units from broken sources."""
    return files.filter((F.col("language") != "python") | syntax_valid("content"))


def route_layers(parsed: DataFrame, units: DataFrame) -> DataFrame:
    """Which detection layers look at each file: (review_id, file_ord, filename, layer)."""
    keys = ["review_id", "file_ord", "filename"]
    first = parsed.filter(_has_python()).select(*keys, F.lit(1).alias("layer"))
    second = parsed.filter(F.col("content") != "").select(*keys, F.lit(2).alias("layer"))
    third = units.select(*keys).distinct().select(*keys, F.lit(3).alias("layer"))
    return first.unionByName(second).unionByName(third)


def review_events_only(deliveries: DataFrame) -> DataFrame:
    """Keep change events whose action starts a review (columns event, action)."""
    return deliveries.filter((F.col("event") == "pull_request") & F.col("action").isin(fv.REVIEW_ACTIONS))
