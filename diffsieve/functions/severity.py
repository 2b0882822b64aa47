"""Severity expressions. Severity is a string column; its order exists only in ``severity_rank``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def lookup(value: Column, table: dict, default: Column | None = None) -> Column:
    """A lookup in a small constant table, as one CASE expression."""
    chain = None
    for key, result in table.items():
        chain = F.when(value == key, F.lit(result)) if chain is None else chain.when(value == key, F.lit(result))
    return chain if default is None else chain.otherwise(default)


def severity_rank(severity: Column) -> Column:
    """critical 5 ... info 1; anything else 0."""
    return lookup(severity, {s: 5 - i for i, s in enumerate(fv.SEVERITIES)}, F.lit(0))


def rule_scanner_severity(raw: Column) -> Column:
    """HIGH/MEDIUM/LOW, missing or unknown -> low."""
    return lookup(F.upper(raw), fv.RULE_SCANNER_SEVERITY, F.lit("low"))


def pattern_scanner_severity(raw: Column) -> Column:
    """ERROR/WARNING/INFO, missing or unknown -> medium."""
    return lookup(F.upper(raw), fv.PATTERN_SCANNER_SEVERITY, F.lit("medium"))


def answer_severity(raw: Column) -> Column:
    """Severity of an added finding: any letter case; info and unknown -> medium."""
    known = {s.upper(): s for s in fv.SEVERITIES if s != "info"}
    return lookup(F.upper(raw), known, F.lit("medium"))


def quality_answer_severity(raw: Column) -> Column:
    """Severity of an answered quality issue: exact letter case; unknown -> low."""
    return lookup(raw, {s: s for s in fv.SEVERITIES}, F.lit("low"))


def evaluation_severity(raw: Column) -> Column:
    """Numeric severity used when detectors are scored; unknown -> 0."""
    return lookup(F.upper(raw), fv.EVALUATION_SEVERITY, F.lit(0))
