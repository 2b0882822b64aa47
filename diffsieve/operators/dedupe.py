"""Merging findings that several layers report for one place, and guarding the dismissal of grave ones.

Findings of one file whose weaknesses belong to one family and whose line ranges touch the same lines, directly or by a
chain of others, are one cluster. A finding of a line covers that line, one of a function the whole function. Clusters come from
gaps and islands: in the order of first lines, a row opens a cluster if it starts behind the greatest last line before it. Rows of a
file are cut into slices of lines for that, so that a file with any number of findings is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.ordering import join_on, with_running_max
from ..functions.severity import severity_rank
from .triage import real_findings

# First entry whose key is part of the lower-case category; other categories are families of their own.
FAMILIES = [
    ("sql", "sql injection"), ("query", "sql injection"),
    ("deserial", "deserialization"), ("pickle", "deserialization"), ("yaml", "deserialization"),
    ("shell", "command execution"), ("command", "command execution"), ("child process", "command execution"),
    ("credential", "hardcoded secret"), ("password", "hardcoded secret"), ("secret", "hardcoded secret"), ("key", "hardcoded secret"),
    ("crypto", "weak cryptography"), ("hash", "weak cryptography"),
    ("random", "weak randomness"),
    ("cert", "unverified peer"), ("tls", "unverified peer"),
    ("import", "dynamic import"),
    ("eval", "code execution"), ("exec", "code execution"),
    ("html", "script injection"), ("document write", "script injection"),
    ("access control", "access control"),
]
LINES_PER_SLICE = 512
PLACE = ["review_id", "file_ord", "filename", "family"]
GRAVE = ("critical", "high")


def family_of(category: Column) -> Column:
    """The weakness family of a category."""
    low, chain = F.lower(category), None
    for key, family in FAMILIES:
        hit = F.contains(low, F.lit(key))
        chain = F.when(hit, F.lit(family)) if chain is None else chain.when(hit, F.lit(family))
    return chain.otherwise(low)


def with_ranges(findings: DataFrame, units: DataFrame) -> DataFrame:
    """Findings with ``family``, ``first_line`` and ``last_line``; those of function units cover the unit's lines."""
    ends = units.select(
        "review_id", "file_ord", F.lit(3).alias("layer"), F.col("unit_ord").alias("seq"), F.col("end_line").alias("_end"))
    return findings.join(ends, ["review_id", "file_ord", "layer", "seq"], "left").withColumns({
        "family": family_of(F.col("category")),
        "first_line": F.col("line"),
        "last_line": F.greatest("line", F.coalesce("_end", "line")),
    }).drop("_end")


def clusters(ranges: DataFrame) -> DataFrame:
    """``ranges(*PLACE, first_line, last_line, ...)``, one row per distinct range of a place, with ``cluster``: the first line
    of the cluster that the range belongs to."""
    part = F.expr(f"first_line div {LINES_PER_SLICE}")
    order = ["first_line", "last_line"]
    reached = with_running_max(ranges, PLACE, part, order, F.col("last_line"), "_reach", current=False)
    opens = F.col("_reach").isNull() | (F.col("first_line") > F.col("_reach"))
    start = F.when(opens, F.col("first_line"))
    return with_running_max(reached, PLACE, part, order, start, "cluster").drop("_reach")


def dedupe_findings(findings: DataFrame, units: DataFrame) -> DataFrame:
    """The real findings, one per cluster: the gravest, of equals the one of the lowest layer, then the first.

    Adds ``family``, the cluster's ``first_line`` and ``last_line``, how many findings it ``merged`` and in how many layers
    (``n_layers``). Dismissed findings neither stay nor join clusters. Texts are joined to the chosen rows only.
    """
    ranged = with_ranges(real_findings(findings), units)
    rank = F.struct(-severity_rank(F.col("severity")), "layer", "seq", "sub")
    spans = ranged.groupBy(*PLACE, "first_line", "last_line").agg(
        F.min(rank.alias("r")).alias("best"), F.count(F.lit(1)).alias("merged"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("layer"))).alias("layers"))
    merged = clusters(spans).groupBy(*PLACE, "cluster").agg(
        F.min("best").alias("best"), F.sum("merged").alias("merged"), F.bit_or("layers").alias("layers"),
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
    chosen = merged.select(
        "review_id", "file_ord", "filename", "best.layer", "best.seq", "best.sub", "family", "first_line", "last_line", "merged",
        F.bit_count("layers").alias("n_layers"))
    return join_on(findings, chosen, ["review_id", "file_ord", "filename", "layer", "seq", "sub"])


def deduped_breakdown(findings: DataFrame, deduped: DataFrame, reviews: DataFrame) -> DataFrame:
    """Real findings of each severity per review, before and after merging; reviews without findings have zeros."""
    both = real_findings(findings).select("review_id", "severity", "copies", F.lit("before").alias("_when")).unionByName(
        deduped.select("review_id", "severity", "copies", F.lit("after").alias("_when")))
    names = [(w, s) for w in ("before", "after") for s in fv.SEVERITIES]
    counts = both.groupBy("review_id").agg(*[
        F.sum(F.when((F.col("_when") == w) & (F.col("severity") == s), F.col("copies")).otherwise(0)).alias(f"{w}_{s}")
        for w, s in names])
    return reviews.join(counts, "review_id", "left").fillna(0, [f"{w}_{s}" for w, s in names])


def guard_dismissals(findings: DataFrame, units: DataFrame, reason_enough: bool = True) -> DataFrame:
    """An outside answer alone does not hide a grave finding: adds ``guard`` to all findings and reopens those refused.

    The dismissal of a critical or high finding stands (``kept``) if a finding of another layer in the same cluster of dismissed
    findings is dismissed too, or if the answer gives a reason of its own and ``reason_enough``; otherwise it is ``refused`` and the finding
    counts again. ``guard`` is null for all other findings. Grounds are read before any dismissal is undone, so
    the order of rows does not matter.
    """
    gone = F.coalesce("false_positive", F.lit(False))
    ranged = with_ranges(findings.filter(gone), units)
    spans = ranged.groupBy(*PLACE, "first_line", "last_line").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("layer"))).alias("layers"))
    placed = clusters(spans)
    shared = placed.groupBy(*PLACE, "cluster").agg(F.bit_count(F.bit_or("layers")).alias("n_layers"))
    backed = join_on(placed, shared, [*PLACE, "cluster"]).filter("n_layers > 1").select(*PLACE, "first_line", "last_line", F.lit(True).alias("_backed"))
    key = ["review_id", "file_ord", "filename", "layer", "seq", "sub"]
    places = join_on(ranged.select(*key, "family", "first_line", "last_line"), backed, [*PLACE, "first_line", "last_line"])
    marks = places.select(*key, "_backed")
    renamed = marks.withColumnsRenamed({k: f"_m_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in key]
    given = F.length(F.trim(F.coalesce("fp_reason", F.lit("")))) > 0
    reasoned = given & (F.col("fp_reason") != fv.DEFAULT_REASON) & F.lit(reason_enough)
    stands = F.coalesce("_backed", F.lit(False)) | reasoned
    grave = gone & F.col("severity").isin(*GRAVE)
    joined = findings.join(renamed, same, "left").drop(*[f"_m_{k}" for k in key])
    return joined.withColumn("guard", F.when(grave, F.when(stands, F.lit("kept")).otherwise(F.lit("refused")))).withColumn(
        "false_positive", gone & (F.coalesce("guard", F.lit("")) != "refused")).drop("_backed")


def guard_audit(guarded: DataFrame) -> DataFrame:
    """One row per dismissal of a grave finding, with what became of it and the reason given."""
    return guarded.filter(F.col("guard").isNotNull()).select(
        "review_id", "file_ord", "layer", "seq", "sub", "id", "filename", "line", "severity", "category", "guard", "fp_reason", "copies")
