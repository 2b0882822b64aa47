"""Joining findings with outside verdicts.

A review looks at files by name. Usually a name occurs once per review; if several files share it, each of them
lists the findings of all of them. That list is the same for every one of these files, so it is kept once, with
``copies`` = how often it stands; counts add up ``copies``, and the few places that need single rows (the first n
of a review) write out no more than they need. ``host`` is the name that owns the list; ``filename`` may differ in
findings that an answer adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schemas
from ..functions.answers import entry_or_default, parse_answer, truthy
from ..functions.ordering import first_n, with_position
from ..functions.severity import answer_severity
from .scan import as_findings

NAME = ["review_id", "filename"]
LISTED_ORDER = ["first_ord", "file_ord", "layer", "seq", "sub"]
FILES_PER_SLICE = 1000
BLOCK = 500


def real_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.coalesce("false_positive", F.lit(False)))


def dismissed_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.coalesce("false_positive", F.lit(False)))


def names_in_review(files: DataFrame) -> DataFrame:
    """Per review and file name: how many files carry it, and the first and last of them."""
    return files.groupBy(*NAME).agg(
        F.count(F.lit(1)).alias("copies"), F.min("file_ord").alias("first_ord"), F.max("file_ord").alias("last_ord")
    )


def findings_for_file(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of each name's list with ``host``, ``copies``, ``first_ord`` and ``last_ord``."""
    return raw.join(names_in_review(files), NAME).withColumn("host", F.col("filename"))


def finding_position(listed: DataFrame) -> DataFrame:
    """Adds ``position``, the 1-based place of a finding in its name's list."""
    return with_position(
        listed, ["review_id", "host"], F.expr(f"file_ord div {FILES_PER_SLICE}"),
        schemas.FINDING_ORDER, "position",
    )


def review_entries(answers: DataFrame) -> DataFrame:
    """Verdicts by position. Entries without a usable index are left out; of a repeated index the last counts."""
    parsed = parse_answer(F.col("answer"), schemas.REVIEW_ANSWER)["reviewed"]
    entries = answers.select("review_id", F.col("filename").alias("host"), F.posexplode(parsed).alias("pos", "entry"))
    position = F.col("entry")["index"].try_cast("bigint")
    return (
        entries.withColumn("position", position)
        .filter(F.col("position").isNotNull())
        .groupBy("review_id", "host", "position")
        .agg(F.max_by("entry", "pos").alias("entry"))
    )


def skipped_entries(answers: DataFrame) -> DataFrame:
    """How many verdict entries per review could not be used for want of an index."""
    parsed = parse_answer(F.col("answer"), schemas.REVIEW_ANSWER)["reviewed"]
    entries = answers.select("review_id", F.explode(parsed).alias("entry"))
    unusable = entries.filter(F.col("entry")["index"].try_cast("bigint").isNull())
    return unusable.groupBy("review_id").agg(F.count(F.lit(1)).alias("n_skipped"))


def apply_verdicts(positioned: DataFrame, answers: DataFrame) -> DataFrame:
    """Marks dismissed findings and adds the exploitation note to the others; no row is lost or gained."""
    joined = positioned.join(review_entries(answers), ["review_id", "host", "position"], "left")
    entry = F.col("entry")
    dismissed = F.coalesce(truthy(entry["false_positive"]), F.lit(False))
    note = entry["exploitation_context"]
    noted = F.concat("description", F.lit("\n\nExploitation: "), note)
    return joined.withColumns({
        "false_positive": dismissed,
        "fp_reason": F.when(dismissed, entry_or_default(entry, "fp_reason", fv.DEFAULT_REASON)),
        "description": F.when(~dismissed & (F.length(note) > 0), noted).otherwise(F.col("description")),
    }).drop("entry")


def append_additional(answers: DataFrame, listed: DataFrame) -> DataFrame:
    """Findings that answers add, for names that already had findings; they close the name's list."""
    hosts = listed.groupBy("review_id", "host").agg(
        *[F.first(c).alias(c) for c in ("copies", "first_ord", "last_ord")]
    )
    parsed = parse_answer(F.col("answer"), schemas.REVIEW_ANSWER)["additional_issues"]
    entries = answers.select("review_id", F.col("filename").alias("host"), F.posexplode(parsed).alias("pos", "entry"))
    entry = F.col("entry")
    rows = entries.join(hosts, ["review_id", "host"]).select(
        "review_id", "host", "copies", "first_ord", "last_ord",
        F.col("last_ord").alias("file_ord"),
        F.lit(4).alias("layer"),
        (F.col("pos") + 1).alias("seq"),
        F.lit(1).alias("sub"),
        F.coalesce(entry["filename"], F.lit("unknown")).alias("filename"),
        F.coalesce(entry["line"].try_cast("int"), F.lit(0)).alias("line"),
        answer_severity(F.coalesce(entry["severity"], F.lit("medium"))).alias("severity"),
        F.coalesce(entry["category"], F.lit("Security Issue")).alias("category"),
        F.lit(None).cast("string").alias("cwe_id"),
        F.lit(None).cast("string").alias("owasp"),
        F.coalesce(entry["description"], F.lit("")).alias("description"),
        F.lit(fv.SOURCE_ANSWER).alias("source"),
        F.lit(None).cast("string").alias("code_snippet"),
    )
    keep = ["host", "copies", "first_ord", "last_ord"]
    return as_findings(rows, keep).withColumn("position", F.lit(None).cast("bigint"))


def triaged(listed: DataFrame, answers: DataFrame) -> DataFrame:
    """The final findings: verdicts applied, additions appended."""
    judged = apply_verdicts(finding_position(listed), answers)
    return judged.unionByName(append_additional(answers, listed))


def clean_files(files: DataFrame, raw: DataFrame) -> DataFrame:
    """Files without any finding."""
    return files.join(raw.select(*NAME).distinct(), NAME, "left_anti")


def first_listed(findings: DataFrame, files: DataFrame, n: int, name: str) -> DataFrame:
    """The first n findings of every review in listing order, repeats of shared names written out.

    At most n findings per name and n files per name can be among the first n, so never more than that is joined.
    """
    per_name = first_n(findings, ["review_id", "host"], schemas.FINDING_ORDER, n, "_in_name")
    owners = files.select("review_id", F.col("filename").alias("host"), F.col("file_ord").alias("listed_ord"))
    owners = first_n(owners, ["review_id", "host"], ["listed_ord"], n, "_copy")
    rows = per_name.join(owners, ["review_id", "host"]).drop("_copy", "_in_name")
    return first_n(rows, ["review_id"], ["listed_ord", *schemas.FINDING_ORDER], n, name)


def top_report_rows(findings: DataFrame, files: DataFrame) -> DataFrame:
    """The first 20 real findings of every review."""
    return first_listed(real_findings(findings), files, fv.MAX_REPORT_ROWS, "row_no")


def review_requests(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Requests to an outside reviewer: the start of a file's source and the numbered findings of its name.

    The first row names the task and the answer that `apply_verdicts` reads. Every file gets one row. A list longer than BLOCK findings continues in further rows (`part` 1, 2, ...)
    that stand once per name, so neither a row nor the number of rows grows beyond the findings themselves.
    """
    snippet = F.substring(F.coalesce("code_snippet", F.lit("")), 1, fv.REQUEST_SNIPPET)
    block = F.format_string(
        "\n#%d %s at %s:%d, rated %s by %s\n%s\n> %s\n",
        "position", "category", "filename", "line", "severity", "source", "description", snippet,
    )
    blocks_in_order = F.sort_array(F.collect_list(F.struct("position", "block")))
    parts = (
        finding_position(listed)
        .withColumns({"part": F.expr(f"cast((position - 1) div {BLOCK} as int)"), "block": block})
        .groupBy("review_id", "host", "part")
        .agg(
            F.array_join(F.transform(blocks_in_order, lambda x: x["block"]), "").alias("findings"),
            F.first("first_ord").alias("first_ord"),
        )
    )
    sources = files.select(
        "review_id", "file_ord", F.col("filename").alias("host"),
        F.substring("content", 1, fv.REQUEST_SOURCE).alias("head"),
    )
    heading = F.concat(F.lit(fv.SECURITY_TASK + "\n"), F.col("head"), F.lit("\n===\n"))
    first = sources.join(parts.filter(F.col("part") == 0), ["review_id", "host"]).select(
        "review_id", "file_ord", F.col("host").alias("filename"), "part",
        F.concat(heading, F.col("findings")).alias("request"),
    )
    more = parts.filter(F.col("part") > 0).select(
        "review_id", F.col("first_ord").alias("file_ord"), F.col("host").alias("filename"), "part",
        F.col("findings").alias("request"),
    )
    return first.unionByName(more)
