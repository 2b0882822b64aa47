"""Reducing a review's rows to verdict, counts, summary, progress events and comment lines.

Headers are one row per review. Everything that lists rows stays a table of rows with order columns: a review may
hold a large share of all findings, and one text or array per review would put it into a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.severity import severity_rank
from .triage import LISTED_ORDER, NAME, real_findings


def _is_real() -> Column:
    return ~F.coalesce("false_positive", F.lit(False))


def _weighted(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("copies")).otherwise(0))


def severity_breakdown(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Counts of real findings per review in the five severities; reviews without findings have zeros."""
    counts = findings.groupBy("review_id").agg(
        *[_weighted(_is_real() & (F.col("severity") == s)).alias(s) for s in fv.SEVERITIES]
    )
    return reviews.join(counts, "review_id", "left").fillna(0, fv.SEVERITIES)


def verdict_of(worst_rank: Column) -> Column:
    """Critical or high -> request_changes; medium -> comment; else approve."""
    return (
        F.when(worst_rank >= 4, F.lit("request_changes"))
        .when(worst_rank == 3, F.lit("comment"))
        .otherwise(F.lit("approve"))
    )


def verdict(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Verdict per review. Quality issues never count; a review without findings is approved."""
    worst = real_findings(findings).groupBy("review_id").agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    return reviews.join(worst, "review_id", "left").select(
        "review_id", verdict_of(F.coalesce("worst", F.lit(0))).alias("verdict")
    )


COUNTS = ["n_files", "n_real", "n_dismissed", "n_quality", "n_fixes", "n_tests"]


def summary_counts(
    reviews: DataFrame, files: DataFrame, findings: DataFrame, quality: DataFrame, fixes: DataFrame, tests: DataFrame
) -> DataFrame:
    """All counts of a review, its severity buckets and worst severity, in one aggregation over tagged rows."""
    blank = {c: F.lit(0).cast("bigint") for c in (*COUNTS, *fv.SEVERITIES, "worst")}

    def tagged(rows: DataFrame, **values: Column) -> DataFrame:
        columns = blank | values
        return rows.select("review_id", *[columns[c].cast("bigint").alias(c) for c in blank])

    one, copies = F.lit(1), F.col("copies")
    when_real = lambda value: F.when(_is_real(), value).otherwise(0)
    buckets = {s: when_real(F.when(F.col("severity") == s, copies).otherwise(0)) for s in fv.SEVERITIES}
    rows = tagged(reviews)
    rows = rows.unionByName(tagged(files, n_files=one))
    rows = rows.unionByName(tagged(
        findings, n_real=when_real(copies), n_dismissed=F.when(~_is_real(), copies).otherwise(0),
        worst=when_real(severity_rank(F.col("severity"))), **buckets,
    ))
    rows = rows.unionByName(tagged(quality, n_quality=one))
    rows = rows.unionByName(tagged(fixes, n_fixes=one))
    rows = rows.unionByName(tagged(tests, n_tests=one))
    sums = [F.sum(c).alias(c) for c in (*COUNTS, *fv.SEVERITIES)]
    return rows.groupBy("review_id").agg(*sums, F.max("worst").alias("worst"))


def summary_text() -> Column:
    return F.format_string(
        fv.SUMMARY_TEXT, "n_real", "n_quality", "n_files", "n_dismissed", "n_fixes", "n_tests"
    )


def report_headers(counts: DataFrame) -> DataFrame:
    """One row per review: verdict, summary, breakdown, number of files."""
    return counts.select(
        "review_id",
        verdict_of(F.col("worst")).alias("verdict"),
        summary_text().alias("summary"),
        F.struct(*fv.SEVERITIES).alias("severity_breakdown"),
        F.col("n_files").alias("files_reviewed"),
    )


def report_slices(counts: DataFrame) -> DataFrame:
    """The five tabs of a report with their sizes."""
    tabs = [("security", "n_real"), ("quality", "n_quality"), ("fixes", "n_fixes"), ("tests", "n_tests"), ("fp", "n_dismissed")]
    pairs = F.array(*[F.struct(F.lit(k).alias("tab"), F.col(c).alias("n_rows")) for k, c in tabs])
    return counts.select("review_id", F.explode(pairs).alias("t")).select("review_id", "t.*")


def event_log(counts: DataFrame, at: Column | None = None) -> DataFrame:
    """One progress row per stage and review, zero counts included."""
    found = F.col("n_real") + F.col("n_dismissed")
    values = [F.col("n_files"), found, F.col("n_quality"), F.col("n_fixes"), F.col("n_tests"), verdict_of(F.col("worst"))]
    rows = [
        F.struct(F.lit(i).alias("stage"), F.lit(agent).alias("agent"), F.format_string(text, value).alias("message"))
        for i, ((agent, text), value) in enumerate(zip(fv.EVENT_TEXT, values), 1)
    ]
    events = counts.select("review_id", F.explode(F.array(*rows)).alias("e")).select("review_id", "e.*")
    return events if at is None else events.withColumn("ts", at)


def findings_by_file(findings: DataFrame) -> DataFrame:
    """Groups of real findings by file name, with size and place of the first one."""
    return real_findings(findings).groupBy(*NAME).agg(
        F.sum("copies").alias("n_issues"), F.min(F.struct(*LISTED_ORDER)).alias("first_place")
    )


def distinct_sources(findings: DataFrame) -> DataFrame:
    """The sources and severities that occur in a review (both come from short fixed lists)."""
    return real_findings(findings).groupBy("review_id").agg(
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.sort_array(F.collect_set("severity")).alias("severities"),
    )


COMMENT_ORDER = ["review_id", "section", "group_place", "place", "line_no"]
_PLACE = "struct<first_ord:int,file_ord:int,layer:int,seq:int,sub:int>"


def _lines(rows: DataFrame, section: int, texts: list[Column], group: Column, place: Column, copies: Column) -> DataFrame:
    """Text lines from rows; a null text is no line."""
    return rows.select(
        "review_id", F.lit(section).alias("section"), group.cast(_PLACE).alias("group_place"),
        place.cast(_PLACE).alias("place"), copies.cast("bigint").alias("copies"),
        F.posexplode(F.array(*texts)).alias("line_no", "text"),
    ).filter(F.col("text").isNotNull())


def comment_markdown(counts: DataFrame, findings: DataFrame, fixes: DataFrame, tests: DataFrame) -> DataFrame:
    """The review comment as ordered lines (see COMMENT_ORDER); `copies` = how often the line stands."""
    none, one = F.lit(None), F.lit(1)
    say = F.format_string
    verdict_name = verdict_of(F.col("worst"))
    icon = F.create_map(*[F.lit(x) for pair in fv.VERDICT_ICON.items() for x in pair])
    title = F.create_map(*[F.lit(x) for pair in fv.VERDICT_TITLE.items() for x in pair])
    head = _lines(counts, 0, [
        say("## [%s] Review -- %s", icon[verdict_name], title[verdict_name]),
        F.lit(""), F.concat(F.lit("> "), summary_text()), F.lit(""),
        F.lit("### Security Issues"), F.lit("| Severity | Count |"), F.lit("|----------|-------|"),
        say("| Critical | %d |", "critical"), say("| High     | %d |", "high"),
        say("| Medium   | %d |", "medium"), say("| Low      | %d |", "low"), F.lit(""),
        F.when(F.col("n_real") > 0, F.lit("### Findings")),
    ], none, none, one)

    groups = findings_by_file(findings)
    before = F.struct(*[F.lit(-1).alias(c) for c in LISTED_ORDER])
    after = F.struct(*[F.lit(2147483647).alias(c) for c in LISTED_ORDER])
    group_head = _lines(groups, 1, [F.lit(""), say("**%s** -- %d issue(s)", "filename", "n_issues"), F.lit("")],
                        F.col("first_place"), before, one)
    group_foot = _lines(groups, 1, [F.lit("")], F.col("first_place"), after, one)
    listed = real_findings(findings).join(groups.select(*NAME, "first_place"), NAME)
    rows = _lines(listed, 1, [
        say("- [%s] %s (line %d): %s", F.upper("severity"), "category", "line", "description"),
        F.when(F.length("cwe_id") > 0, F.concat(F.lit("  - "), F.col("cwe_id"))),
    ], F.col("first_place"), F.struct(*LISTED_ORDER), F.col("copies"))

    def place(number: str) -> Column:
        return F.struct(*[(F.col(number) if c == "first_ord" else F.lit(0)).alias(c) for c in LISTED_ORDER])

    fix_head = _lines(counts, 2, [
        F.when(F.col("n_fixes") > 0, F.lit("")),
        F.when(F.col("n_fixes") > 0, say("### Fixes Generated -- %d patch(es)", "n_fixes")),
    ], none, none, one)
    state = F.when(F.col("validated"), F.lit("syntax validated")).otherwise(F.lit("needs review"))
    fix_lines = _lines(fixes, 2, [say("- %s: %s (%s)", "filename", "description", state)], none, place("item"), one)
    test_head = _lines(counts, 3, [
        F.when(F.col("n_tests") > 0, F.lit("")),
        F.when(F.col("n_tests") > 0, say("### Tests Generated -- %d file(s)", "n_tests")),
    ], none, none, one)
    test_lines = _lines(tests, 3, [
        say("- %s (%s) covers: %s", "filename", "framework", F.array_join("covers", ", "))
    ], none, place("file_ord"), one)
    foot = _lines(counts, 4, [
        F.lit(""), F.lit("---"), say("Reviewed %d file(s) -- Review ID: %d", "n_files", "review_id")
    ], none, none, one)

    lines = head
    for part in (group_head, rows, group_foot, fix_head, fix_lines, test_head, test_lines, foot):
        lines = lines.unionByName(part)
    return lines
