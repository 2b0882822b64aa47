"""Work items for fixes and tests, the requests made for them, and the rows read from the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schemas
from ..functions.answers import parse_answer
from ..functions.ordering import first_n
from ..functions.python_checks import syntax_valid
from ..functions.reduce import keep_likely
from ..functions.text import last_part, window_around_line
from .triage import NAME, first_listed, names_in_review, real_findings


def fixable(findings: DataFrame) -> DataFrame:
    """Real findings of medium severity or worse that do not come from unit scoring."""
    return real_findings(findings).filter(
        F.col("severity").isin(fv.FIXABLE_SEVERITIES) & (F.col("source") != fv.SOURCE_UNITS)
    )


def first_n_fixes(findings: DataFrame, files: DataFrame) -> DataFrame:
    """The first 10 fixable findings of every review, numbered in ``item``; failed ones are not replaced."""
    return first_listed(fixable(findings), files, fv.MAX_FIXES, "item")


def match_guidance(category: Column) -> Column:
    """The first guidance whose key is part of the category, else the fallback."""
    chain = None
    for key, guidance in fv.GUIDANCE:
        hit = F.contains(F.lower(category), F.lit(key))
        chain = F.when(hit, F.lit(guidance)) if chain is None else chain.when(hit, F.lit(guidance))
    return chain.otherwise(F.lit(fv.FALLBACK_GUIDANCE))


def attach_content(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items with the text of the named file ('' if unknown; of a repeated name the last file counts).

    The last file of a name is found on the keys alone; texts are joined by file, and those that no item wants are left where they are.
    """
    last = names_in_review(files).select(*NAME, F.col("last_ord").alias("_ord"))
    texts = files.select("review_id", F.col("file_ord").alias("_ord"), "content")
    named = items.join(last, NAME, "left")
    texts = keep_likely(texts, named.select("review_id", "_ord"), ["review_id", "_ord"])
    joined = named.join(texts, ["review_id", "_ord"], "left").drop("_ord")
    return joined.withColumn("content", F.coalesce("content", F.lit("")))


def fix_requests(items: DataFrame, files: DataFrame) -> DataFrame:
    """One request per work item. File texts are only needed where the finding has no snippet."""
    snippet = F.coalesce("code_snippet", F.lit(""))
    without = attach_content(items.filter(snippet == ""), files).withColumn(
        "shown", window_around_line(F.col("content"), F.col("line"))
    )
    shown = items.filter(snippet != "").withColumn("shown", F.col("code_snippet")).unionByName(without.drop("content"))
    text = F.format_string(
        "ISSUE:\n  File: %s\n  Line: %d\n  Category: %s\n  Severity: %s\n  Description: %s\n\nCODE:\n%s\n\nGUIDANCE: %s\n",
        "filename", "line", "category", "severity", "description", "shown", match_guidance(F.col("category")),
    )
    return shown.select("review_id", "item", "id", "filename", F.concat(F.lit(fv.FIX_TASK + "\n\n"), text).alias("request"))


def fix_rows(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Fixes read from answers (review_id, item, answer); an unreadable answer drops its item."""
    parsed = answers.select("review_id", "item", parse_answer(F.col("answer"), schemas.FIX_ANSWER).alias("a"))
    rows = items.join(parsed.filter(F.col("a").isNotNull()), ["review_id", "item"])
    fixed = F.coalesce("a.fixed", F.lit(""))
    return rows.select(
        "review_id", "item", F.col("id").alias("issue_id"), "filename",
        F.coalesce("a.description", F.lit("Fix applied")).alias("description"),
        F.coalesce("a.original", "code_snippet", F.lit("")).alias("original"),
        fixed.alias("fixed"),
        F.coalesce("a.explanation", F.lit("")).alias("explanation"),
        syntax_valid(fixed).alias("validated"),
    )


# ---- tests ------------------------------------------------------------------------------------------------------


def files_with_fix(files: DataFrame, fixes: DataFrame) -> DataFrame:
    return files.join(fixes.select(*NAME), NAME, "left_semi")


def fixes_per_file(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Files with the number of fixes made under their name, 0 if none."""
    counts = fixes.groupBy(*NAME).agg(F.count(F.lit(1)).alias("n_fixes"))
    return files.join(counts, NAME, "left").withColumn("n_fixes", F.coalesce("n_fixes", F.lit(0)))


def first_n_test_files(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """The first 5 eligible files of every review: with a fix, with functions or with content.

    A file with functions has content, so functions need no look-up here.
    """
    keys = files.select("review_id", "file_ord", "filename", "language", (F.col("content") != "").alias("_full"))
    counted = fixes_per_file(keys, fixes)
    eligible = counted.filter(F.col("_full") | (F.col("n_fixes") > 0)).drop("_full")
    return first_n(eligible, ["review_id"], ["file_ord"], fv.MAX_TEST_FILES, "file_no")


def first_n_functions(units: DataFrame) -> DataFrame:
    """The first 5 functions of every file; ``unit_ord`` already numbers them."""
    return units.filter(F.col("unit_ord") <= fv.MAX_TEST_FUNCTIONS)


def test_eligible(files: DataFrame, units: DataFrame, fixes: DataFrame) -> DataFrame:
    """The files tests are written for: cut to 5 first, then those with functions, with these functions."""
    in_order = F.sort_array(F.collect_list(F.struct("unit_ord", "name", "source")))
    functions = first_n_functions(units).groupBy("review_id", "file_ord").agg(in_order.alias("functions"))
    return first_n_test_files(files, fixes).join(functions, ["review_id", "file_ord"])


def _names() -> Column:
    return F.transform("functions", lambda f: f["name"])


def framework(language: Column) -> Column:
    return F.when(language == "python", F.lit("pytest")).otherwise(F.lit("jest"))


def test_requests(eligible: DataFrame) -> DataFrame:
    source = F.array_join(F.transform("functions", lambda f: f["source"]), "\n\n")
    text = F.format_string(
        "FRAMEWORK: %s\nFILE: %s\nLANGUAGE: %s\nFUNCTIONS: %s\nFIXED ISSUES: %d\n\nSOURCE:\n%s\n",
        framework(F.col("language")), "filename", "language", F.array_join(_names(), ", "), "n_fixes",
        F.substring(source, 1, fv.TEST_SOURCE),
    )
    return eligible.select("review_id", "file_ord", "filename", F.concat(F.lit(fv.TEST_TASK + "\n\n"), text).alias("request"))


def test_rows(eligible: DataFrame, answers: DataFrame) -> DataFrame:
    """Tests read from answers (review_id, filename, answer); an unreadable answer drops its file."""
    parsed = answers.select("review_id", "filename", parse_answer(F.col("answer"), schemas.TEST_ANSWER).alias("a"))
    rows = eligible.join(parsed.filter(F.col("a").isNotNull()), NAME)
    return rows.select(
        "review_id", "file_ord",
        F.coalesce("a.filename", F.concat(F.lit("test_"), last_part(F.col("filename"), "/"))).alias("filename"),
        framework(F.col("language")).alias("framework"),
        F.coalesce("a.content", F.lit("")).alias("content"),
        F.coalesce("a.covers", _names()).alias("covers"),
    )


def quality_requests(files: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit(fv.QUALITY_TASK + "\n\nFILE: "), F.col("filename"), F.lit("\nSOURCE:\n"), F.substring("content", 1, fv.REQUEST_SOURCE), F.lit("\n")
    )
    return files.filter(F.col("content") != "").select("review_id", "file_ord", "filename", text.alias("request"))
