"""One query per operator, over the given tables or tables derived from them.

Every callable takes (spark, folder) and returns a DataFrame over whole tables. Nested results are flattened and
floating-point results rounded, so that they can be compared with SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schemas
from ..functions import text as tx
from ..functions.answers import parse_answer
from ..functions.ordering import with_position
from ..functions.python_checks import signature_of, signature_valid
from ..functions.severity import severity_rank
from ..functions.stats import wilson_bounds
from ..operators import classify, dedupe, evaluate, report, rescan, scan, triage, units, worklist
from ..operators import files as file_ops
from ..operators import quality as quality_ops
from ..operators.rules import RULE_PACK, TEXT_PACK, rule_table
from ..sources import corpus as corpus_source
from ..sources import files as file_source
from ..sources import scanner_json, sinks
from ..staging import checkpoint_folder, stage
from ..streaming import events as event_ops
from ..streaming import reviews as review_streams
from .review import Review, merge_branches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_reviews: dict[tuple[str, str], Review] = {}


def review(spark: SparkSession, folder: str) -> Review:
    """The review job over a folder; its written tables are shared by the queries of one session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _reviews:
        documents = table(spark, folder, "documents")
        answers = [corpus_source.answers(documents, s) for s in ("security", "quality", "fix", "test")]
        _reviews[key] = Review(corpus_source.corpus(documents), *answers)
    return _reviews[key]


def forget_reviews() -> None:
    """Drop shared tables, so that the next query computes everything itself (used by the bench)."""
    _reviews.clear()


def documents_of(spark, folder) -> DataFrame:
    return table(spark, folder, "documents")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


ITEM = ["review_id", "file_ord", "layer", "seq", "sub", "id", "filename", "line", "severity", "category"]


# ---- flagship: which reviews are blocked, and why ----------------------------------------------------------------


def text_hits(spark, folder) -> DataFrame:
    docs = documents_of(spark, folder).select(
        F.expr("doc_id div 20").alias("review_id"), F.expr("cast(doc_id % 20 as int)").alias("file_ord"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("text").alias("content"), F.lit("p/text").alias("ruleset"),
    )
    hits = scan.rule_hits(scan.source_lines(docs), TEXT_PACK)
    meanings = scan.rule_meanings(rule_table(spark, TEXT_PACK))
    return hits.join(F.broadcast(meanings), "rule_ord").withColumns(
        {"false_positive": F.lit(False), "copies": F.lit(1).cast("bigint")}
    )


@query
def blocked_reviews(spark, folder) -> DataFrame:
    """Verdict and severity breakdown of every review of documents, from the text rules.

    Documents and hits are stacked and aggregated once, so a review without hits keeps its zeros without a join.
    """
    hits = text_hits(spark, folder).select("review_id", "severity")
    every = documents_of(spark, folder).select(
        F.expr("doc_id div 20").alias("review_id"), F.lit(None).cast("string").alias("severity")
    )
    severity = F.col("severity")
    counts = every.unionByName(hits).groupBy("review_id").agg(
        F.max(severity_rank(severity)).alias("worst"), *[F.count_if(severity == s).alias(s) for s in fv.SEVERITIES]
    )
    return counts.select("review_id", report.verdict_of(F.col("worst")).alias("verdict"), *fv.SEVERITIES)


# ---- sources and sinks --------------------------------------------------------------------------------------------


def _file_struct(**columns: Column) -> Column:
    given = {"filename": F.lit(None), "language": F.lit(None), "content": F.lit(None), "patch": F.lit(None),
             "additions": F.lit(None), "deletions": F.lit(None)} | columns
    kinds = {"additions": "int", "deletions": "int"}
    return F.struct(*[c.cast(kinds.get(n, "string")).alias(n) for n, c in given.items()])


@query
def read_pr_files(spark, folder):
    doc = F.col("doc_id").cast("string")
    body = F.to_json(F.struct(F.array(
        _file_struct(filename=F.concat(F.lit("a"), doc, F.lit(".py")), content=F.col("text")),
        _file_struct(filename=F.concat(F.lit("b"), doc, F.lit(".ts")), content=F.lit("let b"), patch=F.lit("@@"),
                     language=F.lit("typescript"), additions=F.col("doc_id") % 7, deletions=F.lit(1)),
    ).alias("files")))
    requests = documents_of(spark, folder).select(
        F.col("doc_id").alias("review_id"), F.from_json(body, schemas.REVIEW_REQUEST)["files"].alias("files")
    )
    return file_source.explode_requests(requests)


@query
def read_source_text(spark, folder):
    """Every document as a file of its own, read back by name."""
    target = f"{checkpoint_folder(spark)}/texts-{uuid.uuid4().hex}"
    marked = F.concat(F.coalesce("text", F.lit("")), F.lit("\u0001"))  # Spark does not read empty files
    sinks.write_texts(documents_of(spark, folder).select(F.col("doc_id").alias("name"), marked.alias("text")), target)
    number = F.regexp_extract("path", "name=(-?[0-9]+)-[0-9]+-[0-9]+[.]txt$", 1).cast("bigint")
    return file_source.read_source_text(spark, target).select(
        number.alias("doc_id"), (F.length("content") - 1).alias("n_chars"), F.md5(F.substring("content", F.lit(1), F.length("content") - 1)).alias("digest"))


def _payloads(spark, folder) -> DataFrame:
    """Hook deliveries derived from the event table."""
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    kind = F.col("event_type")
    inline = F.array(
        F.struct(F.concat(F.lit("src/f"), s, F.lit(".py")).alias("filename"),
                 F.concat(F.lit("https://host.example/c/"), s).alias("contents_url"),
                 F.lit("@@").alias("patch"), (i % 50).cast("int").alias("additions"), F.lit(2).alias("deletions")),
        F.struct(F.lit("README.md").alias("filename"), F.lit(None).cast("string").alias("contents_url"),
                 F.lit(None).cast("string").alias("patch"), F.lit(None).cast("int").alias("additions"),
                 F.lit(None).cast("int").alias("deletions")),
    )
    action = (
        F.when(kind == "view", "opened").when(kind == "click", "synchronize").when(kind == "signup", "reopened")
        .otherwise("closed")
    )
    payload = F.to_json(F.struct(
        action.alias("action"),
        F.struct(F.concat(F.lit("https://host.example/o/r/pull/"), s, F.lit("/")).alias("html_url"),
                 i.alias("number"), F.when(i % 3 != 0, inline).alias("files")).alias("pull_request"),
        F.struct(F.lit("o/r").alias("full_name")).alias("repository"),
    ))
    event = F.when(kind == "error", "push").otherwise("pull_request")
    return table(spark, folder, "events").select(
        i.alias("review_id"), event.alias("event"), F.lit(None).cast("string").alias("signature"), payload.alias("payload")
    )


def _fetched(spark, folder) -> tuple[DataFrame, DataFrame]:
    """File lists of every other change, and the contents of two thirds of the files, as an outside job would fetch them."""
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    events = table(spark, folder, "events")
    address = F.concat(F.lit("https://host.example/c/"), s)
    file = F.struct(F.concat(F.lit("listed/f"), s, F.lit(".py")).alias("filename"), address.alias("contents_url"),
                    F.lit(None).cast("string").alias("raw_url"), F.lit("@@ l").alias("patch"), F.lit(3).alias("additions"),
                    F.lit(None).cast("int").alias("deletions"))
    listing = events.where(i % 2 == 0).select(F.lit("o/r").alias("repository"), i.cast("int").alias("number"), F.array(file).alias("files"))
    contents = events.where(i % 3 != 1).select(address.alias("url"), F.concat(F.lit("kind = "), "event_type").alias("content"))
    return listing, contents


@query
def read_pr_events(spark, folder):
    return event_ops.events_to_files(_payloads(spark, folder), *_fetched(spark, folder))


@query
def shape_changed_files(spark, folder):
    docs = documents_of(spark, folder)
    doc = F.col("doc_id").cast("string")
    none = F.lit(None)
    unfetched = F.struct(
        none.cast("string").alias("filename"), F.concat(F.lit("gone/"), doc).alias("raw_url"), none.cast("string").alias("patch"),
        none.cast("int").alias("additions"), none.cast("int").alias("deletions"))
    listing = docs.select(F.col("doc_id").alias("review_id"), F.array(F.struct(
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("m"), doc, F.lit(".js"))).alias("filename"),
        F.concat(F.lit("raw/"), doc).alias("raw_url"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("@@")).alias("patch"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(4)).alias("additions"),
        F.lit(None).cast("int").alias("deletions"),
    ), unfetched).alias("files"))
    contents = docs.select(F.concat(F.lit("raw/"), doc).alias("url"), F.col("text").alias("content"))
    return file_source.shape_changed_files(listing, contents)


@query
def read_labelled_jsonl(spark, folder):
    rows = _labelled(spark, folder)
    line = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("code"), F.col("toxic").alias("label"),
                              F.when(F.col("doc_id") % 2 == 0, F.lit("pattern")).alias("kind")))
    both = F.explode(F.array(line, F.lit("   "))).alias("value")
    return file_source.labelled_items(rows.select(both))


@query
def unpivot_pairs(spark, folder):
    pairs = table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("id"),
        F.when(F.col("item_id") % 3 == 0, F.lit("semantic")).otherwise(F.lit("pattern")).alias("kind"),
        F.col("text").alias("vulnerable"), F.reverse("text").alias("safe"),
    )
    return file_source.unpivot_pairs(pairs)


def _bodies(spark, folder, shape: str) -> DataFrame:
    """Scanner results derived from documents, in all the odd shapes results come in."""
    doc = F.col("doc_id")
    code = F.col("text")
    null = lambda t: F.lit(None).cast(t)
    if shape == "rules":
        results = F.array(
            F.struct(
                F.element_at(F.array(*[F.lit(r) for r in ("B105", "B602", "B999", "B324")]), (doc % 4 + 1).cast("int")).alias("test_id"),
                F.when(doc % 6 != 0, F.lit("hard_coded-b64decode_USE")).alias("test_name"),
                F.element_at(F.array(*[F.lit(r) for r in ("HIGH", "medium", "LOW", "ODD")]), (doc % 4 + 1).cast("int")).alias("issue_severity"),
                F.concat(F.lit("issue in "), doc.cast("string")).alias("issue_text"),
                F.when(doc % 5 != 0, (doc % 40).cast("int")).alias("line_number"),
                F.concat(F.lit("  "), code, F.lit(" \n")).alias("code"),
                F.concat(F.lit("/tmp/x/item"), doc.cast("string"), F.lit(".py")).alias("filename"),
            ),
            F.struct(null("string").alias("test_id"), F.lit("plain").alias("test_name"), F.lit("LOW").alias("issue_severity"),
                     null("string").alias("issue_text"), F.lit(3).alias("line_number"), null("string").alias("code"),
                     F.lit("/tmp/x/__init__.py").alias("filename")),
        )
    else:
        results = F.array(F.struct(
            F.concat(F.lit("python.lang.security-audit.eval_used-"), (doc % 3).cast("string")).alias("check_id"),
            F.concat(F.lit("/w/dir/item"), doc.cast("string"), F.lit(".py")).alias("path"),
            F.struct(F.when(doc % 5 != 0, (doc % 40).cast("int")).alias("line")).alias("start"),
            F.struct(
                F.element_at(F.array(F.lit("ERROR"), F.lit("warning"), F.lit("INFO"), F.lit("ODD"), null("string")),
                             (doc % 5 + 1).cast("int")).alias("severity"),
                F.lit("message").alias("message"), F.concat(F.lit(" "), code).alias("lines")).alias("extra"),
        ))
    body = F.to_json(F.struct(results.alias("results")))
    empty = F.when(doc % 7 == 3, F.lit("{}")).when(doc % 11 == 4, F.lit("not json"))
    bodies = F.explode(F.array_compact(F.array(body, empty))).alias("body")
    return documents_of(spark, folder).select(
        doc.alias("file_id"), F.concat(F.lit("f"), doc.cast("string"), F.lit(".py")).alias("filename"), bodies)


@query
def normalize_rule_scanner(spark, folder):
    return scanner_json.normalize_rule_scanner(_bodies(spark, folder, "rules"))


@query
def normalize_pattern_scanner(spark, folder):
    return scanner_json.normalize_pattern_scanner(_bodies(spark, folder, "patterns"))


@query
def batch_scan_input(spark, folder):
    rows = scanner_json.batch_scan_rows(_bodies(spark, folder, "rules"), "rules")
    more = scanner_json.batch_scan_rows(_bodies(spark, folder, "patterns"), "patterns")
    return rows.withColumn("tool", F.lit("rules")).unionByName(more.withColumn("tool", F.lit("patterns")))


@query
def write_report(spark, folder):
    """All reports written, every third review written again, and all five tables read back."""
    target = f"{checkpoint_folder(spark)}/report-{uuid.uuid4().hex}"
    r = review(spark, folder)
    tables = r.report
    sinks.replace_report(tables, r.reviews, target)
    again = r.reviews.where("review_id % 3 = 0")
    sinks.replace_report({n: t.where("review_id % 3 = 0") for n, t in tables.items()}, again, target)
    header, *others = (sinks.read_report(spark, target, n, t.schema).withColumn("_of", F.lit(n)) for n, t in tables.items())
    rows = header.select("review_id", "_of")
    for other in others:
        rows = rows.unionByName(other.select("review_id", "_of"))
    counts = rows.groupBy("review_id").agg(*[F.count_if(F.col("_of") == n).alias(f"n_{n}") for n in tables])
    return header.select("review_id", "verdict", "files_reviewed").join(counts, "review_id")


@query
def write_markdown(spark, folder):
    target = f"{checkpoint_folder(spark)}/comments-{uuid.uuid4().hex}"
    sinks.write_markdown(review(spark, folder).comment, target, report.COMMENT_ORDER)
    return spark.read.text(target, lineSep="\n")


@query
def event_log(spark, folder):
    return report.event_log(review(spark, folder).counts)


# ---- projections, filters, predicates ------------------------------------------------------------------------------


@query
def detect_language(spark, folder):
    names = review(spark, folder).pr_files.select("filename").unionByName(
        table(spark, folder, "pages").select(F.col("url").alias("filename"))
    )
    return names.select("filename", file_ops.detect_language(F.col("filename")).alias("language"))


@query
def accept_files(spark, folder):
    files = review(spark, folder).pr_files
    detected = files.withColumn("language", file_ops.detect_language(F.col("filename")))
    return file_ops.accept_files(detected).select("review_id", "file_ord", "filename", "language")


@query
def reject_malformed(spark, folder):
    good, bad = file_ops.reject_malformed(review(spark, folder).pr_files)
    keys = ["review_id", "file_ord", "filename", "language"]
    return good.select(*keys, F.lit(True).alias("ok")).unionByName(bad.select(*keys, F.lit(False).alias("ok")))


@query
def ast_available(spark, folder):
    columns = ["review_id", "file_ord", "filename", "language", "content", "patch", "additions", "deletions", "ast_available"]
    return review(spark, folder).parsed.select(columns)


@query
def route_layers(spark, folder):
    r = review(spark, folder)
    return file_ops.route_layers(r.parsed, r.units)


@query
def real_findings(spark, folder):
    return triage.real_findings(review(spark, folder).findings).select(*ITEM, "description")


@query
def dismissed_findings(spark, folder):
    return triage.dismissed_findings(review(spark, folder).findings).select(*ITEM, "fp_reason")


@query
def fixable(spark, folder):
    return worklist.fixable(review(spark, folder).findings).select(*ITEM, "source", "copies")


@query
def score_threshold(spark, folder):
    scored = scan.unit_scores(review(spark, folder).units)
    passed = scored.filter(F.col("score") >= fv.SCORE_THRESHOLD)
    level = lambda high: F.when(high, F.lit("high")).otherwise(F.lit("medium"))
    return passed.select(
        "review_id", "file_ord", "unit_ord", "name", "score",
        level(F.col("score") >= fv.HIGH_SCORE).alias("pattern_severity"),
        level(F.col("score") > fv.HIGH_SCORE).alias("model_severity"),
    )


@query
def length_band(spark, folder):
    rows = evaluate.length_band(documents_of(spark, folder), "text")
    return evaluate.distinct_texts(rows.select("doc_id", "source", "text"), "text", "doc_id")


@query
def blank_unit_filter(spark, folder):
    turns = table(spark, folder, "conversations")
    blank = turns.where("turn % 3 = 0").select("conv_id", F.col("turn") + 1_000_000, F.lit(" \n\t"))
    rows = scan.unit_scores(turns.select("conv_id", "turn", F.col("text").alias("source")).union(blank))
    return rows.select("conv_id", "turn", F.length("source").alias("n_chars"), "score")


@query
def test_eligible(spark, folder):
    names = F.array_join(F.transform("functions", lambda f: f["name"]), ",").alias("names")
    return review(spark, folder).test_files.select("review_id", "file_ord", "filename", "language", "n_fixes", "file_no", names)


@query
def status_filter(spark, folder):
    deliveries = _payloads(spark, folder).withColumn("action", F.get_json_object("payload", "$.action"))
    return file_ops.review_events_only(deliveries).select("review_id", "event", "action")


@query
def report_slices(spark, folder):
    return report.report_slices(review(spark, folder).counts)


@query
def metric_gates(spark, folder):
    return quality_ops.metric_gates(review(spark, folder).blocks)


# ---- units and metrics ---------------------------------------------------------------------------------------------


@query
def extract_functions(spark, folder):
    parsed = file_ops.parse_files(corpus_source.corpus(documents_of(spark, folder)))
    return units.extract_functions(parsed)


UNIT_KEY = ["review_id", "file_ord", "unit_ord", "name"]


@query
def function_length(spark, folder):
    return units.function_length(review(spark, folder).units).select(*UNIT_KEY, "start_line", "end_line", "n_lines")


@query
def missing_docstring(spark, folder):
    return review(spark, folder).units.filter(~F.col("has_docstring")).select(*UNIT_KEY)


@query
def parameter_count(spark, folder):
    return review(spark, folder).units.select(*UNIT_KEY, "params")


@query
def nesting_depth(spark, folder):
    return review(spark, folder).units.select(*UNIT_KEY, "nesting_depth", "nesting_line")


@query
def cyclomatic_complexity(spark, folder):
    rows = units.complexity(review(spark, folder).blocks)
    return rows.select("review_id", "file_ord", "kind", "name", "start_line", "complexity")


@query
def maintainability_index(spark, folder):
    rows = units.maintainability(review(spark, folder).blocks)
    return rows.withColumn("mi", F.round("mi", 6)).select("review_id", "file_ord", "complexity", "statements", "sloc", "comments", "mi")


@query
def quality_findings(spark, folder):
    return review(spark, folder).quality


@query
def presence_of_functions(spark, folder):
    return review(spark, folder).units.groupBy("review_id", "file_ord").agg(
        F.count(F.lit(1)).alias("n_functions"),
        (F.count_if(F.col("name").isin("traced", "wrapper")) >= 2).alias("has_expected"),
    )


# ---- joins ---------------------------------------------------------------------------------------------------------


@query
def match_patterns(spark, folder):
    return scan.match_patterns(review(spark, folder).units).select(*ITEM, "description", "code_snippet")


def _rule_ids(spark, folder) -> DataFrame:
    """Rule ids occurring in the documents, known or not."""
    ids = F.array(*[F.lit(r) for r in ("B105", "B301", "B602", "B605", "B324", "B999")])
    return documents_of(spark, folder).select("doc_id", F.element_at(ids, (F.col("doc_id") % 6 + 1).cast("int")).alias("rule_id"))


def _lookup(spark, values: dict, name: str) -> DataFrame:
    return spark.createDataFrame(list(values.items()), f"rule_id STRING, {name} STRING")


@query
def attach_cwe(spark, folder):
    return scan.attach_lookup(_rule_ids(spark, folder), "rule_id", _lookup(spark, fv.CWE_OF_RULE, "cwe_id"))


@query
def attach_owasp(spark, folder):
    return scan.attach_lookup(_rule_ids(spark, folder), "rule_id", _lookup(spark, fv.OWASP_OF_RULE, "owasp"))


@query
def ruleset_for_language(spark, folder):
    rulesets = spark.createDataFrame(list(fv.RULESET_OF_LANGUAGE.items()), "language STRING, ruleset STRING")
    files = review(spark, folder).pr_files.withColumn("language", file_ops.detect_language(F.col("filename")))
    return scan.ruleset_for_language(files.select("review_id", "file_ord", "language"), rulesets)


@query
def rule_scan(spark, folder):
    r = review(spark, folder)
    return scan.rule_scan(r.parsed, RULE_PACK)


@query
def rule_scan_documents(spark, folder):
    return text_hits(spark, folder).select("review_id", "file_ord", "filename", "line", "rule_id", "severity", "category")


@query
def user_rule_table(spark, folder):
    rules = rule_table(spark, [r for r in RULE_PACK if r.layer == 2]).withColumn("rule_ord", F.col("rule_ord") * 10)
    return scan.rule_scan(review(spark, folder).parsed, rules).select(*ITEM)


@query
def findings_for_file(spark, folder):
    return review(spark, folder).listed.select(*ITEM, "host", "copies", "first_ord", "last_ord")


@query
def apply_verdicts(spark, folder):
    r = review(spark, folder)
    judged = triage.apply_verdicts(triage.finding_position(r.listed), r.security_answers)
    return judged.select(*ITEM, "position", "false_positive", "fp_reason", "description")


@query
def skipped_entries(spark, folder):
    return triage.skipped_entries(review(spark, folder).security_answers)


@query
def attach_content(spark, folder):
    r = review(spark, folder)
    found = triage.append_additional(r.security_answers, r.listed).select("review_id", "id", "filename")
    return worklist.attach_content(found, r.parsed)


@query
def match_guidance(spark, folder):
    rows = review(spark, folder).findings.select("id", "review_id", "file_ord", "layer", "seq", "sub", "category")
    return rows.withColumn("guidance", worklist.match_guidance(F.col("category")))


@query
def files_with_fix(spark, folder):
    r = review(spark, folder)
    return worklist.files_with_fix(r.parsed, r.fixes).select("review_id", "file_ord", "filename")


@query
def fixes_per_file(spark, folder):
    r = review(spark, folder)
    return worklist.fixes_per_file(r.parsed.select("review_id", "file_ord", "filename"), r.fixes)


@query
def clean_files(spark, folder):
    r = review(spark, folder)
    return triage.clean_files(r.parsed.select("review_id", "file_ord", "filename"), r.listed)


@query
def merge_both_branches(spark, folder):
    r = review(spark, folder)
    return merge_branches(r.findings, r.quality)


# ---- evaluation inputs ---------------------------------------------------------------------------------------------


def _labelled(spark, folder) -> DataFrame:
    return table(spark, folder, "labels").join(documents_of(spark, folder), "doc_id")


def _kind() -> Column:
    return F.when(F.col("doc_id") % 3 == 0, F.lit("pattern")).when(F.col("doc_id") % 3 == 1, F.lit("semantic"))


def _snippets(spark, folder) -> DataFrame:
    return table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"), _kind().alias("kind"))


def _scores(spark, folder) -> DataFrame:
    """A score per document, from its length; many ties."""
    return documents_of(spark, folder).select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 201) / 200).alias("score"))


def _detections(spark, folder) -> DataFrame:
    doc = F.expr("cast(substr(filename, 4) as bigint)")
    sev = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    return text_hits(spark, folder).select(doc.alias("id"), sev.alias("sev"), "rule_id", "rule_ord")


def _evidence(spark, folder) -> DataFrame:
    hits = _detections(spark, folder)
    job = _scores(spark, folder).select("id", F.when(F.col("id") % 9 != 0, F.col("score") > 0.9).alias("flag"))
    return evaluate.snippet_evidence(
        _snippets(spark, folder), hits.filter("rule_ord <= 2"), hits.filter("rule_ord > 2"), _scores(spark, folder), job
    )


def _flags(spark, folder) -> DataFrame:
    return evaluate.ensemble_flags(evaluate.at_or_above(_evidence(spark, folder)), True, True, True)


def _scored(spark, folder) -> DataFrame:
    return evaluate.labels_with_flags(_snippets(spark, folder), _scores(spark, folder), "id")


@query
def at_or_above(spark, folder):
    return evaluate.at_or_above(_evidence(spark, folder)).select("id", "setting", "rule_flag", "pattern_flag")


@query
def any_flag(spark, folder):
    flags = evaluate.at_or_above(_evidence(spark, folder))
    return flags.groupBy("setting", "label").agg(
        F.count_if(F.col("rule_flag") | F.col("pattern_flag")).alias("n_flagged"), F.bool_or("rule_flag").alias("any_rule"))


@query
def flags_per_snippet(spark, folder):
    evidence = evaluate.snippet_evidence(_snippets(spark, folder), _detections(spark, folder))
    return evaluate.at_or_above(evidence).select("id", "label", "setting", "rule_flag")


@query
def labels_with_flags(spark, folder):
    return rounded(_scored(spark, folder), "score")


@query
def ensemble_flags(spark, folder):
    return _flags(spark, folder)


@query
def user_flag(spark, folder):
    """A configuration judged by a user's own vectorised predicate; null means not judged."""
    @F.pandas_udf("boolean")
    def predicate(code: pd.Series, name: pd.Series) -> pd.Series:
        judged = code.str.contains("the", regex=False).astype("boolean")
        return judged.mask(name.astype("int64") % 4 == 0)

    rows = _labelled(spark, folder)
    job = rows.select(F.col("doc_id").alias("id"), predicate("text", F.col("doc_id").cast("string")).alias("flag"))
    none = spark.createDataFrame([], "id BIGINT, sev INT")
    evidence = evaluate.snippet_evidence(_snippets(spark, folder), none, pipeline=job)
    flags = evaluate.ensemble_flags(evaluate.at_or_above(evidence), False, False, True)
    return evaluate.confusion_matrix(flags)


@query
def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(_flags(spark, folder))


@query
def precision_recall_fpr(spark, folder):
    rows = evaluate.precision_recall_fpr(evaluate.confusion_matrix(_flags(spark, folder)))
    names = [f"{n}{x}" for n in ("precision", "recall", "fpr") for x in ("", "_k", "_n")]
    return rounded(rows.select("setting", "configuration", *names), "precision", "recall", "fpr")


@query
def wilson_ci(spark, folder):
    rows = evaluate.confusion_matrix(_flags(spark, folder))
    lo, hi = wilson_bounds(F.col("tp"), F.col("tp") + F.col("fn"))
    return rounded(rows.select("setting", "configuration", lo.alias("lo"), hi.alias("hi")), "lo", "hi")


@query
def recall_by_kind(spark, folder):
    return rounded(evaluate.recall_by_kind(_flags(spark, folder)), "recall")


@query
def roc_auc(spark, folder):
    return rounded(evaluate.roc_auc(_scored(spark, folder)), "auc")


@query
def mean_score_by_label(spark, folder):
    return rounded(evaluate.mean_score_by_label(_scored(spark, folder)), "mean_score")


@query
def per_snippet(spark, folder):
    hits = _detections(spark, folder)
    rows = evaluate.per_snippet(_snippets(spark, folder), hits.filter("rule_ord <= 2"), hits.filter("rule_ord > 2"), _scores(spark, folder))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("rule_ids", "pattern_ids")})


@query
def accuracy_and_flagged_rate(spark, folder):
    rows = evaluate.accuracy_and_flagged_rate(_scored(spark, folder), ["kind"])
    return rounded(rows, "accuracy", "flagged_rate", "mean_positive", "mean_negative")


@query
def upper_median(spark, folder):
    rows = documents_of(spark, folder).select("lang", F.length("text").alias("n_code"))
    return evaluate.upper_median(rows, ["lang"], "n_code")


@query
def min_max_mean_flagged(spark, folder):
    scores = _scores(spark, folder).join(documents_of(spark, folder).select(F.col("doc_id").alias("id"), "source"), "id")
    return rounded(evaluate.saturation(scores, ["source"]), "min_score", "max_score", "mean_score", "flagged_rate")


@query
def class_balance(spark, folder):
    return rounded(evaluate.class_balance(table(spark, folder, "labels"), "quality"), "positive_ratio", "majority_baseline")


@query
def classification_metrics(spark, folder):
    rows = _scored(spark, folder).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return rounded(evaluate.classification_metrics(rows, ["kind"]), "accuracy", "precision", "recall", "f1")


@query
def split_sizes(spark, folder):
    return classify.split_sizes(classify.with_split(table(spark, folder, "labels"), "doc_id"))


@query
def metrics_markdown(spark, folder):
    flags = _flags(spark, folder)
    return evaluate.metrics_markdown(evaluate.confusion_matrix(flags), evaluate.recall_by_kind(flags))


@query
def evaluation_markdown(spark, folder):
    return evaluate.evaluation_markdown(_flags(spark, folder), _scored(spark, folder), "labelled documents", "all severities")


@query
def seeded_sample(spark, folder):
    return evaluate.seeded_sample(documents_of(spark, folder).select("doc_id", "source"), "doc_id", 42, 300)


@query
def sorted_values(spark, folder):
    labels = table(spark, folder, "labels").select("quality", "toxic", "doc_id")
    return with_position(labels, ["quality", "toxic"], F.expr("doc_id div 1000"), ["doc_id"], "position")


@query
def distinct_sources_of_code(spark, folder):
    return evaluate.distinct_texts(documents_of(spark, folder).select("doc_id", "lang", "text"), "text", "doc_id").select("doc_id", "lang")


# ---- aggregations --------------------------------------------------------------------------------------------------


@query
def severity_breakdown(spark, folder):
    r = review(spark, folder)
    return report.severity_breakdown(r.findings, r.reviews)


@query
def verdict(spark, folder):
    r = review(spark, folder)
    return report.verdict(r.findings, r.reviews)


@query
def summary_counts(spark, folder):
    return review(spark, folder).counts.select("review_id", *report.COUNTS)


@query
def findings_by_file(spark, folder):
    rows = report.findings_by_file(review(spark, folder).findings)
    return rows.select("review_id", "filename", "n_issues", *[F.col(f"first_place.{c}").alias(c) for c in triage.LISTED_ORDER])


@query
def distinct_sources(spark, folder):
    rows = report.distinct_sources(review(spark, folder).findings)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("sources", "severities")})


@query
def score_max_categories(spark, folder):
    rows = scan.unit_scores(review(spark, folder).units)
    return rows.select(*UNIT_KEY, "score", F.array_join("categories", ",").alias("categories"))


@query
def stage_counts(spark, folder):
    r = review(spark, folder)
    return r.counts.select("review_id", "n_files", (F.col("n_real") + F.col("n_dismissed")).alias("n_security"), "n_quality", "n_fixes", "n_tests")


# ---- ordering and limits ---------------------------------------------------------------------------------------------


@query
def first_n_fixes(spark, folder):
    return review(spark, folder).fix_items.select(*ITEM, "listed_ord", "item")


@query
def first_n_test_files(spark, folder):
    r = review(spark, folder)
    return worklist.first_n_test_files(r.parsed, r.fixes)


@query
def first_n_functions(spark, folder):
    return worklist.first_n_functions(review(spark, folder).units).select(*UNIT_KEY, "source")


@query
def top_report_rows(spark, folder):
    r = review(spark, folder)
    return triage.top_report_rows(r.findings, r.parsed).select(*ITEM, "listed_ord", "row_no")


@query
def finding_position(spark, folder):
    return triage.finding_position(review(spark, folder).listed).select(*ITEM, "position")


@query
def stable_order(spark, folder):
    found = review(spark, folder).findings
    return found.select("review_id", *triage.LISTED_ORDER, "id", "source", "copies")


# ---- set operations --------------------------------------------------------------------------------------------------


@query
def merge_layers(spark, folder):
    return review(spark, folder).raw.select(*ITEM, "source")


@query
def append_additional(spark, folder):
    r = review(spark, folder)
    return triage.append_additional(r.security_answers, r.listed).select(*ITEM, "description", "source", "host", "copies")


@query
def append_quality_answers(spark, folder):
    r = review(spark, folder)
    return quality_ops.append_quality_answers(r.parsed, r.quality_answers)


@query
def event_union(spark, folder):
    """Progress events of two independent stages, one stream of rows."""
    r = review(spark, folder)
    def event(rows: DataFrame, agent: str, text: str) -> DataFrame:
        counted = rows.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
        every = r.reviews.join(counted, "review_id", "left")
        return every.select("review_id", F.format_string(text, F.coalesce("n", F.lit(0))).alias("message"), F.lit(agent).alias("agent"))

    return event(r.quality, "quality", fv.EVENT_TEXT[2][1]).unionByName(event(r.parsed, "parser", fv.EVENT_TEXT[0][1]))


# ---- scalar functions --------------------------------------------------------------------------------------------------


@query
def title_case(spark, folder):
    name = F.concat(F.lit("use_of-b64decode_"), F.lower("url"))
    return table(spark, folder, "pages").select("page_id", tx.title_case(name).alias("title"))


@query
def last_part(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", tx.last_part(F.col("url"), "/").alias("path_end"), tx.last_part(F.col("url"), ".").alias("dot_end"))


@query
def prefixes(spark, folder):
    return documents_of(spark, folder).select(
        "doc_id", *[F.md5(tx.prefix(F.col("text"), n)).alias(f"p{n}") for n in (200, 300, 500, 2500, 3000)])


@query
def window_around_line(spark, folder):
    line = (F.col("doc_id") % 60).cast("int")
    return documents_of(spark, folder).select("doc_id", tx.window_around_line(F.col("text"), line).alias("shown"))


@query
def review_request_text(spark, folder):
    r = review(spark, folder)
    return triage.review_requests(r.listed, r.parsed)


@query
def fix_request_text(spark, folder):
    r = review(spark, folder)
    return worklist.fix_requests(r.fix_items, r.parsed)


@query
def test_request_text(spark, folder):
    return worklist.test_requests(review(spark, folder).test_files)


@query
def quality_request_text(spark, folder):
    return worklist.quality_requests(review(spark, folder).parsed)


@query
def parse_answers(spark, folder):
    a = parse_answer(F.col("answer"), schemas.REVIEW_ANSWER)
    rows = review(spark, folder).security_answers.withColumn("a", a)
    return rows.select(
        "review_id", "filename", F.col("a").isNotNull().alias("readable"),
        F.when(F.col("a.reviewed").isNotNull(), F.size("a.reviewed")).otherwise(0).alias("n_reviewed"),
        F.when(F.col("a.additional_issues").isNotNull(), F.size("a.additional_issues")).otherwise(0).alias("n_additional"),
    )


@query
def fix_rows(spark, folder):
    return review(spark, folder).fixes.drop("validated")


@query
def test_rows(spark, folder):
    return review(spark, folder).tests.withColumn("covers", F.array_join("covers", ","))


@query
def percent_text(spark, folder):
    rows = _scores(spark, folder)
    return rows.select("id", tx.percent(F.col("score")).alias("shown"), tx.percent((F.col("id") % 8) / 8).alias("eighths"))


@query
def summary(spark, folder):
    return report.report_headers(review(spark, folder).counts).select("review_id", "verdict", "summary", "files_reviewed")


@query
def comment_markdown(spark, folder):
    return review(spark, folder).comment.select("review_id", "section", "line_no", "copies", "text")


@query
def pr_url_parts(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    made = F.concat(F.lit("https://host.example/own"), F.col("page_id").cast("string"), F.lit("/repo/pull/"), F.col("page_id").cast("string"), F.lit("//"))
    urls = F.col("url")
    return pages.select("page_id", tx.pr_number(made).alias("number"), tx.pr_repository(made).alias("repository"),
                        tx.pr_repository(urls).alias("page_repository"))


@query
def ratios(spark, folder):
    rows = documents_of(spark, folder).select("doc_id", F.try_divide(F.length(F.replace("text", F.lit(" "), F.lit(""))), F.length("text")).alias("ratio"))
    return rounded(rows.withColumn("root", F.sqrt("ratio")), "ratio", "root")


@query
def event_time(spark, folder):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    rows = table(spark, folder, "events").select("event_id", event_ops.event_time(seconds).alias("at"))
    return rows.select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query
def dedent_text(spark, folder):
    body = F.concat(F.lit("\n    first\n      "), F.replace("text", F.lit("\n"), F.lit("\n     ")), F.lit("\n   \n    "))
    return documents_of(spark, folder).select("doc_id", tx.dedent_strip(body).alias("text"))


@query
def short_id(spark, folder):
    return documents_of(spark, folder).select("doc_id", tx.short_id(F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("id"))


# ---- scoring and training ---------------------------------------------------------------------------------------------


def _quality_rows(spark, folder) -> DataFrame:
    return _labelled(spark, folder).select("doc_id", "text", F.col("quality").alias("label"))


@query
def train_text_classifier(spark, folder):
    return classify.train_text_classifier(_quality_rows(spark, folder), "doc_id", "text")[1]


@query
def calibrated_classifier(spark, folder):
    """Out-of-fold scores of the labelled documents before and after calibration: calibration error and confusion counts."""
    scored = classify.out_of_fold(_quality_rows(spark, folder), "doc_id", "text")[1]
    return rounded(classify.calibration_report(classify.calibrated_out_of_fold(scored)), "calibration_error")


@query
def score_units(spark, folder):
    """Function units scored by a classifier trained on the labelled documents."""
    rows = classify.with_tokens(_quality_rows(spark, folder), "text")
    model = classify.fit(rows, 0.1)
    return classify.score_units(model, review(spark, folder).units).select(*UNIT_KEY, "score", "pattern_score")


@query
def scored_findings(spark, folder):
    scored = review(spark, folder).units.withColumn("score", (F.length("source") % 11) / 10)
    return classify.scored_findings(scored).select(*ITEM, "description", "source")


@query
def tokenize_truncate(spark, folder):
    words = tx.tokens(F.col("text"), fv.MAX_TOKENS)
    return documents_of(spark, folder).select(
        "doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("digest"))


# ---- streams ---------------------------------------------------------------------------------------------------------


def _job_events(spark, folder) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind.isin("click", "signup"), "running").when(kind == "purchase", "complete").otherwise("failed")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("review_id"), F.col("event_id").alias("seq"), status.alias("status"),
        F.when(kind == "error", F.concat(F.lit("error in "), F.col("event_id").cast("string"))).alias("error"), "ts",
    )


@query
def pr_event_stream(spark, folder):
    """Deliveries written as files, streamed through signature check, filter and shaping, and drained."""
    base = f"{checkpoint_folder(spark)}/hooks-{uuid.uuid4().hex}"
    _payloads(spark, folder).write.json(f"{base}/in")
    stream = event_ops.read_pr_events(spark, f"{base}/in")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
    listing, contents = _fetched(spark, folder)
    event_ops.run_reviews(stream, write, f"{base}/state", listing=listing, contents=contents).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


@query
def job_status(spark, folder):
    return event_ops.job_status(_job_events(spark, folder))


@query
def tail_events(spark, folder):
    base = f"{checkpoint_folder(spark)}/tail-{uuid.uuid4().hex}"
    events = _job_events(spark, folder)
    events.write.json(f"{base}/in")
    stream = spark.readStream.schema(events.schema).json(f"{base}/in")
    event_ops.write_tail(event_ops.tail_events(stream), f"{base}/out", f"{base}/state", once=True).awaitTermination()
    return spark.read.schema("review_id BIGINT, seq BIGINT, part INT, message STRING").json(f"{base}/out")


@query
def events_since(spark, folder):
    return event_ops.events_since(_job_events(spark, folder), 5, ["ts", "seq"]).select("review_id", "seq", "status", "position")


@query
def verified_events(spark, folder):
    """Right, wrong, missing and wrongly prefixed signatures, with a short and a long key."""
    number = F.col("event_id")
    payload = F.concat(F.lit('{"event":'), number.cast("string"), F.lit(',"kind":"'), F.col("event_type"), F.lit('"}'))
    parts = []
    for key in ("key", "long" * 20):
        right = signature_of(payload, key)
        given = F.when(number % 4 == 0, right).when(number % 4 == 1, F.lit("sha256=00")).when(
            number % 4 == 2, F.regexp_replace(right, "^sha256", "sha1"))
        signed = table(spark, folder, "events").select(payload.alias("payload"), given.alias("signature"))
        ok = signature_valid(F.col("payload"), F.col("signature"), key)
        parts.append(signed.select(F.length(F.lit(key)).alias("key_length"), ok.alias("ok"), "signature"))
    return parts[0].unionByName(parts[1]).groupBy("key_length", "ok").agg(
        F.count(F.lit(1)).alias("n"), F.min("signature").alias("least"), F.max("signature").alias("greatest"))


@query
def validated_fixes(spark, folder):
    return review(spark, folder).fixes.select("review_id", "item", "fixed", "validated")


@query
def answer_source(spark, folder):
    r = review(spark, folder)
    joined = r.parsed.join(r.quality_answers, ["review_id", "filename"])
    return joined.select("review_id", "file_ord", "filename", "answer")


# ---- merged findings, guarded dismissals, re-scanned fixes ----------------------------------------------------------------


@query
def dedupe_findings(spark, folder):
    return review(spark, folder).deduped.select(
        *ITEM, "source", "copies", "family", "first_line", "last_line", "merged", "n_layers")


@query
def deduped_breakdown(spark, folder):
    r = review(spark, folder)
    return dedupe.deduped_breakdown(r.findings, r.deduped, r.reviews)


@query
def guard_dismissals(spark, folder):
    r = review(spark, folder)
    return dedupe.guard_audit(dedupe.guard_dismissals(r.findings, r.units))


@query
def rescan_fixes(spark, folder):
    r = review(spark, folder)
    return rescan.rescan_fixes(r.fixes, r.fix_items, r.files)


@query
def cleared_share(spark, folder):
    r = review(spark, folder)
    return rounded(rescan.cleared_share(rescan.rescan_fixes(r.fixes, r.fix_items, r.files), r.reviews), "share")


# ---- reviews on streams --------------------------------------------------------------------------------------------------


def _review_arrivals(spark, folder) -> tuple[DataFrame, DataFrame]:
    """One delivery per review with the names of its well-formed files, every third sent twice; and the files' contents by address."""
    files = file_ops.reject_malformed(review(spark, folder).pr_files)[0]
    address = F.concat(F.lit("c/"), F.col("review_id").cast("string"), F.lit("/"), F.col("file_ord").cast("string"))
    none = F.lit(None).cast("string")
    entry = F.struct("file_ord", "filename", address.alias("contents_url"), none.alias("raw_url"), "patch", "additions", "deletions")
    listed = files.groupBy("review_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    rows = review(spark, folder).reviews.join(listed, "review_id", "left")
    shaped = F.transform("entries", lambda e: F.struct(*[e[c].alias(c) for c in ("filename", "contents_url", "raw_url", "patch", "additions", "deletions")]))
    payload = F.to_json(F.struct(
        F.lit("opened").alias("action"),
        F.struct(F.concat(F.lit("u"), F.col("review_id").cast("string")).alias("html_url"), F.col("review_id").cast("int").alias("number"),
                 shaped.alias("files")).alias("pull_request"),
        F.struct(F.lit("o/r").alias("full_name")).alias("repository")))
    sent = F.explode(F.when(F.col("review_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    arrivals = rows.select(
        "review_id", F.lit("pull_request").alias("event"), F.lit(None).cast("string").alias("signature"), payload.alias("payload"),
        F.concat(F.lit("d"), F.col("review_id").cast("string")).alias("delivery_id"), sent,
    ).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("review_id") % 1000 + F.col("again") * 60))
    return arrivals, files.select(address.alias("url"), "content")


HEADER = (
    "review_id BIGINT, verdict STRING, summary STRING, "
    "severity_breakdown STRUCT<critical: BIGINT, high: BIGINT, medium: BIGINT, low: BIGINT, info: BIGINT>, files_reviewed BIGINT, error STRING")


@query
def streamed_reviews(spark, folder):
    """Deliveries, some of them repeated, reviewed in two batches; the headers that the commits published."""
    base = f"{checkpoint_folder(spark)}/reviews-{uuid.uuid4().hex}"
    arrivals, contents = _review_arrivals(spark, folder)
    arrivals = stage(arrivals)
    parts = spark.sparkContext.defaultParallelism
    arrivals.where("again = 0").drop("again").repartition(parts).write.json(f"{base}/in")
    first = len(spark.read.schema(schemas.HOOK_ARRIVAL).json(f"{base}/in").inputFiles())  # files of a batch; the repeats have no more
    arrivals.where("again = 1").drop("again").repartition(first).write.mode("append").json(f"{base}/in")
    answers = [corpus_source.answers(documents_of(spark, folder), s) for s in ("security", "quality", "fix", "test")]
    review_streams.stream_reviews(
        review_streams.read_arrivals(spark, f"{base}/in", max_files=first), f"{base}/out", f"{base}/state", contents=contents,
        make_review=lambda files: Review(files, *answers)).awaitTermination()
    return review_streams.read_reports(spark, f"{base}/out", "header", HEADER).select("review_id", "verdict", "summary", "files_reviewed", "error")


@query
def late_listings(spark, folder):
    """Deliveries and their file lists as two streams; the lists of even numbers come half an hour later, others never."""
    base = f"{checkpoint_folder(spark)}/late-{uuid.uuid4().hex}"
    ts = table(spark, folder, "events").select(F.col("event_id").alias("review_id"), F.col("ts").cast("timestamp").alias("ts"))
    # one more delivery and listing, far ahead, moves the watermarks past all others
    end = F.timestamp_seconds(F.lit(4_000_000_000))
    rows = _payloads(spark, folder).join(ts, "review_id").withColumn("delivery_id", F.col("review_id").cast("string"))
    last = rows.where("event = 'pull_request'").limit(1).select(
        F.lit(-1).cast("bigint").alias("review_id"), "event", "signature", "payload", F.lit("end").alias("delivery_id"), end.alias("ts"))
    rows.unionByName(last).select("review_id", "event", "signature", "payload", "delivery_id", "ts").write.json(f"{base}/in")
    listing, _ = _fetched(spark, folder)
    timed = listing.join(ts.select(F.col("review_id").cast("int").alias("number"), (F.col("ts") + F.expr("interval 30 minutes")).alias("listed_ts")), "number")
    final = timed.limit(1).withColumns({"number": F.lit(-1), "listed_ts": end})
    timed.unionByName(final).write.json(f"{base}/lists")
    lists = spark.readStream.schema(timed.schema).json(f"{base}/lists")
    arrivals = review_streams.read_arrivals(spark, f"{base}/in")
    files = review_streams.listed_later(arrivals, lists)
    files.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(files.schema).parquet(f"{base}/out").where("review_id >= 0")


@query
def streamed_job_status(spark, folder):
    """Job events in three batches, out of order, merged into one table of last states."""
    base = f"{checkpoint_folder(spark)}/jobs-{uuid.uuid4().hex}"
    events = _job_events(spark, folder)
    for k in (1, 2, 0):
        events.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").json(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(f"{base}/in")
    review_streams.stream_job_status(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return review_streams.job_states(spark, f"{base}/out")


# ---- large rule tables -----------------------------------------------------------------------------------------------------


@query
def large_rule_table(spark, folder):
    """A rule for the longest word of every document, run over the lines of all documents."""
    docs = documents_of(spark, folder)
    words = F.transform(
        F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("word")))
    longest = docs.select("doc_id", F.array_min(words).alias("w")).groupBy("doc_id").agg(F.min("w").alias("w")).where("w IS NOT NULL").groupBy(
        "w.word").agg(F.min("doc_id").cast("int").alias("rule_ord"))
    rules = stage(longest.select(
        "rule_ord", F.concat(F.lit("W"), F.col("rule_ord").cast("string")).alias("rule_id"), F.lit("p/text").alias("ruleset"), F.lit(1).alias("layer"),
        F.lit("LOW").alias("raw_severity"), F.col("word").alias("name"),
        F.concat(F.lit("(?i)(^|[^a-z])"), F.col("word"), F.lit("([^a-z]|$)")).alias("pattern"), F.lit("word").alias("message"),
        F.lit(None).cast("array<string>").alias("needles")))
    lines = scan.source_lines(docs.select("doc_id", F.col("text").alias("content"), F.lit("p/text").alias("ruleset")))
    hits = scan.table_hits(lines, rules)
    counts = hits.groupBy("rule_ord").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_documents"))
    return counts.join(scan.rule_meanings(rules).select("rule_ord", "category"), "rule_ord")
