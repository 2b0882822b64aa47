"""Triage and work lists against a plain re-statement of the rules, with shared file names and odd answers."""

import json
import random

import pytest

from diffsieve import fixed_values as fv
from diffsieve import schemas
from diffsieve.operators import report, triage, worklist

FINDING = (
    "review_id BIGINT, file_ord INT, layer INT, seq INT, sub INT, id STRING, filename STRING, line INT, severity STRING, "
    "category STRING, cwe_id STRING, owasp STRING, description STRING, source STRING, code_snippet STRING, "
    "false_positive BOOLEAN, fp_reason STRING"
)
FILES = "review_id BIGINT, file_ord INT, filename STRING, language STRING, content STRING"
ANSWERS = [
    json.dumps({"reviewed": [{"index": 1, "false_positive": True}, {"index": 2, "false_positive": True, "fp_reason": None},
                             {"index": 3, "exploitation_context": "how"}]}),
    json.dumps({"reviewed": [{"index": 1, "false_positive": True, "fp_reason": "a"}, {"index": 1, "false_positive": False}],
                "additional_issues": [{"severity": "info"}, {"filename": "z.py", "line": 4, "severity": "High", "category": "C",
                                       "description": "d", "exploitation_context": "dropped"}]}),
    "```json\n" + json.dumps({"reviewed": [{"false_positive": True}, {"index": 2, "false_positive": True, "fp_reason": "r"}]}) + "\n```",
    '{"reviewed": [{"index": 1, "false_positive": tr', "", "```", None,
]


def make(seed):
    rng = random.Random(seed)
    files, raw, answers = [], [], {}
    for review in range(4):
        names = ["a.py", "b.py", "c.py", "d.py"][: rng.randint(2, 4)]
        for ord_ in range(rng.randint(3, 9)):
            name = rng.choice(names)
            files.append((review, ord_, name, "python", f"text of {ord_}"))
            for n in range(rng.choice([0, 0, 1, 3, 6])):
                raw.append((review, ord_, rng.choice([1, 2, 3]), n + 1, 1, f"{review}-{ord_}-{n}", name, n, rng.choice(fv.SEVERITIES),
                            "Cat", None, None, f"d{n}", rng.choice(["bandit", "codebert"]), "s", False, None))
        for name in names:
            if rng.random() < 0.9:
                answers[review, name] = rng.choice(ANSWERS)
    return files, raw, answers


def usable(answer):
    text = (answer or "").strip()
    if text.startswith("```"):
        if "\n" not in text:
            return None
        text = text.split("\n", 1)[1].rsplit("```", 1)[0]
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return None


def by_hand(files, raw, answers):
    """Per review, the listed findings in order: (id or added category, dismissed, reason, description, severity, source)."""
    result = {}
    names = [f[:3] for f in files]
    for review, ord_, name in sorted(names):
        mine = sorted((r for r in raw if r[0] == review and r[6] == name), key=lambda r: r[1:5])
        rows = result.setdefault(review, [])
        if not mine:
            continue
        data = usable(answers.get((review, name)))
        verdicts = {r["index"]: r for r in (data or {}).get("reviewed", []) if "index" in r}
        for i, r in enumerate(mine, 1):
            v, description, reason = verdicts.get(i, {}), r[12], None
            if v.get("false_positive"):
                reason = v.get("fp_reason", fv.DEFAULT_REASON)
            elif v.get("exploitation_context"):
                description += "\n\nExploitation: " + v["exploitation_context"]
            rows.append((r[5], bool(v.get("false_positive")), reason, description, r[8], r[13]))
        for e in (data or {}).get("additional_issues", []):
            severity = {"CRITICAL": "critical", "HIGH": "high", "MEDIUM": "medium", "LOW": "low"}.get(
                e.get("severity", "medium").upper(), "medium")
            rows.append((e.get("category", "Security Issue"), False, None, e.get("description", ""), severity, "llm"))
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_triage_equals_the_rules(spark, seed, monkeypatch):
    monkeypatch.setattr(triage, "FILES_PER_SLICE", 2)
    files, raw, answers = make(seed)
    want = by_hand(files, raw, answers)
    file_table = spark.createDataFrame(files, FILES)
    listed = triage.findings_for_file(spark.createDataFrame(raw, FINDING), file_table)
    answer_table = spark.createDataFrame([(r, n, a) for (r, n), a in answers.items()], "review_id BIGINT, filename STRING, answer STRING")
    findings = triage.triaged(listed, answer_table).cache()

    # All rows, with their multiplicity.
    got = {}
    for r in findings.collect():
        label = r.category if r.source == "llm" else r.id
        row = (label, r.false_positive, r.fp_reason, r.description, r.severity, r.source)
        got.setdefault(r.review_id, []).extend([row] * r.copies)
    for review, rows in want.items():
        assert sorted(map(repr, got.get(review, []))) == sorted(map(repr, rows))

    # Counts and verdicts.
    reviews = file_table.select("review_id").distinct()
    verdicts = {r.review_id: r.verdict for r in report.verdict(findings, reviews).collect()}
    for r in report.severity_breakdown(findings, reviews).collect():
        real = [x for x in want[r.review_id] if not x[1]]
        counts = {s: sum(x[4] == s for x in real) for s in fv.SEVERITIES}
        assert {s: r[s] for s in fv.SEVERITIES} == counts
        worst = "request_changes" if counts["critical"] + counts["high"] else "comment" if counts["medium"] else "approve"
        assert verdicts[r.review_id] == worst

    # First n, with repeats of shared names written out.
    items = worklist.first_n_fixes(findings, file_table).orderBy("review_id", "item").collect()
    for review, rows in want.items():
        fixable = [x for x in rows if not x[1] and x[4] in fv.FIXABLE_SEVERITIES and x[5] != "codebert"][:10]
        mine = [r for r in items if r.review_id == review]
        assert [r.item for r in mine] == list(range(1, len(fixable) + 1))
        assert [r.category if r.source == "llm" else r.id for r in mine] == [x[0] for x in fixable]
    top = triage.top_report_rows(findings, file_table).orderBy("review_id", "row_no").collect()
    for review, rows in want.items():
        assert [r.category if r.source == "llm" else r.id for r in top if r.review_id == review] == [x[0] for x in rows if not x[1]][:20]
    findings.unpersist()


def test_requests_continue_in_parts(spark, monkeypatch):
    monkeypatch.setattr(triage, "BLOCK", 2)
    files = spark.createDataFrame([(1, 0, "a.py", "python", "src"), (1, 1, "a.py", "python", "other")], FILES)
    raw = [(1, 0, 1, n, 1, f"i{n}", "a.py", n, "low", "C", None, None, "d", "bandit", "s", False, None) for n in range(5)]
    listed = triage.findings_for_file(spark.createDataFrame(raw, FINDING), files)
    rows = triage.review_requests(listed, files).orderBy("part", "file_ord").collect()
    assert [(r.part, r.file_ord) for r in rows] == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert "src" in rows[0].request and "#2 C at" in rows[0].request and "#3 " not in rows[0].request
    assert "#5 C at" in rows[3].request


def test_cut_comes_before_the_function_check(spark):
    files = spark.createDataFrame([(1, i, f"f{i}", "javascript" if i < 4 else "python", "x" if i else "") for i in range(8)], FILES)
    units = spark.createDataFrame(
        [(1, i, 1, f"fn{i}", "def") for i in (4, 5, 6, 7)], "review_id BIGINT, file_ord INT, unit_ord INT, name STRING, source STRING")
    fixes = spark.createDataFrame([(1, "f0"), (1, "f4"), (1, "f4")], "review_id BIGINT, filename STRING")
    assert [r.file_ord for r in worklist.first_n_test_files(files, fixes).orderBy("file_ord").collect()] == [0, 1, 2, 3, 4]
    (only,) = worklist.test_eligible(files, units, fixes).collect()
    assert (only.file_ord, only.n_fixes) == (4, 2)


def test_fix_rows_and_defaults(spark):
    item = "review_id BIGINT, item INT, id STRING, filename STRING, code_snippet STRING"
    items = spark.createDataFrame([(1, n, f"i{n}", "a.py", "old") for n in (1, 2, 3, 4)], item)
    answers = spark.createDataFrame([
        (1, 1, '{"fixed": "x = 1", "description": "D", "original": "o", "explanation": "e"}'), (1, 2, "```\n{\"fixed\": \"def (\"}\n```"),
        (1, 3, "no"), (1, 4, "{}")], "review_id BIGINT, item INT, answer STRING")
    rows = {r.item: r for r in worklist.fix_rows(items, answers).collect()}
    assert set(rows) == {1, 2, 4}
    assert (rows[1].description, rows[1].original, rows[1].validated) == ("D", "o", True)
    assert (rows[2].description, rows[2].original, rows[2].validated) == ("Fix applied", "old", False)
    assert (rows[4].fixed, rows[4].validated) == ("", True)


def test_listing_order_columns_are_in_the_schema():
    assert set(schemas.FINDING_ORDER) <= set(triage.LISTED_ORDER)
