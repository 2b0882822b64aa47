"""Merged findings, guarded dismissals, and fixes put into their files and scanned again."""

import itertools
import random

import pytest

from diffsieve import schemas
from diffsieve.operators import dedupe, rescan
from diffsieve.operators.rules import RULE_SCHEMA

FINDING = (
    "review_id bigint, file_ord int, layer int, seq int, sub int, id string, filename string, line int, severity string, category string, "
    "source string, copies bigint, false_positive boolean, fp_reason string")
UNIT = "review_id bigint, file_ord int, unit_ord int, start_line int, end_line int"


def found(review, file, layer, line, severity, category, seq=None, sub=1, dismissed=False, reason=None, copies=1):
    seq = line if seq is None else seq
    return (review, file, layer, seq, sub, f"{review}-{file}-{layer}-{seq}-{sub}", f"f{file}.py", line, severity, category, "s", copies, dismissed, reason)


def findings_of(spark, rows):
    return spark.createDataFrame(rows, FINDING)


def units_of(spark, rows):
    return spark.createDataFrame(rows, UNIT)


def test_chained_overlaps_are_one_cluster(spark):
    rows = [
        found(1, 0, 3, 1, "medium", "SQL Injection", seq=1),   # lines 1-10
        found(1, 0, 3, 8, "high", "SQL Injection", seq=2),     # lines 8-20
        found(1, 0, 1, 20, "medium", "Hardcoded Sql Expressions"),
        found(1, 0, 2, 20, "high", "Formatted Query", sub=12),
        found(1, 0, 1, 21, "low", "Hardcoded Sql Expressions"),  # behind the reach: a cluster of its own
        found(1, 0, 2, 9, "high", "Eval Detected"),              # another family
        found(1, 1, 2, 9, "high", "Formatted Query"),            # another file
        found(1, 0, 1, 15, "critical", "Hardcoded Sql Expressions", dismissed=True),
        found(2, 0, 4, 0, "info", "Odd Thing"), found(2, 0, 4, 0, "info", "odd thing", seq=1),
    ]
    units = units_of(spark, [(1, 0, 1, 1, 10), (1, 0, 2, 8, 20)])
    got = dedupe.dedupe_findings(findings_of(spark, rows), units).collect()
    assert sorted((r.review_id, r.file_ord, r.family, r.first_line, r.last_line, r.layer, r.severity, r.merged, r.n_layers) for r in got) == [
        (1, 0, "code execution", 9, 9, 2, "high", 1, 1),
        (1, 0, "sql injection", 1, 20, 2, "high", 4, 3),  # of two high ones the lower layer
        (1, 0, "sql injection", 21, 21, 1, "low", 1, 1),
        (1, 1, "sql injection", 9, 9, 2, "high", 1, 1),
        (2, 0, "odd thing", 0, 0, 4, "info", 2, 1),
    ]
    reviews = spark.createDataFrame([(1,), (2,), (3,)], "review_id bigint")
    counts = {r.review_id: r for r in dedupe.deduped_breakdown(findings_of(spark, rows), dedupe.dedupe_findings(findings_of(spark, rows), units), reviews).collect()}
    assert (counts[1].before_high, counts[1].after_high, counts[1].before_critical, counts[1].after_medium) == (4, 3, 0, 0)
    assert (counts[2].before_info, counts[2].after_info, counts[3].before_high) == (2, 1, 0)


def plain_clusters(rows):
    """Clusters by joining overlapping ranges until nothing changes."""
    clusters = []
    for row in rows:
        start, end = row[0], row[1]
        touching = [c for c in clusters if c[0] <= end and start <= c[1]]
        clusters = [c for c in clusters if c not in touching]
        joined = [(start, end, 1), *touching]
        clusters.append((min(c[0] for c in joined), max(c[1] for c in joined), sum(c[2] for c in joined)))
    return sorted(clusters)


def test_a_hot_file_equals_brute_force_and_is_spread(spark):
    rng = random.Random(4)
    ranges = [(a, a + rng.choice([0, 0, 3, 40, 900])) for a in (rng.randrange(200_000) for _ in range(4000))]
    rows = [found(1, 0, 3, a, "low", "Eval", seq=i) for i, (a, _) in enumerate(ranges)]
    units = [(1, 0, i, a, b) for i, (a, b) in enumerate(ranges)]
    merged = dedupe.dedupe_findings(findings_of(spark, rows), units_of(spark, units))
    assert sorted((r.first_line, r.last_line, r.merged) for r in merged.collect()) == plain_clusters(ranges)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if " Window " in line and "_slice" in line]
    assert windows  # rows are walked slice by slice, only slice totals by file


def test_guard_keeps_what_is_backed_and_reopens_the_rest(spark):
    own, default = "only used in tests", "Dismissed by LLM reviewer"
    rows = [
        found(1, 0, 1, 5, "high", "Eval", dismissed=True, reason=default),           # two layers dismissed
        found(1, 0, 2, 5, "high", "Eval Detected", dismissed=True, reason=None),
        found(1, 0, 1, 9, "high", "Eval", dismissed=True, reason=default),           # alone, without a reason
        found(1, 0, 2, 9, "high", "Eval Detected"),
        found(1, 0, 1, 12, "critical", "Pickle", dismissed=True, reason=own),
        found(1, 0, 1, 14, "medium", "Random", dismissed=True, reason=default),      # not grave: not guarded
        found(1, 0, 1, 16, "critical", "Pickle", dismissed=True, reason="  "),
    ]
    units = units_of(spark, [(9, 9, 1, 1, 2)])

    def outcome(**more):
        guarded = dedupe.guard_dismissals(findings_of(spark, rows), units, **more).collect()
        assert len(guarded) == len(rows)
        return {(r.line, r.layer): (r.guard, r.false_positive) for r in guarded}

    assert outcome() == {
        (5, 1): ("kept", True), (5, 2): ("kept", True), (9, 1): ("refused", False), (9, 2): (None, False),
        (12, 1): ("kept", True), (14, 1): (None, True), (16, 1): ("refused", False)}
    assert outcome(reason_enough=False)[12, 1] == ("refused", False)
    audit = dedupe.guard_audit(dedupe.guard_dismissals(findings_of(spark, rows), units))
    assert audit.count() == 5


# ---- fixes --------------------------------------------------------------------------------------------------------------

FIXES = "review_id bigint, item int, filename string, original string, fixed string"
ITEMS = "review_id bigint, item int, file_ord int, filename string, line int, category string, severity string"
TEXT = "import os\n\ndef a(x):\n    return eval(x)\n\ndef b(x):\n    return eval(x)\n    os.system(x)\n"


def results(spark, fixes, text=TEXT, lines=None, rules=None):
    """Fixes as (original, fixed, category) of one file."""
    rows = [(1, i, "f.py", o, f) for i, (o, f, _) in enumerate(fixes, 1)]
    items = [(1, i, 0, "f.py", (lines or {}).get(i, 1), c, "high") for i, (_, _, c) in enumerate(fixes, 1)]
    files = spark.createDataFrame([(1, 0, "f.py", "python", text, "", 0, 0)], schemas.PR_FILES)
    return (spark.createDataFrame(rows, FIXES), spark.createDataFrame(items, ITEMS), files), {
        r.item: r for r in rescan.rescan_fixes(spark.createDataFrame(rows, FIXES), spark.createDataFrame(items, ITEMS), files, rules).collect()}


def test_places_exact_near_and_missing(spark):
    (fixes, items, files), got = results(spark, [
        ("return eval(x)", "return int(x)", "Eval"),              # the one at its line
        ("    os.sytem(x)", "    run(x)", "Os Command"),           # one edit away
        ("nothing like it", "y", "Eval"),
        ("", "y", "Eval"), ("  ", "y", "Eval"),
        ("def a(x):\n    return  eval(x)", "def a(x):\n    y = x\n    return y", "Eval"),  # two lines, near
    ], lines={1: 7})
    assert {i: (r.state, r.how, r.distance, r.first_line, r.last_line) for i, r in got.items()} == {
        1: ("applied", "exact", 0, 8, 8), 2: ("applied", "near", 1, 9, 9), 3: ("not found", None, None, None, None),
        4: ("not found", None, None, None, None), 5: ("not found", None, None, None, None), 6: ("applied", "near", 1, 3, 5)}
    chosen = rescan.choose_fixes(rescan.place_fixes(fixes, items, files))
    assert rescan.spliced_files(chosen, files).first().content == (
        "import os\n\ndef a(x):\n    y = x\n    return y\n\ndef b(x):\n    return int(x)\n    run(x)\n")


def test_cleared_by_family_on_changed_lines_only(spark):
    _, got = results(spark, [
        ("    return eval(x)\n\ndef b", "    return exec (x)\n\ndef b", "Eval"),     # still of the family
        ("os.system(x)", "subprocess.run(x, shell=True)", "Start Process With A Shell"),
        ("import os", "import os; eval(y)", "Hardcoded Password String"),             # cleared, but brings another
    ])
    assert {i: (r.cleared, r.n_other) for i, r in got.items()} == {1: (False, 0), 2: (False, 0), 3: (True, 2)}
    own = spark.createDataFrame([(1, "X1", "p/python", 1, "HIGH", "no_run", "run\\(", "m", None)], RULE_SCHEMA)
    _, got = results(spark, [("os.system(x)", "run(x)", "No Run"), ("import os", "import run", "No Run")], rules=own)
    assert [got[i].cleared for i in (1, 2)] == [False, True]
    reviews = spark.createDataFrame([(1,), (2,)], "review_id bigint")
    _, got = results(spark, [("os.system(x)", "run(x)", "Os Command"), ("zzzzzzzz", "", "Eval")])
    table = spark.createDataFrame([r.asDict() for r in got.values()], "review_id bigint, item int, state string, cleared boolean")
    rows = {r.review_id: r for r in rescan.cleared_share(table, reviews).collect()}
    assert (rows[1].n_fixes, rows[1].n_applied, rows[1].n_not_found, rows[1].share, rows[2].share) == (2, 1, 1, 1.0, None)


def test_the_most_fixes_that_fit_are_taken(spark):
    rng = random.Random(9)
    text = "".join(chr(97 + i % 26) + str(i % 10) for i in range(60))
    for _ in range(4):
        spans = []
        for _ in range(9):
            a = rng.randrange(0, 100)
            spans.append((a, min(len(text), a + rng.randrange(1, 30))))
        rows = [(1, i, 0, "f", a, b, "exact") for i, (a, b) in enumerate(spans)]
        placed = spark.createDataFrame(rows, "review_id bigint, item int, file_ord int, filename string, start int, stop int, how string")
        taken = [spans[r.item] for r in rescan.choose_fixes(placed).filter("state = 'applied'").collect()]
        free = lambda some: all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(some, 2))
        most = max(n for n in range(10) for some in itertools.combinations(spans, n) if free(some))
        assert free(taken) and len(taken) == most


@pytest.mark.parametrize("text", [None, "", "\r\nos.system(x)\r\n"])
def test_missing_empty_and_foreign_line_ends(spark, text):
    _, got = results(spark, [("os.system(x)", "ok()", "Os Command")], text=text)
    assert got[1].state == ("applied" if text else "not found")
