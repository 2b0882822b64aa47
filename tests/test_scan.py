import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from diffsieve import fixed_values as fv
from diffsieve.functions.text import percent, title_case
from diffsieve.operators import scan
from diffsieve.operators.rules import RULE_PACK, TEXT_PACK, rule_table
from diffsieve.operators.files import parse_files
from diffsieve.sources.corpus import corpus

UNIT = "review_id BIGINT, file_ord INT, filename STRING, unit_ord INT, name STRING, start_line INT, end_line INT, source STRING"


def units_of(spark, *sources):
    return spark.createDataFrame([(1, i, f"f{i}.py", 1, f"fn{i}", 5, 9, s) for i, s in enumerate(sources)], UNIT)


def reference_score(source):
    score, found = 0.0, []
    for pattern, category, weight in fv.UNIT_PATTERNS:
        if re.search(pattern, source):
            score = max(score, weight)
            found.append(category)
    return score, found


SOURCES = [
    "def f():\n    x = input('a')", "def f():\n    eval(input('a'))\n    exec('b')",
    "subprocess.run(\n  a,\n  shell=True)", "subprocess.run(a, shell = True)", "ast.literal_eval(x)",
    "cursor.execute(\n  'a' % b)", "cursor.execute('a' + b)", "hashlib.sha1(x); random.random()", "   \n\t", "clean()",
]


def test_scores_and_categories(spark):
    rows = scan.unit_scores(units_of(spark, *SOURCES)).collect()
    got = {r.file_ord: (r.score, list(r.categories)) for r in rows}
    assert got == {i: reference_score(s) for i, s in enumerate(SOURCES) if s.strip()}


def test_all_categories_once_the_score_passes(spark):
    rows = scan.match_patterns(units_of(spark, *SOURCES)).collect()
    want = []
    for i, s in enumerate(SOURCES):
        score, found = reference_score(s)
        if s.strip() and score >= 0.5:
            want += [(i, c, "high" if score >= 0.8 else "medium") for c in found]
    assert sorted((r.file_ord, r.category, r.severity) for r in rows) == sorted(want)
    weak = [r for r in rows if r.file_ord == 1 and r.category == "Unvalidated Input"]
    assert len(weak) == 1 and weak[0].line == 5 and "(confidence 85%)" in weak[0].description
    assert len({r.id for r in rows}) == len(rows)


def test_rules_per_pass_do_not_change_the_result(spark, documents, monkeypatch):
    parsed = parse_files(corpus(documents))
    inline = scan.rule_scan(parsed, RULE_PACK)
    table = rule_table(spark, RULE_PACK)
    key = lambda df: sorted((r.id, r.severity, r.category) for r in df.collect())
    want = key(inline)
    assert want and key(scan.rule_scan(parsed, table)) == want
    monkeypatch.setattr(scan, "RULES_PER_PASS", 3)
    assert key(scan.rule_scan(parsed, table)) == want
    assert key(scan.rule_scan(parsed, table.drop("needles"))) == want


@pytest.mark.parametrize("rule", [r for r in RULE_PACK + TEXT_PACK if r.needles], ids=lambda r: r.rule_id)
def test_needles_are_necessary(rule):
    samples = SOURCES + [
        "EXEC (x)", "password = 'a'", 'Token = "x"', "pickle.load(f)", "random.choice(x)", "verify=False", "yaml.load(x)",
        "os.popen(x)", "query = 'SELECT a FROM b' + c", 'cur.execute("a" % b)', "__import__ (x)", "a.innerHTML = b",
        "document.write(x)", "Math.random()", "exec(x)", "a@b.c", "License", "x.dangerouslySetInnerHTML",
    ]
    for text in samples:
        if re.search(rule.pattern, text):
            assert any(n in text.lower() for n in rule.needles)


def test_titles_and_percents(spark):
    names = ["hard_coded-b64decode", "a", "", "x9y_z", "ÜBER_straße"]
    rows = spark.createDataFrame([(n,) for n in names], "n STRING").select("n", title_case(F.col("n")).alias("t")).collect()
    assert all(r.t == r.n.replace("_", " ").replace("-", " ").title() for r in rows)
    values = [0.125, 0.375, 0.85, 0.5, 0.005, 0.995, 1.0]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", percent(F.col("v")).alias("p")).collect()
    assert all(r.p == f"{r.v:.0%}" for r in rows)


def test_lookups(spark):
    ids = spark.createDataFrame([("B105",), ("B999",)], "rule_id STRING")
    table = spark.createDataFrame(list(fv.CWE_OF_RULE.items()), "rule_id STRING, cwe_id STRING")
    rows = {r.rule_id: r.cwe_id for r in scan.attach_lookup(ids, "rule_id", table).collect()}
    assert rows == {"B105": "CWE-259", "B999": None}


@pytest.mark.parametrize("more", [0, 299, 300, 999])
def test_rule_tables_of_any_size_give_the_same_rows(spark, more):
    row = Row(review_id=1, file_ord=0, filename="a.py", language="python", content="x = eval(y)\n")
    rules = [("r", "p/python", 2, "ERROR", "r", r"eval\(", "m", ["EVAL"], 1)]
    rules += [(f"r{k}", "p/python", 2, "ERROR", "r", f"never{k}", "m", [], k + 2) for k in range(more)]
    schema = ("rule_id string, ruleset string, layer int, raw_severity string, name string, pattern string, message string, "
              "needles array<string>, rule_ord int")
    found = scan.rule_scan(spark.createDataFrame([row]), spark.createDataFrame(rules, schema)).collect()
    assert [(f.line, f.severity) for f in found] == [(1, "high")]
