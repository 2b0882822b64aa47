import math
import random

import pytest
from pyspark.sql import functions as F

from diffsieve.functions.ordering import in_ranges, with_position, with_range_total
from diffsieve.operators import classify, evaluate

PUBLISHED = [
    ("all severities", "Bandit only", 17, 3, 7, 21, "85% (17/20; CI 64-95%)", "71% (17/24; CI 51-85%)", "12% (3/24; CI 4-31%)"),
    ("all severities", "Bandit + Semgrep", 18, 3, 6, 21, None, "75% (18/24; CI 55-88%)", "12% (3/24; CI 4-31%)"),
    ("all severities", "CodeBERT alone (C -> Python transfer)", 24, 24, 0, 0, None, None, "100% (24/24; CI 86-100%)"),
    ("MEDIUM and above", "Bandit only", 0, 0, 0, 5, "n/a", "n/a", "0% (0/5; CI -0-43%)"),
]


# "-0" is what the formula gives in double arithmetic: its lower bound for 0 of 5 is -2e-17.


def wilson(k, n, z=1.96):
    p, d = k / n, 1 + z * z / n
    c, a = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (c - a) / d, (c + a) / d


def test_published_counts(spark):
    matrix = spark.createDataFrame([r[:6] for r in PUBLISHED], "setting STRING, configuration STRING, tp BIGINT, fp BIGINT, fn BIGINT, tn BIGINT")
    kinds = spark.createDataFrame([], "setting STRING, configuration STRING, kind STRING, k BIGINT, n BIGINT")
    texts = {(r.setting, r.line_no): r.text for r in evaluate.metrics_markdown(matrix, kinds).collect()}
    assert len(texts) == 4
    for row, place in zip(PUBLISHED, (0, 1, 3, 0)):
        cells = texts[row[0], place].strip("| ").split(" | ")
        for cell, want in zip(cells[1:4], row[6:]):
            assert want is None or cell == want
    rates = {(r.setting, r.configuration): r for r in evaluate.precision_recall_fpr(matrix).collect()}
    empty = rates["MEDIUM and above", "Bandit only"]
    assert empty.precision is None and empty.precision_ci is None and empty.recall is None and empty.fpr == 0
    for r in rates.values():
        for name in ("precision", "recall", "fpr"):
            if r[f"{name}_n"]:
                lo, hi = r[f"{name}_ci"]
                assert (lo, hi) == pytest.approx(wilson(r[f"{name}_k"], r[f"{name}_n"]))
                assert -1e-9 <= lo <= r[name] + 1e-9 and r[name] - 1e-9 <= hi <= 1 + 1e-9


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_auc_with_ties(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 1), rng.choice([0.0, 0.1, 0.25, 0.5, 0.998, 1.0, rng.random()])) for i in range(200)]
    scored = spark.createDataFrame(rows, "id INT, label INT, score DOUBLE")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(scored).first().auc == pytest.approx(want)
    assert evaluate.roc_auc(scored.filter("label = 1")).first().auc is None


def test_evidence_and_configurations(spark):
    snippets = spark.createDataFrame([(1, 1, "pattern"), (2, 1, "semantic"), (3, 0, None), (4, 0, "pattern")], "id INT, label INT, kind STRING")
    rules = spark.createDataFrame([(1, 0), (1, 2), (3, 0), (99, 2)], "id INT, sev INT")
    patterns = spark.createDataFrame([(2, 1)], "id INT, sev INT")
    scores = spark.createDataFrame([(i, s) for i, s in ((1, 0.4), (2, 0.5), (3, 0.6), (4, 0.1))], "id INT, score DOUBLE")
    nothing = spark.createDataFrame([(i, None) for i in (1, 2, 3, 4)], "id INT, flag BOOLEAN")
    evidence = evaluate.snippet_evidence(snippets, rules, patterns, scores, nothing)
    assert evidence.count() == 4
    flags = evaluate.ensemble_flags(evaluate.at_or_above(evidence), True, True, True)
    matrix = {(r.setting, r.configuration): (r.tp, r.fp, r.fn, r.tn) for r in evaluate.confusion_matrix(flags).collect()}
    assert len(matrix) == 8  # the configuration that judged nothing is left out
    assert matrix["all severities", "Bandit only"] == (1, 1, 1, 1)
    assert matrix["MEDIUM and above", "Bandit only"] == (1, 0, 1, 2)
    assert matrix["MEDIUM and above", "Bandit + Semgrep"] == (2, 0, 0, 2)
    assert matrix["all severities", "CodeBERT alone (C -> Python transfer)"] == (1, 1, 1, 1)
    assert all(sum(m) == 4 for m in matrix.values())
    only_rules = evaluate.ensemble_flags(evaluate.at_or_above(evaluate.snippet_evidence(snippets, rules)), False, False, False)
    assert {r.configuration for r in only_rules.collect()} == {"Bandit only"}
    kinds = {(r.setting, r.configuration, r.kind): (r.k, r.n) for r in evaluate.recall_by_kind(flags).collect()}
    assert kinds["all severities", "Bandit only", "semantic"] == (0, 1)


def test_upper_median_is_the_upper_one(spark):
    groups = {"even": [5, 1, 4000, 2], "odd": [3, 9000, 1], "ties": [7] * 10, "one": [0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g STRING, v INT")
    got = {r.g: r.upper_median for r in evaluate.upper_median(rows, ["g"], "v").collect()}
    assert got == {g: sorted(vs)[len(vs) // 2] for g, vs in groups.items()}


def test_positions_equal_row_numbers(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i % 3, rng.randint(0, 500), i) for i in range(900)], "g INT, t INT, id INT")
    got = with_position(rows, ["g"], F.expr("t div 37"), ["t", "id"], "n").collect()
    for g in range(3):
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.t, r.id))
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))


def test_sample_distinct_and_band(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 7) + str(i % 2)) for i in range(60)], "id INT, text STRING")
    first = [r.id for r in evaluate.seeded_sample(rows, "id", 3, 10).collect()]
    assert len(set(first)) == 10 and first == [r.id for r in evaluate.seeded_sample(rows.repartition(7), "id", 3, 10).collect()]
    assert first != [r.id for r in evaluate.seeded_sample(rows, "id", 4, 10).collect()]
    kept = {r.text: r.id for r in evaluate.distinct_texts(rows, "text", "id").collect()}
    want = {}
    for i in range(60):
        want.setdefault("x" * (i % 7) + str(i % 2), i)
    assert kept == want
    assert {len(r.text) for r in evaluate.length_band(rows, "text", 2, 5).collect()} == {3, 4}


def test_zero_division_counts_as_zero(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("b", 1, 1), ("b", 0, 1)], "g STRING, label INT, prediction INT")
    got = {r.g: r for r in evaluate.classification_metrics(rows, ["g"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1, got["a"].accuracy) == (0.0, 0.0, 0.0, 1.0)
    assert (got["b"].precision, got["b"].recall) == (0.5, 1.0) and got["b"].f1 == pytest.approx(2 / 3)


def test_classifier_learns_a_plain_signal(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(20)) + (" danger" if i % 2 else " calm"), i % 2) for i in range(400)]
    table = spark.createDataFrame(rows, "id INT, text STRING, label INT")
    model, result = classify.train_text_classifier(table, "id", "text", candidates=(0.01,))
    measured = {r.split: r for r in result.collect()}
    assert set(measured) == {"validation", "test"} and measured["test"].f1 > 0.95
    assert measured["test"].majority_baseline >= 0.5
    scored = classify.score_texts(model, table, "text").collect()
    assert all(0 <= r.score <= 1 for r in scored)
    sizes = {r.split: r.n for r in classify.split_sizes(classify.with_split(table, "id")).collect()}
    assert sum(sizes.values()) == 400 and sizes["train"] > 250


def test_null_groups_are_kept(spark):
    rows = spark.createDataFrame([(None, 3), (None, 9), ("a", 1)], "g STRING, v INT")
    assert {r.g: r.upper_median for r in evaluate.upper_median(rows, ["g"], "v").collect()} == {None: 9, "a": 1}


def test_auc_of_scores_of_any_range(spark):
    rng = random.Random(12)
    rows = [(rng.randint(0, 1), rng.choice([rng.uniform(-1e9, 1e9), rng.gauss(0, 1e-9), -0.5, 1e9])) for _ in range(3000)]
    pos, neg = sorted(s for y, s in rows if y), sorted(s for y, s in rows if not y)
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(spark.createDataFrame(rows, "label INT, score DOUBLE")).first().auc == pytest.approx(want, abs=1e-12)
    assert evaluate.roc_auc(spark.createDataFrame([], "label INT, score DOUBLE")).first().auc is None


def test_ranges_are_of_about_equal_size_and_totals_run_through(spark):
    rng = random.Random(2)
    values = [*{rng.gauss(0, 1) ** 9 for _ in range(8000)}, *range(10**9, 10**9 + 500)]  # dense around 0, far outliers
    rows = spark.createDataFrame([(float(v), 1) for v in values], "v DOUBLE, n INT")
    sizes = [r["count"] for r in in_ranges(rows, ["v"], 16).groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2.5 * len(values) / 16
    got = sorted((r.v, r.upto) for r in with_range_total(rows, [], ["v"], "n", "upto", 16).collect())
    assert got == [(float(v), i) for i, v in enumerate(sorted(values), 1)]
    grouped = spark.createDataFrame([(i % 3 or None, float(v)) for i, v in enumerate(values[:900])], "g INT, v DOUBLE")
    medians = {r.g: r.upper_median for r in evaluate.upper_median(grouped, ["g"], "v").collect()}
    for g in (None, 1, 2):
        own = sorted(float(v) for i, v in enumerate(values[:900]) if (i % 3 or None) == g)
        assert medians[g] == own[len(own) // 2]
