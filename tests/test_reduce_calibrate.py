"""Rows kept before a join, calibrated scores, the evaluation text, and the entry without the text operators."""

import importlib.util
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from diffsieve.functions.reduce import keep_likely
from diffsieve.operators import classify, evaluate, worklist
from diffsieve.schemas import PR_FILES
from diffsieve.sources.files import read_source_text


def test_no_wanted_row_is_lost_and_few_others_stay(spark):
    rows = spark.range(40_000).select(F.col("id").alias("a"), (F.col("id") % 7).cast("int").alias("b"), F.lit("text").alias("t"))
    wanted = spark.range(0, 40_000, 97).select(F.col("id").alias("a"), (F.col("id") % 7).cast("int").alias("b"))
    kept = keep_likely(rows, wanted, ["a", "b"])
    assert kept.columns == rows.columns
    ids = {r.a for r in kept.collect()}
    assert set(range(0, 40_000, 97)) <= ids and len(ids) < 413 + 40
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan  # the rows stay where they are
    assert keep_likely(rows, wanted.limit(0), ["a", "b"]).count() == 0


def test_texts_are_attached_as_before_and_the_others_do_not_move(spark):
    files = spark.createDataFrame([(r, i, f"f{i % 90}.py", "python", f"t{r}-{i}", "", 0, 0) for r in range(3) for i in range(100)], PR_FILES)
    items = spark.createDataFrame([(0, "f5.py", 1), (1, "f95.py", 2), (2, "none.py", 3)], "review_id bigint, filename string, item int")
    got = worklist.attach_content(items, files)
    assert sorted((r.item, r.content) for r in got.collect()) == [(1, "t0-95"), (2, ""), (3, "")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap" in plan


def test_source_files_keep_their_names(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x = 1\n\ny = 2\n")
    (tmp_path / "b.py").write_text("")
    got = {r.name: r.content for r in read_source_text(spark, str(tmp_path)).collect()}
    assert got["a.py"] == "x = 1\n\ny = 2\n" and not got.get("b.py")


def test_out_of_fold_scores_and_calibration(spark):
    rng = random.Random(7)
    rows = []
    for i in range(360):
        label = i % 3 == 0
        # a third of the labels is noise, so that a sure model is wrong about probabilities
        words = ["bad" if label ^ (rng.random() < 0.3) else "good"] + rng.choices(["a", "b", "c", "d", "e"], k=6)
        rows.append((i, " ".join(words), int(label)))
    table = spark.createDataFrame(rows, "id bigint, text string, label int")
    model, scored = classify.out_of_fold(table, "id", "text", candidates=(0.0001, 0.1))
    found = scored.collect()
    assert sorted(r.id for r in found) == list(range(360)) and {r.fold for r in found} == {0, 1, 2}
    calibrated = classify.calibrated_out_of_fold(scored)
    rows = calibrated.collect()
    by_score = sorted((r.fold, round(r.score, 3), r.calibrated) for r in rows)
    assert all(a[2] <= b[2] + 1e-12 for a, b in zip(by_score, by_score[1:]) if a[0] == b[0])  # the order of scores stays
    report = {r.scores: r for r in classify.calibration_report(calibrated).collect()}
    for name in ("raw", "calibrated"):
        p = [(r.score if name == "raw" else r.calibrated, r.label) for r in rows]
        bins = {}
        for x, y in p:
            bins.setdefault(min(int(x * 10), 9), []).append(x - y)
        assert report[name].calibration_error == pytest.approx(sum(abs(sum(b)) for b in bins.values()) / len(p))
        flags = [(x >= 0.5, y == 1) for x, y in p]
        assert (report[name].tp, report[name].fp, report[name].fn, report[name].tn) == tuple(
            flags.count(k) for k in ((True, True), (True, False), (False, True), (False, False)))
    assert report["calibrated"].calibration_error <= report["raw"].calibration_error + 0.02
    assert classify.score_texts(model, table, "text").count() == 360


def test_the_evaluation_text_is_whole_and_in_order(spark):
    snippets = spark.createDataFrame([(1, 1, "pattern"), (2, 0, "semantic")], "id INT, label INT, kind STRING")
    hits = spark.createDataFrame([(1, 2)], "id INT, sev INT")
    flags = evaluate.ensemble_flags(evaluate.at_or_above(evaluate.snippet_evidence(snippets, hits)), True, False, False)
    scored = spark.createDataFrame([(1, 0.75), (0, 0.25), (0, None)], "label INT, score DOUBLE")
    order = ["block", "setting", "part", "line_no"]
    text = [r.text for r in evaluate.evaluation_markdown(flags, scored, "own", "all severities").orderBy(*order).collect()]
    assert text[:3] == ["# Detector evaluation", "", "## Benchmark: own (2 snippets, 1 vulnerable)"]
    at = text.index("### Severity filter: all severities (primary)")
    assert text[at + 2].startswith("| Configuration | Precision") and text[at + 4].startswith("| ")
    assert text[-3:-1] == ["- ROC-AUC on this benchmark: **1.000** (0.5 = chance)", "- Mean P(vulnerable): vulnerable snippets 0.750, safe snippets 0.250"]
    none = evaluate.evaluation_markdown(flags, scored.limit(0), "own", "all severities")
    assert none.filter("block = 3").count() == 0


def test_entry_imports_without_the_text_operators():
    root = Path(__file__).resolve().parent.parent
    code = (
        "import sys, importlib.util as u\n"
        f"sys.path.insert(0, {str(root)!r})\n"
        "real = u.find_spec\n"
        "u.find_spec = lambda name, *a: None if name.startswith('diffsieve.llm') else real(name, *a)\n"
        "sys.modules['diffsieve.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'blocked_reviews' in names and 'pipeline' not in names and not [n for n in names if n.startswith('op')], names\n")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    if importlib.util.find_spec("diffsieve.llm") is not None:
        import __spark_entry__

        assert "pipeline" in __spark_entry__.queries()


def test_out_of_fold_hashes_words_once(spark, monkeypatch):
    """Folds and candidates fit on the counts that were written; the model returned still takes words."""
    rows = [(i, " ".join(["good" if i % 2 else "bad", f"w{i % 7}"]), i % 2) for i in range(90)]
    table = spark.createDataFrame(rows, "id bigint, text string, label int")
    written = []
    monkeypatch.setattr(classify, "stage", lambda df: written.append(df.columns) or df)
    model, scored = classify.out_of_fold(table, "id", "text")
    assert "counts" in written[0] and "words" not in written[0]
    assert scored.count() == 90
    assert {r.id: r.score > 0.5 for r in classify.score_texts(model, table, "text").collect()} == {i: y == 1 for i, _, y in rows}
