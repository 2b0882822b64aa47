"""Scoring detector configurations against labels.

A snippet has (id, label, kind); detectors give rows (id, sev) and scores (id, score). All steps aggregate by
snippet first, then by configuration and threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.ordering import join_on, with_range_total
from ..functions.stats import rate, rate_text, wilson_ci


def snippet_evidence(
    snippets: DataFrame,
    rules: DataFrame,
    patterns: DataFrame | None = None,
    scores: DataFrame | None = None,
    pipeline: DataFrame | None = None,
) -> DataFrame:
    """Per snippet: worst severity per detector, score, and the flag of the whole job.

    All inputs are stacked and aggregated by snippet in one shuffle; detector rows of unknown ids drop out.
    """
    types = {"label": "int", "kind": "string", "rule_sev": "int", "pattern_sev": "int", "score": "double",
             "job_flag": "boolean"}

    def stacked(rows: DataFrame, **values: str) -> DataFrame:
        return rows.select("id", *[
            (F.col(values[c]) if c in values else F.lit(None)).cast(t).alias(c) for c, t in types.items()
        ])

    rows = stacked(snippets, label="label", kind="kind").unionByName(stacked(rules, rule_sev="sev"))
    if patterns is not None:
        rows = rows.unionByName(stacked(patterns, pattern_sev="sev"))
    if scores is not None:
        rows = rows.unionByName(stacked(scores, score="score"))
    if pipeline is not None:
        rows = rows.unionByName(stacked(pipeline, job_flag="flag"))
    by_id = rows.groupBy("id").agg(*[F.max(c).alias(c) for c in types])
    return by_id.filter(F.col("label").isNotNull())


def at_or_above(evidence: DataFrame) -> DataFrame:
    """Each snippet at both severity thresholds, with one flag per detector; no finding means false."""
    settings = F.array(*[
        F.struct(F.lit(name).alias("setting"), F.lit(floor).alias("floor")) for name, floor in fv.THRESHOLD_NAMES
    ])
    rows = evidence.withColumn("s", F.explode(settings)).select("*", "s.setting", "s.floor").drop("s")
    return rows.withColumns({
        "rule_flag": F.coalesce(F.col("rule_sev") >= F.col("floor"), F.lit(False)),
        "pattern_flag": F.coalesce(F.col("pattern_sev") >= F.col("floor"), F.lit(False)),
    })


def ensemble_flags(
    flagged: DataFrame, with_patterns: bool, with_scores: bool, with_job: bool, threshold: float = fv.SCORE_THRESHOLD
) -> DataFrame:
    """One row per snippet, setting and configuration; a missing layer removes its configurations."""
    rule, pattern = F.col("rule_flag"), F.col("pattern_flag")
    score = F.coalesce(F.col("score") >= threshold, F.lit(False))
    names = fv.CONFIGURATIONS
    configurations: list[tuple[str, Column]] = [(names[0], rule)]
    if with_patterns:
        configurations.append((names[1], rule | pattern))
        if with_scores:
            configurations.append((names[2], rule | pattern | score))
    if with_scores:
        configurations.append((names[3], score))
    if with_job:
        configurations.append((names[4], F.col("job_flag")))
    pairs = F.array(*[F.struct(F.lit(n).alias("configuration"), flag.alias("flag")) for n, flag in configurations])
    return flagged.select("id", "label", "kind", "setting", F.explode(pairs).alias("c")).select(
        "id", "label", "kind", "setting", "c.*"
    )


def confusion_matrix(flags: DataFrame) -> DataFrame:
    """tp, fp, fn, tn per setting and configuration. A configuration that judged no snippet at all is left out."""
    y, f = F.col("label") == 1, F.coalesce("flag", F.lit(False))
    return (
        flags.groupBy("setting", "configuration")
        .agg(
            F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"),
            F.count_if(y & ~f).alias("fn"), F.count_if(~y & ~f).alias("tn"),
            F.count("flag").alias("_judged"),
        )
        .filter(F.col("_judged") > 0)
        .drop("_judged")
    )


_RATES = {"precision": ("tp", ("tp", "fp")), "recall": ("tp", ("tp", "fn")), "fpr": ("fp", ("fp", "tn"))}


def precision_recall_fpr(matrix: DataFrame) -> DataFrame:
    """Rates with k, n and Wilson bounds; null where n = 0."""
    columns: dict[str, Column] = {}
    for name, (k, parts) in _RATES.items():
        n = F.col(parts[0]) + F.col(parts[1])
        columns |= {name: rate(F.col(k), n), f"{name}_k": F.col(k), f"{name}_n": n, f"{name}_ci": wilson_ci(F.col(k), n)}
    return matrix.withColumns(columns)


def recall_by_kind(flags: DataFrame) -> DataFrame:
    """Recall of vulnerable snippets per kind; kinds without any are not listed."""
    return (
        flags.filter((F.col("label") == 1) & F.col("kind").isin("pattern", "semantic"))
        .groupBy("setting", "configuration", "kind")
        .agg(F.count_if(F.coalesce("flag", F.lit(False))).alias("k"), F.count(F.lit(1)).alias("n"))
        .withColumn("recall", rate(F.col("k"), F.col("n")))
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve of (label, score), ties counted half; null if only one class occurs.

    Rows are first added up per distinct score, whatever range the scores come from. Running totals are built range by range of
    the distinct scores, so no task has to sort all of them.
    """
    per_score = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    ranked = with_range_total(per_score, [], ["score"], "neg", "neg_so_far")
    exact = lambda c: c.cast("decimal(19,0)")
    doubled = exact(F.col("pos")) * exact(2 * F.col("neg_so_far") - F.col("neg"))
    sums = ranked.agg(
        F.sum(doubled.cast("decimal(38,0)")).alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return sums.select("n_pos", "n_neg", F.try_divide(F.col("wins").cast("double"), 2 * pairs).alias("auc"))


def mean_score_by_label(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def per_snippet(snippets: DataFrame, rules: DataFrame, patterns: DataFrame, scores: DataFrame) -> DataFrame:
    """Rule ids each layer reported for a snippet, and its rounded score. Lists are bounded by the snippet's text."""
    def ids(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("id").agg(F.sort_array(F.collect_list("rule_id")).alias(name))

    empty = F.array().cast("array<string>")
    rows = snippets.join(ids(rules, "rule_ids"), "id", "left").join(ids(patterns, "pattern_ids"), "id", "left")
    return rows.join(scores.select("id", "score"), "id", "left").select(
        "id", "label", "kind", F.coalesce("rule_ids", empty).alias("rule_ids"),
        F.coalesce("pattern_ids", empty).alias("pattern_ids"), F.round("score", 3).alias("score"),
    )


def labels_with_flags(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Labels and predictions of the same items, matched by key."""
    return labels.join(predictions, key)


def accuracy_and_flagged_rate(scored: DataFrame, group: list[str]) -> DataFrame:
    """Accuracy, flagged rate, and mean score of either class."""
    flag = F.col("score") >= fv.SCORE_THRESHOLD
    is_label = lambda v: F.when(F.col("label") == v, F.col("score"))
    return scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((flag.cast("int") == F.col("label")).cast("int")).alias("accuracy"),
        F.avg(flag.cast("int")).alias("flagged_rate"),
        F.avg(is_label(1)).alias("mean_positive"),
        F.avg(is_label(0)).alias("mean_negative"),
    )


def saturation(scored: DataFrame, group: list[str]) -> DataFrame:
    """Smallest, largest and mean score, flagged rate, and whether nearly everything is flagged."""
    flagged = F.avg((F.col("score") >= fv.SCORE_THRESHOLD).cast("int"))
    rows = scored.groupBy(*group).agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"),
        flagged.alias("flagged_rate"),
    )
    f = F.col("flagged_rate")
    return rows.withColumn("saturation", F.when(f >= 0.9, "saturated").when(f <= 0.6, "not saturated").otherwise("mixed"))


def upper_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The element n div 2 (from 0) of the sorted values of each group, which may be of any type that has an order.

    Values are counted before anything is ordered, and the counts are run through in ranges of the values.
    """
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*group).agg(F.sum("_c").alias("n"))
    running = with_range_total(counts, group, [value], "_c", "_upto")
    return (
        join_on(running, totals, group)
        .filter(F.col("_upto") > F.expr("n div 2"))
        .groupBy(*group)
        .agg(F.min(value).alias("upper_median"), F.first("n").alias("n"))
    )


def length_band(rows: DataFrame, text: str, lower: int = 300, upper: int = 3000) -> DataFrame:
    """Texts strictly between the two lengths."""
    return rows.filter((F.length(text) > lower) & (F.length(text) < upper))


def distinct_texts(rows: DataFrame, text: str, order: str) -> DataFrame:
    """One row per distinct text, the first in order; texts are compared by a 256-bit digest."""
    columns = [c for c in rows.columns if c != text]
    kept = rows.groupBy(F.sha2(text, 256).alias("_digest")).agg(F.min_by(F.struct(*columns, text), order).alias("r"))
    return kept.select("r.*")


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """Exactly n rows (or all), the same for the same seed, however the data is partitioned."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.orderBy(order, key).limit(n)


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    """Share of positives and the accuracy of always answering the larger class."""
    share = F.avg(F.col(label))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), share.alias("positive_ratio"),
        F.greatest(share, 1 - share).alias("majority_baseline"),
    )


def classification_metrics(rows: DataFrame, group: list[str]) -> DataFrame:
    """Accuracy, precision, recall and F1 of (label, prediction); 0 where a rate has nothing to divide by."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    counts = rows.groupBy(*group).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda k, n: F.coalesce(F.try_divide(k, n), F.lit(0.0))
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def metrics_markdown(matrix: DataFrame, by_kind: DataFrame) -> DataFrame:
    """Result tables as ordered lines (setting, part, line_no, text); one line per configuration."""
    number = F.create_map(*[F.lit(x) for i, c in enumerate(fv.CONFIGURATIONS) for x in (c, i)])
    place = number[F.col("configuration")]
    k = {"precision": "tp", "recall": "tp", "fpr": "fp"}
    cells = [rate_text(F.col(k[n]), F.col(parts[0]) + F.col(parts[1])) for n, (_, parts) in _RATES.items()]
    counts = F.concat_ws("/", *[F.col(c).cast("string") for c in ("tp", "fp", "fn", "tn")])
    table = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("configuration"), *cells, counts), F.lit(" |"))
    first = matrix.select("setting", F.lit(1).alias("part"), place.alias("line_no"), table.alias("text"))
    cell = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, rate_text(F.col("k"), F.col("n")))), F.lit("n/a"))
    rows = by_kind.groupBy("setting", "configuration").agg(cell("pattern").alias("p"), cell("semantic").alias("s"))
    text = F.concat(F.lit("| "), F.concat_ws(" | ", "configuration", "p", "s"), F.lit(" |"))
    second = rows.select("setting", F.lit(2).alias("part"), place.alias("line_no"), text.alias("text"))
    return first.unionByName(second)


def evaluation_markdown(flags: DataFrame, scored: DataFrame, name: str, primary: str) -> DataFrame:
    """The whole evaluation text as ordered lines (block, setting, part, line_no, text): title and benchmark with its counts, per setting
    a heading and the two tables under their heads, and the scores: area under the curve and mean score of either class.

    The lines are bounded by settings and configurations. ``primary`` marks a setting; ``scored`` has label and score, null scores are left out.
    """
    spark = flags.sparkSession
    tables = metrics_markdown(confusion_matrix(flags), recall_by_kind(flags))
    sizes = flags.select("id", "label").distinct().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("v"))
    title = spark.createDataFrame([(0, "# Detector evaluation"), (1, "")], "line_no INT, text STRING")
    benchmark = sizes.select(
        F.posexplode(F.array(F.format_string(f"## Benchmark: {name} (%d snippets, %d vulnerable)", "n", "v"), F.lit(""))).alias("line_no", "text"))
    settings = flags.select("setting").distinct()
    star = F.when(F.col("setting") == primary, F.lit(" (primary)")).otherwise(F.lit(""))
    heads = [
        F.array(F.concat(F.lit("### Severity filter: "), F.col("setting"), star), F.lit(""), *map(F.lit, fv.EVALUATION_HEADS[0])),
        F.array(F.lit(""), F.lit("Recall by weakness type:"), F.lit(""), *map(F.lit, fv.EVALUATION_HEADS[1])),
        F.array(F.lit("")),
    ]
    framed = None
    for k, head in enumerate(heads):  # heads stand before the rows of their table, which are numbered from 0
        rows = settings.select("setting", F.lit(k + 1).alias("part"), F.posexplode(head).alias("line_no", "text")).withColumn(
            "line_no", F.col("line_no") - (100 if k < 2 else 0))
        framed = rows if framed is None else framed.unionByName(rows)
    known = scored.filter(F.col("score").isNotNull())
    mean = lambda label: F.coalesce(F.format_string("%.3f", F.avg(F.when(F.col("label") == label, F.col("score")))), F.lit("n/a"))
    means = known.agg(mean(1).alias("bad"), mean(0).alias("good"), F.count(F.lit(1)).alias("n"))
    curve = roc_auc(known).select(F.when(F.col("auc").isNotNull(), F.format_string("%.3f", "auc")).otherwise(F.lit("n/a")).alias("auc"))
    scores = means.filter("n > 0").crossJoin(curve).select(F.posexplode(F.array(  # one row each
        F.lit("Scores of the units:"), F.lit(""),
        F.format_string("- ROC-AUC on this benchmark: **%s** (0.5 = chance)", "auc"),
        F.format_string("- Mean P(vulnerable): vulnerable snippets %s, safe snippets %s", "bad", "good"), F.lit(""))).alias("line_no", "text"))
    whole = lambda block, rows: rows.select(
        F.lit(block).alias("block"), F.lit("").alias("setting"), F.lit(0).alias("part"), F.col("line_no"), "text")
    body = framed.unionByName(tables).select(F.lit(2).alias("block"), "setting", "part", "line_no", "text")
    return whole(0, title).unionByName(whole(1, benchmark)).unionByName(body).unionByName(whole(3, scores))
