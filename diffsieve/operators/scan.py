"""Detection: line rules on source lines, weighted patterns on function units."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.severity import lookup, pattern_scanner_severity, rule_scanner_severity
from ..functions.text import last_part, percent, prefix, short_id, title_case, unix_lines
from ..schemas import FINDING_COLUMNS
from ..staging import stage
from . import edges
from .literals import compiled, matching_rules, read_patterns, required_of
from .rules import Rule, rule_table

# Rules of a user's table without a required text that are compiled into one projection.
RULES_PER_PASS = 300
# Rules of a user's table that are read by the driver. A larger table stays distributed.
RULES_AT_ONCE = 20_000


def ruleset_of(language: Column) -> Column:
    """The ruleset of a language; null if there is none."""
    return lookup(language, fv.RULESET_OF_LANGUAGE)


def ruleset_for_language(files: DataFrame, rulesets: DataFrame) -> DataFrame:
    """Files with the ruleset of their language (columns language, ruleset); files without one drop out."""
    return files.join(rulesets, "language")


def attach_lookup(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Left join with a lookup table; null where the key is absent. Spark broadcasts the table if its bytes allow it."""
    return rows.join(table, key, "left")


def source_lines(files: DataFrame) -> DataFrame:
    """One row per line of every file. No shuffle: lines are made where the file is."""
    text = unix_lines(F.col("content"))
    keys = [c for c in files.columns if c != "content"]
    rows = files.filter(F.col("content") != "").select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "text"))
    return rows.withColumn("line", F.col("pos") + 1).drop("pos")


def rule_hits(lines: DataFrame, pack: list[Rule]) -> DataFrame:
    """Lines with the rules they match (``rule_ord``), for a pack known when the job is written.

    Every rule is a literal ``rlike`` in one projection, so each pattern is compiled once per task and the
    lines are neither joined nor moved; a plain text search for the rule's needles comes first. The outer
    explode keeps Spark from evaluating the patterns a second time in an inferred filter. Expects a column
    ``ruleset``.
    """
    by_ruleset: dict[str, list[tuple[int, Rule]]] = {}
    for number, rule in enumerate(pack, 1):
        by_ruleset.setdefault(rule.ruleset, []).append((number, rule))

    hits = None
    for ruleset, rules in by_ruleset.items():
        numbers = F.array(*[F.when(_matches(r), F.lit(n)) for n, r in rules])
        condition = F.col("ruleset") == ruleset
        hits = F.when(condition, numbers) if hits is None else hits.when(condition, numbers)
    lowered = lines.withColumn("_low", F.lower("text"))
    found = lowered.withColumn("rule_ord", F.explode_outer(hits)).drop("_low")
    return found.filter(F.col("rule_ord").isNotNull())


def _matches(rule: Rule) -> Column:
    matches = F.col("text").rlike(rule.pattern)
    if not rule.needles:
        return matches
    return reduce(Column.__or__, [F.contains(F.col("_low"), F.lit(n)) for n in rule.needles]) & matches


def table_hits(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with the rules of a user's table that they match, with what the rules say.

    The table is configuration: numbers and patterns are read once. Rules whose patterns name a text that matches must contain are found by
    one pass over the lines, however many there are (see `literals`); the others are compiled in like any pack, RULES_PER_PASS a
    projection. Only patterns decide; needles of a user's rules are not used, as nothing says that they are implied. The table goes to all
    tasks, so that no line is moved.

    A table of more than RULES_AT_ONCE rules stays distributed: tasks read the patterns, plain texts between edges go to the workers as arrays, piece by
    piece (see `edges`), other rules with a text RULES_AT_ONCE a pass. What the rules say is joined only if somebody asks for it.
    """
    if rules.count() > RULES_AT_ONCE:
        hits, meanings = _large_table_hits(lines, rules), rule_meanings(rules).dropDuplicates(["rule_ord"])
        # by number, and a number has one rule: Spark leaves the join out if none of its columns is used
        return _together(hits, lines, rules).join(meanings, "rule_ord", "left")
    rows = rules.select("rule_ord", "ruleset", "pattern").orderBy("rule_ord").collect()
    texts, without = compiled([(r["rule_ord"], r["pattern"]) for r in rows])
    hits = [matching_rules(lines, rules, texts)] if texts else []
    everywhere = set(without)
    hits += _compiled_in(lines, [r for r in rows if r["rule_ord"] in everywhere])
    return _together(hits, lines, rules).join(F.broadcast(rule_meanings(rules)), "rule_ord")


def _together(hits: list[DataFrame], lines: DataFrame, rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, hits or [lines.limit(0).withColumn("rule_ord", F.lit(None).cast(rules.schema["rule_ord"].dataType))])


def _compiled_in(lines: DataFrame, rows: list[Row]) -> list[DataFrame]:
    """Lines with those of the rules ``rule_ord, ruleset, pattern`` that they match; every rule is tried on every line of its ruleset."""
    hits = []
    for at in range(0, len(rows), RULES_PER_PASS):
        part = rows[at : at + RULES_PER_PASS]
        own = F.element_at(F.array(*[F.lit(r["rule_ord"]) for r in part]), F.col("rule_ord"))
        pack = [Rule("", r["ruleset"], 0, "", "", r["pattern"], "", []) for r in part]
        hits.append(rule_hits(lines, pack).withColumn("rule_ord", own))
    return hits


def _large_table_hits(lines: DataFrame, rules: DataFrame) -> list[DataFrame]:
    read = stage(read_patterns(rules))
    alike = {r["shape"]: r["count"] for r in read.groupBy("shape").count().where(f"shape IS NOT NULL AND count >= {edges.LEAST_ALIKE}").collect()}
    edged = F.coalesce(F.col("shape").isin(list(alike)), F.lit(False))
    hits, n = [], sum(alike.values())
    if n:
        passes, pieces = -(-n // edges.PASS_RULES), -(-n // edges.SENT_RULES)
        hits += edges.edged_rules(lines, read.where(edged), passes, max(passes, pieces))
    others = read.where(~edged)
    named = others.where(F.size("texts") > 0)
    parts = -(-named.count() // RULES_AT_ONCE)
    for k in range(parts):
        part = named.where(F.pmod(F.xxhash64("rule_ord"), F.lit(parts)) == k)
        hits.append(matching_rules(lines, part, required_of((r["rule_ord"], r["texts"]) for r in part.select("rule_ord", "texts").collect())))
    without = others.where(F.size("texts") == 0).select("rule_ord", "ruleset", "pattern").orderBy("rule_ord").collect()
    return hits + _compiled_in(lines, without)


def rule_meanings(rules: DataFrame) -> DataFrame:
    """What a match of each rule says: layer, severity, category, weakness codes, description, source."""
    first = F.col("layer") == 1
    return rules.select(
        "rule_ord",
        "layer",
        F.when(first, rule_scanner_severity(F.col("raw_severity")))
        .otherwise(pattern_scanner_severity(F.col("raw_severity"))).alias("severity"),
        title_case(last_part(F.col("name"), ".")).alias("category"),
        F.when(first, lookup(F.col("rule_id"), fv.CWE_OF_RULE)).alias("cwe_id"),
        F.when(first, lookup(F.col("rule_id"), fv.OWASP_OF_RULE)).alias("owasp"),
        F.col("message").alias("description"),
        F.when(first, F.lit(fv.SOURCE_RULES)).otherwise(F.lit(fv.SOURCE_PATTERNS)).alias("source"),
        "rule_id",
    )


def rule_scan(parsed: DataFrame, pack: list[Rule] | DataFrame) -> DataFrame:
    """Findings of the two line-scanning layers, in the finding schema."""
    files = parsed.select("review_id", "file_ord", "filename", "content", ruleset_of(F.col("language")).alias("ruleset"))
    lines = source_lines(files.filter(F.col("ruleset").isNotNull()))
    if isinstance(pack, DataFrame):
        found = table_hits(lines, pack)
    else:
        meanings = rule_meanings(rule_table(parsed.sparkSession, pack))
        found = rule_hits(lines, pack).join(F.broadcast(meanings), "rule_ord")
    return as_findings(found.withColumns({
        "seq": F.col("line"),
        "sub": F.col("rule_ord"),
        "code_snippet": F.regexp_replace("text", r"^\s+|\s+$", ""),
    }))


def as_findings(found: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows to the finding schema: stable id, no verdict yet."""
    parts = [F.col(c).cast("string") for c in
             ("review_id", "filename", "line", "source", "category", "file_ord", "layer", "seq", "sub")]
    return found.withColumns({
        "id": short_id(*parts),
        "false_positive": F.lit(False),
        "fp_reason": F.lit(None).cast("string"),
    }).select(*FINDING_COLUMNS, *keep)


# ---- weighted patterns ----------------------------------------------------------------------------------------


def matched_patterns(source: Column) -> Column:
    """Numbers of the weighted patterns found in a text, ascending."""
    return F.array_compact(F.array(*[
        F.when(source.rlike(pattern), F.lit(n)) for n, (pattern, _, _) in enumerate(fv.UNIT_PATTERNS, 1)
    ]))


def _weights(numbers: Column) -> Column:
    table = F.array(*[F.lit(float(w)) for _, _, w in fv.UNIT_PATTERNS])
    return F.transform(numbers, lambda n: F.element_at(table, n))


def _category(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for _, c, _ in fv.UNIT_PATTERNS]), number)


def unit_scores(units: DataFrame) -> DataFrame:
    """Units with text, with `patterns` (numbers), `score` (largest weight, 0 if none) and `categories`."""
    scored = units.filter(F.col("source").rlike(r"\S")).withColumn("patterns", matched_patterns(F.col("source")))
    return scored.withColumns({
        "score": F.coalesce(F.array_max(_weights(F.col("patterns"))), F.lit(0.0)),
        "categories": F.transform("patterns", _category),
    })


def match_patterns(units: DataFrame) -> DataFrame:
    """Findings of units whose score passes: one per matched pattern, weak and repeated categories included."""
    emitted = F.when(F.col("score") >= fv.SCORE_THRESHOLD, F.col("patterns"))
    passed = unit_scores(units).withColumn("emitted", emitted)
    hits = passed.withColumn("sub", F.explode_outer("emitted")).filter(F.col("sub").isNotNull())
    found = hits.select(
        "review_id",
        "file_ord",
        F.lit(3).alias("layer"),
        F.col("unit_ord").alias("seq"),
        "sub",
        "filename",
        F.col("start_line").alias("line"),
        F.when(F.col("score") >= fv.HIGH_SCORE, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        _category(F.col("sub")).alias("category"),
        F.lit(None).cast("string").alias("cwe_id"),
        F.lit(None).cast("string").alias("owasp"),
        F.format_string(fv.HEURISTIC_TEXT, F.col("name"), _category(F.col("sub")), percent(F.col("score")))
        .alias("description"),
        F.lit(fv.SOURCE_UNITS).alias("source"),
        prefix(F.col("source"), fv.UNIT_SNIPPET).alias("code_snippet"),
    )
    return as_findings(found)


def merge_layers(*layers: DataFrame) -> DataFrame:
    """All findings of all layers; repeats stay."""
    return reduce(DataFrame.unionByName, layers)
