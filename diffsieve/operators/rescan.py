"""Putting fixes into their files and scanning again what they changed.

A fix says which text it replaces. That text is looked for in the file of its finding: exactly, from the finding's line on and then
anywhere; else as the run of whole lines with the least edit distance, if that is at most a fifth of the text. Of fixes that want the same
characters the most that fit together are taken (earliest end first). Only the changed lines are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reduce import keep_likely
from ..functions.text import unix_lines
from .dedupe import family_of
from .rules import RULE_PACK, Rule, rule_table
from .scan import rule_hits, rule_meanings, ruleset_of, table_hits

# Edits allowed for each character of the text to be replaced.
NEAR = 0.2
FILE = ["review_id", "file_ord", "filename"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _before(lines: Column, line: Column) -> Column:
    """How many characters stand before a line (1-based)."""
    return F.when(line > 1, F.length(F.array_join(F.slice(lines, 1, line - 1), "\n")) + 1).otherwise(F.lit(0))


def near_window(lines: Column, original: Column, bound: Column) -> Column:
    """``struct(distance, line)`` of the run of whole lines nearest to ``original`` within ``bound`` edits, the first of equals; else null."""
    height = F.size(_lines(original))
    last = F.size(lines) - height + 1

    def measured(line: Column) -> Column:
        window = F.array_join(F.slice(lines, line, height), "\n")
        close = F.abs(F.length(window) - F.length(original)) <= bound
        distance = F.when(close, F.call_function("levenshtein", window, original, bound)).otherwise(F.lit(-1))
        return F.struct(distance.alias("distance"), line.alias("line"))

    tried = F.filter(F.transform(F.sequence(F.lit(1), last), measured), lambda x: x["distance"] >= 0)
    return F.when((last >= 1) & F.exists(F.array(original), lambda x: x.rlike(r"\S")), F.array_min(tried))


def place_fixes(fixes: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """Fixes with the place of the text they replace: ``how`` (exact, near, null if it isn't there), ``distance``, and the
    characters ``start`` (0-based) to ``stop`` (behind the last)."""
    wanted = items.select("review_id", "item", "file_ord", F.col("filename").alias("_named"), "line", "category", "severity")
    asked = fixes.select("review_id", "item", "filename", "original", "fixed").join(wanted, ["review_id", "item"])
    wanted_files = asked.select("review_id", "file_ord")
    texts = keep_likely(files.select(*FILE, unix_lines(F.col("content")).alias("content")), wanted_files, ["review_id", "file_ord"])
    joined = asked.drop("_named").join(texts, FILE, "left")
    lines = _lines(F.coalesce("content", F.lit("")))
    offset = _before(lines, F.least("line", F.size(lines)))
    from_line = F.call_function("locate", F.col("original"), F.col("content"), offset + 1)
    usable = F.col("original").rlike(r"\S") & F.col("content").isNotNull()
    exact = F.when(usable, F.nullif(F.greatest(
        F.when(from_line > 0, from_line).otherwise(F.instr("content", F.col("original"))), F.lit(0)), F.lit(0)))
    bound = F.floor(F.length("original") * NEAR).cast("int")
    found = joined.withColumn("_exact", exact).withColumn(
        "_near", F.when(usable & F.col("_exact").isNull(), near_window(lines, F.col("original"), bound)))
    start = F.coalesce(F.col("_exact") - 1, _before(lines, F.col("_near.line")))
    height = F.size(_lines(F.col("original")))
    length = F.when(F.col("_exact").isNotNull(), F.length("original")).otherwise(
        F.length(F.array_join(F.slice(lines, F.coalesce("_near.line", F.lit(1)), height), "\n")))
    how = F.when(F.col("_exact").isNotNull(), F.lit("exact")).when(F.col("_near").isNotNull(), F.lit("near"))
    return found.withColumns({
        "how": how,
        "distance": F.when(F.col("_exact").isNotNull(), F.lit(0)).otherwise(F.col("_near.distance")),
        "start": F.when(how.isNotNull(), start).cast("int"),
    }).withColumn("stop", F.when(F.col("how").isNotNull(), F.col("start") + length).cast("int")).drop("_exact", "_near", "content")


def _fitting(spans: Column) -> Column:
    """The items of the most spans (stop, start, item) that do not overlap."""
    none = F.struct(F.lit(-1).alias("stop"), F.array().cast("array<int>").alias("items"))
    return F.aggregate(
        F.sort_array(spans), none,
        lambda done, x: F.when(
            x["start"] >= done["stop"], F.struct(x["stop"].alias("stop"), F.array_append(done["items"], x["item"]).alias("items"))
        ).otherwise(done),
        lambda done: done["items"])


def choose_fixes(placed: DataFrame) -> DataFrame:
    """Adds ``state``: applied, conflict (its place is taken by another fix) or not found. A file has at most the fixes of
    a review, which are ten, so its spans fit one row."""
    spans = placed.filter(F.col("how").isNotNull()).groupBy("review_id", "file_ord").agg(
        F.collect_list(F.struct("stop", "start", "item")).alias("_spans"))
    chosen = spans.select("review_id", "file_ord", F.explode(_fitting(F.col("_spans"))).alias("item"), F.lit(True).alias("_fits"))
    state = F.when(F.col("how").isNull(), F.lit("not found")).when(F.col("_fits"), F.lit("applied")).otherwise(F.lit("conflict"))
    return placed.join(chosen, ["review_id", "file_ord", "item"], "left").withColumn("state", state).drop("_fits")


def spliced(content: Column, edits: Column) -> Column:
    """``struct(text, marks)``: the text with all ``edits`` (start, stop, item, fixed) made, and for each item its first and last line in it."""
    kind = "array<struct<item int, first_line int, last_line int>>"
    nothing = F.struct(F.lit(0).alias("pos"), F.lit("").alias("text"), F.array().cast(kind).alias("marks"))

    def put(done: Column, edit: Column) -> Column:
        upto = F.concat(done["text"], F.substring(content, done["pos"] + 1, edit["start"] - done["pos"]))
        first = F.size(_lines(upto))
        mark = F.struct(
            edit["item"].alias("item"), first.alias("first_line"), (first + F.size(_lines(edit["fixed"])) - 1).alias("last_line"))
        return F.struct(edit["stop"].alias("pos"), F.concat(upto, edit["fixed"]).alias("text"), F.array_append(done["marks"], mark).alias("marks"))

    return F.aggregate(
        F.sort_array(edits), nothing, put,
        lambda done: F.struct(
            F.concat(done["text"], F.substring(content, done["pos"] + 1, F.length(content))).alias("text"), done["marks"].alias("marks")))


def spliced_files(chosen: DataFrame, files: DataFrame) -> DataFrame:
    """The files that a fix changes, with their new ``content`` and the ``marks`` of the fixes in it."""
    edits = chosen.filter(F.col("state") == "applied").groupBy(*FILE).agg(
        F.collect_list(F.struct("start", "stop", "item", "fixed")).alias("edits"))
    texts = files.select(*FILE, "language", unix_lines(F.col("content")).alias("content"))
    return texts.join(edits, FILE).withColumn("_new", spliced(F.col("content"), F.col("edits"))).select(
        *FILE, "language", F.col("_new.text").alias("content"), F.col("_new.marks").alias("marks"))


def rescan_fixes(
    fixes: DataFrame, items: DataFrame, files: DataFrame, rules: list[Rule] | DataFrame | None = None
) -> DataFrame:
    """Every fix with what became of it: ``state``, ``how``, ``distance``, the changed lines, whether it ``cleared`` the weakness of its
    finding (no rule of the same family matches a changed line; null if not applied) and how many matches of other families
    its lines have (``n_other``)."""
    pack = RULE_PACK if rules is None else rules
    chosen = choose_fixes(place_fixes(fixes, items, files)).withColumn("family", family_of(F.col("category")))
    changed = spliced_files(chosen, files).withColumn("ruleset", ruleset_of(F.col("language")))
    marks = changed.select(*FILE, "ruleset", F.explode("marks").alias("m"), _lines(F.col("content")).alias("_lines"))
    own = F.slice("_lines", F.col("m.first_line"), F.col("m.last_line") - F.col("m.first_line") + 1)
    lines = marks.select(
        "review_id", "ruleset", F.col("m.item").alias("item"), F.col("m.first_line").alias("first_line"),
        F.col("m.last_line").alias("last_line"), own.alias("own"))
    rows = lines.select("review_id", "item", "ruleset", F.explode("own").alias("text"))
    if isinstance(pack, DataFrame):
        hits = table_hits(rows, pack)
    else:
        hits = rule_hits(rows, pack).join(F.broadcast(rule_meanings(rule_table(fixes.sparkSession, pack))), "rule_ord")
    hits = hits.select("review_id", "item", family_of(F.col("category")).alias("_hit"))
    per_fix = chosen.select("review_id", "item", "family").join(hits, ["review_id", "item"]).groupBy("review_id", "item").agg(
        F.count_if(F.col("_hit") == F.col("family")).alias("_same"), F.count_if(F.col("_hit") != F.col("family")).alias("_other"))
    applied = F.col("state") == "applied"
    return (
        chosen.join(lines.drop("own", "ruleset"), ["review_id", "item"], "left").join(per_fix, ["review_id", "item"], "left")
        .select(
            "review_id", "item", "file_ord", "filename", "category", "severity", "family", "state", "how", "distance", "first_line", "last_line",
            F.when(applied, F.coalesce("_same", F.lit(0)) == 0).alias("cleared"),
            F.when(applied, F.coalesce("_other", F.lit(0))).alias("n_other")))


def cleared_share(rescanned: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per review: fixes made, applied, in conflict and not found, and the share of the applied ones that cleared their finding (null if none was applied)."""
    state = F.col("state")
    counts = rescanned.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("n_fixes"), F.count_if(state == "applied").alias("n_applied"), F.count_if(state == "conflict").alias("n_conflict"),
        F.count_if(state == "not found").alias("n_not_found"), F.count_if("cleared").alias("n_cleared"))
    names = ["n_fixes", "n_applied", "n_conflict", "n_not_found", "n_cleared"]
    return reviews.join(counts, "review_id", "left").fillna(0, names).withColumn(
        "share", F.try_divide(F.col("n_cleared").cast("double"), F.col("n_applied")))
