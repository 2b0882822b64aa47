"""URL verdicts: rules first, then naive Bayes over the words of host and path.

Host names run words together, so each label of a host is split into words by a unigram model (Viterbi). The unigram
counts are the words of all pages' texts and paths. The classes of the Bayes model are learnt from the URLs that a
rule decides, and give a verdict to all others. Counts, candidates and models stay tables; nothing is broadcast by us.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffsieve.staging import stage

#: Fixed values: (verdict, host, path) of the rules.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest word that a host label is split into.
LONGEST = 20
#: Pseudo-count of a token and class.
SMOOTHING = 1.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null or a text without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        text = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, text).otherwise(chosen)
    return chosen


def words_in(text: Column) -> Column:
    """Runs of letters and of digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\p{N}+)"), 1)


def plain_text(page: Column) -> Column:
    """A page's text for counting: scripts, styles and tags taken out."""
    no_code = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(F.regexp_replace(no_code, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def unigrams(pages: DataFrame) -> DataFrame:
    """``word, n`` over all pages' texts and paths."""
    words = pages.select(F.explode(F.concat(words_in(plain_text(F.coalesce("__page", F.lit("")))), words_in("__path"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def best_split(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words of a label. An unknown stretch of k characters weighs as one chance in total * 10^k."""
    log_total = math.log(total + 1)
    best = [0.0] + [-math.inf] * len(label)
    back = [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for begin in range(max(0, end - LONGEST), end):
            n = counts.get(label[begin:end], 0)
            score = best[begin] + (math.log(n) - log_total if n else -log_total - (end - begin) * math.log(10))
            if score > best[end]:
                best[end], back[end] = score, begin
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def split_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """``label, words`` for every distinct label: its substrings meet the counts by a join, then Viterbi runs on them."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    begins = F.sequence(F.lit(1), F.length("label"))
    ends = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("label") - F.col("begin") + 1))
    parts = (
        labels.where("label <> ''")
        .select("label", F.explode(begins).alias("begin"))
        .select("label", F.explode(F.transform(ends, lambda k: F.substr("label", F.col("begin"), k))).alias("word"))
        .distinct()
    )
    known = parts.join(counts, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
    # the total is one row, so this is no product of tables
    whole = labels.where("label <> ''").join(known, "label", "left").join(F.broadcast(total), F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("label").to_pylist(), batch.column("counts").to_pylist(), batch.column("total").to_pylist(), strict=True)
            words = [best_split(label, dict(known or ()), total) for label, known, total in rows]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(words, pa.list_(pa.string()))], names=["label", "words"])

    return whole.mapInArrow(run, "label string, words array<string>")


def url_verdicts(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict, words`` for every row of ``pages``.

    The verdict is the longest fitting rule's, else that of the Bayes model: block if block is the more probable
    class, allow otherwise (ties and models without a class too). A null URL and one without ``://`` has an empty host and
    path and gets the more frequent class. Repeated rows are judged and counted each; a null id stays null.
    """
    host, path = url_parts(F.col("__url"))
    base = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("__url"),
        F.col(f"`{page}`").cast("string").alias("__page"),
    ).withColumns({"host": host, "__path": path})
    counts = stage(unigrams(base))
    sites = base.groupBy("host", F.col("__path").alias("path")).agg(F.count("*").alias("copies"))
    sites = stage(sites.withColumn("__rule", rule_of(F.col("host"), F.col("path"))))

    cut = sites.select("host", F.explode(F.split("host", r"[^\p{L}\p{N}]+")).alias("label")).where("label <> ''").distinct()
    of_label = split_labels(cut.select("label").distinct(), counts)
    of_host = stage(cut.join(of_label, "label").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("host_words")))
    spelt = stage(
        sites.join(of_host, "host", "left").withColumn(
            "words",
            F.concat(
                F.transform(F.coalesce("host_words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
                F.transform(words_in(F.col("path")), lambda w: F.concat(F.lit("p:"), w)),
            ),
        ).drop("host_words")
    )

    taught = spelt.where("__rule IS NOT NULL").withColumn("blocks", (F.col("__rule.verdict") == "block").cast("long") * F.col("copies"))
    priors = taught.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocked"))
    tokens = taught.select(F.explode("words").alias("word"), "copies", "blocks").groupBy("word").agg(
        F.sum("copies").alias("n"), F.sum("blocks").alias("blocked"))
    sums = tokens.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked_tokens"), F.count("*").alias("vocabulary"))
    smooth = F.lit(SMOOTHING)
    weight = (
        F.log((F.col("blocked") + smooth) / (F.col("blocked_tokens") + smooth * (F.col("vocabulary") + 1)))
        - F.log((F.col("n") - F.col("blocked") + smooth) / (F.col("tokens") - F.col("blocked_tokens") + smooth * (F.col("vocabulary") + 1)))
    )
    # sums and priors are one row each
    weights = tokens.join(F.broadcast(sums), F.lit(True)).select("word", weight.alias("weight"))
    open_sites = spelt.where("__rule IS NULL")
    scored = (
        open_sites.select("host", "path", F.explode("words").alias("word"))
        .groupBy("host", "path", "word").agg(F.count("*").alias("times"))
        .join(weights, "word")
        .groupBy("host", "path").agg(F.sum(F.col("weight") * F.col("times")).alias("score"))
    )
    prior = F.log((F.col("blocked") + smooth) / (F.col("n") - F.col("blocked") + smooth))
    judged = (
        spelt.join(scored, ["host", "path"], "left")
        .join(F.broadcast(priors.select(prior.alias("prior"), F.col("blocked").alias("any_blocked"))), F.lit(True))
        .select(
            "host", "path", F.col("__rule.rule").alias("rule"), "words",
            F.coalesce(
                "__rule.verdict",
                F.when((F.col("any_blocked") > 0) & (F.coalesce("score", F.lit(0.0)) + F.col("prior") > 0), "block").otherwise("allow"),
            ).alias("verdict"),
        )
    )
    return base.select("page_id", "host", F.col("__path").alias("path")).join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule", "verdict", "words")
