"""Required texts of patterns, and large rule tables against trying every rule on every line."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from diffsieve.operators import edges, literals, scan
from diffsieve.operators.rules import RULE_PACK, RULE_SCHEMA, TEXT_PACK, rule_table

LINES = "review_id bigint, file_ord int, filename string, ruleset string, text string, line int"


@pytest.mark.parametrize(("pattern", "texts"), [
    (r"\bexec[ \t]*\(", ["exec"]),
    (r"(?i)\b(Password|token)[ \t]*=", ["password", "token"]),
    (r"a(bc)?defg+", ["def"]),
    (r"(foo|ba)rr", []),                      # a branch is too short, and so is the rest
    (r"(foo|bar)+?x{2,}yyyy", ["yyyy"]),
    (r"(?:abc)def\bghi", ["abcdefghi"]),
    (r"[abc]{3}", []), (r"x*", []), (r"", []), (r"(", []), (r"\p{L}+secret", []), (r"(?x) a b c d", []),
    (r"(?!never)maybe", ["maybe"]), (r"abc|", []), (r"ünder_line", ["nder_line"]), (r"(abcd)\1", ["abcd"]),
])
def test_required_texts(pattern, texts):
    assert literals.required_texts(pattern) == texts


def test_matches_hold_a_required_text():
    rng = random.Random(3)
    parts = ["foo", "BAR", "b", "[xy]", "(?:one|two|three)", "(q|rs)?", r"\d+", "zz{1,2}", r"\b", "(alpha(beta|gamma))", ".*"]
    texts = ["".join(rng.choices("fooBARbxyqrs123zz onetwothreealphabetagamma", k=25)) for _ in range(300)]
    for _ in range(400):
        pattern = "".join(rng.choices(parts, k=rng.randrange(1, 5)))
        needed = literals.required_texts(pattern)
        made = "".join(rng.choice(["foo", "BAR", "b", "x", "two", "rs", "7", "zz", "alphagamma", " "]) for _ in range(8))
        for text in [*texts, made]:
            if needed and re.search(pattern, text, re.IGNORECASE):
                assert any(n in text.lower() for n in needed), (pattern, text)


def test_known_packs_mostly_name_a_text():
    named = [bool(literals.required_texts(r.pattern)) for r in RULE_PACK + TEXT_PACK]
    assert sum(named) >= len(named) - 4


def rules_of(n, rng):
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    shapes = [r"\b{}\b", r"(?i){}[0-9]", r"({}|{}x)=", r"{}.*end", "[abc]{{4}}[0-9]{{3}}"]
    return [(i + 1, f"R{i}", "p/a" if i % 7 else "p/b", 1, "HIGH", f"n{i}", (shapes[i % 4] if i % 997 else shapes[4]).format(w, w), "m", None)
            for i, w in enumerate(words)]


def lines_of(n, rules, rng):
    pool = [r[6].strip("\\b").replace("(?i)", "").split("[")[0].split("|")[0].split(".")[0].strip("(") for r in rules]
    text = lambda: " ".join(rng.choice([rng.choice(pool), rng.choice(pool) + "7", rng.choice(pool).upper() + "1", "end", "=", "abca123", "éİ"]) for _ in range(6))
    return [(1, 0, "f", "p/a" if i % 3 else "p/b", text() if i % 50 else (None, "")[i % 100 == 0], i) for i in range(n)]


def test_a_large_table_equals_brute_force(spark):
    rng = random.Random(6)
    rules = rules_of(5000, rng)
    lines = lines_of(400, rules, rng)
    want = sorted(
        (line[5], r[0]) for r in rules for line in lines if line[4] is not None and line[3] == r[2] and re.search(r[6], line[4], re.ASCII))
    table = spark.createDataFrame(rules, RULE_SCHEMA)
    start = time.time()
    got = scan.table_hits(spark.createDataFrame(lines, LINES), table)
    assert sorted((r.line, r.rule_ord) for r in got.select("line", "rule_ord").collect()) == want
    assert time.time() - start < 60
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one pass for all rules that name a text


def test_empty_tables_and_lines(spark):
    lines = spark.createDataFrame(lines_of(5, rules_of(9, random.Random(1)), random.Random(1)), LINES)
    assert scan.table_hits(lines, rule_table(spark, RULE_PACK).limit(0)).collect() == []
    assert scan.table_hits(lines.limit(0), rule_table(spark, RULE_PACK)).collect() == []


def test_no_line_is_moved_for_a_candidate(spark):
    """Rules too large for Spark's own broadcast threshold: a line stays where it is, however many rules it may match."""
    rng = random.Random(7)
    rules = rules_of(300, rng)
    lines, table = spark.createDataFrame(lines_of(60, rules, rng), LINES), spark.createDataFrame(rules, RULE_SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = scan.table_hits(lines, table)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


EDGED = [
    (r"(?i)(^|[^a-z])wOrd([^a-z]|$)", "(?i)\n(^|[^a-z])\n([^a-z]|$)", "word"), (r"^abc", "\n^\n", "abc"), (r"abc", "\n\n", "abc"),
    (r"[ \t,]a\.b\(\)[\w.]", "\n[ \\t,]\n[\\w.]", "a.b()"), (r"\Dkey=\S", "\n\\D\n\\S", "key="), (r"(?:^|\s)TO-DO(?:$)", "\n(?:^|\\s)\n(?:$)", "TO-DO"),
    (r"ab", None, None), (r"\babc\b", None, None), (r"abcd?", None, None), (r"[z-a]abc", None, None), (r"[[a]b]abc", None, None), (r"[a&&b]abc", None, None),
    (r"abc{2}", None, None), (r"(?m)^abc", None, None), (r"abc[ ]*", None, None), (r"äbc", None, None), (r"abc|def", None, None), (r"a.c.d", None, None),
]


@pytest.mark.parametrize(("pattern", "shape", "text"), EDGED)
def test_plain_texts_between_edges_are_told_apart(pattern, shape, text):
    assert (edges.shape_of(pattern) or (None, None)) == (shape, text)


def test_a_table_beyond_the_driver_equals_its_patterns(spark, monkeypatch):
    """More rules than the driver takes at once, of all kinds, in several pieces and passes: matches are those of the patterns themselves."""
    monkeypatch.setattr(scan, "RULES_AT_ONCE", 150)
    monkeypatch.setattr(edges, "LEAST_ALIKE", 20)
    monkeypatch.setattr(edges, "PASS_RULES", 120)
    monkeypatch.setattr(edges, "SENT_RULES", 50)
    monkeypatch.setattr(edges, "SLICE", 300)
    rng = random.Random(9)
    words = ["".join(rng.choices("abK", k=rng.randrange(3, 6))) for _ in range(60)] + ["a.b", "K-a", "ab ab"]
    shapes = [r"(?i)(^|[^a-z]){}([^a-z]|$)", r"^{}", r"{}$", r"(?i){}", r"[^b\d]{}[\s.]", r"\S{}(?:$|\W)", r"(?:^|[a-c ]){}", r"\b{}\b", "{}.*end", "[aK]{{4}}[0-9]{{3}}"]
    rules = [(i + 1, f"R{i}", ("p/a", "p/b", None)[min(i % 9, 2) if i % 9 > 6 else i % 2], 1, "HIGH", f"n{i}",
              shapes[i % 10 if i % 10 < 9 or i < 30 else 0].format(re.sub(r"([.])", r"\\\1", rng.choice(words))), f"m{i}", None) for i in range(700)]
    pieces = [*words, *(w.upper() for w in words), "end", " ", ".", "7", "é", "\u212a", "\u2028", "\x85", "\r", "\n", "\r\n", "😀", "_"]
    lines = [(1, 0, "f", ("p/a", "p/b", None)[i % 5 // 2], "".join(rng.choices(pieces, k=rng.randrange(0, 9))) if i % 40 else (None, "")[i % 80 == 0], i) for i in range(500)]
    table, frame = spark.createDataFrame(rules, RULE_SCHEMA), spark.createDataFrame(lines, LINES).repartition(3)
    by_ruleset = frame.join(F.broadcast(table.select("rule_ord", "pattern", F.col("ruleset").alias("of"))), F.expr("ruleset = of AND text rlike pattern"))
    want = sorted((r.line, r.rule_ord) for r in by_ruleset.select("line", "rule_ord").collect())
    hits = scan.table_hits(frame, table)
    got = sorted((r.line, r.rule_ord, r.description) for r in hits.select("line", "rule_ord", "description").collect())
    assert [g[:2] for g in got] == want and len(want) > 3000
    assert all(d == f"m{n - 1}" for _, n, d in got)
    assert {n % 10 for _, n in want} == {*range(10)}  # rules of every kind match somewhere
    small = scan.table_hits(frame, table.where("rule_ord <= 100"))
    assert small.columns == hits.columns


def test_a_large_table_leaves_its_meanings_out_of_the_driver(spark, monkeypatch):
    """Nothing that grows with the table is broadcast, and meanings that nobody reads are not joined."""
    monkeypatch.setattr(scan, "RULES_AT_ONCE", 100)
    monkeypatch.setattr(edges, "LEAST_ALIKE", 100)
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:04d}")
    rules = [(i, f"R{i}", "p/a", 1, "HIGH", f"n{i}", f"(?i)(^|[^a-z]){word(i)}([^a-z]|$)", "m", None) for i in range(400)]
    lines = spark.createDataFrame([(1, 0, "f", "p/a", f"{word(i)} {word(i + 1)}", i) for i in range(50)], LINES)
    counts = scan.table_hits(lines, spark.createDataFrame(rules, RULE_SCHEMA)).groupBy("rule_ord").agg(F.count(F.lit(1)).alias("n"))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "broadcast" not in plan.lower()
    assert {r.rule_ord: r.n for r in counts.collect()} == {i: 1 + (0 < i < 50) for i in range(51)}
