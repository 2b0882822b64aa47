"""Parts of the SQL that the queries are compared with.

These are the shared parts (common table expressions); `oracles` holds one statement per query.

The SQL takes other routes than the Spark plans wherever there is a choice: rules are joined instead of compiled
in, unit ends and nesting come from comparing lines with each other, shared file names are written out row by row,
and positions are plain row numbers over whole groups.
"""

from __future__ import annotations

import keyword
import re
import token

from .. import fixed_values as fv
from ..functions.masking import PIECES
from ..operators.rules import RULE_PACK, TEXT_PACK, Rule
from ..sources import corpus as c

# Definitions of the metrics, set down from Python's own grammar tables and the published rules, not from the engine.
_HEAD = (
    r"^[ \t]*((?:async[ \t]+)?(?:" + "|".join(("def", "for", "with")) + ")|"
    + "|".join(("class", "if", "elif", "else", "while", "try", "except", "finally")) + r")\b")
_CASE = r"^[ \t]*(case|match)\b[^=]*:[ \t]*$"
# A branch, a loop, a handler, a further condition, an assertion, and a function inside add one path each.
_DECISIONS = r"\b(?:" + "|".join(sorted(("if", "elif", "for", "while", "except", "and", "or", "assert", "def"), reverse=True)) + r")\b"
_NO_OPERATORS = {"(", ")", "[", "]", "{", "}", ",", ":", ".", ";", "=", "->", "...", ":=", "!"}
_SIGNS = sorted(set(token.EXACT_TOKEN_TYPES) - _NO_OPERATORS, key=lambda x: (-len(x), x))
_OPERATOR = "|".join(map(re.escape, _SIGNS)) + r"|\b(?:" + "|".join(("not", "and", "or", "in", "is")) + r")\b"
_OPERAND = r"\b[A-Za-z_][A-Za-z0-9_]*|\b[0-9][A-Za-z0-9_.]*"
_KEYWORDS = [k for k in keyword.kwlist if k not in ("None", "True", "False")]

PARTS: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def lit(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows) + ")"


def case(column: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def oracle(name: str, sql: str) -> None:
    """Registers SQL, with the parts it needs in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for other in PARTS:
            if other not in needed and re.search(rf"\b(FROM|JOIN)\s+{other}\b", text):
                visit(PARTS[other])
                needed.append(other)

    visit(sql)
    head = ", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in needed)
    ORACLES[name] = f"WITH {head} {sql}" if needed else sql


def title(column: str) -> str:
    runs = f"regexp_extract_all(translate({column}, '_-', '  '), '\\p{{L}}+|[^\\p{{L}}]+')"
    return f"array_to_string(list_transform({runs}, lambda x: upper(x[1]) || lower(x[2:])), '')"


def stripped(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def short_id(*parts: str) -> str:
    return "substr(sha256(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 8)"


# ---- changed files ------------------------------------------------------------------------------------------------

part("tpl", "SELECT * FROM " + values(
    (i, end, body + c.OPEN[how], c.CLOSE[how]) for i, (end, how, body) in enumerate(c.TEMPLATES)
) + " v(template, ending, head, tail)")
part("named", f"""
    SELECT d.*, d.doc_id // 20 AS review_id, t.*,
           'pkg' || (d.doc_id // 20) || '/m' || (CASE WHEN d.doc_id % 40 = 37 THEN d.doc_id - 16 ELSE d.doc_id END)
           || t.ending AS filename
    FROM documents d JOIN tpl t ON d.doc_id % {c.N_TEMPLATES} = t.template""")
part("pr_files", """
    SELECT review_id, CAST(doc_id % 20 AS INT) AS file_ord, filename,
           CASE WHEN doc_id % 31 = 7 THEN 'cobol' WHEN doc_id % 3 = 0 THEN 'python' END AS language,
           replace(head, '@N@', CAST(doc_id AS VARCHAR)) || replace(text, '\"\"\"', '\"') || tail AS content,
           CASE WHEN doc_id % 4 <> 0 THEN '@@ m' || doc_id END AS patch,
           CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 90 AS INT) END AS additions,
           CAST(NULL AS INT) AS deletions
    FROM named
    UNION ALL
    SELECT review_id, CAST(20 + doc_id % 20 AS INT), 'pkg' || review_id || '/x' || doc_id || '.py', 'python',
           CASE WHEN doc_id % 37 <> 5 THEN '' END, NULL, NULL, NULL
    FROM named WHERE doc_id % 37 = 5 OR doc_id % 16 = 12""")


def language_of(column: str) -> str:
    ignored = " OR ".join(f"ends_with({column}, {lit(s)})" for s in fv.IGNORED_SUFFIXES)
    ending = f"lower(regexp_extract({column}, '\\.([^.]*)$', 1))"
    return f"CASE WHEN {ignored} THEN 'unknown' ELSE {case(ending, fv.EXTENSION_LANGUAGE, lit('unknown'))} END"


LANGS = ", ".join(lit(x) for x in fv.LANGUAGES)
part("well_formed", f"""
    SELECT * FROM pr_files WHERE filename IS NOT NULL AND content IS NOT NULL
    AND coalesce(language, 'unknown') IN ({LANGS})""")
part("parsed", f"""
    SELECT review_id, file_ord, filename, detected AS language, content, coalesce(patch, '') AS patch,
           coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions,
           detected = 'python' AND content <> '' AS ast_available
    FROM (SELECT *, {language_of("filename")} AS detected FROM well_formed) WHERE detected <> 'unknown'""")
for stage, cases in (("security", c.SECURITY_ANSWERS), ("quality", c.QUALITY_ANSWERS), ("test", c.TEST_ANSWERS), ("fix", c.FIX_ANSWERS)):
    item = "CAST(doc_id % 20 + 1 AS INT) AS item" if stage == "fix" else "filename"
    only = "doc_id % 20 < 10" if stage == "fix" else "doc_id % 40 <> 37"
    part(f"{stage}_answers", f"""
        SELECT review_id, {item}, replace(replace(
            {case(f"doc_id % {len(cases)}", dict(enumerate(cases)))}, '@N@', CAST(doc_id AS VARCHAR)), '@F@', filename) AS answer
        FROM named WHERE {only}""")


def unfenced(column: str) -> str:
    text = stripped(column)
    body = f"CASE WHEN contains({text}, chr(10)) THEN substr({text}, instr({text}, chr(10)) + 1) END"
    return f"""CASE WHEN starts_with({text}, '```') THEN
        CASE WHEN contains({body}, '```') THEN regexp_extract({body}, '(?s)^(.*)```', 1) ELSE {body} END ELSE {text} END"""


for stage in ("security", "quality", "test", "fix"):
    part(f"{stage}_json", f"""
        SELECT * EXCLUDE (answer, raw), CASE WHEN json_valid(raw) THEN raw END AS js
        FROM (SELECT *, {unfenced("answer")} AS raw FROM {stage}_answers)""")

# ---- rule hits ------------------------------------------------------------------------------------------------------


def pack_part(name: str, pack: list[Rule]) -> None:
    part(name, f"SELECT * FROM {values((i, *r[:7]) for i, r in enumerate(pack, 1))} "
               "v(rule_ord, rule_id, ruleset, layer, raw_severity, name, pattern, message)")


pack_part("pack", RULE_PACK)
pack_part("text_pack", TEXT_PACK)
part("rule_lines", f"""
    SELECT review_id, file_ord, filename, {case("language", fv.RULESET_OF_LANGUAGE)} AS ruleset,
           CAST(line AS INT) AS line, lines[line] AS text
    FROM (SELECT *, string_split(content, chr(10)) AS lines FROM parsed WHERE content <> ''), unnest(range(1, len(lines) + 1)) u(line)""")


def meaning(rule_ord: str = "r.rule_ord") -> str:
    return f"""
        r.layer, line AS seq, {rule_ord} AS sub, filename, line,
        CASE WHEN r.layer = 1 THEN {case("upper(r.raw_severity)", fv.RULE_SCANNER_SEVERITY, "'low'")}
             ELSE {case("upper(r.raw_severity)", fv.PATTERN_SCANNER_SEVERITY, "'medium'")} END AS severity,
        {title("regexp_extract(r.name, '[^.]*$')")} AS category,
        CASE WHEN r.layer = 1 THEN {case("r.rule_id", fv.CWE_OF_RULE)} END AS cwe_id,
        CASE WHEN r.layer = 1 THEN {case("r.rule_id", fv.OWASP_OF_RULE)} END AS owasp,
        r.message AS description, CASE WHEN r.layer = 1 THEN 'bandit' ELSE 'semgrep' END AS source,
        {stripped("text")} AS code_snippet"""


FINDING_ID = short_id("review_id", "filename", "line", "source", "category", "file_ord", "layer", "seq", "sub")
part("rule_rows", f"""
    SELECT review_id, file_ord, {meaning()}
    FROM rule_lines JOIN pack r USING (ruleset) WHERE regexp_matches(text, r.pattern)""")
part("text_lines", """
    SELECT doc_id // 20 AS review_id, CAST(doc_id % 20 AS INT) AS file_ord, 'doc' || doc_id AS filename, doc_id,
           CAST(line AS INT) AS line, lines[line] AS text
    FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''), unnest(range(1, len(lines) + 1)) u(line)""")
part("text_hits", f"""
    SELECT review_id, file_ord, doc_id, r.rule_id, r.rule_ord, {meaning()}
    FROM text_lines JOIN text_pack r ON regexp_matches(text, r.pattern)""")

# ---- lines, blocks, units ---------------------------------------------------------------------------------------------

_mask = """array_to_string(list_transform(regexp_extract_all(regexp_replace(content, '\\\\[^\\n]', '__', 'g'), {pieces}),
    lambda p: CASE WHEN starts_with(p, '\"\"\"') OR starts_with(p, '''''''')
                   THEN replace(regexp_replace(p, '[^\\n]+', '', 'g'), chr(10), chr(10) || chr(1))
                   WHEN p[1] IN ('\"', '''', '#') THEN '' ELSE p END), '')""".format(pieces=lit(PIECES))
part("code0", f"""
    SELECT review_id, file_ord, filename, CAST(line AS INT) AS line, t[line] AS text,
           replace(m[line], chr(1), '') AS code, starts_with(m[line], chr(1)) AS inside
    FROM (SELECT review_id, file_ord, filename, string_split(content, chr(10)) AS t, string_split({_mask}, chr(10)) AS m
          FROM parsed WHERE language = 'python' AND content <> ''), unnest(range(1, len(t) + 1)) u(line)""")
part("code1", """
    SELECT *, NOT regexp_matches(text, '\\S') AS blank, regexp_matches(text, '^[ \\t]*#') AND NOT inside AS comment,
           CAST(length(regexp_extract(text, '^[ \\t]*')) AS INT) AS indent,
           length(regexp_replace(code, '[^(\\[{]', '', 'g')) - length(regexp_replace(code, '[^)\\]}]', '', 'g')) AS delta
    FROM code0""")
part("code2", """
    SELECT *, coalesce(sum(delta) OVER w, 0) > 0
           OR coalesce(regexp_matches(lag(code) OVER (PARTITION BY review_id, file_ord ORDER BY line), '\\\\[ \\t]*$'), false) AS continued
    FROM code1 WINDOW w AS (PARTITION BY review_id, file_ord ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
part("code", f"""
    SELECT *, blank OR comment OR inside OR continued AS skip,
           CASE WHEN blank OR comment OR inside OR continued THEN NULL
                WHEN regexp_matches(code, {lit(_HEAD)}) THEN regexp_replace(regexp_extract(code, {lit(_HEAD)}, 1), '[ \\t]+', ' ', 'g')
                WHEN regexp_matches(code, {lit(_CASE)}) THEN regexp_extract(code, {lit(_CASE)}, 1) END AS word
    FROM code2""")
CONTINUES = "('elif', 'else', 'except', 'finally')"
# Where the chain of a block head stops, and where its indentation ends.
part("heads", f"""
    SELECT h.review_id, h.file_ord, h.line, h.indent, h.word,
           coalesce(min(x.line) FILTER (x.indent < h.indent OR (x.indent = h.indent AND coalesce(x.word, '') NOT IN {CONTINUES})), 1000000000) AS stop
    FROM code h LEFT JOIN code x ON x.review_id = h.review_id AND x.file_ord = h.file_ord AND x.line > h.line
         AND NOT x.skip AND x.indent <= h.indent
    WHERE h.word IS NOT NULL AND h.word NOT IN {CONTINUES}
    GROUP BY ALL""")
# Every opener with every head around it: elifs passed so far and the last continuation before it.
part("around", """
    SELECT x.review_id, x.file_ord, x.line, x.indent, x.word, h.line AS head_line, h.indent AS head_indent, h.word AS head_word,
           count(e.line) FILTER (e.word = 'elif') AS elifs, max_by(e.word, e.line) AS last_word
    FROM code x JOIN heads h ON h.review_id = x.review_id AND h.file_ord = x.file_ord AND h.line < x.line AND x.line < h.stop
         AND (x.indent > h.indent OR (x.indent = h.indent AND x.word IN ('elif', 'else')))
    LEFT JOIN code e ON e.review_id = x.review_id AND e.file_ord = x.file_ord AND e.line > h.line AND e.line <= x.line
         AND e.indent = h.indent AND NOT e.skip AND e.word IN ('elif', 'else', 'except', 'finally')
    WHERE x.word IS NOT NULL GROUP BY ALL""")
part("depths", """
    SELECT review_id, file_ord, line,
           sum(CASE WHEN indent = head_indent THEN 0 WHEN head_word = 'if' THEN 1 + elifs
                    WHEN last_word = 'except' THEN 2 ELSE 1 END) AS tree_depth,
           count(*) FILTER (indent > head_indent AND head_word IN ('def', 'async def')) AS defs_above
    FROM around GROUP BY ALL""")
part("spans", """
    SELECT d.review_id, d.file_ord, d.filename, d.line AS start_line, d.indent, d.word,
           coalesce(min(x.line), 1000000000) AS stop
    FROM code d LEFT JOIN code x ON x.review_id = d.review_id AND x.file_ord = d.file_ord AND x.line > d.line
         AND NOT x.skip AND x.indent <= d.indent
    WHERE d.word IN ('def', 'async def', 'class') GROUP BY ALL""")
part("bodies", """
    SELECT s.review_id, s.file_ord, s.filename, s.start_line, s.indent, s.word, s.stop,
           max(l.line) FILTER (NOT l.blank AND NOT l.comment) AS end_line,
           coalesce(min(l.line) FILTER (l.line > s.start_line AND NOT l.continued), max(l.line) + 1) AS body_line,
           string_agg(l.code, ' ' ORDER BY l.line) AS all_code
    FROM spans s JOIN code l ON l.review_id = s.review_id AND l.file_ord = s.file_ord
         AND l.line >= s.start_line AND l.line < s.stop
    GROUP BY ALL""")
part("texts", """
    SELECT b.review_id, b.file_ord, b.start_line,
           string_agg(l.text, chr(10) ORDER BY l.line) FILTER (l.line <= b.end_line) AS source,
           string_agg(l.code, ' ' ORDER BY l.line) FILTER (l.line < b.body_line) AS signature,
           max_by(l.code, l.line) FILTER (l.line < b.body_line) AS last_code,
           max_by(l.text, l.line) FILTER (l.line < b.body_line) AS last_text,
           min_by(l.code, l.line) FILTER (l.line >= b.body_line AND NOT l.blank AND NOT l.comment) AS first_code,
           min_by(l.text, l.line) FILTER (l.line >= b.body_line AND NOT l.blank AND NOT l.comment) AS first_text
    FROM bodies b JOIN code l ON l.review_id = b.review_id AND l.file_ord = b.file_ord
         AND l.line >= b.start_line AND l.line < b.stop GROUP BY ALL""")
part("nestings", """
    SELECT s.review_id, s.file_ord, s.start_line, a.line,
           CAST(sum(CASE WHEN a.head_line > s.start_line AND a.head_word IN ('if', 'for', 'while', 'with', 'try') AND a.word <> 'else'
                    THEN 1 + a.elifs ELSE 0 END) + CASE WHEN any_value(a.word) = 'elif' THEN 0 ELSE 1 END AS INT) AS depth
    FROM spans s JOIN (
        SELECT review_id, file_ord, line, word, indent, head_line, head_word, elifs FROM around
        UNION ALL SELECT review_id, file_ord, line, word, indent, 0, 'none', 0 FROM code WHERE word IS NOT NULL
    ) a ON a.review_id = s.review_id AND a.file_ord = s.file_ord AND a.line > s.start_line AND a.line < s.stop
    WHERE a.word IN ('if', 'elif', 'for', 'while', 'with', 'try') GROUP BY ALL""")
part("deepest", """
    SELECT review_id, file_ord, start_line, max(depth) AS nesting_depth, min_by(line, (-depth, line)) AS nesting_line
    FROM nestings GROUP BY ALL""")
part("loop_elses", """
    SELECT s.review_id, s.file_ord, s.start_line, count(*) AS n
    FROM spans s JOIN around a ON a.review_id = s.review_id AND a.file_ord = s.file_ord AND a.line > s.start_line AND a.line < s.stop
    WHERE a.word = 'else' AND a.indent = a.head_indent AND a.head_word IN ('for', 'while', 'try', 'async for') GROUP BY ALL""")
part("methods", """
    SELECT s.review_id, s.file_ord, s.start_line, count(*) AS n
    FROM spans s JOIN spans m ON m.review_id = s.review_id AND m.file_ord = s.file_ord AND m.start_line > s.start_line
         AND m.start_line < s.stop AND m.word IN ('def', 'async def')
    WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.review_id = s.review_id AND o.file_ord = s.file_ord
                      AND o.start_line > s.start_line AND o.start_line < m.start_line AND m.start_line < o.stop
                      AND o.word IN ('def', 'async def')) GROUP BY ALL""")
_inner = "regexp_extract(signature, '^[^(]*\\((.*)$', 1)"
for _ in range(6):
    _inner = f"regexp_replace({_inner}, '\\([^()\\[\\]{{}}]*\\)|\\[[^()\\[\\]{{}}]*\\]|\\{{[^()\\[\\]{{}}]*\\}}', '', 'g')"
_inner = f"regexp_replace(regexp_extract({_inner}, '^[^)]*'), 'lambda[^:]*:', '', 'g')"
part("blocks", f"""
    SELECT b.review_id, b.file_ord, b.filename, CASE WHEN b.word = 'class' THEN 'class' ELSE 'def' END AS kind,
           regexp_extract(t.signature, '(?:def|class)[ \\t]+(\\w+)', 1) AS name, b.start_line, b.end_line, t.source,
           coalesce(d.tree_depth, 0) AS tree_depth, coalesce(d.defs_above, 0) AS defs_above,
           CAST(len(list_filter(string_split({_inner}, ','), lambda p: trim(p) NOT IN ('', '*', '/'))) AS INT) AS params,
           coalesce(regexp_matches(t.first_text, '^[ \\t]*[rRuU]?["'']') AND trim(t.first_code) IN ('', 'r', 'R', 'u', 'U'), false)
           OR coalesce(regexp_matches(t.last_code, ':[ \\t]*$') AND regexp_matches(t.last_text, '["''][ \\t]*$'), false) AS has_docstring,
           coalesce(n.nesting_depth, 0) AS nesting_depth, coalesce(n.nesting_line, 0) AS nesting_line,
           len(regexp_extract_all(b.all_code, {lit(_DECISIONS)})) + coalesce(e.n, 0) AS decisions, coalesce(m.n, 0) AS methods
    FROM bodies b JOIN texts t USING (review_id, file_ord, start_line)
    LEFT JOIN deepest n USING (review_id, file_ord, start_line)
    LEFT JOIN loop_elses e USING (review_id, file_ord, start_line)
    LEFT JOIN methods m USING (review_id, file_ord, start_line)
    LEFT JOIN depths d ON d.review_id = b.review_id AND d.file_ord = b.file_ord AND d.line = b.start_line""")
part("units", """
    SELECT *, CAST(row_number() OVER (PARTITION BY review_id, file_ord ORDER BY tree_depth, start_line) AS INT) AS unit_ord
    FROM blocks WHERE kind = 'def'""")
part("complexities", """
    SELECT *, CASE WHEN kind = 'class' AND methods > 0 THEN (decisions + 1) // methods + CASE WHEN methods > 1 THEN 1 ELSE 0 END
                   WHEN kind = 'class' THEN decisions + 1 ELSE decisions END AS complexity
    FROM blocks WHERE defs_above = 0""")
_keywords = ", ".join(lit(k) for k in _KEYWORDS)
part("tokens", f"""
    SELECT review_id, file_ord, filename,
           flatten(list(regexp_extract_all(code, {lit(_OPERATOR)}))) AS ops,
           list_filter(flatten(list(regexp_extract_all(code, {lit(_OPERAND)}))), lambda x: x NOT IN ({_keywords})) AS names,
           CAST(sum(len(regexp_extract_all(code, {lit(_DECISIONS)}))) + 1 AS BIGINT) AS complexity,
           count(*) FILTER (NOT skip) AS statements, count(*) FILTER (NOT blank AND NOT comment) AS sloc,
           count(*) FILTER (comment OR inside) AS comments
    FROM code GROUP BY ALL""")
part("indexes", """
    SELECT *, CASE WHEN volume <= 0 OR statements <= 0 THEN 100.0 ELSE least(greatest((171 - 5.2 * ln(volume) - 0.23 * complexity
           - 16.2 * ln(statements) + 50 * sin(sqrt(2.4 * radians(least(comments / sloc, 1.0) * 100)))) * 100 / 171, 0.0), 100.0) END AS mi
    FROM (SELECT *, CASE WHEN len(ops) + len(names) = 0 THEN 0 ELSE
                 (len(ops) + len(names)) * log2(len(list_distinct(ops)) + len(list_distinct(names))) END AS volume FROM tokens)""")

# ---- quality --------------------------------------------------------------------------------------------------------


def fmt(text: str, *args: str) -> str:
    return f"printf({lit(text)}, " + ", ".join(args) + ")"


part("quality_static", f"""
    SELECT review_id, file_ord, filename, 1 AS "check", start_line AS seq, 1 AS sub, start_line AS line,
           CASE WHEN complexity >= 15 THEN 'high' ELSE 'medium' END AS severity, 'High Complexity' AS category,
           {fmt(fv.COMPLEXITY_TEXT, "name", "CAST(complexity AS INT)", "CASE WHEN complexity >= 15 THEN 'very high' ELSE 'high' END")} AS description,
           'cyclomatic_complexity=' || complexity AS metric FROM complexities WHERE complexity >= 10
    UNION ALL
    SELECT review_id, file_ord, filename, 2, 1, 1, 1, CASE WHEN mi <= 10 THEN 'high' ELSE 'medium' END, 'Low Maintainability',
           {fmt(fv.MAINTAINABILITY_TEXT, "printf('%.1f', mi)", "CASE WHEN mi <= 10 THEN 'very low' ELSE 'low' END")},
           'maintainability_index=' || printf('%.1f', mi) FROM indexes WHERE mi <= 20
    UNION ALL
    SELECT review_id, file_ord, filename, 3, unit_ord, 1, start_line, 'medium', 'Long Function',
           {fmt(fv.LENGTH_TEXT, "name", "end_line - start_line + 1")}, 'lines=' || (end_line - start_line + 1)
    FROM units WHERE end_line - start_line + 1 > 50
    UNION ALL
    SELECT review_id, file_ord, filename, 3, unit_ord, 2, start_line, 'low', 'Missing Docstring', {fmt(fv.DOCSTRING_TEXT, "name")}, NULL
    FROM units WHERE NOT has_docstring AND NOT starts_with(name, '_')
    UNION ALL
    SELECT review_id, file_ord, filename, 3, unit_ord, 3, start_line, 'medium', 'Too Many Parameters',
           {fmt(fv.PARAMETER_TEXT, "name", "CAST(params AS INT)")}, 'params=' || params FROM units WHERE params > 7
    UNION ALL
    SELECT review_id, file_ord, filename, 3, unit_ord, 4, nesting_line, 'medium', 'Deep Nesting',
           {fmt(fv.NESTING_TEXT, "name", "CAST(nesting_depth AS INT)")}, 'nesting_depth=' || CAST(nesting_depth AS INT)
    FROM units WHERE nesting_depth > 4""")
part("quality_llm", f"""
    SELECT f.review_id, f.file_ord, f.filename, 4 AS "check", CAST(i + 1 AS INT) AS seq, 1 AS sub,
           coalesce(TRY_CAST(e ->> 'line' AS INT), 1) AS line,
           {case("coalesce(e ->> 'severity', 'low')", {s: s for s in fv.SEVERITIES}, "'low'")} AS severity,
           coalesce(e ->> 'category', 'Quality Issue') AS category, coalesce(e ->> 'description', '') AS description,
           CAST(NULL AS VARCHAR) AS metric
    FROM parsed f JOIN quality_json a USING (review_id, filename),
         unnest(range(0, CAST(coalesce(json_array_length(js, '$.issues'), 0) AS BIGINT))) u(i), LATERAL (SELECT json_extract(js, '$.issues[' || i || ']') AS e)
    WHERE f.content <> ''""")
QUALITY_ID = short_id("review_id", "filename", "line", "category", "file_ord", '"check"', "seq", "sub")
part("quality", f"""
    SELECT *, {QUALITY_ID} AS id FROM (SELECT * FROM quality_static UNION ALL SELECT * FROM quality_llm)""")

# ---- pattern findings and triage ----------------------------------------------------------------------------------------

part("weighted", "SELECT sub, pattern, category, CAST(weight AS DOUBLE) AS weight FROM " + values((i, *p) for i, p in enumerate(fv.UNIT_PATTERNS, 1)) + " v(sub, pattern, category, weight)")
part("matched", """
    SELECT u.*, w.sub, w.category, w.weight, max(w.weight) OVER (PARTITION BY u.review_id, u.file_ord, u.unit_ord) AS score
    FROM units u JOIN weighted w ON regexp_matches(u.source, w.pattern) WHERE regexp_matches(u.source, '\\S')""")
part("pattern_rows", f"""
    SELECT review_id, file_ord, 3 AS layer, unit_ord AS seq, sub, filename, start_line AS line,
           CASE WHEN score >= 0.8 THEN 'high' ELSE 'medium' END AS severity, category, NULL AS cwe_id, NULL AS owasp,
           {fmt(fv.HEURISTIC_TEXT, "name", "category", "CAST(CAST(round_even(score * 100, 0) AS INT) AS VARCHAR) || '%'")} AS description,
           'codebert' AS source, substr(source, 1, 300) AS code_snippet
    FROM matched WHERE score >= 0.5""")
part("raw_findings", f"""
    SELECT *, {FINDING_ID} AS id FROM (SELECT * FROM rule_rows UNION ALL SELECT * FROM pattern_rows)""")
# Every file lists the findings of all files of its name.
part("expanded", """
    SELECT r.*, r.filename AS host, f.file_ord AS listed_ord,
           row_number() OVER (PARTITION BY f.review_id, f.file_ord ORDER BY r.file_ord, layer, seq, sub) AS position
    FROM parsed f JOIN raw_findings r ON r.review_id = f.review_id AND r.filename = f.filename""")
part("verdicts", """
    SELECT review_id, filename AS host, pos, e, TRY_CAST(e ->> 'index' AS BIGINT) AS position
    FROM security_json, unnest(range(0, CAST(coalesce(json_array_length(js, '$.reviewed'), 0) AS BIGINT))) u(pos),
         LATERAL (SELECT json_extract(js, '$.reviewed[' || pos || ']') AS e)""")
part("last_verdicts", """
    SELECT review_id, host, position, max_by(e, pos) AS e FROM verdicts WHERE position IS NOT NULL GROUP BY ALL""")
part("judged", f"""
    SELECT x.* EXCLUDE (description), dismissed AS false_positive,
           CASE WHEN dismissed THEN CASE WHEN json_exists(e, '$.fp_reason') THEN e ->> 'fp_reason' ELSE {lit(fv.DEFAULT_REASON)} END END AS fp_reason,
           CASE WHEN NOT dismissed AND length(e ->> 'exploitation_context') > 0
                THEN description || chr(10) || chr(10) || 'Exploitation: ' || (e ->> 'exploitation_context') ELSE description END AS description
    FROM (SELECT x.*, v.e, coalesce(v.e ->> 'false_positive' NOT IN ('false', '0', '0.0', '', '[]', '{{}}'), false) AS dismissed
          FROM expanded x LEFT JOIN last_verdicts v USING (review_id, host, position)) x""")
part("additions", f"""
    SELECT h.review_id, h.last_ord AS file_ord, 4 AS layer, CAST(i + 1 AS INT) AS seq, 1 AS sub,
           coalesce(e ->> 'filename', 'unknown') AS filename, coalesce(TRY_CAST(e ->> 'line' AS INT), 0) AS line,
           {case("upper(coalesce(e ->> 'severity', 'medium'))", {s.upper(): s for s in fv.SEVERITIES if s != "info"}, "'medium'")} AS severity,
           coalesce(e ->> 'category', 'Security Issue') AS category, NULL AS cwe_id, NULL AS owasp,
           coalesce(e ->> 'description', '') AS description, 'llm' AS source, NULL AS code_snippet, h.host, h.listed_ord
    FROM (SELECT DISTINCT review_id, host, listed_ord, max(listed_ord) OVER (PARTITION BY review_id, host) AS last_ord FROM expanded) h
    JOIN security_json a ON a.review_id = h.review_id AND a.filename = h.host,
         unnest(range(0, CAST(coalesce(json_array_length(js, '$.additional_issues'), 0) AS BIGINT))) u(i),
         LATERAL (SELECT json_extract(js, '$.additional_issues[' || i || ']') AS e)""")
_final = "review_id, file_ord, layer, seq, sub, filename, line, severity, category, cwe_id, owasp, description, source, code_snippet, host, listed_ord"
part("final", f"""
    SELECT {_final}, id, false_positive, fp_reason, position FROM judged
    UNION ALL
    SELECT {_final}, {FINDING_ID} AS id, false, NULL, NULL FROM additions""")
# One row per finding again, with the number of files that list it.
part("finals", f"""
    SELECT * EXCLUDE (listed_ord), count(*) AS copies, min(listed_ord) AS first_ord, max(listed_ord) AS last_ord FROM final GROUP BY ALL""")

# ---- work lists -----------------------------------------------------------------------------------------------------------

part("fix_items", """
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY review_id ORDER BY listed_ord, file_ord, layer, seq, sub) AS INT) AS item
                   FROM final WHERE NOT false_positive AND severity IN ('critical', 'high', 'medium') AND source <> 'codebert')
    WHERE item <= 10""")
part("fix_table", """
    SELECT i.review_id, i.item, i.id AS issue_id, i.filename, coalesce(js ->> 'description', 'Fix applied') AS description,
           coalesce(js ->> 'original', i.code_snippet, '') AS original, coalesce(js ->> 'fixed', '') AS fixed,
           coalesce(js ->> 'explanation', '') AS explanation
    FROM fix_items i JOIN fix_json a ON a.review_id = i.review_id AND a.item = i.item WHERE js IS NOT NULL""")
part("fix_counts", "SELECT review_id, filename, count(*) AS n_fixes FROM fix_table GROUP BY ALL")
part("test_files", """
    SELECT * FROM (SELECT f.review_id, f.file_ord, f.filename, f.language, coalesce(n_fixes, 0) AS n_fixes,
                          CAST(row_number() OVER (PARTITION BY f.review_id ORDER BY f.file_ord) AS INT) AS file_no
                   FROM parsed f LEFT JOIN fix_counts c USING (review_id, filename) WHERE f.content <> '' OR c.n_fixes > 0)
    WHERE file_no <= 5""")
part("test_units", """
    SELECT t.*, string_agg(u.name, ',' ORDER BY unit_ord) AS names, string_agg(u.name, ', ' ORDER BY unit_ord) AS listed,
           string_agg(u.source, chr(10) || chr(10) ORDER BY unit_ord) AS sources
    FROM test_files t JOIN units u USING (review_id, file_ord) WHERE u.unit_ord <= 5
    GROUP BY t.review_id, t.file_ord, t.filename, t.language, t.n_fixes, t.file_no""")
part("test_table", """
    SELECT t.review_id, t.file_ord, coalesce(js ->> 'filename', 'test_' || regexp_extract(t.filename, '[^/]*$')) AS filename,
           CASE WHEN language = 'python' THEN 'pytest' ELSE 'jest' END AS framework, coalesce(js ->> 'content', '') AS content,
           CASE WHEN json_exists(js, '$.covers') THEN array_to_string(CAST(json_extract(js, '$.covers') AS VARCHAR[]), ',') ELSE names END AS covers
    FROM test_units t JOIN test_json a ON a.review_id = t.review_id AND a.filename = t.filename WHERE js IS NOT NULL""")
part("all_reviews", "SELECT DISTINCT review_id FROM pr_files")
_sev = ", ".join(f"(SELECT count(*) FROM final x WHERE x.review_id = r.review_id AND NOT false_positive AND severity = {lit(s)}) AS {s}" for s in fv.SEVERITIES)
part("counted", f"""
    SELECT r.review_id, (SELECT count(*) FROM parsed x WHERE x.review_id = r.review_id) AS n_files,
           (SELECT count(*) FROM final x WHERE x.review_id = r.review_id AND NOT false_positive) AS n_real,
           (SELECT count(*) FROM final x WHERE x.review_id = r.review_id AND false_positive) AS n_dismissed,
           (SELECT count(*) FROM quality x WHERE x.review_id = r.review_id) AS n_quality,
           (SELECT count(*) FROM fix_table x WHERE x.review_id = r.review_id) AS n_fixes,
           (SELECT count(*) FROM test_table x WHERE x.review_id = r.review_id) AS n_tests, {_sev}
    FROM all_reviews r""")
VERDICT = "CASE WHEN critical + high > 0 THEN 'request_changes' WHEN medium > 0 THEN 'comment' ELSE 'approve' END"
SUMMARY = fmt(fv.SUMMARY_TEXT, "n_real", "n_quality", "n_files", "n_dismissed", "n_fixes", "n_tests")
part("summed", f"SELECT *, {VERDICT} AS verdict, {SUMMARY} AS summary FROM counted")
