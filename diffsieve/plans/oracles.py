"""One SQL statement per query, over the same tables (see `oracle_parts` for the shared parts)."""

from __future__ import annotations

import hashlib
import re

from .. import fixed_values as fv
from ..operators.dedupe import FAMILIES
from .oracle_parts import (
    ORACLES, VERDICT, case, fmt, language_of, lit, oracle, part, short_id, stripped, title, values,
)

__all__ = ["ORACLES"]

ITEM = "review_id, file_ord, layer, seq, sub, id, filename, line, severity, category"
UNIT_KEY = "review_id, file_ord, unit_ord, name"
SEV = ", ".join(f"count(*) FILTER (severity = {lit(s)}) AS {s}" for s in fv.SEVERITIES)

# ---- flagship ---------------------------------------------------------------------------------------------------------

oracle("blocked_reviews", f"""
    SELECT review_id, {VERDICT} AS verdict, {", ".join(fv.SEVERITIES)}
    FROM (SELECT r.review_id, {SEV} FROM (SELECT DISTINCT doc_id // 20 AS review_id FROM documents) r
          LEFT JOIN text_hits h USING (review_id) GROUP BY r.review_id)""")

# ---- sources ----------------------------------------------------------------------------------------------------------

oracle("read_pr_files", """
    SELECT doc_id AS review_id, 0 AS file_ord, 'a' || doc_id || '.py' AS filename, 'python' AS language, text AS content,
           '' AS patch, 0 AS additions, 0 AS deletions FROM documents
    UNION ALL
    SELECT doc_id, 1, 'b' || doc_id || '.ts', 'typescript', 'let b', '@@', CAST(doc_id % 7 AS INT), 1 FROM documents""")
part("deliveries", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'push' ELSE 'pull_request' END AS event,
           CASE event_type WHEN 'view' THEN 'opened' WHEN 'click' THEN 'synchronize' WHEN 'signup' THEN 'reopened' ELSE 'closed' END AS action
    FROM events""")
_fetched = "CASE WHEN event_id % 3 <> 1 THEN 'kind = ' || event_type ELSE '' END"
_start = "event_id AS review_id, 'https://host.example/o/r/pull/' || event_id || '/' AS pr_url"
HOOKS = f"""
    SELECT {_start}, 0 AS file_ord,
           'src/f' || event_id || '.py' AS filename, 'python' AS language, {_fetched} AS content,
           'https://host.example/c/' || event_id AS url, '@@' AS patch, CAST(event_id % 50 AS INT) AS additions, 2 AS deletions
    FROM deliveries JOIN events USING (event_id) WHERE event = 'pull_request' AND action <> 'closed' AND event_id % 3 <> 0
    UNION ALL
    SELECT event_id, 'https://host.example/o/r/pull/' || event_id || '/', 1, 'README.md', 'python', '', '', '', 0, 0
    FROM deliveries WHERE event = 'pull_request' AND action <> 'closed' AND event_id % 3 <> 0
    UNION ALL
    SELECT {_start}, 0, 'listed/f' || event_id || '.py', 'python', {_fetched}, 'https://host.example/c/' || event_id, '@@ l', 3, 0
    FROM deliveries JOIN events USING (event_id) WHERE event = 'pull_request' AND action <> 'closed' AND event_id % 6 = 0
    UNION ALL
    SELECT {_start}, NULL, '', 'python', '', '', '', 0, 0
    FROM deliveries WHERE event = 'pull_request' AND action <> 'closed' AND event_id % 6 = 3"""
oracle("read_pr_events", HOOKS)
oracle("pr_event_stream", HOOKS)
oracle("shape_changed_files", """
    SELECT doc_id AS review_id, 0 AS file_ord, CASE WHEN doc_id % 5 <> 0 THEN 'm' || doc_id || '.js' ELSE '' END AS filename,
           'python' AS language, text AS content,
           CASE WHEN doc_id % 2 = 0 THEN '@@' ELSE '' END AS patch, CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END AS additions,
           0 AS deletions FROM documents
    UNION ALL SELECT doc_id, 1, '', 'python', '', '', 0, 0 FROM documents""")
oracle("read_source_text", "SELECT doc_id, CAST(length(coalesce(text, '')) AS INT) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents")
oracle("read_labelled_jsonl", """
    SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN 'pattern' END AS kind, toxic AS label, text AS code
    FROM labels JOIN documents USING (doc_id)""")
oracle("unpivot_pairs", """
    SELECT item_id || '__vuln' AS id, CASE WHEN item_id % 3 = 0 THEN 'semantic' ELSE 'pattern' END AS kind, 1 AS label, text AS code
    FROM benchmark UNION ALL
    SELECT item_id || '__safe', CASE WHEN item_id % 3 = 0 THEN 'semantic' ELSE 'pattern' END, 0, reverse(text) FROM benchmark""")
_RULE = "['B105', 'B602', 'B999', 'B324'][doc_id % 4 + 1]"
_RAW = "['HIGH', 'medium', 'LOW', 'ODD'][doc_id % 4 + 1]"
oracle("normalize_rule_scanner", f"""
    SELECT doc_id AS file_id, 0 AS pos, 'f' || doc_id || '.py' AS filename, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 40 AS INT) ELSE 0 END AS line,
           ['high', 'medium', 'low', 'low'][doc_id % 4 + 1] AS severity,
           CASE WHEN doc_id % 6 <> 0 THEN 'Hard Coded B64Decode Use' ELSE 'Unknown' END AS category,
           {case(_RULE, fv.CWE_OF_RULE)} AS cwe_id, {case(_RULE, fv.OWASP_OF_RULE)} AS owasp, 'issue in ' || doc_id AS description,
           'bandit' AS source, {stripped("text")} AS code_snippet FROM documents
    UNION ALL
    SELECT doc_id, 1, 'f' || doc_id || '.py', 3, 'low', 'Plain', NULL, NULL, '', 'bandit', '' FROM documents""")
oracle("normalize_pattern_scanner", f"""
    SELECT doc_id AS file_id, 0 AS pos, 'f' || doc_id || '.py' AS filename, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 40 AS INT) ELSE 0 END AS line,
           ['high', 'medium', 'low', 'medium', 'medium'][doc_id % 5 + 1] AS severity, 'Eval Used ' || (doc_id % 3) AS category,
           CAST(NULL AS VARCHAR) AS cwe_id, CAST(NULL AS VARCHAR) AS owasp, 'message' AS description, 'semgrep' AS source,
           {stripped("text")} AS code_snippet FROM documents""")
oracle("batch_scan_input", f"""
    SELECT 'item' || doc_id || '.py' AS name, [2, 1, 0, 0][doc_id % 4 + 1] AS sev, {_RULE} AS id, 'rules' AS tool FROM documents
    UNION ALL SELECT '__init__.py', 0, NULL, 'rules' FROM documents
    UNION ALL SELECT 'item' || doc_id || '.py', [2, 1, 0, 0, 0][doc_id % 5 + 1], 'eval_used-' || (doc_id % 3), 'patterns'
    FROM documents""")
EVENTS = " UNION ALL ".join(
    f"SELECT review_id, {i} AS stage, {lit(agent)} AS agent, {fmt(text, value)} AS message FROM summed"
    for i, ((agent, text), value) in enumerate(
        zip(fv.EVENT_TEXT, ["n_files", "n_real + n_dismissed", "n_quality", "n_fixes", "n_tests", "verdict"]), 1)
)
oracle("event_log", EVENTS)
oracle("write_report", """
    SELECT s.review_id, verdict, n_files AS files_reviewed, CAST(1 AS BIGINT) AS n_header,
           (SELECT count(*) FROM finals x WHERE x.review_id = s.review_id) AS n_security_issues,
           (SELECT count(*) FROM quality x WHERE x.review_id = s.review_id) AS n_quality_issues, n_fixes, n_tests FROM summed s""")

# ---- projections, filters, predicates ------------------------------------------------------------------------------------

oracle("detect_language", f"""
    SELECT filename, {language_of("filename")} AS language
    FROM (SELECT filename FROM pr_files UNION ALL SELECT url AS filename FROM pages)""")
oracle("accept_files", f"""
    SELECT review_id, file_ord, filename, detected AS language
    FROM (SELECT *, {language_of("filename")} AS detected FROM pr_files) WHERE detected <> 'unknown'""")
oracle("reject_malformed", """
    SELECT p.review_id, p.file_ord, p.filename, p.language, w.review_id IS NOT NULL AS ok
    FROM pr_files p LEFT JOIN well_formed w USING (review_id, file_ord)""")
oracle("ast_available", "SELECT * FROM parsed")
oracle("route_layers", """
    SELECT review_id, file_ord, filename, 1 AS layer FROM parsed WHERE language = 'python' AND content <> ''
    UNION ALL SELECT review_id, file_ord, filename, 2 FROM parsed WHERE content <> ''
    UNION ALL SELECT DISTINCT review_id, file_ord, filename, 3 FROM units""")
oracle("real_findings", f"SELECT {ITEM}, description FROM finals WHERE NOT false_positive")
oracle("dismissed_findings", f"SELECT {ITEM}, fp_reason FROM finals WHERE false_positive")
oracle("fixable", f"""
    SELECT {ITEM}, source, copies FROM finals
    WHERE NOT false_positive AND severity IN ('critical', 'high', 'medium') AND source <> 'codebert'""")
oracle("score_threshold", f"""
    SELECT DISTINCT {UNIT_KEY}, score, CASE WHEN score >= 0.8 THEN 'high' ELSE 'medium' END AS pattern_severity,
           CASE WHEN score > 0.8 THEN 'high' ELSE 'medium' END AS model_severity FROM matched WHERE score >= 0.5""")
oracle("length_band", """
    SELECT min(doc_id) AS doc_id, min_by(source, doc_id) AS source, text FROM documents
    WHERE length(text) > 300 AND length(text) < 3000 GROUP BY text""")
part("turn_units", "SELECT conv_id, turn, text FROM conversations WHERE regexp_matches(text, '\\S')")
oracle("blank_unit_filter", """
    SELECT conv_id, turn, CAST(length(text) AS INT) AS n_chars, coalesce(max(w.weight), 0.0) AS score
    FROM turn_units LEFT JOIN weighted w ON regexp_matches(text, w.pattern) GROUP BY conv_id, turn, text""")
oracle("test_eligible", "SELECT review_id, file_ord, filename, language, n_fixes, file_no, names FROM test_units")
oracle("status_filter", """
    SELECT event_id AS review_id, event, action FROM deliveries WHERE event = 'pull_request' AND action <> 'closed'""")
oracle("report_slices", " UNION ALL ".join(
    f"SELECT review_id, {lit(tab)} AS tab, {column} AS n_rows FROM summed" for tab, column in
    [("security", "n_real"), ("quality", "n_quality"), ("fixes", "n_fixes"), ("tests", "n_tests"), ("fp", "n_dismissed")]))
QUALITY = 'review_id, file_ord, "check", seq, sub, id, filename, line, severity, category, description, metric'
oracle("metric_gates", f'SELECT {QUALITY} FROM quality WHERE "check" < 4')

# ---- units and metrics -----------------------------------------------------------------------------------------------------

oracle("extract_functions", f"SELECT {UNIT_KEY}, filename, start_line, end_line, source FROM units")
oracle("function_length", f"SELECT {UNIT_KEY}, start_line, end_line, end_line - start_line + 1 AS n_lines FROM units")
oracle("missing_docstring", f"SELECT {UNIT_KEY} FROM units WHERE NOT has_docstring")
oracle("parameter_count", f"SELECT {UNIT_KEY}, params FROM units")
oracle("nesting_depth", f"SELECT {UNIT_KEY}, nesting_depth, nesting_line FROM units")
oracle("cyclomatic_complexity", "SELECT review_id, file_ord, kind, name, start_line, complexity FROM complexities")
oracle("maintainability_index", """
    SELECT review_id, file_ord, complexity, statements, sloc, comments, round(mi, 6) AS mi FROM indexes""")
oracle("quality_findings", f"SELECT {QUALITY} FROM quality")
oracle("presence_of_functions", """
    SELECT review_id, file_ord, count(*) AS n_functions,
           bool_or(name = 'traced') AND bool_or(name = 'wrapper') AS has_expected FROM units GROUP BY ALL""")

# ---- joins -----------------------------------------------------------------------------------------------------------------

oracle("match_patterns", f"SELECT {ITEM}, description, code_snippet FROM raw_findings WHERE layer = 3")
_ID = "['B105', 'B301', 'B602', 'B605', 'B324', 'B999'][doc_id % 6 + 1]"
for _name, _column, _table in (("attach_cwe", "cwe_id", fv.CWE_OF_RULE), ("attach_owasp", "owasp", fv.OWASP_OF_RULE)):
    oracle(_name, f"""
        SELECT d.rule_id, d.doc_id, t.{_column} FROM (SELECT doc_id, {_ID} AS rule_id FROM documents) d
        LEFT JOIN {values(_table.items())} t(rule_id, {_column}) USING (rule_id)""")
oracle("ruleset_for_language", f"""
    SELECT p.language, review_id, file_ord, ruleset FROM (SELECT review_id, file_ord, {language_of("filename")} AS language FROM pr_files) p
    JOIN {values(fv.RULESET_OF_LANGUAGE.items())} t(language, ruleset) USING (language)""")
FINDING = ("review_id, file_ord, layer, seq, sub, id, filename, line, severity, category, cwe_id, owasp, description, source, "
           "code_snippet")
oracle("rule_scan", f"""
    SELECT {FINDING}, false AS false_positive, CAST(NULL AS VARCHAR) AS fp_reason FROM raw_findings WHERE layer < 3""")
oracle("rule_scan_documents", """
    SELECT review_id, file_ord, filename, line, rule_id, severity, category FROM text_hits""")
_own = short_id("review_id", "filename", "line", "source", "category", "file_ord", "layer", "seq", "sub")
oracle("user_rule_table", f"""
    SELECT review_id, file_ord, layer, seq, sub, {_own} AS id, filename, line, severity, category
    FROM (SELECT * EXCLUDE (sub), CAST((sub - (SELECT count(*) FROM pack WHERE layer = 1)) * 10 AS INT) AS sub FROM raw_findings WHERE layer = 2)""")
oracle("findings_for_file", f"""
    SELECT {ITEM}, host, count(*) AS copies, min(listed_ord) AS first_ord, max(listed_ord) AS last_ord FROM expanded GROUP BY ALL""")
oracle("apply_verdicts", f"""
    SELECT DISTINCT {ITEM}, position, false_positive, fp_reason, description FROM judged""")
oracle("skipped_entries", """
    SELECT review_id, count(*) AS n_skipped FROM verdicts WHERE position IS NULL GROUP BY ALL""")
part("added", f"""
    SELECT * EXCLUDE (listed_ord), {_own} AS id, count(*) AS copies FROM additions GROUP BY ALL""")
oracle("attach_content", """
    SELECT a.review_id, a.id, a.filename, coalesce(max_by(p.content, p.file_ord), '') AS content
    FROM added a LEFT JOIN parsed p ON p.review_id = a.review_id AND p.filename = a.filename
    GROUP BY a.review_id, a.id, a.filename, a.file_ord, a.seq""")
_guidance = "CASE " + " ".join(f"WHEN contains(lower(category), {lit(k)}) THEN {lit(g)}" for k, g in fv.GUIDANCE) + f" ELSE {lit(fv.FALLBACK_GUIDANCE)} END"
oracle("match_guidance", f"""
    SELECT id, review_id, file_ord, layer, seq, sub, category, {_guidance} AS guidance FROM finals""")
oracle("files_with_fix", """
    SELECT review_id, file_ord, filename FROM parsed p
    WHERE EXISTS (SELECT 1 FROM fix_table f WHERE f.review_id = p.review_id AND f.filename = p.filename)""")
oracle("fixes_per_file", """
    SELECT review_id, file_ord, filename, coalesce(n_fixes, 0) AS n_fixes FROM parsed LEFT JOIN fix_counts USING (review_id, filename)""")
oracle("clean_files", """
    SELECT review_id, file_ord, filename FROM parsed p
    WHERE NOT EXISTS (SELECT 1 FROM raw_findings f WHERE f.review_id = p.review_id AND f.filename = p.filename)""")
oracle("merge_both_branches", """
    SELECT review_id, coalesce(n_security, 0) AS n_security, coalesce(n_quality, 0) AS n_quality
    FROM (SELECT review_id, count(*) AS n_security FROM final GROUP BY ALL)
    FULL JOIN (SELECT review_id, count(*) AS n_quality FROM quality GROUP BY ALL) USING (review_id)""")

# ---- evaluation ---------------------------------------------------------------------------------------------------------------

part("snippets", """
    SELECT doc_id AS id, toxic AS label, CASE doc_id % 3 WHEN 0 THEN 'pattern' WHEN 1 THEN 'semantic' END AS kind FROM labels""")
part("scores", "SELECT doc_id AS id, (n_chars % 201) / 200.0 AS score FROM documents")
part("detections", """
    SELECT doc_id AS id, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS sev, rule_id, rule_ord FROM text_hits""")
part("settings", "SELECT * FROM " + values(fv.THRESHOLD_NAMES) + " v(setting, floor)")
part("flagged", """
    SELECT s.id, s.label, s.kind, t.setting,
           EXISTS (SELECT 1 FROM detections d WHERE d.id = s.id AND d.rule_ord <= 2 AND d.sev >= t.floor) AS rule_flag,
           EXISTS (SELECT 1 FROM detections d WHERE d.id = s.id AND d.rule_ord > 2 AND d.sev >= t.floor) AS pattern_flag,
           EXISTS (SELECT 1 FROM detections d WHERE d.id = s.id AND d.sev >= t.floor) AS any_flag,
           c.score >= 0.5 AS score_flag, CASE WHEN s.id % 9 <> 0 THEN c.score > 0.9 END AS job_flag
    FROM snippets s CROSS JOIN settings t JOIN scores c USING (id)""")
_flag = ["rule_flag", "rule_flag OR pattern_flag", "rule_flag OR pattern_flag OR score_flag", "score_flag", "job_flag"]
part("flags", " UNION ALL ".join(
    f"SELECT id, label, kind, setting, {lit(n)} AS configuration, {f} AS flag FROM flagged" for n, f in zip(fv.CONFIGURATIONS, _flag)))


def matrix(source: str) -> str:
    return f"""
    SELECT setting, configuration, count(*) FILTER (label = 1 AND coalesce(flag, false)) AS tp,
           count(*) FILTER (label = 0 AND coalesce(flag, false)) AS fp, count(*) FILTER (label = 1 AND NOT coalesce(flag, false)) AS fn,
           count(*) FILTER (label = 0 AND NOT coalesce(flag, false)) AS tn FROM {source} GROUP BY ALL HAVING count(flag) > 0"""


part("matrix", matrix("flags"))
part("kinds", """
    SELECT setting, configuration, kind, count(*) FILTER (coalesce(flag, false)) AS k, count(*) AS n FROM flags
    WHERE label = 1 AND kind IS NOT NULL GROUP BY ALL""")
part("scored", "SELECT id, label, kind, score FROM snippets JOIN scores USING (id)")
oracle("at_or_above", "SELECT id, setting, rule_flag, pattern_flag FROM flagged")
oracle("any_flag", """
    SELECT setting, label, count(*) FILTER (rule_flag OR pattern_flag) AS n_flagged, bool_or(rule_flag) AS any_rule
    FROM flagged GROUP BY ALL""")
oracle("flags_per_snippet", "SELECT id, label, setting, any_flag AS rule_flag FROM flagged")
oracle("labels_with_flags", "SELECT id, label, kind, round(score, 9) AS score FROM scored")
oracle("ensemble_flags", "SELECT * FROM flags")
oracle("confusion_matrix", "SELECT * FROM matrix")
part("judged_by_user", f"""
    SELECT s.id, s.label, t.setting, {lit(fv.CONFIGURATIONS[4])} AS configuration,
           CASE WHEN s.id % 4 <> 0 THEN contains(d.text, 'the') END AS flag
    FROM snippets s CROSS JOIN settings t JOIN documents d ON d.doc_id = s.id
    UNION ALL SELECT s.id, s.label, t.setting, {lit(fv.CONFIGURATIONS[0])}, false FROM snippets s CROSS JOIN settings t""")
oracle("user_flag", matrix("judged_by_user"))


def ratio(k: str, n: str) -> str:
    return f"CASE WHEN ({n}) > 0 THEN round(({k}) / ({n}), 9) END"


oracle("precision_recall_fpr", f"""
    SELECT setting, configuration, {ratio("tp", "tp + fp")} AS precision, tp AS precision_k, tp + fp AS precision_n,
           {ratio("tp", "tp + fn")} AS recall, tp AS recall_k, tp + fn AS recall_n,
           {ratio("fp", "fp + tn")} AS fpr, fp AS fpr_k, fp + tn AS fpr_n FROM matrix""")


def wilson(k: str, n: str) -> tuple[str, str]:
    p, z2 = f"(({k}) / ({n}))", "(CAST(1.96 AS DOUBLE) * CAST(1.96 AS DOUBLE))"
    reach = f"CAST(1.96 AS DOUBLE) * sqrt({p} * (1 - {p}) / ({n}) + {z2} / (4 * ({n}) * ({n})))"
    centre, scale = f"({p} + {z2} / (2 * ({n})))", f"(1 + {z2} / ({n}))"
    return f"(({centre} - {reach}) / {scale})", f"(({centre} + {reach}) / {scale})"


_lo, _hi = wilson("tp", "tp + fn")
oracle("wilson_ci", f"SELECT setting, configuration, round({_lo}, 9) AS lo, round({_hi}, 9) AS hi FROM matrix")
oracle("recall_by_kind", "SELECT *, round(k / n, 9) AS recall FROM kinds")
oracle("roc_auc", """
    SELECT (SELECT count(*) FROM scored WHERE label = 1) AS n_pos, (SELECT count(*) FROM scored WHERE label = 0) AS n_neg,
           round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 9) AS auc
    FROM scored p CROSS JOIN scored n WHERE p.label = 1 AND n.label = 0""")
oracle("mean_score_by_label", "SELECT label, round(avg(score), 9) AS mean_score, count(*) AS n FROM scored GROUP BY ALL")
oracle("per_snippet", """
    SELECT s.id, s.label, s.kind, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (rule_ord <= 2), '') AS rule_ids,
           coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (rule_ord > 2), '') AS pattern_ids, round(any_value(c.score), 3) AS score
    FROM snippets s LEFT JOIN detections d USING (id) JOIN scores c USING (id) GROUP BY s.id, s.label, s.kind""")
oracle("accuracy_and_flagged_rate", """
    SELECT kind, count(*) AS n, round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1 ELSE 0 END), 9) AS accuracy,
           round(avg(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END), 9) AS flagged_rate,
           round(avg(score) FILTER (label = 1), 9) AS mean_positive, round(avg(score) FILTER (label = 0), 9) AS mean_negative
    FROM scored GROUP BY kind""")
oracle("upper_median", """
    SELECT lang, CAST(list_sort(list(length(text)))[count(*) // 2 + 1] AS INT) AS upper_median, count(*) AS n FROM documents GROUP BY lang""")
oracle("min_max_mean_flagged", """
    SELECT *, CASE WHEN flagged_rate >= 0.9 THEN 'saturated' WHEN flagged_rate <= 0.6 THEN 'not saturated' ELSE 'mixed' END AS saturation
    FROM (SELECT source, round(min(score), 9) AS min_score, round(max(score), 9) AS max_score, round(avg(score), 9) AS mean_score,
                 round(avg(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END), 9) AS flagged_rate
          FROM scores JOIN documents ON doc_id = id GROUP BY source)""")
oracle("class_balance", """
    SELECT count(*) AS n, round(avg(quality), 9) AS positive_ratio, round(greatest(avg(quality), 1 - avg(quality)), 9) AS majority_baseline FROM labels""")
oracle("classification_metrics", """
    SELECT kind, tp, fp, fn, tn, round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END, 9) AS accuracy,
           round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
           round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1
    FROM (SELECT kind, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
                 count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn
          FROM scored GROUP BY kind)""")


def percent_of(k: str, n: str) -> str:
    lo, hi = wilson(k, n)
    whole = lambda x: f"printf('%.0f', {x} * 100)"
    share = f"(({k}) / ({n}))"
    return (f"CASE WHEN ({n}) > 0 THEN {whole(share)} || '% (' || ({k}) || '/' || ({n}) || '; CI ' || {whole(lo)} || '-' "
            f"|| {whole(hi)} || '%)' ELSE 'n/a' END")


_place = case("configuration", {n: i for i, n in enumerate(fv.CONFIGURATIONS)})
oracle("split_sizes", """
    SELECT CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'validation' ELSE 'test' END AS split, count(*) AS n
    FROM (SELECT CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS b FROM labels) GROUP BY ALL""")
oracle("metrics_markdown", f"""
    SELECT setting, 1 AS part, {_place} AS line_no, '| ' || configuration || ' | ' || {percent_of("tp", "tp + fp")} || ' | '
           || {percent_of("tp", "tp + fn")} || ' | ' || {percent_of("fp", "fp + tn")} || ' | ' || tp || '/' || fp || '/' || fn || '/' || tn || ' |' AS text
    FROM matrix
    UNION ALL
    SELECT setting, 2, {_place}, '| ' || configuration || ' | ' || coalesce(max(t) FILTER (kind = 'pattern'), 'n/a') || ' | '
           || coalesce(max(t) FILTER (kind = 'semantic'), 'n/a') || ' |'
    FROM (SELECT *, {percent_of("k", "n")} AS t FROM kinds) GROUP BY setting, configuration""")
oracle("seeded_sample", "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 300")
oracle("sorted_values", """
    SELECT quality, toxic, doc_id, row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) AS position FROM labels""")
oracle("distinct_sources_of_code", "SELECT min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang FROM documents GROUP BY text")

# ---- aggregations and order --------------------------------------------------------------------------------------------------

oracle("severity_breakdown", f"SELECT review_id, {', '.join(fv.SEVERITIES)} FROM counted")
oracle("verdict", "SELECT review_id, verdict FROM summed")
oracle("summary_counts", "SELECT review_id, n_files, n_real, n_dismissed, n_quality, n_fixes, n_tests FROM counted")
oracle("findings_by_file", """
    SELECT review_id, filename, count(*) AS n_issues, min(k).a AS first_ord, min(k).b AS file_ord, min(k).c AS layer, min(k).d AS seq, min(k).e AS sub
    FROM (SELECT *, {'a': min(listed_ord) OVER (PARTITION BY review_id, host), 'b': file_ord, 'c': layer, 'd': seq, 'e': sub} AS k
          FROM final WHERE NOT false_positive) GROUP BY review_id, filename""")
oracle("distinct_sources", """
    SELECT review_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
           array_to_string(list_sort(list(DISTINCT severity)), ',') AS severities FROM final WHERE NOT false_positive GROUP BY ALL""")
oracle("score_max_categories", """
    SELECT u.review_id, u.file_ord, u.unit_ord, u.name, coalesce(max(m.weight), 0.0) AS score,
           coalesce(string_agg(m.category, ',' ORDER BY m.sub), '') AS categories
    FROM units u LEFT JOIN matched m USING (review_id, file_ord, unit_ord) GROUP BY ALL""")
oracle("stage_counts", "SELECT review_id, n_files, n_real + n_dismissed AS n_security, n_quality, n_fixes, n_tests FROM counted")
oracle("first_n_fixes", f"SELECT {ITEM}, listed_ord, item FROM fix_items")
oracle("first_n_test_files", "SELECT review_id, file_ord, filename, language, n_fixes, file_no FROM test_files")
oracle("first_n_functions", f"SELECT {UNIT_KEY}, source FROM units WHERE unit_ord <= 5")
oracle("top_report_rows", f"""
    SELECT * FROM (SELECT {ITEM}, listed_ord, CAST(row_number() OVER (PARTITION BY review_id ORDER BY listed_ord, file_ord, layer, seq, sub) AS INT) AS row_no
                   FROM final WHERE NOT false_positive) WHERE row_no <= 20""")
oracle("finding_position", f"SELECT DISTINCT {ITEM}, position FROM expanded")
oracle("stable_order", "SELECT review_id, first_ord, file_ord, layer, seq, sub, id, source, copies FROM finals")

# ---- set operations -------------------------------------------------------------------------------------------------------------

oracle("merge_layers", f"SELECT {ITEM}, source FROM raw_findings")
oracle("append_additional", f"SELECT {ITEM}, description, source, host, copies FROM added")
oracle("append_quality_answers", f'SELECT {QUALITY} FROM quality WHERE "check" = 4')
part("every_review", "SELECT DISTINCT doc_id // 20 AS review_id FROM documents")
oracle("event_union", """
    SELECT review_id, printf('Found %d quality issue(s)', count(q.review_id)) AS message, 'quality' AS agent
    FROM every_review LEFT JOIN quality q USING (review_id) GROUP BY review_id
    UNION ALL SELECT review_id, printf('Parsed %d file(s)', count(p.review_id)), 'parser'
    FROM every_review LEFT JOIN parsed p USING (review_id) GROUP BY review_id""")

# ---- scalar functions -------------------------------------------------------------------------------------------------------------

_name = "'use_of-b64decode_' || lower(url)"
oracle("title_case", f"SELECT page_id, {title(_name)} AS title FROM pages")
oracle("last_part", "SELECT page_id, string_split(url, '/')[-1] AS path_end, string_split(url, '.')[-1] AS dot_end FROM pages")
oracle("prefixes", "SELECT doc_id, " + ", ".join(f"md5(substr(text, 1, {n})) AS p{n}" for n in (200, 300, 500, 2500, 3000)) + " FROM documents")
oracle("window_around_line", """
    SELECT doc_id, CASE WHEN doc_id % 60 * 40 - 200 <= 0 THEN left(text, CAST(doc_id % 60 * 40 + 200 AS INT))
           ELSE substr(text, doc_id % 60 * 40 - 199, 400) END AS shown FROM documents""")
_block = fmt("\n#%d %s at %s:%d, rated %s by %s\n%s\n> %s\n",
             "position", "category", "filename", "line", "severity", "source", "description", "substr(coalesce(code_snippet, ''), 1, 200)")
part("blocks_of_file", f"""
    SELECT review_id, listed_ord, host, string_agg({_block}, '' ORDER BY position) AS findings FROM expanded GROUP BY ALL""")
oracle("review_request_text", f"""
    SELECT p.review_id, p.file_ord, p.filename, 0 AS part, {lit(fv.SECURITY_TASK)} || chr(10) || substr(content, 1, 3000)
           || chr(10) || '===' || chr(10) || findings AS request
    FROM parsed p JOIN blocks_of_file b ON b.review_id = p.review_id AND b.listed_ord = p.file_ord""")
_shown = """CASE WHEN coalesce(code_snippet, '') <> '' THEN code_snippet
    ELSE CASE WHEN line * 40 <= 200 THEN left(content, line * 40 + 200) ELSE substr(content, line * 40 - 199, 400) END END"""
_request = fmt("ISSUE:\n  File: %s\n  Line: %d\n  Category: %s\n  Severity: %s\n  Description: %s\n\nCODE:\n%s\n\nGUIDANCE: %s\n",
               "filename", "line", "category", "severity", "description", _shown, _guidance)
oracle("fix_request_text", f"""
    SELECT review_id, item, id, filename, {lit(fv.FIX_TASK)} || chr(10) || chr(10) || {_request} AS request
    FROM (SELECT i.*, coalesce((SELECT max_by(p.content, p.file_ord) FROM parsed p
                                WHERE p.review_id = i.review_id AND p.filename = i.filename), '') AS content FROM fix_items i)""")
_request = fmt("FRAMEWORK: %s\nFILE: %s\nLANGUAGE: %s\nFUNCTIONS: %s\nFIXED ISSUES: %d\n\nSOURCE:\n%s\n",
               "CASE WHEN language = 'python' THEN 'pytest' ELSE 'jest' END", "filename", "language", "listed", "n_fixes", "substr(sources, 1, 2500)")
oracle("test_request_text", f"SELECT review_id, file_ord, filename, {lit(fv.TEST_TASK)} || chr(10) || chr(10) || {_request} AS request FROM test_units")
oracle("quality_request_text", f"""
    SELECT review_id, file_ord, filename, {lit(fv.QUALITY_TASK)} || chr(10) || chr(10) || 'FILE: ' || filename || chr(10) || 'SOURCE:' || chr(10) || substr(content, 1, 3000) || chr(10) AS request
    FROM parsed WHERE content <> ''""")
oracle("parse_answers", """
    SELECT review_id, filename, js IS NOT NULL AS readable, CAST(coalesce(json_array_length(js, '$.reviewed'), 0) AS INT) AS n_reviewed,
           CAST(coalesce(json_array_length(js, '$.additional_issues'), 0) AS INT) AS n_additional FROM security_json""")
oracle("fix_rows", "SELECT * FROM fix_table")
oracle("test_rows", "SELECT * FROM test_table")
oracle("percent_text", """
    SELECT id, CAST(CAST(round_even(score * 100, 0) AS INT) AS VARCHAR) || '%' AS shown,
           CAST(CAST(round_even((id % 8) / 8 * 100, 0) AS INT) AS VARCHAR) || '%' AS eighths FROM scores""")
oracle("summary", "SELECT review_id, verdict, summary, n_files AS files_reviewed FROM summed")
_icon, _title = case("verdict", fv.VERDICT_ICON), case("verdict", fv.VERDICT_TITLE)
_head = [f"'## [' || {_icon} || '] Review -- ' || {_title}", "''", "'> ' || summary", "''", "'### Security Issues'", "'| Severity | Count |'",
         "'|----------|-------|'", "'| Critical | ' || critical || ' |'", "'| High     | ' || high || ' |'",
         "'| Medium   | ' || medium || ' |'", "'| Low      | ' || low || ' |'", "''", "CASE WHEN n_real > 0 THEN '### Findings' END"]
_foot = ["''", "'---'", "'Reviewed ' || n_files || ' file(s) -- Review ID: ' || review_id"]


def lines(section: int, texts: list[str], source: str, copies: str = "1") -> str:
    return " UNION ALL ".join(
        f"SELECT review_id, {section} AS section, {i} AS line_no, {copies} AS copies, {t} AS text FROM {source}" for i, t in enumerate(texts))


part("file_groups", "SELECT review_id, filename, count(*) AS n FROM final WHERE NOT false_positive GROUP BY ALL")
part("listed_real", "SELECT * FROM finals WHERE NOT false_positive")
part("made_fixes", "SELECT * FROM fix_table JOIN valid_fixes USING (fixed)")
part("valid_fixes", "SELECT DISTINCT fixed, fixed <> 'def broken(:' AND NOT starts_with(fixed, ' ') AS valid FROM fix_table")
part("comment_lines", "SELECT * FROM (" + " UNION ALL ".join([
    lines(0, _head, "summed"),
    lines(1, ["''", "'**' || filename || '** -- ' || n || ' issue(s)'", "''"], "file_groups"), lines(1, ["''"], "file_groups"),
    lines(1, ["'- [' || upper(severity) || '] ' || category || ' (line ' || line || '): ' || description", "'  - ' || cwe_id"], "listed_real", "copies"),
    lines(2, ["CASE WHEN n_fixes > 0 THEN '' END", "CASE WHEN n_fixes > 0 THEN '### Fixes Generated -- ' || n_fixes || ' patch(es)' END"], "summed"),
    lines(2, ["'- ' || filename || ': ' || description || CASE WHEN valid THEN ' (syntax validated)' ELSE ' (needs review)' END"], "made_fixes"),
    lines(3, ["CASE WHEN n_tests > 0 THEN '' END", "CASE WHEN n_tests > 0 THEN '### Tests Generated -- ' || n_tests || ' file(s)' END"], "summed"),
    lines(3, ["'- ' || filename || ' (' || framework || ') covers: ' || replace(covers, ',', ', ')"], "test_table"),
    lines(4, _foot, "summed"),
]) + ") WHERE text IS NOT NULL")
oracle("comment_markdown", "SELECT * FROM comment_lines")
oracle("write_markdown", """
    SELECT unnest(string_split(text || CASE WHEN copies > 1 THEN ' (x ' || copies || ')' ELSE '' END, chr(10))) AS value FROM comment_lines""")
oracle("pr_url_parts", """
    SELECT page_id, CAST(page_id AS INT) AS number, 'own' || page_id || '/repo' AS repository,
           CASE WHEN len(p) >= 4 THEN p[-4] || '/' || p[-3] WHEN len(p) = 3 THEN p[-3] ELSE '' END AS page_repository
    FROM (SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/') AS p FROM pages)""")
oracle("ratios", """
    SELECT doc_id, round(r, 9) AS ratio, round(sqrt(r), 9) AS root
    FROM (SELECT doc_id, CASE WHEN length(text) > 0 THEN length(replace(text, ' ', '')) / length(text) END AS r FROM documents)""")
oracle("event_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
_lines = "list_transform(string_split(body, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[ \\t]*$') THEN '' ELSE x END)"
_margin = "coalesce(list_min(list_transform(list_filter(l, lambda x: x <> ''), lambda x: length(regexp_extract(x, '^[ \\t]*')))), 0)"
_cut = f"array_to_string(list_transform(l, lambda x: substr(x, {_margin} + 1)), chr(10))"
oracle("dedent_text", f"""
    SELECT doc_id, {stripped(_cut)} || chr(10) AS text
    FROM (SELECT doc_id, {_lines} AS l FROM (SELECT doc_id, chr(10) || '    first' || chr(10) || '      '
          || replace(text, chr(10), chr(10) || '     ') || chr(10) || '   ' || chr(10) || '    ' AS body FROM documents))""")
oracle("short_id", f"SELECT doc_id, {short_id('doc_id', 'source', 'text')} AS id FROM documents")

# ---- scoring, streams ---------------------------------------------------------------------------------------------------------------

part("unit_scores", "SELECT *, (length(source) % 11) / 10 AS score, unit_ord AS seq, 0 AS sub, 3 AS layer, start_line AS line FROM units")
oracle("scored_findings", f"""
    SELECT review_id, file_ord, layer, seq, sub, {short_id("review_id", "filename", "line", "source_name", "category", "file_ord", "layer", "seq", "sub")} AS id,
           filename, line, severity, category, description, source_name AS source
    FROM (SELECT *, 'codebert' AS source_name, {lit(fv.MODEL_CATEGORY)} AS category, CASE WHEN score > 0.8 THEN 'high' ELSE 'medium' END AS severity,
                 {fmt(fv.MODEL_TEXT, "name", "CAST(CAST(round_even(score * 100, 0) AS INT) AS VARCHAR) || '%'")} AS description
          FROM unit_scores WHERE score >= 0.5)""")
oracle("tokenize_truncate", """
    SELECT doc_id, CAST(len(w) AS INT) AS n, md5(array_to_string(w, ' ')) AS digest
    FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')[1:512] AS w FROM documents)""")
part("job_events", """
    SELECT user_id AS review_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'running'
           WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status, CASE WHEN event_type = 'error' THEN 'error in ' || event_id END AS error, ts
    FROM events""")
oracle("job_status", """
    SELECT review_id, seq, status, error FROM job_events QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY seq DESC) = 1""")
oracle("tail_events", """
    SELECT review_id, seq, 0 AS part, '{"seq":' || seq || ',"status":"' || status || '"' || CASE WHEN error IS NULL THEN '' ELSE ',"error":"' || error || '"' END || '}' AS message
    FROM job_events
    UNION ALL SELECT review_id, seq, 1, '{"done":true,"status":"' || status || '"}' FROM job_events WHERE status IN ('complete', 'failed')""")
oracle("events_since", """
    SELECT * FROM (SELECT review_id, seq, status, row_number() OVER (PARTITION BY review_id ORDER BY ts, seq) AS position FROM job_events) WHERE position > 5""")
def _pads(key: bytes) -> tuple[str, str]:
    """The padded keys of the two nested digests, as SQL blobs."""
    whole = (hashlib.sha256(key).digest() if len(key) > 64 else key) + bytes(64)
    return tuple(f"unhex('{bytes(b ^ pad for b in whole[:64]).hex()}')" for pad in (0x36, 0x5C))


_signed = " UNION ALL ".join(
    f"""SELECT {len(key)} AS key_length, event_id, 'sha256=' || sha256({outer} || unhex(sha256({inner} || encode(payload)))) AS signature
    FROM (SELECT event_id, '{{"event":' || event_id || ',"kind":"' || event_type || '"}}' AS payload FROM events)"""
    for key in (b"key", b"long" * 20) for inner, outer in [_pads(key)])
oracle("verified_events", f"""
    SELECT key_length, event_id % 4 = 0 AS ok, count(*) AS n, min(given) AS least, max(given) AS greatest
    FROM (SELECT key_length, event_id, CASE event_id % 4 WHEN 0 THEN signature WHEN 1 THEN 'sha256=00'
          WHEN 2 THEN replace(signature, 'sha256=', 'sha1=') END AS given FROM ({_signed})) GROUP BY ALL""")
oracle("validated_fixes", "SELECT review_id, item, fixed, valid AS validated FROM made_fixes")
oracle("answer_source", """
    SELECT p.review_id, p.file_ord, p.filename, a.answer FROM parsed p JOIN quality_answers a USING (review_id, filename)""")

# ---- merged findings, guarded dismissals, re-scanned fixes ----------------------------------------------------------------

RANK = case("severity", {s: 5 - i for i, s in enumerate(fv.SEVERITIES)}, "0")


def family(column: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), {lit(k)}) THEN {lit(v)}" for k, v in FAMILIES) + f" ELSE lower({column}) END"


part("ranged", f"""
    SELECT f.*, {family("category")} AS family, f.line AS first_line,
           CASE WHEN f.layer = 3 THEN greatest(f.line, coalesce(u.end_line, f.line)) ELSE f.line END AS last_line
    FROM finals f LEFT JOIN units u ON f.layer = 3 AND u.review_id = f.review_id AND u.file_ord = f.file_ord AND u.unit_ord = f.seq""")
part("reaching", """
    SELECT *, max(last_line) OVER (PARTITION BY review_id, file_ord, filename, family, false_positive ORDER BY first_line, last_line, layer, seq, sub
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranged""")
part("clustered", """
    SELECT *, count(*) FILTER (reach IS NULL OR first_line > reach) OVER (
        PARTITION BY review_id, file_ord, filename, family, false_positive ORDER BY first_line, last_line, layer, seq, sub ROWS UNBOUNDED PRECEDING) AS cluster
    FROM reaching""")
_place = "review_id, file_ord, filename, family, false_positive, cluster"
part("merged_findings", f"""
    SELECT * FROM (
        SELECT c.* EXCLUDE (first_line, last_line, reach), m.first_line, m.last_line, m.merged, m.n_layers,
               row_number() OVER (PARTITION BY {", ".join(f"c.{x}" for x in _place.split(", "))} ORDER BY {RANK} DESC, c.layer, c.seq, c.sub) AS place
        FROM clustered c JOIN (
            SELECT {_place}, min(first_line) AS first_line, max(last_line) AS last_line, count(*) AS merged, count(DISTINCT layer) AS n_layers
            FROM clustered GROUP BY ALL) m USING ({_place})
        WHERE NOT c.false_positive) WHERE place = 1""")
oracle("dedupe_findings", f"""
    SELECT {ITEM}, source, copies, family, first_line, last_line, merged, CAST(n_layers AS INT) AS n_layers FROM merged_findings""")
_both = ", ".join(
    f"CAST(coalesce(sum(copies) FILTER (t = {lit(w)} AND severity = {lit(s)}), 0) AS BIGINT) AS {w}_{s}" for w in ("before", "after") for s in fv.SEVERITIES)
oracle("deduped_breakdown", f"""
    SELECT review_id, {_both} FROM all_reviews LEFT JOIN (
        SELECT review_id, severity, copies, 'before' AS t FROM finals WHERE NOT false_positive
        UNION ALL SELECT review_id, severity, copies, 'after' FROM merged_findings) USING (review_id) GROUP BY review_id""")
oracle("guard_dismissals", f"""
    SELECT {ITEM}, CASE WHEN (SELECT count(DISTINCT o.layer) FROM clustered o WHERE o.false_positive AND o.review_id = c.review_id
                              AND o.file_ord = c.file_ord AND o.filename = c.filename AND o.family = c.family AND o.cluster = c.cluster) > 1
                OR (length(trim(coalesce(fp_reason, ''))) > 0 AND fp_reason <> {lit(fv.DEFAULT_REASON)}) THEN 'kept' ELSE 'refused' END AS guard,
           fp_reason, copies
    FROM clustered c WHERE false_positive AND severity IN ('critical', 'high')""")

NL = "chr(10)"
part("sought", f"""
    SELECT t.review_id, t.item, t.filename, t.original, t.fixed, i.file_ord, i.line, i.category, i.severity, p.content,
           string_split(coalesce(p.content, ''), {NL}) AS lines, len(string_split(t.original, {NL})) AS height,
           regexp_matches(t.original, '\\S') AND p.content IS NOT NULL AS usable
    FROM fix_table t JOIN fix_items i USING (review_id, item)
    LEFT JOIN parsed p ON p.review_id = t.review_id AND p.file_ord = i.file_ord AND p.filename = t.filename""")
part("exactly", f"""
    SELECT *, CASE WHEN usable THEN CASE WHEN instr(substr(content, behind + 1), original) > 0 THEN behind + instr(substr(content, behind + 1), original) - 1
                                         WHEN instr(content, original) > 0 THEN instr(content, original) - 1 END END AS exact
    FROM (SELECT *, CASE WHEN least(line, len(lines)) > 1 THEN length(array_to_string(lines[1:least(line, len(lines)) - 1], {NL})) + 1 ELSE 0 END AS behind FROM sought)""")
part("nearly", f"""
    SELECT review_id, item, min({{'distance': levenshtein(w, original), 'line': l}}) AS near
    FROM (SELECT review_id, item, original, l, array_to_string(lines[l:l + height - 1], {NL}) AS w
          FROM exactly, unnest(range(1, len(lines) - height + 2)) u(l) WHERE usable AND exact IS NULL)
    WHERE abs(length(w) - length(original)) <= floor(length(original) * 0.2) AND levenshtein(w, original) <= floor(length(original) * 0.2)
    GROUP BY ALL""")
part("placed", f"""
    SELECT *, start + CASE WHEN how = 'exact' THEN length(original) ELSE length(array_to_string(lines[near.line:near.line + height - 1], {NL})) END AS stop
    FROM (SELECT e.*, near, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'near' END AS how,
                 CASE WHEN exact IS NOT NULL THEN 0 ELSE near.distance END AS distance,
                 coalesce(exact, CASE WHEN near.line > 1 THEN length(array_to_string(lines[1:near.line - 1], {NL})) + 1 WHEN near.line = 1 THEN 0 END) AS start
          FROM exactly e LEFT JOIN nearly USING (review_id, item))""")
part("fitting", """
    SELECT review_id, file_ord, list_reduce(
        list({'stop': stop, 'start': start, 'items': [item]} ORDER BY stop, start, item),
        lambda done, x: CASE WHEN x.start >= done.stop THEN {'stop': x.stop, 'start': done.start, 'items': list_concat(done.items, x.items)} ELSE done END).items AS items
    FROM placed WHERE how IS NOT NULL GROUP BY ALL""")
part("fix_states", f"""
    SELECT p.*, {family("category")} AS family,
           CASE WHEN how IS NULL THEN 'not found' WHEN list_contains(items, item) THEN 'applied' ELSE 'conflict' END AS state
    FROM placed p LEFT JOIN fitting f USING (review_id, file_ord)""")
part("pieces", """
    SELECT *, substr(content, before + 1, start - before) AS gap FROM (
        SELECT *, coalesce(lag(stop) OVER (PARTITION BY review_id, file_ord ORDER BY start), 0) AS before FROM fix_states WHERE state = 'applied')""")
_nl = lambda x: f"(length({x}) - length(replace({x}, {NL}, '')))"
part("changed_lines", f"""
    SELECT *, first_line + {_nl("fixed")} AS last_line, string_split(
           string_agg(gap || fixed, '' ORDER BY start) OVER (PARTITION BY review_id, file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
           || substr(content, max(stop) OVER (PARTITION BY review_id, file_ord) + 1), {NL}) AS new_lines
    FROM (SELECT *, 1 + {_nl("gap")} + coalesce(sum({_nl("gap")} + {_nl("fixed")}) OVER (
              PARTITION BY review_id, file_ord ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line FROM pieces)""")
part("rescanned", f"""
    SELECT c.review_id, c.item, count(*) FILTER (hit = family) AS n_same, count(*) FILTER (hit <> family) AS n_other
    FROM (SELECT c.*, {family(title("regexp_extract(r.name, '[^.]*$')"))} AS hit
          FROM (SELECT c.review_id, c.item, c.family, {case("p.language", fv.RULESET_OF_LANGUAGE)} AS ruleset, new_lines[l] AS text
                FROM changed_lines c JOIN parsed p USING (review_id, file_ord), unnest(range(CAST(first_line AS BIGINT), CAST(last_line AS BIGINT) + 1)) u(l)) c
          JOIN pack r ON r.ruleset = c.ruleset AND regexp_matches(c.text, r.pattern)) c GROUP BY ALL""")
part("fix_results", """
    SELECT s.review_id, s.item, s.file_ord, s.filename, s.category, s.severity, s.family, s.state, s.how, CAST(s.distance AS INT) AS distance,
           CAST(c.first_line AS INT) AS first_line, CAST(c.last_line AS INT) AS last_line,
           CASE WHEN s.state = 'applied' THEN coalesce(n_same, 0) = 0 END AS cleared, CASE WHEN s.state = 'applied' THEN coalesce(n_other, 0) END AS n_other
    FROM fix_states s LEFT JOIN changed_lines c ON c.review_id = s.review_id AND c.item = s.item
    LEFT JOIN rescanned r ON r.review_id = s.review_id AND r.item = s.item""")
oracle("rescan_fixes", "SELECT * FROM fix_results")
oracle("cleared_share", """
    SELECT review_id, count(item) AS n_fixes, count(*) FILTER (state = 'applied') AS n_applied, count(*) FILTER (state = 'conflict') AS n_conflict,
           count(*) FILTER (state = 'not found') AS n_not_found, count(*) FILTER (cleared) AS n_cleared,
           round(count(*) FILTER (cleared) / nullif(count(*) FILTER (state = 'applied'), 0), 9) AS share
    FROM all_reviews LEFT JOIN fix_results USING (review_id) GROUP BY review_id""")

# ---- reviews on streams --------------------------------------------------------------------------------------------------

oracle("streamed_reviews", """
    SELECT review_id, verdict, summary, n_files AS files_reviewed,
           CASE WHEN review_id NOT IN (SELECT review_id FROM well_formed) THEN 'no file known' END AS error FROM summed""")
oracle("late_listings", re.sub(r"CASE WHEN event_id % 3 <> 1 THEN 'kind = ' \|\| event_type ELSE '' END", "''", HOOKS))
ORACLES["streamed_job_status"] = ORACLES["job_status"]

# ---- large rule tables -----------------------------------------------------------------------------------------------------

part("longest_words", """
    SELECT word, CAST(min(doc_id) AS INT) AS rule_ord FROM (
        SELECT doc_id, w AS word, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS place
        FROM documents, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) u(w)) WHERE place = 1 GROUP BY word""")
part("words_of_lines", """
    SELECT DISTINCT doc_id, line, w AS word
    FROM (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
         unnest(regexp_extract_all(lower(text), '[a-z]+')) u(w)""")
oracle("large_rule_table", """
    SELECT rule_ord, count(*) AS n_lines, count(DISTINCT doc_id) AS n_documents, min(upper(word[1]) || word[2:]) AS category
    FROM longest_words JOIN words_of_lines USING (word) GROUP BY rule_ord""")

# ---- the whole evaluation text ---------------------------------------------------------------------------------------------

_heads = [
    f"['### Severity filter: ' || setting || CASE WHEN setting = 'all severities' THEN ' (primary)' ELSE '' END, '', {lit(fv.EVALUATION_HEADS[0][0])}, {lit(fv.EVALUATION_HEADS[0][1])}]",
    f"['', 'Recall by weakness type:', '', {lit(fv.EVALUATION_HEADS[1][0])}, {lit(fv.EVALUATION_HEADS[1][1])}]",
    "['']",
]
part("result_tables", ORACLES["metrics_markdown"])
_settings = " UNION ALL ".join(
    f"SELECT 2 AS block, setting, {k} AS part, CAST(i - {101 if k < 3 else 1} AS INT) AS line_no, ({h})[i] AS text FROM (SELECT DISTINCT setting FROM flags), unnest(range(1, len({h}) + 1)) u(i)"
    for k, h in enumerate(_heads, 1))
oracle("evaluation_markdown", f"""
    SELECT 0 AS block, '' AS setting, 0 AS part, 0 AS line_no, '# Detector evaluation' AS text UNION ALL SELECT 0, '', 0, 1, ''
    UNION ALL SELECT 1, '', 0, 0, '## Benchmark: labelled documents (' || count(*) || ' snippets, ' || count(*) FILTER (label = 1) || ' vulnerable)'
    FROM (SELECT DISTINCT id, label FROM flags) UNION ALL SELECT 1, '', 0, 1, ''
    UNION ALL {_settings}
    UNION ALL SELECT 2, setting, part, line_no, text FROM result_tables
    UNION ALL SELECT 3, '', 0, CAST(i - 1 AS INT), ['Scores of the units:', '', '- ROC-AUC on this benchmark: **' || auc || '** (0.5 = chance)',
                     '- Mean P(vulnerable): vulnerable snippets ' || bad || ', safe snippets ' || good, ''][i]
    FROM (SELECT printf('%.3f', avg(score) FILTER (label = 1)) AS bad, printf('%.3f', avg(score) FILTER (label = 0)) AS good FROM scored),
         (SELECT printf('%.3f', avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)) AS auc
          FROM scored p CROSS JOIN scored n WHERE p.label = 1 AND n.label = 0), unnest(range(1, 6)) u(i)""")
