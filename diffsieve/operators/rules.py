"""Rule packs for line scanning.

A rule has an id, ruleset, layer, raw severity, name, pattern, message and, optionally, needles: lower-case texts
of which every matching line has at least one. Needles only save work: they are looked for before the pattern.
Patterns keep to the syntax that Java regular expressions and RE2 share (no look-around, no back-references).
Users pass their own packs as a DataFrame with the columns of RULE_SCHEMA.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = (
    "rule_ord INT, rule_id STRING, ruleset STRING, layer INT, raw_severity STRING, name STRING, "
    "pattern STRING, message STRING, needles ARRAY<STRING>"
)


class Rule(NamedTuple):
    rule_id: str
    ruleset: str
    layer: int
    raw_severity: str
    name: str
    pattern: str
    message: str
    needles: list[str] = []


def _scanner(rule_id, severity, name, pattern, message, *needles):
    return Rule(rule_id, "p/python", 1, severity, name, pattern, message, list(needles))


def _pattern(ruleset, severity, rule_id, pattern, message, *needles):
    return Rule(rule_id, ruleset, 2, severity, rule_id, pattern, message, list(needles))


RULE_PACK = [
    _scanner("B102", "MEDIUM", "exec_used", r"\bexec[ \t]*\(", "Use of exec detected.", "exec"),
    _scanner("B105", "LOW", "hardcoded_password_string",
             r"(?i)\b(password|passwd|secret|token|api_key)[ \t]*=[ \t]*[\"'][^\"']+[\"']",
             "Possible hardcoded password.", "password", "passwd", "secret", "token", "api_key"),
    _scanner("B301", "MEDIUM", "pickle", r"\bpickle\.loads?\(", "Unpickling of data that may be untrusted.",
             "pickle.load"),
    _scanner("B307", "MEDIUM", "eval", r"\beval[ \t]*\(", "Use of a possibly insecure function.", "eval"),
    _scanner("B311", "LOW", "random", r"\brandom\.(random|randint|choice)\(",
             "Standard generators are not suitable for security purposes.", "random."),
    _scanner("B324", "HIGH", "hashlib", r"\bhashlib\.(md5|sha1)\(", "Use of a weak hash for security.", "hashlib."),
    _scanner("B501", "HIGH", "request_with_no_cert_validation", r"\bverify[ \t]*=[ \t]*False\b",
             "Call without certificate validation.", "verify"),
    _scanner("B506", "MEDIUM", "yaml_load", r"\byaml\.load\(", "Use of an unsafe loader.", "yaml.load"),
    _scanner("B602", "HIGH", "subprocess_popen_with_shell_equals_true",
             r"\bsubprocess\..*\bshell[ \t]*=[ \t]*True\b", "Subprocess call with a shell.", "subprocess."),
    _scanner("B605", "HIGH", "start_process_with_a_shell", r"\bos\.(system|popen)[ \t]*\(",
             "Starting a process with a shell.", "os.system", "os.popen"),
    _scanner("B608", "MEDIUM", "hardcoded_sql_expressions",
             r"(?i)\b(select|insert|update|delete)\b.*\b(from|into|set)\b.*([\"'][ \t]*(%|\+)|\{[a-z_]+\})",
             "Possible injection through string-built SQL.", "select", "insert", "update", "delete"),
    _pattern("p/python", "ERROR", "python.security.sql.formatted-query",
             r"\bexecute\([ \t]*[\"'].*[\"'][ \t]*[%+]", "Query built from pieces.", "execute("),
    _pattern("p/python", "WARNING", "python.security.eval_detected", r"\beval[ \t]*\(", "eval() on dynamic text.",
             "eval"),
    _pattern("p/python", "INFO", "python.security.dynamic-import", r"__import__[ \t]*\(", "Dynamic import.",
             "__import__"),
    _pattern("p/javascript", "ERROR", "javascript.security.eval-detected", r"\beval[ \t]*\(",
             "eval() on dynamic text.", "eval"),
    _pattern("p/javascript", "WARNING", "javascript.browser.insecure-inner-html",
             r"\.innerHTML[ \t]*=|\bdangerouslySetInnerHTML\b", "Markup set from a variable.",
             ".innerhtml", "dangerouslysetinnerhtml"),
    _pattern("p/javascript", "WARNING", "javascript.browser.document_write", r"\bdocument\.write\(",
             "Markup written from a variable.", "document.write"),
    _pattern("p/javascript", "EXPERIMENT", "javascript.secrets.hardcoded-key",
             r"(?i)\b(api_key|token|secret)[ \t]*=[ \t]*[\"'][^\"']+[\"']", "Key in source.",
             "api_key", "token", "secret"),
    _pattern("p/typescript", "ERROR", "typescript.node.child-process-exec", r"\bexec[ \t]*\(",
             "Shell command from a variable.", "exec"),
    _pattern("p/typescript", "INFO", "typescript.security.weak-random", r"\bMath\.random\(\)",
             "Not suitable for security purposes.", "math.random"),
    _pattern("p/typescript", "WARNING", "typescript.secrets.hardcoded-key",
             r"(?i)\b(api_key|token|secret)[ \t]*=[ \t]*[\"'][^\"']+[\"']", "Key in source.",
             "api_key", "token", "secret"),
]

# For plain prose: secrets and personal data planted in documents.
TEXT_PACK = [
    Rule("T1", "p/text", 1, "HIGH", "assigned_token", r"(?i)\b(token|secret|password)[ \t]*=[ \t]*\"[^\"]+\"",
         "Secret in text.", ["token", "secret", "password"]),
    Rule("T2", "p/text", 1, "MEDIUM", "mail_address", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+",
         "Mail address in text.", ["@"]),
    Rule("T3", "p/text", 1, "MEDIUM", "ip_address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
         "Network address in text."),
    Rule("T4", "p/text", 1, "LOW", "license_line", r"(?i)\blicen[cs]e\b", "License line.", ["licen"]),
    Rule("T5", "p/text", 1, "LOW", "long_number", r"\b[0-9]{13,19}\b", "Long number in text."),
]


def rule_table(spark: SparkSession, pack: list[Rule]) -> DataFrame:
    """A rule pack as a DataFrame; its order is the order in which matches are listed."""
    return spark.createDataFrame([(i, *rule) for i, rule in enumerate(pack, 1)], RULE_SCHEMA)
