"""Tables, patterns, limits and text formats that results depend on.

FIXED VALUES - everything in this file is data that has to have exactly this value for results to be right
(lookup tables, weighted patterns, thresholds, severity maps, message formats). There is no logic here.
"""

# ---- languages -------------------------------------------------------------------------------------------
EXTENSION_LANGUAGE = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "jsx": "jsx",
    "tsx": "tsx",
}
IGNORED_SUFFIXES = ["package-lock.json", "yarn.lock", "poetry.lock", ".min.js", ".min.css", ".map"]
LANGUAGES = ["python", "javascript", "typescript", "jsx", "tsx", "unknown"]

RULESET_OF_LANGUAGE = {
    "python": "p/python",
    "javascript": "p/javascript",
    "typescript": "p/typescript",
    "jsx": "p/javascript",
    "tsx": "p/typescript",
}

# ---- severities ------------------------------------------------------------------------------------------
SEVERITIES = ["critical", "high", "medium", "low", "info"]
RULE_SCANNER_SEVERITY = {"HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
PATTERN_SCANNER_SEVERITY = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
EVALUATION_SEVERITY = {"LOW": 0, "INFO": 0, "MEDIUM": 1, "WARNING": 1, "HIGH": 2, "ERROR": 2}

# ---- rule id lookups -------------------------------------------------------------------------------------
OWASP_OF_RULE = {
    "B101": "A05:2021", "B102": "A01:2021", "B105": "A07:2021", "B106": "A07:2021", "B107": "A07:2021",
    "B201": "A05:2021", "B301": "A08:2021", "B302": "A08:2021", "B303": "A02:2021", "B304": "A02:2021",
    "B307": "A03:2021", "B311": "A02:2021", "B324": "A02:2021", "B401": "A06:2021", "B403": "A08:2021",
    "B404": "A03:2021", "B501": "A02:2021", "B502": "A02:2021", "B505": "A02:2021", "B506": "A08:2021",
    "B602": "A03:2021", "B603": "A03:2021", "B605": "A03:2021", "B607": "A03:2021", "B608": "A03:2021",
    "B701": "A03:2021", "B702": "A03:2021",
}
CWE_OF_RULE = {
    "B105": "CWE-259", "B106": "CWE-259", "B107": "CWE-259", "B301": "CWE-502", "B302": "CWE-502",
    "B303": "CWE-327", "B307": "CWE-78", "B311": "CWE-330", "B501": "CWE-295", "B502": "CWE-326",
    "B602": "CWE-78", "B605": "CWE-78", "B608": "CWE-89",
}

# ---- weighted patterns for function units: (pattern, category, weight) -------------------------------------
UNIT_PATTERNS = [
    (r"pickle\.loads?\(", "Insecure Deserialization", 0.9),
    (r"subprocess.*shell\s*=\s*True", "Shell Injection", 0.9),
    (r"exec\s*\(", "Arbitrary Code Execution", 0.85),
    (r"eval\s*\(", "Arbitrary Code Execution", 0.85),
    (r"os\.system\s*\(", "OS Command Injection", 0.8),
    (r"cursor\.execute\s*\([^,)]*%", "SQL Injection", 0.9),
    (r"cursor\.execute\s*\([^,)]*\+", "SQL Injection", 0.85),
    (r"password\s*=\s*[\"'][^\"']+", "Hardcoded Credential", 0.8),
    (r"secret\s*=\s*[\"'][^\"']+", "Hardcoded Credential", 0.8),
    (r"api_key\s*=\s*[\"'][^\"']+", "Hardcoded Credential", 0.8),
    (r"hashlib\.md5\(", "Weak Cryptography", 0.7),
    (r"hashlib\.sha1\(", "Weak Cryptography", 0.65),
    (r"random\.random\(\)", "Insecure Randomness", 0.6),
    (r"verify\s*=\s*False", "TLS Verification Disabled", 0.85),
    (r"yaml\.load\(", "Unsafe YAML Deserialization", 0.8),
    (r"__import__\s*\(", "Dynamic Import", 0.65),
    (r"deserialize\s*\(", "Possible Deserialization", 0.55),
    (r"input\s*\(", "Unvalidated Input", 0.4),
]
SCORE_THRESHOLD = 0.5
HIGH_SCORE = 0.8
HEURISTIC_TEXT = "CodeBERT heuristic flagged `%s` for `%s` (confidence %s)."
MODEL_TEXT = "CodeBERT (fine-tuned) flagged `%s` as potentially vulnerable with %s confidence."
MODEL_CATEGORY = "ML-Detected Vulnerability"

# ---- finding sources, in the order in which a file's findings are listed -----------------------------------
SOURCE_RULES = "bandit"
SOURCE_PATTERNS = "semgrep"
SOURCE_UNITS = "codebert"
SOURCE_ANSWER = "llm"

# ---- quality gates and texts -----------------------------------------------------------------------------
COMPLEXITY_FLAG, COMPLEXITY_HIGH = 10, 15
MAINTAINABILITY_FLAG, MAINTAINABILITY_HIGH = 20, 10
MAX_LINES, MAX_PARAMETERS, MAX_NESTING = 50, 7, 4
COMPLEXITY_TEXT = "`%s` has cyclomatic complexity %d (%s — aim for ≤ 10)."
MAINTAINABILITY_TEXT = "File maintainability index is %s/100 (%s — aim for > 20)."
LENGTH_TEXT = "`%s` is %d lines long — consider splitting (aim for ≤ 50 lines)."
DOCSTRING_TEXT = "Public function `%s` has no docstring."
PARAMETER_TEXT = "`%s` has %d parameters — consider a config object (aim for ≤ 7)."
NESTING_TEXT = "`%s` has nesting depth %d — consider early returns (aim for ≤ 4)."

# ---- work lists, cuts and truncations ----------------------------------------------------------------------
MAX_FIXES, MAX_TEST_FILES, MAX_TEST_FUNCTIONS, MAX_REPORT_ROWS = 10, 5, 5, 20
REQUEST_SNIPPET, UNIT_SNIPPET, TEST_SOURCE, REQUEST_SOURCE = 200, 300, 2500, 3000
MAX_TOKENS = 512
FIXABLE_SEVERITIES = ["critical", "high", "medium"]
DEFAULT_REASON = "Dismissed by LLM reviewer"

# ---- guidance: first key contained in the lower-cased category wins -----------------------------------------
GUIDANCE = [
    ("sql injection",
     "Replace string-concatenated SQL with parameterized queries. "
     "Use `cursor.execute(query, params)` where params is a tuple."),
    ("shell injection",
     "Replace shell=True subprocess calls with a list of arguments: "
     "`subprocess.run(['cmd', 'arg1', 'arg2'])`. Never pass user input to shell."),
    ("command injection",
     "Use subprocess with a list of args (no shell=True). "
     "Validate and sanitize any user-controlled values before use."),
    ("hardcoded credential",
     "Move secrets to environment variables: `import os; secret = os.getenv('SECRET_NAME')`. "
     "Never commit secrets to source control."),
    ("hardcoded password",
     "Move passwords to environment variables using os.getenv(). "
     "Consider using a secrets manager (e.g. AWS Secrets Manager, Vault)."),
    ("weak cryptography",
     "Replace MD5/SHA1 with SHA-256 or stronger: `hashlib.sha256(data).hexdigest()`. "
     "For passwords, use bcrypt or argon2 — never raw hashlib."),
    ("insecure deserialization",
     "Replace pickle with json.loads() for untrusted data. "
     "If pickle is required, only unpickle data from trusted, signed sources."),
    ("arbitrary code execution",
     "Replace eval() with ast.literal_eval() for safe expression parsing, "
     "or refactor to avoid dynamic code execution entirely."),
    ("tls verification disabled",
     "Remove `verify=False` from requests calls. "
     "If using a custom CA, pass `verify='/path/to/ca-bundle.crt'` instead."),
    ("unsafe yaml deserialization",
     "Replace yaml.load() with yaml.safe_load() which disallows arbitrary objects."),
    ("missing docstring",
     "Add a Google-style docstring describing the function's purpose, arguments, and return value."),
    ("high complexity",
     "Refactor by extracting sub-functions for each logical block. "
     "Aim for a cyclomatic complexity of 10 or less per function."),
]
FALLBACK_GUIDANCE = "Apply the principle of least privilege and follow OWASP secure coding guidelines."

# ---- report texts ------------------------------------------------------------------------------------------
SUMMARY_TEXT = (
    "Found %d security issue(s) and %d quality issue(s) across %d file(s). "
    "%d false positive(s) dismissed. %d fix(es) and %d test file(s) generated."
)
VERDICT_ICON = {"approve": "OK", "comment": "WARNING", "request_changes": "BLOCKED"}
VERDICT_TITLE = {"approve": "Approve", "comment": "Comment", "request_changes": "Request Changes"}
EVENT_TEXT = [
    ("parser", "Parsed %d file(s)"),
    ("security", "Found %d security issue(s)"),
    ("quality", "Found %d quality issue(s)"),
    ("fix", "Generated %d fix(es)"),
    ("test_writer", "Generated %d test file(s)"),
    ("reviewer", "Review complete — verdict: %s"),
]

# ---- evaluation --------------------------------------------------------------------------------------------
CONFIGURATIONS = [
    "Bandit only",
    "Bandit + Semgrep",
    "Bandit + Semgrep + CodeBERT",
    "CodeBERT alone (C -> Python transfer)",
    "Full pipeline (+ LLM triage)",
]
THRESHOLD_NAMES = [("all severities", 0), ("MEDIUM and above", 1)]
WILSON_Z = 1.96
REVIEW_ACTIONS = ["opened", "synchronize", "reopened"]
FINAL_STATUSES = ["complete", "failed"]

# What a request to the outside reviewer opens with: the task and the answer that is parsed.
SECURITY_TASK = (
    "Decide for every numbered finding below whether it is real, and add what the scanners missed. Reply with one JSON object: "
    '"reviewed" holds {"index": number of the finding, "false_positive": boolean, "fp_reason": text or null, '
    '"exploitation_context": text}; "additional_issues" holds {"filename", "line", "severity", "category", "description"}. '
    "The start of the file, then the findings:"
)
FIX_TASK = (
    "Repair the weakness below with as small a change as will do. Reply with one JSON object: "
    '"description": what was changed, in a sentence; "original": the text to replace, letter by letter as it stands in the file; '
    '"fixed": the text to put there; "explanation": why the weakness is gone.'
)
TEST_TASK = (
    "Write one test file for the functions below: usual input, odd input (empty, missing, huge), and input by which a repaired weakness "
    "could be used. Replace what reaches outside by stand-ins. Reply with one JSON object: "
    '"filename": name of the test file; "content": its whole text; "covers": list of the functions tested.'
)
QUALITY_TASK = (
    "Name faults in this source that counting cannot find: misleading names, mixed duties, repeated code, errors that nobody handles, logic "
    "that is hard to follow. Leave out matters of taste. Reply with one JSON object: "
    '"issues" holds {"line": number, "severity": critical, high, medium, low or info, "category": text, "description": text}.'
)

# Heads of the two result tables of an evaluation.
EVALUATION_HEADS = (
    ("| Configuration | Precision | Recall | False-positive rate | TP/FP/FN/TN |", "|---|---|---|---|---|"),
    ("| Configuration | Pattern-style | Semantic (logic/authz) |", "|---|---|---|"),
)
