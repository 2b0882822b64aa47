"""Review tables derived from the text tables.

The given tables hold prose, not source code. Each document becomes one changed file: a code template chosen by
``doc_id``, and behind it a function that returns the whole document text, so that units grow with the texts too. 20 documents
make one review, so the review tables grow with the documents. Files without content come on top, as rows of their own. Answers of
outside reviewers are derived from the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_PER_REVIEW = 20

# (file name ending, embeds the text as, template). "@N@" stands for the document id.
TEMPLATES: list[tuple[str, str, str]] = [
    (".py", "py", '''import logging

log = logging.getLogger(__name__)


def load_order_@N@(store, key):
    """Look up one order."""
    if key is None:
        return None
    return store.get(key)


class Ledger@N@:
    """Running totals."""

    def __init__(self, start=0):
        self.total = start

    def add(self, amount, *, note=""):
        self.total += amount
        log.debug("added %s %s", amount, note)
        return self.total
'''),
    (".py", "py", '''import hashlib


def find_rows_@N@(conn, name):
    cursor = conn.cursor()
    cursor.execute("SELECT * FROM items WHERE name = '%s'" % name)
    return cursor.fetchall()


def drop_rows_@N@(conn, table, key):
    """Remove rows."""
    cursor = conn.cursor()
    cursor.execute("DELETE FROM items WHERE id = " + key)
    return hashlib.md5(key.encode()).hexdigest()
'''),
    (".PY", "py", '''import os
import subprocess


def pack_@N@(folder):
    return subprocess.run("tar cf backup.tar " + folder, shell=True)


def wipe_@N@(path):
    os.system("rm -r " + path)


password = "swordfish-@N@"


async def watch_@N@(queue):
    """Wait for work."""
    async for item in queue:
        if item:
            await item.run()
'''),
    (".py", "py", '''import functools


def traced(fn):
    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        """Call through."""
        return fn(*args, **kwargs)

    return wrapper


class Router@N@:
    @traced
    def dispatch(
        self,
        verb,
        path,
        *,
        depth=(0, 1),
    ):
        for part in path.split("/"):
            if part:
                while depth:
                    try:
                        with open(part) as handle:
                            if handle.readable():
                                return handle.read()
                    except OSError:
                        # closed meanwhile
                        return None
                    finally:
                        depth = None
        return verb

    def label(self, n):
        if n == 0:
            return "none"
        elif n == 1:
            return "one"
        elif n == 2:
            return "two"
        else:
            if n > @N@:
                return "many"
        return "few"
'''),
    (".py", "py", '''def configure_@N@(host, port, user, secret_name, retries, timeout, region, verbose=False, **extra):
    settings = {"host": host, "port": port}
    return settings


def _helper_@N@(a, b, /, c, *rest, key=None):
    return [a, b, c, rest, key]


def long_sum_@N@(total):
    """Add a fixed ladder."""
''' + "".join(f"    total += {i} * total\n" for i in range(52)) + '''    return total
'''),
    (".js", "js", '''function render@N@(node, html) {
  node.innerHTML = html;
  return eval("(" + html + ")");
}

const api_key = "k-@N@-live";
document.write(api_key);
'''),
    (".ts", "js", '''export function add@N@(a: number, b: number): number {
  return a + b;
}
'''),
    (".jsx", "js", '''export const Card@N@ = ({ body }) => (
  <div dangerouslySetInnerHTML={{ __html: body }} />
);
'''),
    (".tsx", "js", '''import { exec } from "child_process";

export const run@N@ = (name: string) => {
  exec("ls " + name);
  return Math.random();
};
'''),
    (".py", "py", '''import pickle
import random

import requests
import yaml


def restore_@N@(blob, text):
    state = pickle.loads(blob)
    rules = yaml.load(text)
    return state, rules


def fetch_@N@(url):
    """Fetch without looking at the certificate."""
    reply = requests.get(url, verify=False)
    return eval(reply.text), random.random()
'''),
    (".md", "raw", '''# Notes @N@

password = "not code"
'''),
    (".min.js", "raw", '''var a=@N@;eval(a);
'''),
    (".py", "py", ""),
    (".py", "py", '''def grade_@N@(a, b, c, d, e):
    if a and b or c:
        return 1
    elif d:
        return 2
    for x in e:
        if x and a:
            b = [y for y in x if y]
        elif x or b:
            c = 1 if x else 0
        while b and c:
            b = None
    try:
        assert a
    except ValueError:
        d = None
    except TypeError:
        d = 0
    return d


def sort_@N@(rows):
    out = []
    for row in rows:
        if row > 0 and row < 10:
            out.append(row)
        elif row >= 10 or row == -1:
            out.insert(0, row)
        elif row in (2, 3):
            continue
        if not out:
            break
        while out and out[0] is None:
            out.pop()
    return out
'''),
    (".rb", "raw", '''def hello
  puts "@N@"
end
'''),
    (".py", "py", '''def outer_@N@(items):
    \'\'\'Keep the good ones.\'\'\'
    def inner(item):
        query = f"SELECT * FROM t WHERE a = {item}"
        return input("value for " + query)

    if items:
        def later(x):
            return __import__("json").dumps(x)
        return [later(inner(i)) for i in items]

    return deserialize (items)
'''),
]
N_TEMPLATES = len(TEMPLATES)

OPEN = {
    "py": '\n\ndef notes_@N@():\n    """What the change says."""\n    return r"""\n', "js": "\n\nconst notes = `\n", "raw": "\n"}
CLOSE = {"py": '\n"""\n', "js": "\n`;\n", "raw": "\n"}


def _templates(spark: SparkSession) -> DataFrame:
    """The templates as a table of fixed size: key, file name ending, text before and after the document."""
    rows = [(i, end, body + OPEN[how], CLOSE[how]) for i, (end, how, body) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template BIGINT, ending STRING, head STRING, tail STRING")


def _with_templates(documents: DataFrame) -> DataFrame:
    templates = F.broadcast(_templates(documents.sparkSession))
    doc_id = F.col("doc_id")
    # Some files carry the name of an earlier file of their review (same template, 16 documents before).
    number = F.when(_is_twin(), doc_id - N_TEMPLATES).otherwise(doc_id).cast("string")
    name = F.concat(F.lit("pkg"), _review().cast("string"), F.lit("/m"), number, F.col("ending"))
    return (
        documents.withColumn("template", doc_id % N_TEMPLATES)
        .join(templates, "template")
        .withColumns({"review_id": _review(), "filename": name})
    )


def _is_twin() -> Column:
    return F.col("doc_id") % 40 == 37


def _review() -> Column:
    return F.expr(f"doc_id div {FILES_PER_REVIEW}")


def corpus(documents: DataFrame) -> DataFrame:
    """`pr_files`: one changed file per document, and for some documents another whose content is missing or empty. Some
    files declare a language that is none."""
    doc_id = F.col("doc_id")
    text = F.replace(F.col("text"), F.lit('"""'), F.lit('"'))
    head = F.replace(F.col("head"), F.lit("@N@"), doc_id.cast("string"))
    files = _with_templates(documents).select(
        "review_id",
        (doc_id % FILES_PER_REVIEW).cast("int").alias("file_ord"),
        "filename",
        F.when(doc_id % 31 == 7, F.lit("cobol")).when(doc_id % 3 == 0, F.lit("python")).alias("language"),
        F.concat(head, text, F.col("tail")).alias("content"),
        F.when(doc_id % 4 != 0, F.concat(F.lit("@@ m"), doc_id.cast("string"))).alias("patch"),
        F.when(doc_id % 5 != 0, (doc_id % 90).cast("int")).alias("additions"),
        F.lit(None).cast("int").alias("deletions"),
    )
    odd = documents.filter((doc_id % 37 == 5) | (doc_id % N_TEMPLATES == 12)).select(
        _review().alias("review_id"),
        (FILES_PER_REVIEW + doc_id % FILES_PER_REVIEW).cast("int").alias("file_ord"),
        F.concat(F.lit("pkg"), _review().cast("string"), F.lit("/x"), doc_id.cast("string"), F.lit(".py")).alias("filename"),
        F.lit("python").alias("language"),
        F.when(doc_id % 37 != 5, F.lit("")).alias("content"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("patch", "string"), ("additions", "int"), ("deletions", "int"))],
    )
    return files.unionByName(odd)


# Answers of the outside reviewer, per file; @N@ is the document id, @F@ the file name. Case = doc_id % 7.
SECURITY_ANSWERS = [
    '{"reviewed": [{"index": 1, "false_positive": false, "fp_reason": null, "exploitation_context": '
    '"reachable from @F@"}, {"index": 2, "false_positive": true, "fp_reason": "constant input"}], '
    '"additional_issues": []}',
    '```json\n{"reviewed": [{"index": 1, "false_positive": true}, {"index": 3, "false_positive": true, '
    '"fp_reason": null}], "additional_issues": [{"filename": "@F@", "line": 3, "severity": "Critical", '
    '"category": "Broken Access Control", "description": "no owner check in @N@", '
    '"exploitation_context": "dropped"}]}\n```',
    '{"reviewed": [{"index": 1, "false_positive": fal',
    '{"reviewed": [{"index": 1, "false_positive": true, "fp_reason": "first"}, {"index": 1, '
    '"false_positive": false, "exploitation_context": "last entry wins"}], "additional_issues": '
    '[{"severity": "info"}]}',
    '{"reviewed": [{"false_positive": true, "fp_reason": "no index"}, {"index": 2, "false_positive": true, '
    '"fp_reason": "test only"}]}',
    '',
    '{"additional_issues": [{"filename": "other.py", "line": 9, "severity": "LOW", "category": "Race", '
    '"description": "window"}]}',
]
QUALITY_ANSWERS = [
    '{"issues": [{"line": 4, "severity": "medium", "category": "Poor Naming", "description": "rename @N@"}]}',
    '```\n{"issues": [{"description": "unclear"}, {"line": 2, "severity": "HIGH"}]}\n```',
    'no issues found',
    '{"issues": []}',
    '{"other": 1}',
]
FIX_ANSWERS = [
    '{"description": "Use parameters", "original": "a = @N@", "fixed": "b = @N@\\n", "explanation": "safe"}',
    '{"fixed": "def broken(:"}',
    '```json\n{"description": "Drop the call", "original": "x()", "fixed": ""}\n```',
    'cannot fix',
    '{"fixed": "checked_@N@()", "explanation": "replaced"}',
    '{"original": "return eval(reply.text), random.random()", "fixed": "return json.loads(reply.text)"}',
    '{"original": "    return subprocess.run(\\"tar cf backups.tar \\" + folders, shell=True)", "fixed": "    return pack(folder)"}',
    '{"fixed": "value = eval(os.popen(name_@N@)); password = \\"p\\""}',
]
TEST_ANSWERS = [
    '{"filename": "test_@N@.py", "content": "def test_ok():\\n    assert True\\n", "covers": ["load", "add"]}',
    '{"content": "import pytest"}',
    '```\n{"filename": "t.py", "covers": []}\n```',
    '[1, 2',
]


def answers(documents: DataFrame, stage: str) -> DataFrame:
    """Outside answers of one stage: security, quality and test per file name, fix per work item (1..10)."""
    doc_id = F.col("doc_id")
    cases = {"security": SECURITY_ANSWERS, "quality": QUALITY_ANSWERS, "fix": FIX_ANSWERS, "test": TEST_ANSWERS}[stage]
    table = documents.sparkSession.createDataFrame(list(enumerate(cases)), "variant BIGINT, body STRING")
    rows = _with_templates(documents).withColumn("variant", doc_id % len(cases)).join(F.broadcast(table), "variant")
    answer = F.replace(F.replace("body", F.lit("@N@"), doc_id.cast("string")), F.lit("@F@"), F.col("filename"))
    if stage == "fix":
        item = (doc_id % FILES_PER_REVIEW + 1).cast("int")
        return rows.select("review_id", item.alias("item"), answer.alias("answer")).filter(F.col("item") <= 10)
    return rows.filter(~_is_twin()).select("review_id", "filename", answer.alias("answer"))
