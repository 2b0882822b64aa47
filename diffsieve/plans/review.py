"""The review job: one lazy plan over all reviews, with tables as attributes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import files as file_ops
from ..operators import quality as quality_ops
from ..operators import report as report_ops
from ..operators import dedupe, scan, triage, units, worklist
from ..operators.rules import RULE_PACK, Rule
from ..staging import stage


@dataclass
class Review:
    """All tables of a review job.

    ``pr_files`` are the raw changed files. The answer tables come from outside; without one, its stage adds
    nothing. Tables that several branches read (files, blocks, findings, work items, quality issues, fixes, tests, counts) are
    written once with ``stage``; everything else stays lazy. ``files`` are the rows of ``parsed``: branches that want keys
    read only these from it, instead of making every text again.
    """

    pr_files: DataFrame
    security_answers: DataFrame | None = None
    quality_answers: DataFrame | None = None
    fix_answers: DataFrame | None = None
    test_answers: DataFrame | None = None
    rules: list[Rule] | DataFrame | None = None
    # Whether Python files that do not parse give no functions (one Python call per file) or those recognised.
    only_parseable: bool = False

    @cached_property
    def reviews(self) -> DataFrame:
        return self.pr_files.select("review_id").distinct()

    @cached_property
    def parsed(self) -> DataFrame:
        return file_ops.parse_files(self.pr_files)

    @cached_property
    def files(self) -> DataFrame:
        return stage(self.parsed)

    @cached_property
    def quarantine(self) -> DataFrame:
        return file_ops.reject_malformed(self.pr_files)[1]

    @cached_property
    def blocks(self) -> DataFrame:
        files = file_ops.parseable(self.files) if self.only_parseable else self.files
        return stage(units.blocks(files))

    @cached_property
    def units(self) -> DataFrame:
        return units.functions_of(self.blocks)

    @cached_property
    def raw(self) -> DataFrame:
        """Findings of the three detection layers."""
        lines = scan.rule_scan(self.files, RULE_PACK if self.rules is None else self.rules)
        return scan.merge_layers(lines, scan.match_patterns(self.units))

    @cached_property
    def listed(self) -> DataFrame:
        return stage(triage.findings_for_file(self.raw, self.files))

    @cached_property
    def findings(self) -> DataFrame:
        if self.security_answers is None:
            return triage.finding_position(self.listed)
        return stage(triage.triaged(self.listed, self.security_answers))

    @cached_property
    def deduped(self) -> DataFrame:
        """The real findings, one per place and weakness family."""
        return stage(dedupe.dedupe_findings(self.findings, self.units))

    @cached_property
    def quality(self) -> DataFrame:
        found = quality_ops.metric_gates(self.blocks)
        if self.quality_answers is not None:
            found = found.unionByName(quality_ops.append_quality_answers(self.files, self.quality_answers))
        return stage(found)

    @cached_property
    def fix_items(self) -> DataFrame:
        return stage(worklist.first_n_fixes(self.findings, self.files))

    @cached_property
    def fixes(self) -> DataFrame:
        items = self.fix_items
        answers = self.fix_answers
        if answers is None:
            answers = self.pr_files.sparkSession.createDataFrame([], "review_id BIGINT, item INT, answer STRING")
        return stage(worklist.fix_rows(items, answers))

    @cached_property
    def test_files(self) -> DataFrame:
        return worklist.test_eligible(self.files, self.units, self.fixes)

    @cached_property
    def tests(self) -> DataFrame:
        answers = self.test_answers
        if answers is None:
            answers = self.pr_files.sparkSession.createDataFrame([], "review_id BIGINT, filename STRING, answer STRING")
        return stage(worklist.test_rows(self.test_files, answers))

    @cached_property
    def counts(self) -> DataFrame:
        return stage(report_ops.summary_counts(
            self.reviews, self.files, self.findings, self.quality, self.fixes, self.tests
        ))

    @cached_property
    def report(self) -> dict[str, DataFrame]:
        """The report: header rows and the four row tables."""
        return {
            "header": report_ops.report_headers(self.counts),
            "security_issues": self.findings,
            "quality_issues": self.quality,
            "fixes": self.fixes,
            "tests": self.tests,
        }

    @cached_property
    def comment(self) -> DataFrame:
        return report_ops.comment_markdown(self.counts, self.findings, self.fixes, self.tests)


def merge_branches(security: DataFrame, quality: DataFrame) -> DataFrame:
    """Per review, the row counts of both branches; a review may occur in only one of them."""
    left = security.groupBy("review_id").agg(F.sum("copies").alias("n_security"))
    right = quality.groupBy("review_id").agg(F.count(F.lit(1)).alias("n_quality"))
    return left.join(right, "review_id", "full").fillna(0, ["n_security", "n_quality"])
