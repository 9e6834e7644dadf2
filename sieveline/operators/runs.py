"""Repeated runs: replace, compare, delete."""

from pyspark.sql import DataFrame, functions as F

from sieveline.operators.dedup import FINDING_KEY
from sieveline.schema import MAX_ERROR_TEXT


def runnable(files: DataFrame) -> DataFrame:
    """Files that may be analysed: not those being analysed already."""
    return files.filter(F.col("status") != "analyzing")


def replace_findings(old: DataFrame, new: DataFrame, scanned: DataFrame) -> DataFrame:
    """Findings after a run: the old ones of files outside it and all new ones."""
    kept = old.join(scanned.select("file_id"), "file_id", "left_anti")
    return kept.select(*new.columns).unionByName(new)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of every file, by an aggregate: many runs of one file are reduced
    before the shuffle."""
    others = [c for c in runs.columns if c != "file_id"]
    last = F.max_by(F.struct(*others), F.struct("analyzed_at", "run_id")).alias("last")
    return runs.groupBy("file_id").agg(last).select("file_id", "last.*")


def run_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings of two runs side by side: ``new``, ``fixed`` or ``unchanged``.  One
    aggregate over both instead of a full join: a single shuffle, reduced beforehand."""
    key = list(FINDING_KEY)
    both = old.select(*key, F.col("confidence_score").alias("old_confidence")).unionByName(
        new.select(*key, F.col("confidence_score").alias("new_confidence")), allowMissingColumns=True)
    change = F.when(F.col("old_confidence").isNull(), "new") \
        .when(F.col("new_confidence").isNull(), "fixed").otherwise("unchanged")
    return both.groupBy(*key).agg(F.max("old_confidence").alias("old_confidence"),
                                  F.max("new_confidence").alias("new_confidence")).withColumn("change", change)


def cascade_delete(deleted: DataFrame, projects: DataFrame, files: DataFrame, findings: DataFrame,
                   explanations: DataFrame) -> dict:
    """All four tables without the given projects and what belongs to them."""
    gone_files = files.join(deleted.select("project_id"), "project_id", "left_semi").select("file_id")
    gone_findings = findings.join(gone_files, "file_id", "left_semi").select("finding_id")
    return {
        "projects": projects.join(deleted.select("project_id"), "project_id", "left_anti"),
        "files": files.join(deleted.select("project_id"), "project_id", "left_anti"),
        "findings": findings.join(gone_files, "file_id", "left_anti"),
        "explanations": explanations.join(gone_findings, "finding_id", "left_anti"),
    }


def with_explanation_flag(findings: DataFrame, explanations: DataFrame) -> DataFrame:
    known = explanations.select("finding_id").distinct().withColumn("has_explanation", F.lit(True))
    return findings.join(known, "finding_id", "left").na.fill(False, ["has_explanation"])


def unexplained(findings: DataFrame, explanations: DataFrame) -> DataFrame:
    return findings.join(explanations.select("finding_id"), "finding_id", "left_anti")


def finished(files: DataFrame, scores: DataFrame, failures: DataFrame, now) -> DataFrame:
    """File rows after a run: complete with a score between 0 and 1, failed with the first
    2000 characters of the error, or untouched."""
    s = scores.select("file_id", F.col("risk_score").alias("new_risk"), F.col("duration_ms").alias("new_duration"))
    f = failures.select("file_id", F.substring("error", 1, MAX_ERROR_TEXT).alias("new_error"))
    done, broken = F.col("new_risk").isNotNull(), F.col("new_error").isNotNull()
    return files.join(s, "file_id", "left").join(f, "file_id", "left").select(
        *[c for c in files.columns if c not in ("status", "risk_score")],
        F.when(broken, "failed").when(done, "complete").otherwise(F.col("status")).alias("status"),
        F.when(done & ~broken, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("new_risk")))).alias("risk_score"),
        F.col("new_duration").alias("analysis_duration_ms"),
        F.coalesce("new_error", F.lit("")).alias("error_message"),
        F.when(done | broken, now).alias("analyzed_at"))
