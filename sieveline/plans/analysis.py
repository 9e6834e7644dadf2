"""The main job: files in, one analysed row per file out.

Scan, structure checks, order, risk score and metrics of a file need nothing but the file,
so the whole job is a single stage without a shuffle.  Write its result once; every report
reads from there.
"""

from pyspark.sql import DataFrame, functions as F

from sieveline.functions.scoring import risk_of_ranked, risk_weight
from sieveline.functions.text import stored_line_count
from sieveline.operators.lines import computed_once
from sieveline.operators.scan import finding_rows, local_findings
from sieveline.operators.structure import metrics
from sieveline.rules import PACKS
from sieveline.schema import SEVERITIES


def analyze(files: DataFrame, packs: dict = PACKS, signals: bool = False) -> DataFrame:
    """``file_id, project_id, filename, language, size_bytes, stored_line_count, risk_score,
    metrics, found`` with ``found`` in reporting order."""
    sized = files.withColumn("stored_line_count", stored_line_count(F.col("source"))) \
        .withColumn("size_bytes", F.octet_length("source"))
    found = local_findings(sized, packs, signals=signals)
    weights = F.transform("found", lambda f: risk_weight(f["severity"]) * f["confidence_score"])
    return found.withColumn("risk_score", risk_of_ranked(weights)) \
        .withColumn("metrics", metrics()).drop("lines")


def file_scores(files: DataFrame, packs: dict = PACKS) -> DataFrame:
    """Risk and counts per file without the findings themselves, still without a shuffle."""
    found = local_findings(files, packs, signals=False)
    weights = F.transform("found", lambda f: risk_weight(f["severity"]) * f["confidence_score"])
    counts = [F.expr(f"size(filter(found, f -> f.severity = '{s}'))").alias(s) for s in SEVERITIES]
    rated = found.select("file_id", "project_id", "filename", "language",
                         risk_of_ranked(weights).alias("risk_score"), F.size("found").alias("findings"), *counts)
    return computed_once(rated, "risk_score", "findings", *SEVERITIES)


def findings_of(analyzed: DataFrame, packs: dict = PACKS) -> DataFrame:
    """The finding rows of an analysed table."""
    return finding_rows(analyzed, packs)


def top_files(scores: DataFrame, limit: int = 25) -> DataFrame:
    """Files with the highest risk, a top-k report."""
    return scores.orderBy(F.desc("risk_score"), "file_id").limit(limit)
