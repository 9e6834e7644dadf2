"""Ranks, risk scores and counts over finding tables."""

from pyspark.sql import DataFrame, Window, functions as F

from sieveline.functions.scoring import RISK_CAP, RISK_FACTOR, exact_round, risk_weight
from sieveline.schema import severity_rank
from sieveline.session import written

#: lines per block when the findings of one file are ranked in pieces
BLOCK_LINES = 1024


def rank_in_file(findings: DataFrame) -> DataFrame:
    """Add ``rank``, the position (from 0) inside the file by severity, line and ordinal.

    Ranks are taken inside blocks of 1024 lines and shifted by the sizes of the blocks
    before, so a file that holds a large share of all findings is still split over tasks.
    """
    keyed = findings.withColumn("sev_rank", severity_rank(F.col("severity"))) \
        .withColumn("block", F.floor(F.col("line_start") / BLOCK_LINES))
    block = ["file_id", "sev_rank", "block"]
    before = Window.partitionBy("file_id").orderBy("sev_rank", "block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    shift = keyed.groupBy(*block).agg(F.count(F.lit(1)).alias("size")) \
        .withColumn("shift", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    inside = Window.partitionBy(*block).orderBy("line_start", "ordinal", "rule_id")
    return (keyed.withColumn("inside", F.row_number().over(inside)).join(shift, block)
            .withColumn("rank", F.col("shift") + F.col("inside") - 1)
            .drop("sev_rank", "block", "inside", "shift"))


def file_risk(findings: DataFrame) -> DataFrame:
    """Risk per file of a finding table: ``file_id, risk_score, findings``.

    Contributions are added as decimals, so the result does not depend on partitioning.  Ranks and the sizes of blocks both
    read the findings, which are therefore computed once and written with the few columns that count.
    """
    needed = findings.select("file_id", "rule_id", "line_start", "severity", "confidence_score", "ordinal")
    part = (risk_weight(F.col("severity")) * F.col("confidence_score")
            * (F.lit(1.0) / F.sqrt(F.col("rank") + 1)) * F.lit(RISK_FACTOR))
    return (rank_in_file(written(needed, "rated")).withColumn("part", part.cast("decimal(24,18)"))
            .groupBy("file_id").agg(F.sum("part").cast("double").alias("total"),
                                    F.count(F.lit(1)).alias("findings"))
            .select("file_id", exact_round(F.least("total", F.lit(RISK_CAP)), 4).alias("risk_score"), "findings"))


def mean_risk(score) -> "Column":
    """Mean of four-digit scores over whole ten-thousandths: the same in any order."""
    units = F.bround(score * 10000).cast("long")
    return F.sum(units) / F.lit(10000.0) / F.count(score)


def project_risk(scores: DataFrame) -> DataFrame:
    """Mean of the known file scores; NULL for a project without any."""
    return scores.groupBy("project_id").agg(
        F.when(F.count("risk_score") > 0, mean_risk(F.col("risk_score"))).alias("overall_risk_score"))


def file_counts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings and critical findings of every file, zero included."""
    counts = findings.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("severity") == "critical").alias("critical"))
    return files.select("file_id").join(counts, "file_id", "left").na.fill(0, ["findings", "critical"])


def in_text_order(findings: DataFrame) -> DataFrame:
    """Add ``position``, the place (from 1) inside the file in the stored listing order:
    severity as text, descending, then line."""
    order = Window.partitionBy("file_id").orderBy(F.desc("severity"), "line_start", "ordinal")
    return findings.withColumn("position", F.row_number().over(order))
