"""Merging findings of several sources."""

from pyspark.sql import DataFrame, functions as F

FINDING_KEY = ("file_id", "rule_id", "line_start")


def deduplicate(findings: DataFrame, key=FINDING_KEY) -> DataFrame:
    """One finding per key: the highest confidence, the earlier one when equal.

    The survivor takes the position (``ordinal``) of the first finding of its key.  This is
    an aggregate, not a window: copies of one key are reduced before the shuffle, however
    many there are.
    """
    others = [c for c in findings.columns if c not in key and c != "ordinal"]
    best = F.max_by(F.struct(*others), F.struct("confidence_score", -F.col("ordinal")))
    return (findings.groupBy(*key).agg(best.alias("best"), F.min("ordinal").alias("ordinal"))
            .select(*key, "best.*", "ordinal").select(*findings.columns))


def merge(local: DataFrame, external: DataFrame = None) -> DataFrame:
    """Local and external findings, local ones first.  Without an external feed the local
    findings are returned unchanged."""
    if external is None:
        return local
    return deduplicate(local.unionByName(external))
