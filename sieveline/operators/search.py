"""Searches and filters over the stored tables.

A search word matches any of a table's text columns, ignoring case and anywhere inside.
"""

from pyspark.sql import Column, DataFrame, functions as F

# Columns that are searched and filters that are offered.
SEARCHED = {
    "projects": ("name", "description"),
    "files": ("filename", "project_name"),
    "findings": ("title", "description", "rule_id", "cwe_id"),
    "explanations": ("finding_title", "top_feature_name", "summary"),
}
PERIODS = ("any", "today", "past_7_days", "this_month", "this_year")


def contains_word(word: str, columns) -> Column:
    """Every blank-separated word must occur in one of the columns."""
    out = F.lit(True)
    for part in word.lower().split():
        hit = F.lit(False)
        for column in columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(part))
        out = out & hit
    return out


def _filtered(table: DataFrame, filters: dict) -> DataFrame:
    for column, value in filters.items():
        if value is not None:
            table = table.filter(F.col(column) == F.lit(value))
    return table


def in_period(created_at: Column, period: str, today: Column) -> Column:
    """Date facet on a timestamp; ``today`` is a date, so that a report can be repeated."""
    day = F.to_date(created_at)
    if period == "any":
        return F.lit(True)
    if period == "today":
        return day == today
    if period == "past_7_days":
        return (day >= F.date_sub(today, 7)) & (day <= today)
    if period == "this_month":
        return F.date_trunc("month", created_at) == F.date_trunc("month", today)
    if period == "this_year":
        return F.year(created_at) == F.year(today)
    raise ValueError(period)


def search_projects(projects: DataFrame, word: str = "", period: str = "any", today: Column = None) -> DataFrame:
    today = F.current_date() if today is None else today
    return projects.filter(contains_word(word, SEARCHED["projects"])) \
        .filter(in_period(F.col("created_at"), period, today))


def search_files(files: DataFrame, projects: DataFrame, word: str = "", language: str = None,
                 status: str = None) -> DataFrame:
    """Files by their name or the name of their project."""
    named = projects.select("project_id", F.col("name").alias("project_name"))
    return _filtered(files, {"language": language, "status": status}).join(named, "project_id") \
        .filter(contains_word(word, SEARCHED["files"]))


def search_findings(findings: DataFrame, files: DataFrame, word: str = "", severity: str = None,
                    category: str = None, language: str = None) -> DataFrame:
    """Findings by their texts and ids, filtered also by the language of their file.  The
    file table is joined only where the findings do not carry the language themselves."""
    rows = _filtered(findings, {"severity": severity, "category": category}) \
        .filter(contains_word(word, SEARCHED["findings"]))
    if language is None:
        return rows
    if "language" in findings.columns:
        return rows.filter(F.col("language") == language)
    return rows.join(files.filter(F.col("language") == language).select("file_id"), "file_id", "left_semi")


def search_explanations(explanations: DataFrame, word: str = "", method: str = None) -> DataFrame:
    return _filtered(explanations, {"method": method}) \
        .filter(contains_word(word, SEARCHED["explanations"]))
