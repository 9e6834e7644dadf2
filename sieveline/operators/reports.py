"""Views over files, findings and explanations."""

from pyspark.sql import Column, DataFrame, functions as F

from sieveline.functions.scoring import exact_round, percent, risk_badge, risk_band, shown_weight
from sieveline.functions.text import cwe_link, ellipsis, html_escape, line_range
from sieveline.operators.joins import with_children
from sieveline.operators.lines import covered_lines
from sieveline.operators.scan import describe
from sieveline.operators.score import mean_risk
from sieveline.schema import LANGUAGE_LABELS, SEVERITIES, severity_rank

# Fixed values.
PAGE_SIZE = 25

#: columns of a finding in a list; the long texts are left out
COMPACT_FINDING = ("finding_id", "title", "severity", "category", "line_start", "line_end", "line_range",
                   "rule_id", "confidence_score", "cwe_id", "owasp_category", "code_snippet")


def finding_id(file_id: Column, rule_id: Column, line_start: Column) -> Column:
    """A stable key, so that re-runs agree."""
    return F.sha2(F.concat_ws("|", file_id.cast("string"), rule_id, line_start.cast("string")), 256)


def with_ids(findings: DataFrame) -> DataFrame:
    return findings.withColumn("finding_id", finding_id(F.col("file_id"), F.col("rule_id"), F.col("line_start")))


def compact(findings: DataFrame) -> DataFrame:
    return with_ids(findings).withColumn("line_range", line_range(F.col("line_start"), F.col("line_end"))) \
        .select("file_id", *COMPACT_FINDING)


def language_label(language: Column) -> Column:
    out = F.lit("Unknown")
    for name, label in LANGUAGE_LABELS.items():
        out = F.when(language == name, label).otherwise(out)
    return out


def file_details(rows: DataFrame) -> DataFrame:
    """Files with their findings in list form, from finding rows that carry their file's
    columns (and one row for a file without findings).  The source column never leaves."""
    listed = with_ids(rows).withColumn("line_range", line_range(F.col("line_start"), F.col("line_end"))) \
        .withColumn("finding_id", F.when(F.col("rule_id").isNotNull(), F.col("finding_id")))
    return listed.drop("source", "encrypted_source", "description", "recommendation", "fixed_snippet") \
        .withColumn("language_display", language_label(F.col("language")))


def file_detail(files: DataFrame, findings: DataFrame, file_id) -> DataFrame:
    """One stored file with its findings; empty when the file is unknown."""
    wanted = F.col("file_id") == F.lit(file_id)
    shown = files.filter(wanted).drop("source", "encrypted_source")
    return shown.withColumn("language_display", language_label(F.col("language"))) \
        .join(compact(findings.filter(wanted)), "file_id", "left")


def project_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, finished files, findings, critical and high findings and mean risk.

    Findings are counted per file first, so one shuffle by project carries one row per
    file at most, and partial aggregation reduces even that.
    """
    return summarise_projects(files.join(severity_pivot(findings), "file_id", "left")
                              .withColumn("findings", sum(F.coalesce(s, F.lit(0)) for s in SEVERITIES)))


def summarise_projects(counted: DataFrame) -> DataFrame:
    """The same from file rows that carry their ``findings``, ``critical`` and ``high``."""
    return counted.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("status") == "complete").alias("completed_files"),
        F.coalesce(F.sum("findings"), F.lit(0)).alias("total_vulnerabilities"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical_count"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_count"),
        F.when(F.count("risk_score") > 0, mean_risk(F.col("risk_score"))).alias("overall_risk_score"))


def severity_pivot(findings: DataFrame) -> DataFrame:
    """Findings per file and severity; severities without any count zero."""
    return findings.groupBy("file_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def severity_table(findings: DataFrame) -> DataFrame:
    """The same in long form, severities without findings left out."""
    return findings.groupBy("file_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


def line_map(findings: DataFrame) -> DataFrame:
    """Per covered line: the worst severity, the number of findings and their titles."""
    rank = severity_rank(F.col("severity"))
    rows = covered_lines(findings).withColumn("entry", F.struct(
        rank.alias("rank"), "line_start", "ordinal", "rule_id", "title", "severity"))
    return rows.groupBy("file_id", "line_no").agg(
        F.min("entry").alias("top"), F.count(F.lit(1)).alias("findings"),
        F.array_sort(F.collect_list("entry")).alias("entries")) \
        .select("file_id", "line_no", F.col("top.severity").alias("top_severity"), "findings",
                F.array_join(F.transform("entries", lambda e: e["title"]), ", ").alias("titles"),
                F.when(F.col("findings") > 1, F.col("findings").cast("string")).otherwise("!").alias("marker"))


def by_severity(findings: DataFrame, severity: str = "all") -> DataFrame:
    return findings if severity == "all" else findings.filter(F.col("severity") == severity)


def risk_bands(scores: DataFrame) -> DataFrame:
    score = F.col("risk_score")
    return scores.select("file_id", "risk_score", risk_band(score).alias("band"),
                         risk_badge(score).alias("badge"), percent(score).alias("percent"),
                         exact_round(score * 100, 0).cast("int").alias("percent_even"))


def severity_weights(findings: DataFrame) -> DataFrame:
    """Findings with the weight shown beside them."""
    return findings.withColumn("severity_weight", shown_weight(F.col("severity")))


def default_files(files: DataFrame) -> DataFrame:
    """Per project the file to open: the first finished one, else the first."""
    first = F.min(F.struct((F.col("status") != "complete").alias("open"), "uploaded_at", "file_id")).alias("f")
    return files.groupBy("project_id").agg(first).select("project_id", "f.file_id")


def listing(projects: DataFrame, files: DataFrame, page: int = 0) -> DataFrame:
    """One page of projects, newest first, with their number of files and the total."""
    counts = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    total = projects.agg(F.count(F.lit(1)).alias("count"))
    return projects.join(counts, "project_id", "left").na.fill(0, ["files"]) \
        .orderBy(F.desc("created_at"), "project_id").offset(PAGE_SIZE * page).limit(PAGE_SIZE) \
        .withColumn("count", total.scalar())


def report_header(scored: DataFrame) -> DataFrame:
    """The head of each file's report, from file rows that carry their counts."""
    return scored.select(
        "file_id", "filename", "language", "status", percent(F.col("risk_score")).alias("risk_percent"),
        F.col("findings").alias("total"), *SEVERITIES)


def report_findings(analysed: DataFrame, detail_limit: int = None) -> DataFrame:
    """The findings of each report in order, from analysed files and their ``found`` arrays,
    which are in that order.  With a limit full texts appear only where a file has at most so
    many findings."""
    rows = analysed.select("file_id", "language", F.size("found").alias("in_file"), F.posexplode_outer("found").alias("at", "f")) \
        .filter(F.col("f").isNotNull()) \
        .select("file_id", "language", "in_file", (F.col("at") + 1).cast("long").alias("position"), "f.*")
    found = describe(rows, keep=("in_file", "position"))
    full = F.lit(True) if detail_limit is None else F.col("in_file") <= detail_limit
    end = F.coalesce("line_end", F.lit(0))
    return found.select(
        "file_id", "position", F.upper("severity").alias("label"),
        html_escape(F.col("title")).alias("title"),
        F.concat(F.lit("line "), F.col("line_start").cast("string"),
                 F.when(end != 0, F.concat(F.lit("–"), end.cast("string"))).otherwise("")).alias("place"),
        "rule_id", "cwe_id", cwe_link(F.col("cwe_id")).alias("link"),
        F.when(full, html_escape(F.col("description"))).alias("description"),
        F.when(full, html_escape(F.col("recommendation"))).alias("recommendation"),
        ellipsis(F.col("description")).alias("callout"))


def navigation(analysed: DataFrame) -> DataFrame:
    """Next and previous finding inside the file, wrapping at the ends: the neighbours in the
    ``found`` array, which is in reporting order."""
    ids = F.transform("found", lambda f: finding_id(F.col("file_id"), f["rule_id"], f["line_start"]))
    return analysed.select("file_id", F.explode_outer(F.array(ids)).alias("ids")) \
        .select("file_id", "ids", F.posexplode_outer("ids").alias("at", "finding_id")).filter(F.col("finding_id").isNotNull()) \
        .select("file_id", (F.col("at") + 1).cast("long").alias("position"), "finding_id",
                F.get("ids", F.pmod(F.col("at") + 1, F.size("ids"))).alias("next_id"),
                F.get("ids", F.pmod(F.col("at") - 1 + F.size("ids"), F.size("ids"))).alias("previous_id"))


def risk_rollup(rows: DataFrame) -> DataFrame:
    """Findings by project, file and severity with all subtotals in one pass, from finding
    rows that carry their project."""
    return rows.rollup("project_id", "file_id", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.grouping_id().cast("int").alias("level"))


def facets(rows: DataFrame) -> DataFrame:
    """Findings by language and severity with all margins."""
    return rows.cube("language", "severity").agg(F.count(F.lit(1)).alias("findings"))


def rule_coverage(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule with the findings and files it produced; zero for those that never fired."""
    per_file = findings.groupBy("rule_id", "file_id").agg(F.count(F.lit(1)).alias("n"))
    used = per_file.groupBy("rule_id").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("files"))
    known = rules.groupBy("rule_id").agg(F.min("title").alias("title"), F.min("severity").alias("severity"))
    return known.join(used, "rule_id", "left").na.fill(0, ["findings", "files"])


def project_tree(projects: DataFrame, files: DataFrame, findings: DataFrame, explanations: DataFrame) -> DataFrame:
    """Projects with their files, findings and explanations; missing branches stay as NULL."""
    v = with_ids(findings).select("file_id", "finding_id", "rule_id", "line_start") \
        .join(explanations.select("finding_id", "top_feature_name"), "finding_id", "left")
    f = with_children(files.select("project_id", "file_id", "filename"), v, "file_id")
    return with_children(projects.select("project_id", "name"), f, "project_id")


def fix_diff(findings: DataFrame) -> DataFrame:
    """Removed lines, then added lines of every finding."""
    def side(column, tag):
        text = F.coalesce(column, F.lit(""))
        return F.transform(F.split(text, "\n"), lambda line, i: F.struct(
            F.lit(tag).alias("change"), i.alias("n"), html_escape(line).alias("text")))
    rows = F.concat(side("code_snippet", "removed"), side("fixed_snippet", "added"))
    return findings.select("file_id", "rule_id", "line_start", F.posexplode(rows).alias("position", "d")) \
        .select("file_id", "rule_id", "line_start", "position", "d.change", "d.text")
