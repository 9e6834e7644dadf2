"""Report export: one nested document a file, with a manifest.

A document holds the head of a file's report, its totals, a table of severities and the findings in reporting order. It is put
together inside the file's row, from the ``found`` array of an analysed table, so no text and no finding is shuffled. Documents
are written as JSON lines, one open writer a task, and the manifest, which tells for every file the part that holds its
document, is written behind them: an export without a manifest is incomplete and not read. An export gets its number from
``sinks.claim``, so an interrupted one can be repeated under the same name and replaces only itself.

Files without findings have a document with an empty list. An empty table gives an empty export. Null scores stay null.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sieveline.functions.text import cwe_link, ellipsis, html_escape
from sieveline.operators.reports import percent
from sieveline.operators.scan import rule_table
from sieveline.rules import PACKS
from sieveline.schema import SEVERITIES
from sieveline.sources import sinks

HEAD = ("file_id", "filename", "language", "status", "risk_percent", "total")
_WORDING = ("title", "description", "recommendation", "cwe_id")


def _wording(spark: SparkSession, packs: dict) -> Column:
    """Language and rule to the rule's texts: a literal, as large as the packs."""
    rules = rule_table(spark, packs).select("language", "rule_id", *_WORDING).collect()
    pairs = [part for r in rules for part in (
        F.lit(f"{r['language']}/{r['rule_id']}"), F.struct(*(F.lit(r[name]).alias(name) for name in _WORDING)))]
    return F.create_map(*pairs) if pairs else F.expr(
        "map('', named_struct('title', '', 'description', '', 'recommendation', '', 'cwe_id', ''))")


def _place(finding: Column) -> Column:
    end = F.coalesce(finding["line_end"], F.lit(0))
    return F.concat(F.lit("line "), finding["line_start"].cast("string"),
                    F.when(end != 0, F.concat(F.lit("–"), end.cast("string"))).otherwise(""))


def documents(analysed: DataFrame, packs: dict = PACKS) -> DataFrame:
    """One row a file: the head, ``severities`` and ``findings``, from ``file_id, filename, language, status, risk_score, found``."""
    def told(f, at):
        rule = F.col("wording")[F.concat_ws("/", F.col("language"), f["rule_id"])]
        description = F.coalesce(f["description"], rule["description"])
        return F.struct(
            (at + 1).cast("long").alias("position"), F.upper(f["severity"]).alias("label"),
            html_escape(rule["title"]).alias("title"), _place(f).alias("place"), f["rule_id"].alias("rule_id"),
            rule["cwe_id"].alias("cwe_id"), cwe_link(rule["cwe_id"]).alias("link"), html_escape(description).alias("description"),
            html_escape(rule["recommendation"]).alias("recommendation"), ellipsis(description).alias("callout"))

    found = F.coalesce("found", F.array())
    counts = F.array(*(F.expr(f"named_struct('severity', '{s}', 'findings', size(filter(found, f -> f.severity = '{s}')))")
                       for s in SEVERITIES))
    return analysed.withColumn("found", found).withColumn("wording", _wording(analysed.sparkSession, packs)).select(
        "file_id", "filename", "language", "status", percent(F.col("risk_score")).alias("risk_percent"),
        F.size("found").alias("total"), counts.alias("severities"), F.transform("found", told).alias("findings"))


def write(docs: DataFrame, path: str, owner: str) -> int:
    """Writes an export and then its manifest; returns its number. ``owner`` names the export, which may be repeated."""
    spark = docs.sparkSession
    run = sinks.claim(spark, path, owner)
    to = f"{path}/documents/run={run}"
    docs.write.mode("overwrite").json(to)
    spark.read.schema(docs.select("file_id", "total").schema).json(to) \
        .select("file_id", "total", F.col("_metadata.file_name").alias("part")) \
        .write.mode("overwrite").parquet(f"{path}/manifest/run={run}")
    return run


def manifest(spark: SparkSession, path: str, run: int = None) -> DataFrame:
    """The manifest of an export, by default the last complete one: ``run, file_id, total, part``."""
    rows = spark.read.parquet(f"{path}/manifest")
    run = rows.agg(F.max("run")).first()[0] if run is None else run
    return rows.filter(F.col("run") == run).select("run", "file_id", "total", "part")


def read(spark: SparkSession, path: str, schema, run: int = None) -> DataFrame:
    """The documents of a complete export, by default of the last one. ``schema`` is that of ``documents``."""
    complete = f"{path}/manifest" if run is None else f"{path}/manifest/run={run}"
    if run is None:
        run = spark.read.parquet(complete).agg(F.max("run")).first()[0]
    else:
        spark.read.parquet(complete)  # fails where the export is incomplete
    return spark.read.schema(schema).json(f"{path}/documents/run={run}")


def heads(docs: DataFrame) -> DataFrame:
    """The heads of documents with a column for every severity."""
    return docs.select(*HEAD, *(F.expr(f"filter(severities, s -> s.severity = '{s}')[0].findings").alias(s) for s in SEVERITIES))


def findings(docs: DataFrame) -> DataFrame:
    """The findings of documents as rows."""
    return docs.select("file_id", F.explode("findings").alias("f")).select("file_id", "f.*")
