"""The stored tree: projects, files, findings and explanations as one table.

A row is a finding with the keys of its file and project and its explanation as a struct; a file without findings is one row
without a finding. So every level carries the keys of those above it, a level is a filter and a column selection of the
table, and going up or down the tree needs no chain of joins. The source text is read once, when the tree grows; it is not
stored.

The table is versioned by runs (``sources.sinks``): a run holds the files it scanned, readers see every file's last complete
run, a failed run changes nothing.

Null keys: files without a project are kept and belong to none. An empty corpus gives an empty tree. Files of the same id
share one row set and should not occur.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sieveline.operators import explain
from sieveline.operators.joins import with_children
from sieveline.operators.reports import finding_id
from sieveline.operators.scan import describe, local_findings
from sieveline.rules import PACKS
from sieveline.sources import sinks

#: what an explanation holds
EXPLANATION = ("method", "base_value", "prediction", "features", "lime", "summary", "top_feature_name", "top_feature_importance")
#: columns of the tree that belong to a file
FILE_COLUMNS = ("project_id", "file_id", "filename", "language")


def grow(files: DataFrame, explained: Column = None, packs: dict = PACKS, keep=(), noise: str = "none") -> DataFrame:
    """The rows of the tree from files with their ``source``, in one scan without a shuffle.

    ``explained`` tells from a finding's columns which ones get their explanation now, by default none; ``keep`` names
    further columns of files. ``head`` marks one row of every file.
    """
    carried = list(dict.fromkeys([*FILE_COLUMNS, *keep]))
    found = local_findings(files, packs, signals=True)
    rows = found.select(*carried, F.posexplode_outer("found").alias("at", "f")) \
        .withColumn("head", F.coalesce("at", F.lit(0)) == 0).select(*carried, "head", "f.*")
    rows = describe(rows, packs, (*carried, "head")).withColumn("finding_id", F.when(
        F.col("rule_id").isNotNull(), finding_id(F.col("file_id"), F.col("rule_id"), F.col("line_start"))))
    return _explained(rows, F.lit(False) if explained is None else explained, noise)


def _explained(rows: DataFrame, chosen: Column, noise: str) -> DataFrame:
    """Rows with ``explanation`` where ``chosen``. The others go through without features, which costs next to nothing."""
    plain = [c for c in rows.columns if c != "explanation"]
    kept = F.col("explanation") if "explanation" in rows.columns else F.lit(None)
    narrowed = rows.withColumn("chosen", F.coalesce(chosen & F.col("finding_id").isNotNull(), F.lit(False))) \
        .withColumn("reasons", F.col("shap_features")).withColumn("shap_features", F.when(F.col("chosen"), F.col("reasons")))
    told = explain.explain(narrowed, noise)
    columns = [F.col("reasons").alias(c) if c == "shap_features" else F.col(c) for c in plain]
    return told.select(*columns, F.when(F.col("chosen"), F.struct(*EXPLANATION)).otherwise(kept).alias("explanation"))


def explain_missing(tree: DataFrame, noise: str = "none") -> DataFrame:
    """The tree with an explanation of every finding; those it has are left as they are."""
    return _explained(tree, F.col("explanation").isNull(), noise)


# --- levels -----------------------------------------------------------------------------

def projects(tree: DataFrame) -> DataFrame:
    """Projects that have files, with their numbers of files, findings and explanations; reduced before the shuffle."""
    return tree.filter(F.col("project_id").isNotNull()).groupBy("project_id").agg(
        F.count_if("head").alias("files"), F.count("finding_id").alias("findings"), F.count("explanation").alias("explanations"))


def files(tree: DataFrame, keep=()) -> DataFrame:
    return tree.filter("head").select(*FILE_COLUMNS, *keep)


def findings(tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("finding_id").isNotNull()).drop("head", "explanation")


def explanations(tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("explanation").isNotNull()).select(
        "project_id", "file_id", "finding_id", F.col("title").alias("finding_title"), "explanation.*")


def unexplained(tree: DataFrame) -> DataFrame:
    """Findings without an explanation, with all that explaining takes."""
    return findings(tree.filter(F.col("explanation").isNull()))


# --- up and down ------------------------------------------------------------------------

def under(listed: DataFrame, tree: DataFrame) -> DataFrame:
    """The rows of the tree below the given projects; a project without files is one row without them."""
    return with_children(listed, tree, "project_id")


def without(tree: DataFrame, deleted: DataFrame) -> DataFrame:
    """The tree without the projects in ``deleted`` and everything below them: one anti join for all levels."""
    return tree.join(deleted.select("project_id").distinct(), "project_id", "left_anti")


def files_with(tree: DataFrame, finding: Column) -> DataFrame:
    """All rows of files with at least one finding of a kind. Keys go up reduced, a row a file at most."""
    hit = tree.filter(F.col("finding_id").isNotNull() & finding).select("file_id").distinct()
    return tree.join(hit, "file_id", "left_semi")


def projects_with(tree: DataFrame, finding: Column) -> DataFrame:
    """All rows of projects with at least one finding of a kind; a row a project goes up."""
    hit = tree.filter(F.col("finding_id").isNotNull() & finding).select("project_id").distinct()
    return tree.join(hit, "project_id", "left_semi")


# --- storage ----------------------------------------------------------------------------

def store(tree: DataFrame, path: str, owner: str) -> int:
    """Adds the tree of some files as one run and returns its number; ``owner`` names the piece of work, which may repeat."""
    run = sinks.claim(tree.sparkSession, path, owner)
    sinks.append_run(tree, None, path, run)
    return run


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of a stored tree."""
    return sinks.read_latest(spark, path)
