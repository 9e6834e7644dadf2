"""Files to lines."""

from pyspark.sql import DataFrame, functions as F

from sieveline.functions.text import split_lines


def with_lines(files: DataFrame) -> DataFrame:
    """Replace ``source`` by ``lines``, an array kept inside the file row.

    Per-file work reads this array in place, so nothing has to be shuffled back together.
    """
    return files.withColumn("lines", split_lines(F.col("source"))).drop("source")


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line: ``file_id, language, line_no, line``."""
    lined = files.select("file_id", "language", split_lines(F.col("source")).alias("lines"))
    return (lined.select("file_id", "language", F.posexplode_outer("lines").alias("pos", "line"))
            .filter(F.col("pos").isNotNull())
            .select("file_id", "language", (F.col("pos") + 1).alias("line_no"), "line"))


def unnest(rows: DataFrame, array: str, name: str, keep) -> DataFrame:
    """One row per element of a computed array.

    A plain ``explode`` lets the optimizer put a "not empty" filter below it, which repeats
    the whole computation of the array; dropping the empty ones afterwards does not.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def covered_lines(findings: DataFrame) -> DataFrame:
    """Repeat each finding for every line of its range."""
    last = F.when(F.coalesce("line_end", F.lit(0)) == 0, F.col("line_start")).otherwise(F.col("line_end"))
    return findings.filter(last >= F.col("line_start")) \
        .withColumn("line_no", F.explode(F.sequence("line_start", last)))


def computed_once(rows: DataFrame, *names: str) -> DataFrame:
    """Rows with the named columns computed in place, once.

    A filter on a computed column is normally moved below the projection with the whole
    expression copied into it; for long expressions built on each other the copies multiply.
    Passing the columns through a one-element ``explode_outer`` keeps such filters above.
    """
    others = [c for c in rows.columns if c not in names]
    packed = F.explode_outer(F.array(F.struct(*names))).alias("once")
    return rows.select(*others, packed).select(*others, "once.*")
