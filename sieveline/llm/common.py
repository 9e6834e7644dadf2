"""Helpers shared by the operators of this folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sieveline.session import shared_folder

#: characters that part words: blank, tab, line feed, vertical tab, form feed, carriage return
GAPS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` below ``spark.checkpoint.dir`` and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: str) -> list[bytes]:
    """The words of a text as UTF-8: ``bytes.split`` parts at exactly the characters of ``GAPS``."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def remainder(column: str, modulus: int):
    """crc32 of a number's decimal text, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def sampled(rows: DataFrame, key: str, by: str, limit: int | dict) -> DataFrame:
    """About ``limit`` rows of every value of ``by``, at most twice that, chosen by a hash of the key.

    Values with fewer rows stay whole. Null values of ``by`` are left out. A dict has a limit for each value.
    """
    counts = rows.filter(F.col(by).isNotNull()).groupBy(by).count().collect()
    parts = []
    for value, count in sorted(map(tuple, counts)):
        most = limit[value] if isinstance(limit, dict) else limit
        place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000)) < 1_000_000 * most // max(1, count)
        chosen = rows.filter(F.col(by) == F.lit(value)).filter(place if count > most else F.lit(True))
        parts.append(chosen.limit(2 * most))
    out = rows.limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


def range_starts(base: DataFrame, range_chars: int, accuracy: int = 100_000) -> tuple:
    """Where ranges of the key ``k`` start, so that each holds about ``range_chars`` characters of ``t``.

    Returns the ascending starts (keys of the table, the least first; empty without any), whether there are null keys, and
    the number of characters.
    """
    facts = base.agg(F.sum(F.length("t")).alias("chars"), F.max(F.col("k").isNull()).alias("nulls"),
                     F.min("k").alias("least")).first()
    chars, least = facts["chars"] or 0, facts["least"]
    ranges = 1 + chars // range_chars
    starts = [] if least is None else [least]
    if starts and ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        starts = sorted({least, *base.agg(F.percentile_approx("k", cuts, accuracy)).first()[0]})
    return starts, bool(facts["nulls"]), chars


def range_of(starts: list):
    """The number of the range that holds the key ``k``; null keys lie in the first."""
    if len(starts) < 2:
        return F.lit(0)
    start = F.array(*(F.lit(s) for s in starts))
    return F.coalesce(F.greatest(F.lit(0), F.size(F.filter(start, lambda s: s <= F.col("k"))) - 1), F.lit(0))
