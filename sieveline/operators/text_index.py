"""An index of character triples over the searched columns of a table.

Three stored tables, each grown by ``add`` and never rewritten:

* ``values``: the distinct lower-case texts, by their hash;
* ``triples``: triple of characters -> hash of a text, in folders by a hash of the triple;
* ``holders``: hash of a text -> key of a row, in folders by a hash of that hash.

A search word of three characters or more reads the folders of its triples alone, keeps the texts that hold all of them and
then looks whether they hold the word; shorter words look at the distinct texts. Texts that many rows share, such as the title
of a rule, are indexed and tested once. What comes out is tested again on the rows themselves, so a row that changed since it was
indexed, or two texts with one hash, give no wrong row. Rows that were not added are not found.

Null texts count as empty. Empty tables, repeated rows and repeated additions are allowed. A word without characters finds every row.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sieveline.operators.search import contains_word
from sieveline.session import written

BUCKETS = 256
#: overlapping triples of characters, in one pass over a text of any length
_TRIPLES = r"(?s)(?=(...))"


def _bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def add(table: DataFrame, key: str, columns, path: str, buckets: int = BUCKETS) -> None:
    """Index the rows of ``table``, whose ``key`` names a row, by their text in ``columns``. ``buckets`` has to stay the same."""
    text = F.explode(F.array_distinct(F.array(*(F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns))))
    held = written(table.select(F.col(key).alias("key"), text.alias("text")).withColumn("value", F.xxhash64("text")), "texts")
    distinct = written(held.select("value", "text").distinct(), "values")
    distinct.write.mode("append").parquet(f"{path}/values")
    # ranges of triple and text: a triple that most texts hold is cut into several
    held_triples = F.array_distinct(F.regexp_extract_all("text", F.lit(_TRIPLES), F.lit(1)))
    # written first, as finding the ranges reads them too
    triples = written(distinct.select("value", held_triples.alias("triples")), "triples") \
        .select("value", F.explode("triples").alias("triple")).withColumn("bucket", _bucket(F.col("triple"), buckets))
    triples.repartitionByRange("bucket", "triple", "value").sortWithinPartitions("bucket", "triple") \
        .write.mode("append").partitionBy("bucket").parquet(f"{path}/triples")
    held.select("value", "key", _bucket(F.col("value"), buckets).alias("bucket")) \
        .repartitionByRange("bucket", "value", "key").sortWithinPartitions("bucket", "value") \
        .write.mode("append").partitionBy("bucket").parquet(f"{path}/holders")


def _hash_of(spark: SparkSession, words, buckets: int) -> list:
    """The folders of some triples; the literals are those of one search word."""
    row = spark.range(1).select(*(_bucket(F.lit(w), buckets) for w in words)).first()
    return sorted(set(row))


def values_with(spark: SparkSession, path: str, part: str, buckets: int = BUCKETS) -> DataFrame:
    """``value``: the hashes of the indexed texts that hold ``part``, which is lower case."""
    texts = spark.read.schema("value long, text string").parquet(f"{path}/values")
    wanted = sorted({part[i:i + 3] for i in range(len(part) - 2)})
    if wanted:
        posted = spark.read.schema("value long, triple string, bucket int").parquet(f"{path}/triples") \
            .filter(F.col("bucket").isin(_hash_of(spark, wanted, buckets)) & F.col("triple").isin(wanted))
        # an index grown by several additions may hold a pair twice
        having = posted.groupBy("value").agg(F.count_distinct("triple").alias("n")).filter(F.col("n") == len(wanted))
        texts = texts.join(having, "value", "left_semi")
    return texts.filter(F.contains("text", F.lit(part))).select("value").distinct()


def keys_with(spark: SparkSession, path: str, word: str, buckets: int = BUCKETS, key_type: str = "long") -> DataFrame:
    """``key``: the rows that hold every blank-separated part of ``word`` in one of their texts."""
    holders = spark.read.schema(f"value long, key {key_type}, bucket int").parquet(f"{path}/holders")
    parts = sorted(set(word.lower().split()))
    if not parts:
        return holders.select("key").distinct()
    found = None
    for n, part in enumerate(parts):
        values = values_with(spark, path, part, buckets).select("value", _bucket(F.col("value"), buckets).alias("bucket"))
        keys = holders.join(values, ["bucket", "value"], "left_semi").select("key", F.lit(n).alias("part"))
        found = keys if found is None else found.unionByName(keys)
    return found.groupBy("key").agg(F.count_distinct("part").alias("n")).filter(F.col("n") == len(parts)).select("key")


def search(table: DataFrame, key: str, columns, path: str, word: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``table`` that ``search.contains_word`` finds, by way of the index."""
    kind = table.schema[key].dataType.simpleString()
    keys = keys_with(table.sparkSession, path, word, buckets, kind).withColumnRenamed("key", key)
    return table.join(keys, key, "left_semi").filter(contains_word(word, columns))
