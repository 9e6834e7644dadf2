"""Writing results.

A table grows by runs.  A run writes its rows to a folder of its own and then, as the mark
that it is complete, the files it scanned; nothing written before is touched.  Reading takes
for every file the rows of its last complete run.  So a run costs what it scanned, a failed
run changes nothing, and a repeated run replaces only itself.  ``compact`` rewrites the
latest state as one run, apart from the runs, ``fold`` as one further run of the same table.

Writers that do not know of each other get their numbers from ``claim``: a number is taken by creating a file that must not
exist yet, and is kept under the writer's name, so the same piece of work has the same number when it is repeated. A number
whose run never completes is simply left out.
"""

import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def append_run(new: DataFrame, scanned: DataFrame, path: str, run: int) -> None:
    """Add the rows of one run.  ``scanned`` names its files (``file_id``), also those without
    rows now; a higher ``run`` wins. None means that every file has a row: they are read from the rows just written."""
    new.write.mode("overwrite").parquet(f"{path}/rows/run={run}")
    if scanned is None:
        scanned = new.sparkSession.read.schema(new.schema).parquet(f"{path}/rows/run={run}")
    scanned.select("file_id").distinct().write.mode("overwrite").parquet(f"{path}/files/run={run}")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """For every file the rows of its last complete run; of folded runs the run they stem from counts."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/rows")
    last = _last_runs(spark, path).select("file_id", "run")
    return rows.join(last, ["file_id", "run"], "left_semi").drop("run")


def _last_runs(spark: SparkSession, path: str) -> DataFrame:
    """file_id, the run to read it from, and ``stems``, the run that scanned it."""
    marks = spark.read.option("mergeSchema", "true").parquet(f"{path}/files")
    stems = F.coalesce("stems", "run") if "stems" in marks.columns else F.col("run")
    return marks.select("file_id", "run", stems.cast("long").alias("stems")).groupBy("file_id").agg(
        F.max(F.struct("stems", "run")).alias("x")).select("file_id", "x.run", "x.stems")


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as its own kind of object."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def _said(fs, at) -> str:
    """The first line of a small file."""
    stream = fs.open(at)
    try:
        return (stream.readLine() or "").strip()
    finally:
        stream.close()


def _create(spark: SparkSession, fs, at) -> bool:
    """Creates an empty file that must not exist yet, in one step; whether it was this writer."""
    if fs.getScheme() == "file":  # Spark's local file system looks first and creates then
        return spark.sparkContext._jvm.java.io.File(at.toUri().getPath()).createNewFile()
    try:
        return fs.createNewFile(at)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error):
            return False
        raise


def _say(spark: SparkSession, fs, at, text: str) -> bool:
    """Writes a small file unless it is there; whether it was this writer."""
    if not _create(spark, fs, at):
        return False
    stream = fs.create(at, True)
    try:
        stream.writeBytes(text + "\n")
    finally:
        stream.close()
    return True


def claim(spark: SparkSession, path: str, owner: str) -> int:
    """The run number of a piece of work: the one it has from an earlier attempt, or a new one of its own.

    ``owner`` names the work, such as a stream and its batch. The number is behind all that are taken or complete.
    """
    fs, log, at = _folder(spark, f"{path}/log")
    fs.mkdirs(log)
    own = at(f"{path}/log/owner-{hashlib.sha256(owner.encode()).hexdigest()}")
    if fs.exists(own) and (told := _said(fs, own)):
        return int(told)
    taken = [int(f.getPath().getName()[4:]) for f in fs.listStatus(log) if f.getPath().getName().startswith("run-")]
    run = max(1 + max(taken, default=-1), next_run(spark, path))
    while not _create(spark, fs, at(f"{path}/log/run-{run}")):
        run += 1
    if not _say(spark, fs, own, str(run)) and (told := _said(fs, own)):
        return int(told)  # another attempt at the same work was faster
    return run


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The lasting id of a stream, from its checkpoint."""
    import json
    fs, at, _ = _folder(spark, f"{checkpoint}/metadata")
    return json.loads(_said(fs, at))["id"]


def next_run(spark: SparkSession, path: str) -> int:
    """The number behind the last complete run; 0 for a new table."""
    try:
        return 1 + spark.read.parquet(f"{path}/files").agg(F.max("run")).first()[0]
    except AnalysisException:
        return 0


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The latest state of a table as a new table of one run."""
    files = spark.read.parquet(f"{path}/files").select("file_id")
    append_run(read_latest(spark, path), files, to, 0)


def fold(spark: SparkSession, path: str) -> int:
    """Adds the latest state as one run of the same table and returns its number.

    Every file keeps the number of the run that scanned it, so a run that completes meanwhile wins over what was folded.
    Runs below the returned number whose files all stand in it are read no more and may be removed.
    """
    import uuid
    run = claim(spark, path, f"fold-{uuid.uuid4().hex}")
    last = _last_runs(spark, path).select("file_id", "stems")
    read_latest(spark, path).join(last.select("file_id"), "file_id", "left_semi").write.mode("overwrite").parquet(f"{path}/rows/run={run}")
    last.write.mode("overwrite").parquet(f"{path}/files/run={run}")
    return run


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt not in ("json", "csv", "parquet"):
        raise ValueError(fmt)
    writer = report.write.mode("overwrite")
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              partitions: int, **options) -> DataFrame:
    """A relational table read in parallel ranges of a numeric key; the driver's jar has to
    be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table) \
        .option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper) \
        .option("numPartitions", partitions)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
