"""Report documents with their manifest, and the stuck files at the end of a stream."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sieveline.operators import activity, export
from sieveline.plans import analysis
from sieveline.streaming import rates, status


def _documents(make_files, *texts):
    files = make_files(*texts)
    return export.documents(analysis.analyze(files).withColumn("status", F.lit("complete")))


def test_export_reads_back_what_was_written(spark, make_files, tmp_path):
    path = str(tmp_path / "reports")
    docs = _documents(make_files, ("python", "eval(x)\npassword = 'secret12345'"), ("java", "int a;"), ("python", ""), ("python", None))
    run = export.write(docs, path, "first")
    back = export.read(spark, path, docs.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    listed = {r["file_id"]: r for r in export.manifest(spark, path).collect()}
    assert set(listed) == {0, 1, 2, 3} and all(r["run"] == run for r in listed.values())
    parts = {p.name for p in (tmp_path / "reports" / "documents" / f"run={run}").iterdir()}
    assert {r["part"] for r in listed.values()} <= parts
    assert listed[0]["total"] == export.findings(back).filter("file_id = 0").count() >= 2
    head = export.heads(back).filter("file_id = 0").first()
    assert head["total"] == sum(head[s] for s in ("critical", "high", "medium", "low", "info"))


def test_incomplete_export_is_not_read(spark, make_files, tmp_path):
    path = str(tmp_path / "reports")
    docs = _documents(make_files, ("python", "eval(x)"))
    run = export.write(docs, path, "first")
    docs.limit(0).write.json(f"{path}/documents/run={run + 1}")  # a writer that was lost before its manifest
    assert export.read(spark, path, docs.schema).count() == 1
    with pytest.raises(AnalysisException):
        export.read(spark, path, docs.schema, run + 1)
    again = export.write(docs, path, "first")
    assert again == run and export.read(spark, path, docs.schema).count() == 1
    assert export.write(docs, path, "second") > run


def test_empty_export(spark, make_files, tmp_path):
    docs = _documents(make_files, ("python", "x")).limit(0)
    run = export.write(docs, str(tmp_path / "none"), "empty")
    assert export.read(spark, str(tmp_path / "none"), docs.schema, run).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stuck_at_end_equals_the_batch_form(spark, tmp_path, seed):
    """Many batches, files that get stuck, move on, get stuck again, come back after their state was dropped."""
    pick = random.Random(seed)
    rows, second = [], 0
    for n in range(120):
        second += pick.choice([1, 30, 100, 400, 5000])
        rows.append((pick.randint(1, 12), n, pick.choice(["analyzing", "analyzing", "complete", "failed"]), second))
    schema = "file_id long, event_id long, status string, second long"
    source = tmp_path / "events"
    for at in range(0, 120, 15):
        spark.createDataFrame(rows[at:at + 15], schema).coalesce(1).write.mode("append").parquet(str(source))
    files = sorted(source.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 8
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)) \
        .withColumn("ts", F.timestamp_seconds("second"))
    told = status.stuck_episodes(stream, delay="1 minute", keep_seconds=600)
    query = rates.to_table(told, str(tmp_path / "told"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert status.dropped_late(query) == 0
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("second"))
    written = spark.read.schema(told.schema).parquet(str(tmp_path / "told"))
    assert written.filter("stuck").count() > 3
    for later in (0, 100, 10_000):
        now = F.timestamp_seconds(F.lit(second + later))
        got = {r[0] for r in status.stuck_at_end(written, str(tmp_path / "checkpoint"), now).collect()}
        assert got == {r[0] for r in activity.stuck_files(batch, now).collect()}


def _alarms(batches, delay, seconds):
    """``stuck_stream`` in plain Python, a file at a time: ``file_id, since`` in seconds."""
    held, out, watermark, seen = {}, [], 0, 0
    for batch in [*batches, []]:
        due = [f for f, (_, _, at) in held.items() if at < watermark]
        for f in {r[0] for r in batch if r[3] > watermark}:
            last = max((r[3], r[1], r[2]) for r in batch if r[0] == f and r[3] > watermark)
            known = held.get(f, ((-1,), None, 0))[0]
            best = max(known, last)
            held[f] = (best, best[2], max(best[0] + seconds, watermark + .001))
            due = [d for d in due if d != f]
        for f in due:
            (since, *_), status, _ = held.pop(f)
            out += [(f, since)] if status == "analyzing" else []
        seen = max([seen, *(r[3] for r in batch)])
        watermark = max(watermark, seen - delay)
    return out


@pytest.mark.parametrize("seed, groups", [(1, 2), (2, 2048)])
def test_alarms_of_files_that_share_a_group(spark, tmp_path, seed, groups):
    """Groups of files act as each file alone would, in many batches; the state holds a row a group and not a row a file."""
    pick = random.Random(seed)
    rows, second = [], 1000
    for n in range(150):
        second += pick.choice([1, 30, 100, 400])
        rows.append((None, n, "analyzing", second) if n in (20, 21, 50) else
                    (pick.randint(1, 39), n, pick.choice(["analyzing", "complete", None]), second))
    schema = "file_id long, event_id long, status string, second long"
    source = tmp_path / "events"
    batches = [rows[at:at + 30] for at in range(0, 150, 30)]
    for batch in batches:
        spark.createDataFrame([*batch, (7, 9999, "analyzing", None)], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)) \
        .withColumn("ts", F.timestamp_seconds("second"))
    stuck = status.stuck_stream(stream, delay="1 minute", groups=groups)
    rates.to_table(stuck, str(tmp_path / "stuck"), str(tmp_path / "checkpoint")).awaitTermination()
    got = [(r.file_id, r.since_ms // 1000) for r in spark.read.schema(stuck.schema).parquet(str(tmp_path / "stuck")).collect()]
    want = _alarms(batches, 60, 120)
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 10 and None in {f for f, _ in want}
    assert groups > 2 or spark.read.format("statestore").load(str(tmp_path / "checkpoint")).count() <= groups


def test_late_rows_are_counted(spark, tmp_path):
    schema = "file_id long, event_id long, status string, second long"
    source = str(tmp_path / "events")
    for rows in ([(1, 1, "analyzing", 10_000)], [(2, 2, "analyzing", 20_000)], [(3, 3, "analyzing", 5), (4, 4, "complete", 20_001)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_seconds("second"))
    query = rates.to_table(status.stuck_episodes(stream), str(tmp_path / "told"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert status.dropped_late(query) == 1
