"""Ingest, encryption, sinks and streams."""

import os

import pytest
from pyspark.sql import functions as F

from sieveline.operators import activity, runs
from sieveline.operators.scan import scan_files
from sieveline.plans import analysis
from sieveline.plans.registry import QUERIES
from sieveline.schema import FILES
from sieveline.sources import ingest, sinks, vault
from sieveline.streaming import rates, scan as stream_scan, status as stream_status

KEY = bytes(range(32))


def raw(spark, *rows):
    return spark.createDataFrame(
        [(n, "p", name, bytearray(content), declared) for n, (name, content, declared) in enumerate(rows)],
        "file_id long, project_id string, filename string, content binary, declared_language string")


CASES = [("a.py", b"x = 1\n", None, None), ("dir.x/b.JAVA", b"class B {}", None, None), ("c.mjs", b"1", "csharp", None),
         ("d.txt", b"x", None, "bad_extension"), (".py", b"x", None, "bad_extension"), ("e", b"x", None, "bad_extension"),
         ("f.py", b"", None, "empty"), ("g.py", b"x" * 101, None, "too_large"), ("h.cs", b"\xff\xfe", None, "not_utf8"),
         ("i.js", "é".encode(), None, None), ("j.py", b"x", "cobol", "bad_language")]


def test_accept_and_reject(spark):
    files = raw(spark, *[c[:3] for c in CASES])
    bad = {r.file_id: r.reason for r in ingest.rejected(files, 100).collect()}
    good = {r.file_id: r for r in ingest.accepted(files, 100).collect()}
    assert bad == {n: c[3] for n, c in enumerate(CASES) if c[3]}
    assert set(good) | set(bad) == set(range(len(CASES))) and not set(good) & set(bad)
    assert [good[n].language for n in (0, 1, 2, 9)] == ["python", "java", "csharp", "javascript"]
    assert (good[0].line_count, good[9].size_bytes, good[9].source) == (2, 2, "é")
    assert tuple(ingest.totals(files, 100).collect()[0]) == (len(good), len(bad))


def test_ingest_queries_refuse_only_over_a_megabyte(spark, tmp_path):
    sizes = {1: 10, 2: 8193, 3: 1_048_576, 4: 1_048_577}
    docs = [(n, "src0", "x" * size, "en") for n, size in sizes.items()]
    spark.createDataFrame(docs, "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    good, bad, totals = (QUERIES[f"ingest_{n}"](spark, str(tmp_path)).collect() for n in ("files", "rejects", "totals"))
    assert {r.file_id: r.size_bytes for r in good} == {n: sizes[n] for n in (1, 2, 3)}
    assert [(r.file_id, r.reason) for r in bad] == [(4, "too_large")]
    assert tuple(totals[0]) == (3, 1)


def test_folder(spark, tmp_path):
    os.makedirs(tmp_path / "one" / "deep")
    (tmp_path / "one" / "deep" / "a.py").write_text("eval(x)")
    (tmp_path / "one" / "big.py").write_text("x" * 300)
    files = ingest.accepted(ingest.read_files(spark, str(tmp_path), limit=200), 200)
    row = files.collect()[0]
    assert (row.project_id, row.filename, row.source) == ("one", "one/deep/a.py", "eval(x)")
    assert files.count() == 1 and ingest.oversized_files(spark, str(tmp_path), 200).count() == 1
    assert scan_files(files).collect()[0].rule_id == "PY-SEC-003"


@pytest.mark.parametrize("name,reason", [(" a ", "too_short"), ("", "blank"), (None, "blank"), ("ab", None), ("x" * 256, "too_long"), (" " + "x" * 255, None)])
def test_project_names(spark, name, reason):
    row = spark.createDataFrame([(name,)], "name string").select(ingest.project_reason(F.col("name")).alias("r")).collect()[0]
    assert row.r == reason


def test_encryption(spark, make_files):
    texts = ["", "x", "ünï\n" * 50, "z" * 50_000]
    files = make_files(*[("python", t) for t in texts])
    a = {r.file_id: r.encrypted_source for r in vault.store(files, KEY).collect()}
    b = {r.file_id: r.encrypted_source for r in vault.store(files, KEY).collect()}
    assert all(a[n] != b[n] and len(a[n]) == len(t.encode()) + vault.OVERHEAD_BYTES for n, t in enumerate(texts))
    stored = vault.store(files, KEY)
    assert [r.source for r in vault.load(stored, KEY).orderBy("file_id").collect()] == texts
    lost = vault.load(stored, bytes(32)).collect()
    assert len(lost) == len(texts) and all(r.status == "failed" and r.error_message for r in lost)
    broken = [(n, bytearray(v)) for n, v in enumerate([b"", b"short", bytes(a[1])[:-1] + bytes([a[1][-1] ^ 1])])]
    frame = spark.createDataFrame(broken, "n int, blob binary")
    assert all(r.t is None for r in frame.select(vault.decrypt(F.col("blob"), KEY).alias("t")).collect())


def test_keys():
    assert vault.key_from_base64(vault.key_to_base64(KEY)) == KEY
    for bad in (b"", bytes(16), bytes(33), "x" * 32):
        with pytest.raises(ValueError):
            vault.check_key(bad)


def test_runs_of_a_table(spark, make_files, tmp_path):
    import os
    path = str(tmp_path / "t")
    files = make_files(*[("python", "eval(x)\n" * (n + 1)) for n in range(6)])
    assert sinks.next_run(spark, path) == 0
    sinks.append_run(scan_files(files), files, path, 0)
    assert sinks.read_latest(spark, path).count() == 21 and sinks.next_run(spark, path) == 1
    first = {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(f"{path}/rows/run=0") for f in (os.path.join(d, x) for x in fs)}
    changed = spark.createDataFrame([(1, "p", "f1", "python", "exec(x)"), (2, "p", "f2", "python", "clean")],
                                    "file_id long, project_id string, filename string, language string, source string")
    # a run that fails before its mark changes nothing
    scan_files(changed).write.parquet(f"{path}/rows/run=1")
    assert sinks.read_latest(spark, path).count() == 21
    for _ in range(2):   # a repeated run leaves the same table
        sinks.append_run(scan_files(changed), changed, path, 1)
        rows = sinks.read_latest(spark, path).groupBy("file_id").agg(F.count("*").alias("n"), F.min("rule_id").alias("r"))
        assert {r.file_id: (r.n, r.r) for r in rows.collect()} == {
            0: (1, "PY-SEC-003"), 1: (1, "PY-SEC-003b"), 3: (4, "PY-SEC-003"), 4: (5, "PY-SEC-003"), 5: (6, "PY-SEC-003")}
    assert first == {f: os.stat(f).st_mtime_ns for f in first}
    sinks.compact(spark, path, str(tmp_path / "c"))
    same = [sorted(map(str, sinks.read_latest(spark, p).collect())) for p in (path, str(tmp_path / "c"))]
    assert same[0] == same[1]
    # a table that becomes empty
    nothing = files.withColumn("source", F.lit("clean"))
    sinks.append_run(scan_files(nothing), nothing, path, 2)
    assert sinks.read_latest(spark, path).count() == 0


def test_reports_are_written(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a,b"), (2, None)], "n long, t string")
    for fmt in ("json", "csv", "parquet"):
        sinks.write_report(frame, str(tmp_path / fmt), fmt)
        back = spark.read.schema(frame.schema).option("header", "true").format(fmt).load(str(tmp_path / fmt))
        assert sorted(map(tuple, back.collect())) == [(1, "a,b"), (2, None)]
    with pytest.raises(ValueError):
        sinks.write_report(frame, str(tmp_path / "x"), "xml")


def test_runnable_and_replacement(spark, make_files):
    files = make_files(("python", "eval(x)"), ("python", "eval(x)")).withColumn(
        "status", F.when(F.col("file_id") == 0, "analyzing").otherwise("complete"))
    old = scan_files(files).withColumn("severity", F.lit("old"))
    scanned = runs.runnable(files)
    rows = runs.replace_findings(old, scan_files(scanned), scanned).orderBy("file_id").collect()
    assert [(r.file_id, r.severity) for r in rows] == [(0, "old"), (1, "critical")]


def test_stream_scan_equals_batch(spark, make_files, tmp_path):
    def arrive(name, *rows):
        spark.createDataFrame(list(rows), FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arrive("a", (1, "p", "a.py", "python", "eval(x)\nexec(y)"), (2, "p", "b.js", "javascript", "eval(x)"))
    stream = lambda: spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream_scan.scan_stream(stream(), out, mark).awaitTermination()
    arrive("b", (2, "p", "b.js", "javascript", "console.log(x)"), (3, "p", "c.py", "python", "print(x)"))
    stream_scan.scan_stream(stream(), out, mark).awaitTermination()
    got = sorted((r.file_id, r.rule_id) for r in sinks.read_latest(spark, out).collect())
    assert got == [(1, "PY-SEC-003"), (1, "PY-SEC-003b"), (2, "JS-MAINT-001"), (3, "PY-MAINT-004")]


def test_a_stream_with_a_new_checkpoint_adds_to_the_table(spark, tmp_path):
    """A second stream, and one started anew, leave the files of the first ones."""
    def arrive(folder, *rows):
        spark.createDataFrame(list(rows), FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))

    def scanned(folder, mark):
        stream_scan.scan_stream(spark.readStream.schema(FILES).parquet(str(tmp_path / folder)), out, str(tmp_path / mark)).awaitTermination()
        return sorted((r.file_id, r.rule_id) for r in sinks.read_latest(spark, out).collect())

    out = str(tmp_path / "out")
    arrive("a", (1, "p", "a.py", "python", "eval(x)"), (2, "p", "b.py", "python", "exec(x)"))
    arrive("b", (2, "p", "b.py", "python", "eval(x)"), (3, "p", "c.py", "python", "eval(x)"))
    assert scanned("a", "mark-a") == [(1, "PY-SEC-003"), (2, "PY-SEC-003b")]
    both = [(1, "PY-SEC-003"), (2, "PY-SEC-003"), (3, "PY-SEC-003")]
    assert scanned("b", "mark-b") == both
    assert scanned("b", "mark-b") == both  # nothing new
    assert scanned("b", "mark-c") == both  # started anew
    run = sinks.fold(spark, out)
    assert sorted((r.file_id, r.rule_id) for r in sinks.read_latest(spark, out).collect()) == both and run == 3
    arrive("b", (1, "p", "a.py", "python", "clean"))
    assert scanned("b", "mark-b") == both[1:]


def test_writers_at_once_lose_nothing(spark, make_files, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    path = str(tmp_path / "t")

    def write(n):
        files = make_files(("python", "eval(x)\n" * (n + 1))).withColumn("file_id", F.lit(n).cast("long"))
        run = sinks.claim(spark, path, f"writer {n}")
        sinks.append_run(scan_files(files), files, path, run)
        return run

    with ThreadPoolExecutor(4) as pool:
        taken = list(pool.map(write, range(6)))
    assert sorted(taken) == list(range(6))
    got = {r.file_id: r["count"] for r in sinks.read_latest(spark, path).groupBy("file_id").count().collect()}
    assert got == {n: n + 1 for n in range(6)}
    assert [sinks.claim(spark, path, f"writer {n}") for n in range(6)] == taken  # the same work, the same number
    # an older run that completes while the table is folded wins over what it replaces, and nothing else
    late = sinks.claim(spark, path, "late")
    files = make_files(("python", "clean")).withColumn("file_id", F.lit(5).cast("long"))
    sinks.fold(spark, path)
    sinks.append_run(scan_files(files), files, path, late)
    got = {r.file_id: r["count"] for r in sinks.read_latest(spark, path).groupBy("file_id").count().collect()}
    assert got == {n: n + 1 for n in range(5)}


def test_stream_of_repeats_and_windows(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:50"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:30:00")]
    frame = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    windows = rates.rate_windows(stream)
    rates.to_table(windows, str(tmp_path / "w"), str(tmp_path / "wm")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "w"))
    assert sorted((r.user_id, r.requests) for r in out.collect()) == [(1, 1), (1, 2)]
    assert [r.requests for r in rates.over_limit(out, 1).collect()] == [2]
    rates.counts_to_table(rates.rate_windows(stream), str(tmp_path / "u"), str(tmp_path / "um")).awaitTermination()
    assert sorted((r.user_id, r.requests) for r in rates.latest_counts(spark, str(tmp_path / "u")).collect()) == [(1, 1), (1, 2), (2, 1)]
    once = stream_scan.without_repeats(rates.timed(stream), key="user_id", ts="ts")
    rates.to_table(once, str(tmp_path / "d"), str(tmp_path / "dm")).awaitTermination()
    assert sorted(r.user_id for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [1, 2]


def test_stuck_files_as_stream_and_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "analyzing"), (2, "2024-01-01 00:00:00", 2, "analyzing"),
            (2, "2024-01-01 00:01:00", 3, "complete"), (3, "2024-01-01 01:00:00", 4, "analyzing"),
            (5, "2024-01-01 00:00:00", 9, "complete"), (5, "2024-01-01 00:00:00", 8, "analyzing")]
    frame = spark.createDataFrame(rows, "file_id long, ts string, event_id long, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stuck = stream_status.stuck_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")))
    rates.to_table(stuck, str(tmp_path / "s"), str(tmp_path / "sm")).awaitTermination()
    assert [r.file_id for r in spark.read.schema(stuck.schema).parquet(str(tmp_path / "s")).collect()] == [1]
    now = F.lit("2024-01-01 01:01:00").cast("timestamp")
    assert [r.file_id for r in activity.stuck_files(frame, now).collect()] == [1]


def test_analysed_row(make_files):
    row = analysis.analyze(make_files(("python", "eval(x)\n\n# note")), signals=True).collect()[0]
    assert (row.risk_score, row.metrics.line_count, row.metrics.comment_lines, row.stored_line_count) == (0.322, 3, 1, 3)
    assert row.found[0].rule_id == "PY-SEC-003" and row.found[0].signals.user_input == 0.0
