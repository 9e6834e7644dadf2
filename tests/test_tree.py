"""The stored tree against the levels computed apart."""

from pyspark.sql import functions as F

from sieveline.operators import explain, reports, runs
from sieveline.operators.scan import scan_files
from sieveline.plans import tree

GRAVE = "severity IN ('critical', 'high')"
PYTHON = "import os\nx = eval(input())\npassword = 'hunter2hunter2'\nprint(x)\n"
JAVA = "class A {\n  String password = \"hunter2hunter2\";\n}\n"


def corpus(spark):
    return spark.createDataFrame(
        [(1, "p", "a.py", "python", PYTHON), (2, "p", "b.py", "python", "x = 1\n"), (3, "q", "A.java", "java", JAVA),
         (4, "q", "c.py", "python", PYTHON * 3), (5, None, "d.py", "python", PYTHON), (6, "r", "e.py", "python", "")],
        "file_id long, project_id string, filename string, language string, source string")


def rows_of(frame, *columns):
    return sorted(map(str, (frame.select(*columns) if columns else frame).collect()))


def test_levels_equal_those_computed_apart(spark):
    files = corpus(spark)
    rows = tree.grow(files, F.expr(GRAVE))
    found = reports.with_ids(scan_files(files, signals=True))
    told = explain.explain(found.filter(GRAVE))
    columns = [c for c in found.columns if c != "signals"]
    assert found.count() > 8 and 0 < told.count() < found.count()
    assert rows_of(tree.findings(rows), *columns) == rows_of(found, *columns)
    assert rows_of(tree.explanations(rows), "finding_id", *tree.EXPLANATION) == rows_of(told, "finding_id", *tree.EXPLANATION)
    assert rows_of(tree.files(rows)) == rows_of(files, *tree.FILE_COLUMNS)
    assert rows_of(tree.unexplained(rows), "finding_id") == rows_of(runs.unexplained(found, told), "finding_id")
    counts = {r.project_id: (r.files, r.findings) for r in tree.projects(rows).collect()}
    of_file = {r.file_id: r["count"] for r in found.groupBy("file_id").count().collect()}
    assert counts == {"p": (2, of_file[1] + of_file.get(2, 0)), "q": (2, of_file[3] + of_file[4]), "r": (1, of_file.get(6, 0))}


def test_grows_by_one_scan_without_a_shuffle(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "files"))
    rows = tree.grow(spark.read.parquet(str(tmp_path / "files")), F.expr(GRAVE))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert all("BroadcastExchange" in line for line in plan.splitlines() if "Exchange" in line)


def test_missing_explanations_are_added(spark):
    files = corpus(spark)
    some = tree.grow(files, F.expr(GRAVE)).withColumn("explanation", F.when(
        F.col("explanation").isNotNull(), F.col("explanation").withField("summary", F.lit("kept"))))
    all_told = tree.explain_missing(some)
    assert tree.unexplained(all_told).isEmpty() and all_told.columns == some.columns
    assert rows_of(tree.findings(all_told)) == rows_of(tree.findings(some))
    old = tree.explanations(all_told).join(tree.findings(all_told).filter(GRAVE).select("finding_id").distinct(), "finding_id", "left_semi")
    assert {r.summary for r in old.collect()} == {"kept"}
    full = tree.grow(files, F.lit(True))
    fresh = [c for c in tree.EXPLANATION if c != "summary"]
    assert rows_of(tree.explanations(all_told), "finding_id", *fresh) == rows_of(tree.explanations(full), "finding_id", *fresh)
    assert tree.explanations(tree.grow(files)).isEmpty()


def test_up_and_down(spark):
    rows = tree.grow(corpus(spark), F.expr(GRAVE))
    gone = spark.createDataFrame([("q",), ("q",), (None,)], "project_id string")
    assert {r.file_id for r in tree.files(tree.without(rows, gone)).collect()} == {1, 2, 5, 6}
    assert {r.file_id for r in tree.files(tree.files_with(rows, F.expr(GRAVE))).collect()} == {1, 3, 4, 5}
    assert {r.file_id for r in tree.files(tree.projects_with(rows, F.col("language") == "java")).collect()} == {3, 4}
    listed = spark.createDataFrame([("p", "P"), ("none", "N")], "project_id string, name string")
    below = tree.under(listed, rows)
    assert {(r.name, r.file_id) for r in below.collect()} == {("P", 1), ("P", 2), ("N", None)}


def test_runs_of_a_tree(spark, tmp_path):
    path, files = str(tmp_path / "t"), corpus(spark)
    assert tree.store(tree.grow(files, F.expr(GRAVE)), path, "first") == 0
    first = rows_of(tree.findings(tree.stored(spark, path)), "file_id", "finding_id")
    changed = spark.createDataFrame([(1, "p", "a.py", "python", "x = 1\n"), (7, "s", "n.py", "python", PYTHON)], files.schema)
    assert tree.store(tree.grow(changed), path, "second") == 1
    assert tree.store(tree.grow(changed), path, "second") == 1  # the same work again replaces only itself
    now = tree.stored(spark, path)
    assert {r.file_id for r in tree.files(now).collect()} == {1, 2, 3, 4, 5, 6, 7}
    parts = files.filter("file_id <> 1").unionByName(changed)
    assert rows_of(tree.findings(now), "file_id", "finding_id") == rows_of(reports.with_ids(scan_files(parts)), "file_id", "finding_id") != first
    tree.grow(files, F.expr(GRAVE)).write.parquet(f"{path}/rows/run=2")  # a run that never completed
    assert rows_of(tree.findings(tree.stored(spark, path)), "file_id", "finding_id") == rows_of(tree.findings(now), "file_id", "finding_id")


def test_empty_corpus(spark, tmp_path):
    nothing = tree.grow(corpus(spark).limit(0), F.expr(GRAVE))
    tree.store(nothing, str(tmp_path / "t"), "x")
    rows = tree.stored(spark, str(tmp_path / "t"))
    assert all(f.isEmpty() for f in (rows, tree.projects(rows), tree.files(rows), tree.findings(rows), tree.explanations(rows)))
