"""Feeds, merging and failure safety on small tables."""

import json

from sieveline.operators import diagnostics, scan
from sieveline.schema import FINDING_COLUMNS

SOURCE = "\n".join(f"  line{n};" for n in range(1, 11))


def java_feed(spark, *rows):
    return spark.createDataFrame(
        [(0, n, 0, *row) for n, row in enumerate(rows)],
        "file_id long, seq long, sub long, kind string, line string, message string, source_fragment string")


def csharp_feed(spark, *responses):
    rows = [(0, n, 0, r if isinstance(r, str) else json.dumps(r)) for n, r in enumerate(responses)]
    return spark.createDataFrame(rows, "file_id long, seq long, sub long, response string")


def java(spark, make_files, *rows, source=SOURCE):
    return diagnostics.java_findings(java_feed(spark, *rows), make_files(("java", source))).orderBy("ordinal").collect()


def test_kinds(spark, make_files):
    rows = java(spark, make_files, ("ERROR", "1", "a", "x"), (" mandatory_warning ", "2", "b", ""), ("NOTE", "3", "c", ""),
                ("OTHER", "3", "c", ""), ("Warning", "3", " ", ""), (None, "1", "", ""))
    assert [(r.rule_id, r.severity, r.confidence_score, r.description) for r in rows] == [
        ("JAVA-COMPILE-ERROR", "high", 0.98, "a"), ("JAVA-COMPILE-WARNING", "low", 0.85, "b"),
        ("JAVA-COMPILE-WARNING", "low", 0.85, "Compiler diagnostic")]
    assert [r.shap_features for r in rows] == [["compile_error"], ["compiler_warning"], ["compiler_warning"]]


def test_lines_and_snippets(spark, make_files):
    rows = java(spark, make_files, *[("ERROR", line, "m", frag) for line, frag in
                                     [("0", ""), ("999", None), ("-4", ""), ("x", ""), (None, ""), ("2.9", ""), ("7", " frag\t"), ("3", " ")]])
    assert [r.line_start for r in rows] == [1, 10, 1, 1, 1, 1, 7, 3]
    assert [r.code_snippet for r in rows][-2:] == ["frag", "line3;"]
    assert java(spark, make_files, ("ERROR", "5", "m", ""), source="")[0].line_start == 1


def test_cap_keeps_feed_order(spark, make_files):
    feed = java_feed(spark, *[("ERROR" if n % 2 else "NOTE", "1", f"m{n}", "") for n in range(199)])
    files = make_files(("java", SOURCE))
    rows = diagnostics.java_findings(feed, files, limit=50).orderBy("ordinal").collect()
    assert [r.description for r in rows] == [f"m{n}" for n in range(1, 100, 2)]
    assert diagnostics.java_findings(feed, files).count() == 99
    assert [tuple(r) for r in diagnostics.beyond_limit(diagnostics.java_items(feed), 50).collect()] == [(0, "java", 49)]


def test_csharp_response(spark, make_files):
    response = {"diagnostics": [{"severity": "Error", "id": "CS1002", "message": "; expected", "line": 2},
                                {"severity": "Hidden", "id": "CS8019", "message": "x", "line": 1},
                                {"severity": " warning ", "id": " ", "message": None, "line": "99"}],
                "findings": [{"rule_id": "CS-SEC-009", "title": "T", "severity": "HIGH", "category": "nonsense", "line": 3},
                             {"rule_id": "", "title": "T"}, {"rule_id": "R", "title": ""},
                             {"rule_id": "CS-X", "title": "U", "description": "d", "severity": "awful", "category": "Style",
                              "line": 4, "snippet": " s ", "cwe_id": "CWE-" + "9" * 40}]}
    rows = diagnostics.csharp_findings(csharp_feed(spark, response), make_files(("csharp", SOURCE))).orderBy("ordinal").collect()
    assert [(r.rule_id, r.title, r.severity, r.category, r.line_start, r.description, r.code_snippet) for r in rows] == [
        ("CS-ROS-CS1002", "C# Compilation Error (CS1002)", "high", "correctness", 2, "; expected", "line2;"),
        ("CS-ROS-UNKNOWN", "C# Compilation Warning (UNKNOWN)", "low", "maintainability", 10, "Compiler diagnostic", "line10;"),
        ("CS-SEC-009", "T", "high", "security", 3, "T", "line3;"),
        ("CS-X", "U", "medium", "style", 4, "d", "s")]
    assert [r.confidence_score for r in rows] == [0.98, 0.85, 0.75, 0.75] and len(rows[3].cwe_id) == 20


def test_diagnostics_come_first_under_the_shared_cap(spark, make_files):
    responses = [{"diagnostics": [{"severity": "error", "id": f"C{n}", "line": 1}],
                  "findings": [{"rule_id": f"S{n}", "title": "t", "line": 1}]} for n in range(40)]
    rows = diagnostics.csharp_findings(csharp_feed(spark, *responses), make_files(("csharp", SOURCE)), limit=50).orderBy("ordinal").collect()
    assert [r.rule_id for r in rows] == [f"CS-ROS-C{n}" for n in range(40)] + [f"S{n}" for n in range(10)]


def test_long_rule_names_stay_apart(spark, make_files):
    response = {"findings": [{"rule_id": "R" * 120 + end, "title": "t", "line": 1} for end in "ab"]}
    rows = diagnostics.csharp_findings(csharp_feed(spark, response), make_files(("csharp", SOURCE))).collect()
    assert len({r.rule_id for r in rows}) == 2


def test_broken_feed_changes_nothing(spark, make_files):
    files = make_files(("csharp", "new BinaryFormatter();"))
    local = scan.scan_files(files)
    for feed in (csharp_feed(spark, "{not json", '{"diagnostics": 7}', "", "null"), None):
        merged = diagnostics.enrich(local, files, csharp=feed)
        assert sorted(map(str, merged.collect())) == sorted(map(str, local.select(*FINDING_COLUMNS).collect()))
    off = diagnostics.enrich(local, files, csharp=csharp_feed(spark, {"diagnostics": [{"severity": "error", "line": 1}]}), enabled=False)
    assert off.count() == local.count()


def test_local_finding_wins_and_others_join(spark, make_files):
    files = make_files(("csharp", "new BinaryFormatter();\nx;"), ("python", "eval(x)"))
    service = {"findings": [{"rule_id": "CS-SEC-003", "title": "other", "severity": "low", "line": 1},
                            {"rule_id": "CS-SEC-002", "title": "BinaryFormatter", "severity": "critical", "line": 1}]}
    rows = diagnostics.enrich(scan.scan_files(files), files, csharp=csharp_feed(spark, service)).orderBy("file_id", "ordinal").collect()
    assert [(r.file_id, r.rule_id, r.confidence_score) for r in rows] == [
        (0, "CS-SEC-003", 0.92), (0, "CS-SEC-002", 0.75), (1, "PY-SEC-003", 0.92)]


def test_counts(spark):
    feed = java_feed(spark, ("ERROR", "1", "", ""), ("WARNING", "1", "", ""), ("mandatory_warning", "1", "", ""), ("NOTE", "1", "", ""))
    assert tuple(diagnostics.diagnostic_counts(feed).collect()[0]) == (0, 1, 2, False)


def test_cap_is_applied_before_the_shuffle(spark, make_files):
    items = diagnostics.java_items(java_feed(spark, ("ERROR", "1", "", "")))
    plan = diagnostics.capped(items, 50)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_no_text_is_moved_and_one_file_fills_many_tasks(spark, make_files):
    """A file with 300,000 items, many of them on one line: numbered in feed order by ranges."""
    from pyspark.sql import functions as F
    from sieveline.operators import numbering
    feed = spark.range(300_000, numPartitions=6).select(
        F.lit(0).cast("long").alias("file_id"), (F.col("id") * 7919 % 300_000).alias("seq"), F.lit(0).cast("long").alias("sub"),
        F.lit("ERROR").alias("kind"), F.when(F.col("id") % 3 == 0, "none").otherwise((F.col("id") % 12).cast("string")).alias("line"),
        F.col("id").cast("string").alias("message"), F.when(F.col("id") % 2 == 0, "").otherwise("own").alias("source_fragment"))
    found = diagnostics.java_findings(feed, make_files(("java", SOURCE), ("java", "other")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    for exchange in [x for x in plan.split("\n") if "Exchange" in x]:
        assert "source" not in exchange
    assert "collect_list" not in plan
    rows = found.select("ordinal", F.col("description").cast("long").alias("id"), "line_start", "code_snippet")
    wrong = rows.filter(
        (F.col("ordinal") != diagnostics.EXTERNAL_ORDINAL + F.col("id") * 7919 % 300_000)
        | (F.col("line_start") != F.when(F.col("id") % 3 == 0, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), F.col("id") % 12))))
        | (F.col("code_snippet") != F.when(F.col("id") % 2 == 1, "own").otherwise(F.concat(F.lit("line"), F.col("line_start"), F.lit(";")))))
    assert rows.count() == 300_000 and wrong.count() == 0
    blocks = feed.select("file_id", "seq", numbering.block_of(F.col("seq")).alias("block"))
    places = numbering.numbered(blocks, ["file_id"], ["block"], ["seq"])
    assert places.filter("n <> seq").count() == 0 and places.count() == 300_000
    assert places.groupBy("block").count().agg(F.max("count")).first()[0] == 4096


def test_a_feed_meets_its_files_before_it_is_parsed(spark, make_files):
    """Responses for files of other languages, unknown or without an id are never parsed."""
    files = make_files(("java", "a\nb"), ("csharp", "a\nb\nc"), ("csharp", ""), ("csharp", None))
    feed = spark.createDataFrame([(n, 0, 0, "{}") for n in (0, 1, 1, 2, 3, 9, None)], "file_id long, seq long, sub long, response string")
    fed = diagnostics.of_files(feed, files, "csharp")
    assert sorted((r.file_id, r.line_counts) for r in fed.collect()) == [(1, [3]), (1, [3]), (2, [0]), (3, [0])]
    plan = diagnostics.csharp_items(fed, ("line_counts",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("from_json") < plan.index("Join Inner")


def test_files_that_share_an_id_all_have_the_finding(spark, make_files):
    files = make_files(("java", SOURCE)).unionByName(make_files(("java", "one\ntwo")))
    rows = diagnostics.java_findings(java_feed(spark, ("ERROR", "9", "m", "own"), ("NOTE", "9", "m", "own")), files).collect()
    assert sorted(r.line_start for r in rows) == [2, 9]
    first = diagnostics.java_findings(java_feed(spark, ("ERROR", "9", "a", "own"), ("ERROR", "9", "b", "own")), files, limit=1).collect()
    assert [r.description for r in first] == ["a", "a"]


def test_enrichment_with_few_columns(spark, make_files):
    files = make_files(("csharp", "new BinaryFormatter();\nx;"), ("java", SOURCE))
    service = {"findings": [{"rule_id": "CS-SEC-003", "title": "other", "severity": "low", "line": 1},
                            {"rule_id": "CS-SEC-002", "title": "BinaryFormatter", "severity": "critical", "line": 1}]}
    local, feed = scan.scan_files(files), csharp_feed(spark, service, service)
    some = ("file_id", "rule_id", "line_start", "severity", "confidence_score", "ordinal")
    few = diagnostics.enrich(local, files, csharp=feed, columns=some)
    assert few.columns == list(some)
    plan = few._jdf.queryExecution().executedPlan().toString()
    for exchange in [x for x in plan.split("\n") if "SortAggregate" in x]:
        assert "description" not in exchange and "recommendation" not in exchange
    whole = diagnostics.enrich(local, files, csharp=feed)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.select(*some).collect()))
