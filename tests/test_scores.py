"""Rounding, risk and de-duplication against hand values and plain Python."""

import math
import random

from pyspark.sql import functions as F

from sieveline.functions.scoring import RISK_WEIGHT, exact_round, risk_of_ranked, risk_weight
from sieveline.operators import dedup, runs, score
from sieveline.plans import analysis
from sieveline.schema import SEVERITIES


def test_exact_round_is_pythons(spark):
    rng = random.Random(1)
    values = [rng.randrange(-99999, 99999) / 10000 for _ in range(3000)] + \
             [n / 2000 for n in range(1, 400, 2)] + [rng.uniform(-2, 2) for _ in range(500)] + \
             [0.25725, 0.5, 1.5, 2.5, -0.5, 0.3845, 0.0005, 1e-9, 0.14175, 0.0, 86.5]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 3, 4):
        rows = frame.select("v", exact_round(F.col("v"), digits).alias("r")).collect()
        assert [r.r + 0.0 for r in rows] == [round(v, digits) + 0.0 for v in values]


def plain_risk(findings):
    total = 0.0
    ordered = sorted(findings, key=lambda f: SEVERITIES.index(f[0]) if f[0] in SEVERITIES else 5)
    for place, (severity, confidence) in enumerate(ordered, 1):
        total += RISK_WEIGHT.get(severity, 0.1) * confidence * (1.0 / math.sqrt(place)) * 0.35
    return round(min(total, 0.98), 4)


def test_hand_values(spark):
    cases = [([], 0.0), ([("critical", .92)], .322), ([("high", .97)], .2546),
             ([("critical", .92), ("high", .97)], .502), ([("critical", .92)] * 3, .7356),
             ([("critical", .92)] * 10, .98), ([("info", .99)], .0069), ([("high", .98)], .2572)]
    rows = [(n, [(s, float(c)) for s, c in f]) for n, (f, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "n int, f array<struct<severity: string, confidence: double>>")
    got = frame.select("n", risk_of_ranked(F.transform(
        "f", lambda x: risk_weight(x["severity"]) * x["confidence"])).alias("r")).orderBy("n").collect()
    assert [r.r for r in got] == [want for _, want in cases]


def _findings(spark, rows):
    return spark.createDataFrame(
        rows, "file_id long, rule_id string, line_start int, severity string, confidence_score double, ordinal int")


def _random_findings(seed, count):
    rng = random.Random(seed)
    rows = set()
    for _ in range(count):
        # one file holds most of the rows
        rows.add((0 if rng.random() < 0.6 else rng.randrange(1, 30), f"R{rng.randrange(12)}", rng.randrange(1, 6000)))
    return [(*key, rng.choice(SEVERITIES + ("odd",)), round(rng.uniform(0.001, 0.02), 4), n)
            for n, key in enumerate(sorted(rows))]


def test_ranks_and_risk_of_a_large_file(spark):
    rows = _random_findings(2, 4000)
    got = {(r.file_id, r.rule_id, r.line_start): r["rank"] for r in score.rank_in_file(_findings(spark, rows)).collect()}
    want, by_file = {}, {}
    for row in rows:
        by_file.setdefault(row[0], []).append(row)
    for file_rows in by_file.values():
        file_rows.sort(key=lambda r: (SEVERITIES.index(r[3]) if r[3] in SEVERITIES else 5, r[2], r[5], r[1]))
        want.update({r[:3]: n for n, r in enumerate(file_rows)})
    assert got == want
    risks = {r.file_id: (r.risk_score, r.findings) for r in score.file_risk(_findings(spark, rows)).collect()}
    assert risks == {f: (plain_risk([(r[3], r[4]) for r in rs]), len(rs)) for f, rs in by_file.items()}


def test_findings_are_rated_from_one_computation(spark):
    rows = _random_findings(3, 500)
    seen = spark.sparkContext.accumulator(0)

    def count(severity):
        seen.add(1)
        return severity

    counted = F.udf(count, "string").asNondeterministic()
    risks = score.file_risk(_findings(spark, rows).withColumn("severity", counted("severity"))).collect()
    assert seen.value == len(rows) and sum(r.findings for r in risks) == len(rows)


def test_table_risk_equals_row_risk(spark, sf_dir):
    from sieveline.operators.scan import scan_files
    from sieveline.sources import corpus
    files = corpus.files(spark, sf_dir)
    inside = analysis.file_scores(files).filter("findings > 0").select("file_id", "risk_score")
    table = score.file_risk(scan_files(files)).select("file_id", "risk_score")
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, table.collect()))


def test_dedup_keeps_best_and_first_place(spark):
    rows = [(1, "A", 5, "low", .5, 0), (1, "A", 5, "high", .9, 3), (1, "A", 5, "info", .9, 7), (1, "A", 6, "low", .1, 9)]
    frame = _findings(spark, rows)
    got = sorted(map(tuple, dedup.deduplicate(frame).collect()))
    assert got == [(1, "A", 5, "high", .9, 0), (1, "A", 6, "low", .1, 9)]
    assert sorted(map(tuple, dedup.deduplicate(dedup.deduplicate(frame)).collect())) == got


def test_project_mean(spark):
    frame = spark.createDataFrame([("a", .8), ("a", .4), ("a", None), ("b", None)], "project_id string, risk_score double")
    got = {r.project_id: r.overall_risk_score for r in score.project_risk(frame).collect()}
    assert abs(got["a"] - .6) < 1e-12 and got["b"] is None


def test_run_difference(spark):
    old = _findings(spark, [(1, "A", 1, "low", .5, 0), (1, "B", 1, "low", .5, 0)])
    new = _findings(spark, [(1, "A", 1, "low", .6, 0), (1, "C", 1, "low", .5, 0)])
    got = {r.rule_id: r.change for r in runs.run_diff(old, new).collect()}
    assert got == {"A": "unchanged", "B": "fixed", "C": "new"}


def test_status_after_a_run(spark):
    files = spark.createDataFrame([(n, "pending", None) for n in range(4)], "file_id long, status string, risk_score double")
    scores = spark.createDataFrame([(0, 1.7, 5), (1, -0.2, 6), (2, .3, 7)], "file_id long, risk_score double, duration_ms long")
    failures = spark.createDataFrame([(2, "x" * 3000)], "file_id long, error string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = {r.file_id: r for r in runs.finished(files, scores, failures, now).collect()}
    assert (rows[0].status, rows[0].risk_score) == ("complete", 1.0)
    assert (rows[1].status, rows[1].risk_score) == ("complete", 0.0)
    assert rows[2].status == "failed" and len(rows[2].error_message) == 2000 and rows[2].analyzed_at is not None
    assert rows[3].status == "pending" and rows[3].analyzed_at is None
