"""Pages, rates and sessions against plain Python; plan checks."""

import random
from datetime import datetime, timedelta
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sieveline.functions.text import ellipsis, html_escape, line_range
from sieveline.operators import activity, pages, search, tokens
from sieveline.operators.joins import with_children
from sieveline.plans.registry import QUERIES

BASES = ["http://a.org/x/y.html", "https://a.org", "https://a.org/", "http://a.org/x/y?q=/z#f", "https://a.org/x/y/"]
LINKS = ["/p", "q.html", "./q", "../q", "../../../q", "//b.org/z", "?k=1", "http://c.org/u", "a/b/../c", "a/./b", "..", "/x/../y/", "mailto:x"]


def test_absolute_is_urljoin(spark):
    frame = spark.createDataFrame([(b, l) for b in BASES for l in LINKS], "b string, l string")
    for row in frame.select("b", "l", pages.absolute(F.col("b"), F.col("l")).alias("t")).collect():
        want = urljoin(row.b, row.l)
        # a site without a path means its root
        assert row.t == want or (row.b == "https://a.org" and row.t.replace("a.org/", "a.org") == want.replace("a.org/", "a.org")), row


HTML = '''<html><!-- <a href="/hidden"> --><head><meta property="og:image" content="/i.png"><meta name="x" content="/no">
<link rel="preconnect" href="//f.org"><link rel="stylesheet icon" href='/css/s.css'><script src=/js/a.js>"<a href='/inscript'>"</script></head>
<body><A HREF="/one.html">1</A><a title="a > b" href="two&amp;x">2</a><img src="/p.jpg" srcset="/p.jpg 1x, /q.jpg 2x"><a href="mailto:m">m</a>
<a href="#top">t</a><a data-href="/nothref">n</a><a href="https://else.org/">e</a></body></html>'''


def test_links(spark):
    frame = spark.createDataFrame([(1, "http://s.org/d/i.html", HTML), (2, "http://s.org/one.html", "<a href='x,'>")],
                                  "page_id long, url string, html string")
    got = {r.link: (r.target, r.kind) for r in pages.page_links(frame).filter("page_id = 1").collect()}
    assert got == {
        "/i.png": ("http://s.org/i.png", "asset"), "/css/s.css": ("http://s.org/css/s.css", "asset"),
        "/js/a.js": ("http://s.org/js/a.js", "asset"), "/one.html": ("http://s.org/one.html", "page"),
        "two&x": ("http://s.org/d/two&x", "asset"), "/p.jpg": ("http://s.org/p.jpg", "asset"),
        "/q.jpg": ("http://s.org/q.jpg", "asset"), "https://else.org/": ("https://else.org/", "external")}
    strict = pages.broken_links(frame, strict=True).collect()
    assert {(r.page_id, r.problem) for r in strict} == {(1, "BROKEN"), (2, "PARSE ERROR")}
    assert not [r for r in strict if r.target.endswith("one.html") and r.problem == "BROKEN"]
    both = pages.broken_links(frame).collect()
    assert {r.problem for r in both} == {"BROKEN", "PARSE ERROR"} and len(both) > len(strict)


def test_entities_of_links(spark):
    html = "<a href='/&#233;&#x1F600;&#xE9;&amp;#233;&#0;&#xD800;&apos;&lt;'>x</a>"
    frame = spark.createDataFrame([(1, "http://s.org/", html)], "page_id long, url string, html string")
    assert [r.link for r in pages.page_links(frame).collect()] == ["/\u00e9\U0001f600\u00e9&#233;&#0;&#xD800;'<"]


def test_very_long_attributes(spark):
    long = "v" * 1_000_000
    html = f"<a title={long} href='/x.html'>x</a><!-- {long} --><a href='/{long}'>y</a>"
    frame = spark.createDataFrame([(1, "http://s.org/", html)], "page_id long, url string, html string")
    assert {len(r.link) for r in pages.page_links(frame).collect()} == {7, 1_000_001}
    assert pages.broken_links(frame).count() == 2 and pages.page_weight(frame).count() == 1


def test_weight(spark):
    frame = spark.createDataFrame([(1, "http://s.org/a", '<a href="/css/x.css"></a><img src="/css/x.css">'),
                                   (2, "http://s.org/css/x.css", "12345"), (3, "http://s.org/b", "x" * 600_000)],
                                  "page_id long, url string, html string")
    got = {r.page_id: (r.assets, r.asset_bytes, r.over_budget) for r in pages.page_weight(frame).collect()}
    assert got == {1: (1, 5, False), 2: (0, 0, False), 3: (0, 0, True)}


@pytest.fixture(scope="module")
def events(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    rows = []
    for n in range(1500):
        user = 0 if n % 3 == 0 else rng.randrange(1, 20)    # one user causes a third
        rows.append((n, user, start + timedelta(seconds=rng.randrange(0, 40_000), microseconds=rng.randrange(10**6))))
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


@pytest.mark.parametrize("seconds", [60, 900, 7200])
def test_rolling_rate(events, seconds):
    rows, frame = events
    at = [(u, int(t.timestamp())) for _, u, t in rows]
    want = {}
    for user, second in at:
        want[(user, second)] = sum(1 for u, s in at if u == user and second - seconds < s <= second)
    got = {(r.user_id, r.second - at[0][1]): r.requests for r in activity.rolling_rate(frame, 3, seconds).collect()}
    shift = {(u, s - at[0][1]): n for (u, s), n in want.items()}
    offset = min(s for _, s in got) - min(s for _, s in shift)
    assert got == {(u, s + offset): n for (u, s), n in shift.items()}


def test_sessions(events):
    rows, frame = events
    want = []
    for user in {u for _, u, _ in rows}:
        times, size, last = sorted(t for _, u, t in rows if u == user), 0, None
        for t in times:
            if last is not None and (t - last).total_seconds() >= 900:
                want.append((user, size))
                size = 0
            size, last = size + 1, t
        want.append((user, size))
    assert sorted((r.user_id, r.events) for r in activity.sessions(frame, 900).collect()) == sorted(want)


def test_tokens(spark):
    cases = [("python", "x = f\"a\" + 'b' # c", {"string": 2, "comment": 1, "default": 3}),
             ("python", "def if1 for 3.5e2 @dec len(x)", {"keyword": 2, "number": 1, "decorator": 1, "builtin": 1, "default": 5}),
             ("javascript", "let r = /a b/g; // end", {"keyword": 1, "regex": 1, "comment": 1, "default": 2}),
             ("csharp", "[Fact] var s = @\"a\"\"b\";", {"decorator": 1, "keyword": 1, "string": 1, "default": 3}),
             ("java", "éfor", {"keyword": 1, "default": 1})]
    for language, line, want in cases:
        row = spark.createDataFrame([(language, line)], "language string, line string") \
            .select(tokens.line_tokens(F.col("language"), F.col("line")).alias("t")).collect()[0]
        got = {}
        for token in row.t:
            got[token.kind] = got.get(token.kind, 0) + 1
        assert got == want, (line, row.t)
        assert sum(len(t.text) for t in row.t) == len(line)


def test_text_helpers(spark):
    row = spark.range(1).select(
        html_escape(F.lit("<a href=\"x\">&'")).alias("e"), ellipsis(F.lit("x" * 161)).alias("l"), ellipsis(F.lit("x" * 160)).alias("s"),
        line_range(F.lit(3), F.lit(None).cast("int")).alias("a"), line_range(F.lit(3), F.lit(3)).alias("b"),
        line_range(F.lit(3), F.lit(9)).alias("c")).collect()[0]
    assert row.e == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;" and row.l == "x" * 157 + "…" and row.s == "x" * 160
    assert (row.a, row.b, row.c) == ("3", "3", "3–9")


def test_periods(spark):
    frame = spark.createDataFrame([("2024-03-10",), ("2024-03-03",), ("2024-03-02",), ("2024-02-28",), ("2023-03-10",)], "d string") \
        .select(F.col("d").cast("timestamp").alias("created_at"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("description"))
    today = F.lit("2024-03-10").cast("date")
    counts = [search.search_projects(frame, "", p, today).count() for p in search.PERIODS]
    assert counts == [5, 1, 2, 3, 4]


def test_children_join_is_a_left_join(spark):
    parents = spark.createDataFrame([(n, f"p{n}") for n in range(5)], "k long, p string")
    children = spark.createDataFrame([(0, n) for n in range(50)] + [(2, 7)], "k long, c long")
    a = with_children(parents, children, "k").select("k", "p", "c")
    b = parents.join(children, "k", "left").select("k", "p", "c")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


PYTHON_STAGES = {"shap_seeded", "lime_seeded"}


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith("stream")])
def test_plans_hold_at_scale(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan or name in ("ingest_totals", "project_listing"), "one task sees everything"
    udfs = plan.count("ArrowEvalPython")
    assert udfs == 0 or name in PYTHON_STAGES


def test_scan_is_one_stage(spark, sf_dir):
    from sieveline.operators.scan import scan_files
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id AS file_id", "source AS project_id", "'x' AS filename", "'python' AS language", "text AS source")
    plan = scan_files(files, signals=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
