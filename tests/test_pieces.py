"""Files cut into pieces give the rows of whole files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import pieces, scan
from sieveline.sources import corpus

KEY = ["file_id", "rule_id", "line_start", "line_end", "code_snippet", "description", "confidence_score", "ordinal"]


def rows(df, *more):
    return sorted((tuple(str(v) for v in r) for r in df.select(*KEY, *more).collect()))


def python_file(seed):
    """A file whose literals, brackets and functions run over many lines, some of them unpaired."""
    pick = random.Random(seed)
    out = []
    for n in range(pick.randint(5, 14)):
        kind = pick.randint(0, 7)
        if kind == 0:
            out += ['x = """first', "def inside(a): if a and b or c", "  if ' \" it", 'last"""']
        elif kind == 1:
            out += ["y = f(1,", "  [2,", "def = 3,", "  ])  # ) not ' closed"]
        elif kind == 2:
            out += ["s = 'goes \\", "def on(' + \"it's # no remark\""]
        elif kind == 3:
            out += ["@deco(1 if a else 2)", "@other", f"def led_{n}(a):"] + ["    if a and b or c: eval(a)"] * pick.randint(1, 6)
        elif kind == 4:
            out += [f"class C{n}:", "    '''doc", "    '''", f"    def m_{n}(self):"] + ["        if a: pass"] * pick.randint(8, 14) \
                + ["    async def other(self):"] + ["        for x in y: pass", ""] * pick.randint(8, 12)
        elif kind == 5:
            out += [f"def long_{n}():", "    '''x'''"] + ["    pass"] * pick.randint(55, 70)
        elif kind == 6:
            out += [f"def f_{n}(a):"] + ["    while a or b:", "        password = 'secret12345'"] * pick.randint(4, 7) + ["    return (a", "+ b)"]
        else:
            out += ["# remark with \"\"\" and '", "import os", "", "\tos.system(cmd)"]
    if seed % 9 == 0:
        out += ["z = ("]
    if seed % 11 == 0:
        out.insert(pick.randrange(len(out)), "w = 'open")
    end = pick.choice(["\n", "\n", "\r\n"])
    return end.join(out) + pick.choice(["", end])


@pytest.mark.parametrize("size", [1, 2, 7, 50, 4096])
def test_pieces_equal_whole_files(spark, make_files, size, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_PIECES", 5)
    texts = [("python", python_file(seed)) for seed in range(40)] + [
        ("python", ""), ("python", "\n"), ("python", None), ("java", "public void a() {\n" + "x\n" * 70 + "public void b() {\n"),
        ("java", "public void a() {\n" + "x\n" * 70), ("python", "a\x0bdef f(): eval(x)\x85\n" + "if a and b: pass\n" * 12)]
    files = make_files(*texts).repartition(4).cache()
    whole = scan.scan_files(files, signals=True)
    parts = pieces.scan_pieces(pieces.cut(files, size), signals=True)
    found = rows(whole, "signals")
    assert rows(parts, "signals") == found
    assert {r[1] for r in found} >= {"PY-CMPLX-001", "PY-MAINT-LONGFN", "JA-MAINT-LONGFN"}


def test_segments_hold_every_character_once(spark, make_files):
    files = make_files(*[("python", python_file(seed)) for seed in (1, 2, 3, 4)])
    cut = pieces.cut(files, 3)
    back = {r[0]: r[1] for r in pieces.segments(cut).groupBy("file_id").agg(F.sum(F.length("text"))).collect()}
    ends = {r[0]: r[1] for r in cut.groupBy("file_id").agg(F.sum(F.length("text"))).collect()}
    assert back == ends


def test_corpus_in_pieces(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    assert rows(pieces.scan_pieces(pieces.cut(files, 16))) == rows(scan.scan_files(files))


def test_one_large_file_from_disk_runs_in_many_tasks(spark, tmp_path):
    text = "".join(f"def f_{n}(a):\n" + "    if a and b: eval(a)\n" * (n % 9) + "    x = '''\n" + "def no():\n" * (n % 70) + "'''\n"
                   for n in range(4000))
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "big.py").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = pieces.read_pieces(spark, str(folder), 500)
        assert read.select("block").distinct().count() > 4
        named = read.select(F.lit(1).cast("long").alias("file_id"), F.lit("python").alias("language"), "block", "part", "alone", "text")
        found = pieces.scan_pieces(named)
        whole = spark.createDataFrame([(1, "p", "big.py", "python", text)],
                                      "file_id long, project_id string, filename string, language string, source string")
        assert rows(found) == rows(scan.scan_files(whole))
        assert found.count() > 10_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert os.path.getsize(folder / "big.py") > 1_000_000


def test_small_files_from_disk_are_pieces_of_their_own(spark, tmp_path):
    texts = {"a.py": "eval(x)\n", "b.py": "eval(x)\n\neval(y)", "c.py": "x\n" * 30, "ä.py": "# ä\r\neval(é)"}
    folder = tmp_path / "files"
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    read = pieces.read_pieces(spark, str(folder), 10).collect()
    joined = {}
    for r in sorted(read, key=lambda r: (r["path"], r["block"], r["part"])):
        joined[r["path"]] = joined.get(r["path"], "") + r["text"]
    assert sorted(joined.values()) == sorted(t if t.endswith("\n") else t + "\n" for t in texts.values())
    assert all(joined[r["path"]] == r["text"] for r in read if r["alone"])
    assert sum(r["alone"] for r in read) >= 2
    assert sum(r["text"].count("\n") for r in read) == sum(len(t.splitlines()) for t in texts.values())


def test_no_files(spark, make_files):
    empty = make_files(("python", "x")).limit(0)
    assert pieces.scan_pieces(pieces.cut(empty)).count() == 0
