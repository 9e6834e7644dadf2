"""Rules and structure against plain Python on small texts."""

import ast
import re

import pytest
from pyspark.sql import functions as F

from sieveline.operators import lines, literals as literals_of, scan, structure
from sieveline.rules import PACKS
from sieveline.sources import corpus

# rule -> (line that fires, line that does not)
CASES = {
    "PY-SEC-001": ("cur.execute('select ' + name)", "cur.execute('select 1', (name,))"),
    "PY-SEC-001b": ("q = 'SELECT a FROM t WHERE x = {}'.format(x)", "q = f'SELECT a FROM t WHERE x = {x}'"),
    "PY-SEC-002": ("os.system('rm ' + path)", "os.system('ls')"),
    "PY-SEC-002b": ("subprocess.call(cmd, shell=True)", "subprocess.call([cmd], shell=False)"),
    "PY-SEC-003": ("y = eval(text)", "y = ast.literal_eval(text)"),
    "PY-SEC-003b": ("exec(code)", "cursor.execute(code)"),
    "PY-SEC-004": ("h = hashlib.md5(x)", "h = hashlib.sha256(x)"),
    "PY-SEC-004b": ("h = hashlib.sha1(x)", "h = hashlib.sha512(x)"),
    "PY-SEC-005": ("password = 'abcdef'", "password = 'abc'"),
    "PY-SEC-006": ("pickle.loads(data)", "pickle.dumps(data)"),
    "PY-SEC-007": ("yaml.load(stream)", "yaml.load(stream, Loader=yaml.SafeLoader)"),
    "PY-SEC-008": ("open('/srv/' + name)", "open('/srv/fixed')"),
    "PY-SEC-009": ("random.choice(xs)", "secrets.choice(xs)"),
    "PY-SEC-010": ("app.run(port=1, debug=True)", "app.run(port=1, debug=False)"),
    "PY-MAINT-001": ("    except:", "    except ValueError:"),
    "PY-MAINT-002": ("def f(a, b=[]):", "def f(a, b=None):"),
    "PY-MAINT-003": ("# todo later", "# done"),
    "PY-MAINT-004": ("  print(x)", "log(x)  # print(x)"),
    "PY-PERF-001": ("s += 'x'", "s = s + 'x'"),
    "JAVA-SEC-001": ('st.executeQuery("select " + id);', 'st.executeQuery("select 1");'),
    "JAVA-SEC-002": ('String password = "abcdef";', 'String password = read();'),
    "JAVA-SEC-003": ("Object o = in.readObject();", "Object o = in.read();"),
    "JAVA-SEC-004": ("Random r = new Random();", "Random r = new SecureRandom();"),
    "JAVA-SEC-005": ("a.getB().c();", "a.getB();"),
    "JAVA-SEC-006": ("e.printStackTrace();", "log.error(e);"),
    "JAVA-MAINT-001": ("} catch (Exception e) { }", "} catch (Exception e) { log(e); }"),
    "JAVA-MAINT-002": ("// FIXME now", "// fixed"),
    "CS-SEC-001": ('new SqlCommand("select " + id);', 'new SqlCommand("select 1");'),
    "CS-SEC-002": ('var password = "12345678";', 'var password = "1234567";'),
    "CS-SEC-003": ("new BinaryFormatter();", "new MyBinaryFormatterX();"),
    "CS-SEC-004": ("var h = MD5.Create();", "var h = SHA256.Create();"),
    "CS-SEC-005": ("File.ReadAllText(x); File.Read(Request.Path);", "File.Read(path);"),
    "CS-SEC-006": ("Response.Write(Request.Query);", 'Response.Write("x");'),
    "CS-MAINT-001": ("catch { }", "catch { Log(); }"),
    "CS-MAINT-002": ("// HACK", "// hacksaw"),
    "JS-SEC-001": ("el.innerHTML = x;", "if (el.innerHTML == x) {}"),
    "JS-SEC-001b": ("document.write(x);", "document.writeln(x);"),
    "JS-SEC-002": ("eval(x);", "evaluate(x);"),
    "JS-SEC-003": ("localStorage.setItem('token', t);", "localStorage.setItem('theme', t);"),
    "JS-SEC-004": ("Object.assign(a, JSON.parse(b));", "Object.assign(a, b);"),
    "JS-SEC-005": ("const api_key = 'ABCDEFGHIJKLMNOP';", "const api_key = 'short';"),
    "JS-SEC-006": ("w.postMessage(m, '*');", "w.postMessage(m, origin);"),
    "JS-MAINT-001": ("console.log(x);", "console.error(x);"),
    "JS-MAINT-002": ("if (a == b) {}", "if (a === b) {}"),
    "JS-MAINT-003": ("// BUG here", "// debugging"),
}
ODD = ["", "   ", "\t", "pa\u017f\u017fword = 'long enough'", "\u0131", "\u00e9eval(x)", "EVAL (x)", "x\u00a0+=\u00a0'y'",
       "\u00e9 += 'x'", "e.PRINTSTACKTRACE()", "TOKEN\u2003= 'abcdefgh'", "app.run(debug\u00a0=\u00a0True)", "\u212aey == \u212a"]


def brute(language, source):
    """The pack tried line by line."""
    found = set()
    for number, line in enumerate(source.splitlines(), 1):
        if not line.strip():
            continue
        for rule in PACKS.get(language, ()):
            if rule.pattern and re.search(rule.pattern, line, re.IGNORECASE):
                found.add((rule.rule_id, number, line.strip()[:500]))
    return found


def texts():
    out = []
    for language, rules in PACKS.items():
        body = [line for rule in rules if rule.rule_id in CASES for line in CASES[rule.rule_id]] + ODD
        for end in ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u2029"):
            out.append((language, end.join(body)))
            out.append((language, end.join(body) + end))
    out += [("cobol", "eval(x)"), ("python", ""), ("python", "\n\n"), ("python", "x" * 2000 + " eval(y) " + "z" * 900)]
    return out


def test_every_line_rule_has_a_case():
    assert set(CASES) == {r.rule_id for rules in PACKS.values() for r in rules if r.pattern}


@pytest.mark.parametrize("guarded", [True, False])
def test_scan_equals_plain_matching(make_files, guarded):
    rows = texts()
    got = {}
    for row in scan.scan_files(make_files(*rows), structural=False, guarded=guarded).collect():
        got.setdefault(row.file_id, set()).add((row.rule_id, row.line_start, row.code_snippet))
    for n, (language, source) in enumerate(rows):
        assert got.get(n, set()) == brute(language, source), (language, source[:80])


def test_each_rule_fires_and_stays_silent(make_files):
    rows, wanted = [], []
    for language, rules in PACKS.items():
        for rule in rules:
            if rule.pattern:
                for line, fires in zip(CASES[rule.rule_id], (True, False)):
                    rows.append((language, line))
                    wanted.append((rule.rule_id, fires))
    got = {(r.file_id, r.rule_id) for r in scan.scan_files(make_files(*rows), structural=False).collect()}
    for n, (rule_id, fires) in enumerate(wanted):
        assert ((n, rule_id) in got) == fires, (rule_id, rows[n])


@pytest.mark.parametrize("limit", [1 << 20, 3])
def test_table_plan_agrees_with_literal_plan(spark, make_files, monkeypatch, limit):
    monkeypatch.setattr(scan, "BROADCAST_BYTES", limit)
    files = make_files(*texts())
    a = scan.scan_files(files, structural=False).select("file_id", "rule_id", "line_start", "code_snippet")
    b = scan.scan_with_table(files, scan.rule_table(spark)).select(*a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_same_result_in_any_partitioning(spark, sf_dir):
    files = corpus.files(spark, sf_dir)
    want = sorted(map(tuple, scan.scan_files(files).drop("shap_features").collect()), key=str)
    for pieces in (1, 7):
        got = scan.scan_files(files.repartition(pieces)).drop("shap_features").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_duplicate_rule_ids_are_refused(make_files):
    with pytest.raises(ValueError):
        scan.scan_files(make_files(("python", "x")), {"python": PACKS["python"][:1] * 2})


def test_lines(make_files):
    cases = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb", "a\rb\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i"]
    rows = lines.explode_lines(make_files(*[("python", c) for c in cases])).collect()
    for n, text in enumerate(cases):
        got = [r.line for r in sorted(rows, key=lambda r: r.line_no) if r.file_id == n]
        assert got == text.splitlines()


def test_long_functions(make_files):
    def py(body):
        return "def a(x):\n" + "    pass\n" * body + "def b(x):\n    pass\n" + "    pass\n" * 80
    rows = scan.scan_files(make_files(("python", py(60)), ("python", py(59)),
                                      ("javascript", "let f = function () {\n" + "x\n" * 70 + "function g() {}"))) \
        .filter(F.col("rule_id").endswith("LONGFN")).orderBy("file_id").collect()
    assert [(r.file_id, r.rule_id, r.line_start, r.line_end, r.code_snippet) for r in rows if r.file_id == 0] == \
        [(0, "PY-MAINT-LONGFN", 1, 61, "def b(x):")]
    assert not [r for r in rows if r.file_id == 1]


def _paths(node):
    kinds = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension, ast.BoolOp)
    return 1 + sum(isinstance(x, kinds) for x in ast.walk(node))


def test_complexity(make_files):
    branchy = "def f(a):\n" + "".join(f"    if a == {n} and a:\n        return {n}\n" for n in range(5))
    sources = [branchy, branchy + "    if a:\n        return 9\n", "def f(:\n" + "if and or " * 20, "def g():\n" + "    pass\n",
               "async def h(x):\n    return [i for i in x if i]\n" + branchy.replace("\n", "\n") * 2]
    got = {(r.file_id, r.line_start): r.confidence_score
           for r in scan.scan_files(make_files(*[("python", s) for s in sources])).filter("rule_id = 'PY-CMPLX-001'").collect()}
    want = {}
    for n, source in enumerate(sources):
        try:
            tree = ast.parse(source)
        except SyntaxError:
            continue
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and _paths(node) > 10:
                want[(n, node.lineno)] = min(0.95, 0.7 + (_paths(node) - 10) * 0.02)
    assert got == want and want


def test_complexity_of_awkward_files(make_files):
    """Tabs, remarks, literals, inner functions, loops over async iterators; compared with the parser."""
    body = "".join(f"\tif a == {n} and b or c:\n\t\tpass\n" for n in range(4))
    sources = [
        "def\tf(a, b, c):\n" + body, "def f(a, b, c):\n" + body.replace("\n", "\r\n"),
        'def f(a):\n    """\n' + "if and or for while\n" * 9 + '"""\n    x = "if and or" # if and or\n    return 1\n',
        "class C:\n    def f(self):\n        def g(x):\n" + "".join(f"            if x == {n}: return {n}\n" for n in range(11)) + "        return g\n\n    def h(self): pass\n",
        "async def f(x):\n    async for i in x:\n        pass\n" + "".join("    y = [i async for i in x if i]\n" for _ in range(10)),
        "def f(x):\n" + "    with x: assert x\n" * 3 + "    while x:\n        try:\n            pass\n        except ValueError:\n            pass\n    return (x and\n        x) or [i for i in x for j in i if j]\n"]
    got = {(r.file_id, r.line_start): r.confidence_score
           for r in scan.scan_files(make_files(*[("python", s) for s in sources])).filter("rule_id = 'PY-CMPLX-001'").collect()}
    want = {(n, node.lineno): min(0.95, 0.7 + (_paths(node) - 10) * 0.02) for n, source in enumerate(sources)
            for node in ast.walk(ast.parse(source)) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and _paths(node) > 10}
    assert got == want and len(want) >= 5


def test_very_long_literals(make_files):
    long = "x\\n" * 250_000
    rows = make_files(("csharp", f'class A {{ string s = "{long}"; string t = @"{"y" * 500_000}""z"; /* {long} */ }}'),
                      ("python", f'a = "{long}"\nb = f\'{long}\' # {long}'), ("javascript", f"a = `{long}`; b = /{'z' * 300_000}/g"),
                      ("java", f'String s = "{long}"; // {long}'), ("csharp", '@"open ""quote"" and on'))
    from sieveline.operators import tokens
    counts = {(r.language, r.kind): r.tokens for r in tokens.token_counts(rows).collect()}
    assert counts["csharp", "string"] == 3 and counts["python", "string"] == 2
    assert counts["javascript", "string"] == counts["javascript", "regex"] == counts["java", "string"] == 1
    first = structure.csharp_metrics(rows).orderBy("file_id").collect()[0]
    assert (first.class_count, first.max_nesting_depth) == (1, 0)
    assert scan.scan_files(rows).count() >= 0


def test_metrics(make_files):
    source = "# top\nimport os\n\ndef f():\n    return 1"
    row = structure.file_metrics(make_files(("python", source), ("python", ""), ("cobol", "a\n\nbcd\n"))).orderBy("file_id").collect()
    assert tuple(row[0])[1:] == (5, 1, 1, 1, 0, 8, 12, 5, len(source))
    assert tuple(row[1])[1:] == (0, 0, 0, 0, 0, 0, 0, 1, 0)
    assert tuple(row[2])[1:] == (3, 1, 0, 0, 0, 2, 3, 4, 7)


def test_csharp_structure(make_files):
    source = '''using System;
namespace A {
  class P {
    public P(int x) { }
    public int X { get; set; }
    string Say(string s) { if (s == "{{{") { return "}"; } return Foo(s); }
    // { { {
    public async Task Run() { await Go(); }
  }
}'''
    row = structure.csharp_metrics(make_files(("csharp", source), ("java", source))).collect()
    assert len(row) == 1
    assert (row[0].class_count, row[0].method_count, row[0].property_count, row[0].namespace_count,
            row[0].using_count, row[0].comment_count, row[0].max_nesting_depth,
            row[0].has_async_methods, row[0].has_unsafe_blocks) == (1, 2, 1, 1, 1, 1, 2, True, False)


def test_service_lines_and_snippets(make_files):
    from sieveline.rules import SERVICE_PACK
    source = "a\x0bb\rc\n\t  new BinaryFormatter();\x0c " + "x" * 300 + "  \nend"
    rows = scan.service_findings(make_files(("csharp", source)), SERVICE_PACK).collect()
    assert {r.line_start for r in rows} == {2}
    assert all(r.snippet == ("new BinaryFormatter();\x0c " + "x" * 300)[:200] for r in rows)


def complexities(make_files, sources):
    """What is found, by file and line, and what the parser says."""
    files = make_files(*[("python", s) for s in sources])
    rows = files.select("file_id", F.explode(structure.complex_functions(F.col("language"), F.col("source"))).alias("c")).collect()
    want = {}
    for n, source in enumerate(sources):
        try:
            tree = ast.parse(source)
        except SyntaxError:
            continue
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and _paths(node) > 10:
                want[(n, node.lineno)] = (node.name, _paths(node))
    return {(r.file_id, r.c.line): (r.c.name, r.c.complexity) for r in rows}, want


BRANCHY = "".join(f"    if a == {n} and b:\n        pass\n" for n in range(6))


def test_complexity_with_quotes_and_brackets(make_files):
    """Quotes in remarks and literals, brackets over lines, groups of operators, decorators, prefixes."""
    f = "def f(a, b):\n" + BRANCHY
    sources = [
        '# say """ here\n' + f, "a = '\"\"\"'\n" + f, 'a = "\'\'\'" # \'\n' + f, "x = '#'\n" + f, "x = r'\\'' + b\"\\\"#\"\n" + f,
        'def g(a, b):\n    """if and """\n    s = "it\'s # " # don\'t\n' + BRANCHY + "\n\n" + f,
        "def f(a, b):\n    return [\n(a and b) or (a and c),\n[x for x in a if x and b or c and d]\n]\n" + BRANCHY + "y = 1\n",
        "def f(a, b):\n" + "    x = (a and b) or (c and d)\n" * 4, "def f(a, b):\n" + "    x = a or b and c or d\n" * 5,
        "def f(a, b):\n" + "    x = a and b == c and d, a and b\n" * 5, "def f(a, b):\n" + "    x = a and \\\n  b or \\\n c\n" * 5 + "z = 1\n",
        "def f(a, b):\n" + "    g(a or b, k=a or b)[a or b:c or d]\n" * 3, "def f(a):\n" + "    x = a and b if c and d else e and f\n" * 4,
        "def f(a):\n" + "    x = lambda: a and b or (lambda q: q or a)\n" * 4, "def f(a):\n" + "    a += a or b; a //= a or b; assert a or b\n" * 3,
        "@dec(a and b or c and d)\n@other\n" + "def f(a):\n" + "    x = a or b\n" * 8, "class C:\n    @dec(a or b)\n    async def f(self):\n"
        + "        async with a or b: pass\n        async for i in a: pass\n        with a: pass\n" * 5,
        "def f(a):\n" + "\tif a: assert a\n\telse: assert a or b\n" * 4 + "\t# if and or\n\n" + "def g(a): return a and b\n",
        "def f(a):\n  return {\n" + "  a: b or c,\n" * 11 + "  }\n", "def f(a):\n" + "  while a!=b and b>=c or d<=e and f==g: pass\n" * 3,
        'def f(a):\n    """doc\n  def x(): if and or\n' + "if and\n" * 9 + '    """\n' + BRANCHY.replace("b:", "b or c:"),
        "def f(a):\n" + "    x = [i for i in a for j in i]\n" * 6 + "    def g(): pass\n", "def f(a, b=(c and d) or (e and f)) -> (a or b):\n" + BRANCHY,
        "def f(a):\n    x = '\\\n if and or \\\n'\n" + BRANCHY + "x = 1\nif a and b: pass\n" + f, "if x:\n  " + f.replace("\n", "\n  ").rstrip(" "),
        "def f(a):\n" + "    try: pass\n    except (A or B): pass\n    except: pass\n" * 4, f.replace("\n", "\r\n"), f.replace("\n", "\r"),
        "def f(a):\n" + "    match a:\n        case 1 if a and b: pass\n" * 10, "def f(:\n" + BRANCHY, f + "x = (1\n", f + "s = 'open\n", "x = )\n" + f, f + '"""',
        "def f(a):\n    return a.x if a.y and not a.z or not (a or b) else yield_ and a\n" + BRANCHY, "def ünïcode(a):\n" + BRANCHY,
        "async  def  f(a):\n" + BRANCHY + "\x0c\ndef g(a): pass\n", f + "    if (yield a) and b: pass\n" + "if a or b:\n    pass\n" * 9]
    got, want = complexities(make_files, sources)
    assert got == want and len(want) >= 30


def test_complexity_of_a_library(make_files):
    """Files of the standard library, but for operators inside f-strings."""
    import argparse
    import difflib
    import inspect
    import tarfile
    import textwrap
    import tokenize
    sources = [inspect.getsource(m) for m in (argparse, difflib, tarfile, textwrap, tokenize, ast)]
    got, want = complexities(make_files, sources)
    assert got == want and len(want) > 30


@pytest.mark.parametrize("pattern, literals", [
    (r"\beval\s*\(", ["eval"]), (r"os\.system\(", ["os.system("]), (r"(?:md5|sha1)\(", ["md5(", "sha1("]), (r"a?b+c{2,}", ["b"]),
    (r"[ab]c*", ["a", "b"]), (r"[a-z]c*", []), (r"foo|fab", ["fab", "foo"]), (r"x[=:]['\"]y", ['x:"y', "x:'y", 'x="y', "x='y"]), (r"(foo|b.r)baz", ["baz"]), (r"(foobar|ba.)x", ["ba"]), (r"Straße", ["stra"]), (r"x*", []),
    (r"(?=needle)n", ["needle"]), (r"(?!needle)n", ["n"]), (r"(", []), (None, []), (r"(?i:SELECT)\s+\w+\s+FROM", ["select"]),
    (r"(?:abc|abcd)", ["abc"]), (r"\p{Alpha}word", []), (r"(?>atom)ic", ["atom"]), (r"a|", [])])
def test_required_literals(pattern, literals):
    assert literals_of.required(pattern) == literals


def test_packs_have_literals_where_they_are_met(spark):
    """A line on which a rule fires holds one of its literals."""
    without = []
    for rules in PACKS.values():
        for rule in rules:
            if rule.pattern:
                found = literals_of.required(rule.pattern)
                without += [] if found else [rule.rule_id]
                line = CASES[rule.rule_id][0].lower()
                assert not found or any(s in line for s in found)
    assert len(without) <= 5


@pytest.mark.parametrize("limit", [64 << 20, 1000])
def test_thousands_of_rules(spark, make_files, monkeypatch, limit):
    """5,000 rules: rows as by trying all of them, and no more candidate pairs than literal hits."""
    import random
    monkeypatch.setattr(scan, "BROADCAST_BYTES", limit)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(3000)})
    shapes = (r"\b{0}\s*\(", r"{0}\.{1}", r"(?:{0}|{1})\s*=\s*[\"']", r"{0}.*{1}", r"{0}[0-9]+")
    rules = [("python", f"R{n}", n, "low", 0.5, shapes[n % 5].format(rng.choice(words), rng.choice(words))) for n in range(5000)]
    rules += [("python", "FREE", 5000, "low", 0.5, r"^\s*[0-9]{4}$"), ("python", "NONE", 5001, "low", 0.5, None),
              ("java", "OTHER", 0, "low", 0.5, words[0])]
    table = spark.createDataFrame(rules, "language string, rule_id string, rule_ordinal int, severity string, confidence double, "
                                         "pattern string")
    ends = ("(x)", " = 'v'", "7", ".", "")
    texts_ = ["\n".join(f"{rng.choice(words)}{rng.choice('. ')}{rng.choice(words).upper()}{rng.choice(ends)}" for _ in range(60))
              + "\n\n 2024\n" for _ in range(6)] + [f"{words[0]} ſ\u212aı" + words[1].replace("s", "ſ").replace("i", "ı") + "("]
    files = make_files(*[("python", t) for t in texts_])
    got = sorted((r.file_id, r.line_start, r.rule_id) for r in scan.scan_with_table(files, table).collect())
    compiled = [(r[1], re.compile(r[5], re.IGNORECASE)) for r in rules if r[0] == "python" and r[5]]
    folded = [[line.replace("ſ", "s").replace("ı", "i") for line in t.split("\n")] for t in texts_]
    want = sorted((n, at + 1, rule) for n, ls in enumerate(folded) for at, line in enumerate(ls) for rule, p in compiled if p.search(line))
    assert got == want and len(got) > 100
    entries = literals_of.index(table.filter("pattern IS NOT NULL"))
    kept = [(r.rule_id, r.literal) for r in entries.collect() if r.language == "python" and r.literal]
    lined, held = lines.explode_lines(files).filter("language = 'python'"), entries.filter("literal IS NOT NULL AND language = 'python'")
    sizes = sorted({len(r.gram) for r in held.collect()})
    pairs = scan.automaton_hits(lined, held) if limit > 1000 else scan.gram_hits(lined, held, sizes)
    hits = {(n, at, rule) for n, ls in enumerate(folded) for at, line in enumerate(ls) for rule, s in kept if s in line.lower()}
    assert pairs.count() == len(hits) < 5000 * 370 / 50
