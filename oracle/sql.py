"""SQL counterparts of the queries, built from shared common table expressions.

They are written apart from the Spark code: plain joins, windows and aggregates over the
given tables.  Only data is shared: templates, rule patterns, feature weights and words.
Expressions of the regular-expression engine here have no look-ahead, so two rules are
spelled differently.
"""

from sieveline.operators.diagnostics import CSHARP_SEVERITIES, JAVA_KINDS
from sieveline.operators.structure import CLASS_LINE, COMMENT_LINE, FUNCTION_LINE, HEADER
from sieveline.operators.tokens import TOKENS
from sieveline.plans import registry
from sieveline.rules import PACKS, SERVICE_PACK
from sieveline.rules.features import DISPLAY, FEATURE_SIGNAL, SIGNALS, WEIGHTS
from sieveline.sources.corpus import COMMENT, TEMPLATES, UPLOAD_EPOCH


def q(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows):
    return "VALUES " + ",\n".join("(" + ", ".join(rows_) + ")" for rows_ in rows)


BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
RANK = "CASE {0} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"
RISK_WEIGHT = "CASE {0} WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.75::DOUBLE WHEN 'medium' THEN 0.45::DOUBLE WHEN 'low' THEN 0.2::DOUBLE WHEN 'info' THEN 0.02::DOUBLE ELSE 0.1::DOUBLE END"


def rounded(expr, digits):
    """Rounding by the exact binary value."""
    return f"CAST(printf('%.{digits}f', ({expr})::DOUBLE) AS DOUBLE)"


def strip(expr):
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def snippet(expr):
    return f"substring({strip(expr)}, 1, 500)"


def by_language(patterns, line="line"):
    cases = " ".join(f"WHEN {q(k)} THEN regexp_matches({line}, {q(p)})" for k, p in patterns.items())
    return f"CASE language {cases} ELSE false END"


# rules whose expression needs another spelling here
RESPELLED = {
    "JS-SEC-001": r"regexp_matches(line, '(?i)\.innerHTML\s*=([^=]|$)')",
    "PY-SEC-007": r"len(list_filter(regexp_extract_all(lower(line), '\byaml\.load\s*\(([^)]*)', 1), lambda a: NOT contains(a, 'safeloader'))) > 0",
}


def hits(packs):
    parts = []
    for language, rules in packs.items():
        for n, rule in enumerate(rules):
            if rule.pattern is None:
                continue
            test = RESPELLED.get(rule.rule_id) or f"regexp_matches(line, {q('(?i)' + rule.pattern)})"
            parts.append(f"SELECT file_id, language, {n} AS ordinal, line_no, line FROM lines "
                         f"WHERE language = {q(language)} AND regexp_matches(line, '\\S') AND {test}")
    return "\nUNION ALL ".join(parts)


def rule_rows(packs):
    rows = []
    for language, rules in packs.items():
        for n, r in enumerate(rules):
            rows.append((q(language), str(n), q(r.rule_id), q(r.title), q(r.severity), q(r.category),
                         f"{r.confidence}::DOUBLE", q(r.cwe_id), q(r.owasp_category), q(r.recommendation),
                         q(r.description), "[" + ", ".join(q(f) for f in r.shap_features) + "]"))
        if packs is PACKS:
            rows.append((q(language), "2000", q({"python": "PY", "java": "JA", "csharp": "CS", "javascript": "JA"}[language] + "-MAINT-LONGFN"),
                         "'Long Function (> 60 lines)'", "'low'", "'maintainability'", "0.8::DOUBLE", "''", "''",
                         "'Move parts of it into functions of their own.'", "''",
                         "['function_length', 'cyclomatic_complexity', 'test_coverage_risk']"))
    return values(rows)


RULE_COLUMNS = "language, ordinal, rule_id, title, severity, category, confidence, cwe_id, owasp_category, recommendation, description, features"

# C# templates counted by hand: classes, methods, properties, namespaces, usings, depth, async, unsafe
CSHARP = {
    2: (1, 1, 1, 1, 1, 2, False, False), 6: (1, 1, 0, 0, 2, 2, False, False),
    10: (1, 2, 0, 1, 0, 0, False, False), 14: (2, 2, 0, 0, 1, 3, True, True),
    18: (1, 0, 2, 0, 0, 1, False, False), 22: (1, 1, 0, 0, 0, 1, False, False),
    26: (1, 1, 0, 0, 1, 1, False, False), 30: (1, 1, 0, 0, 0, 2, False, False),
    34: (1, 1, 0, 2, 0, 4, False, False), 38: (0, 0, 0, 0, 0, 0, False, False),
}


def finding_select(source, ordinal):
    return f"""SELECT h.file_id, h.language, r.rule_id, h.line_no::INT AS line_start, {source},
  r.title, r.category, r.severity, r.confidence AS confidence_score, r.recommendation, r.cwe_id,
  r.owasp_category, r.features, {ordinal}::INT AS ordinal"""


STATUS = "CASE WHEN file_id % 13 = 0 THEN 'analyzing' WHEN file_id % 11 = 0 THEN 'failed' WHEN file_id % 7 = 0 THEN 'pending' ELSE 'complete' END"


def signal(name):
    spec = SIGNALS[name]
    text = "both_text" if spec["with_line"] else "around"
    total = " + ".join(f"contains({text}, {q(w)})::INT" for w in spec["words"])
    return f"least(({total}) / {float(spec['need'])}::DOUBLE, 1.0::DOUBLE) AS \"{name}\""


def presence():
    cases = " ".join(
        f"WHEN {q(f)} THEN " + (f"1.0::DOUBLE - s.\"{s[1:]}\"" if s.startswith("!") else f"s.\"{s}\"")
        for f, s in FEATURE_SIGNAL.items())
    return f"CASE u.name {cases} ELSE 1.0::DOUBLE END"


TIE = "concat_ws('/', l_partkey, l_suppkey, l_quantity::INT, round(l_extendedprice * 100)::BIGINT)"
SEVERITY_FEED = "CASE WHEN l_returnflag = 'A' THEN 'error' WHEN l_returnflag = 'R' THEN 'warning' END"


def picked(key, table, field, kind=""):
    return "CASE " + key + " " + " ".join(f"WHEN {q(k)} THEN {q(v[field]) if isinstance(v[field], str) else str(v[field]) + '::DOUBLE'}"
                                            for k, v in table.items()) + " END"


def line_of(expr):
    return f"greatest(1, least(coalesce(try_cast({expr} AS BIGINT), 1), greatest(len(f.lines), 1)))::INT"


CTE = {
    "templates": ((), "templates(template, language, extension, comment, head)", values(
        [(str(n), q(l), q(e), q(COMMENT[l]), q(t)) for n, (l, e, t) in enumerate(TEMPLATES)])),
    "files": (("templates",), "files", """SELECT doc_id AS file_id, source AS project_id, 'f' || doc_id || extension AS filename, language, template,
  array_to_string(list_concat(list_concat(l[1:length(text) % (len(l) + 1)], [t.head]), l[1 + length(text) % (len(l) + 1):]), chr(10)) AS source
  FROM (SELECT d.*, t.*, list_transform(string_split(d.text, chr(10)), lambda x: t.comment || x) AS l FROM documents d JOIN templates t ON d.doc_id % """ + str(len(TEMPLATES)) + " = t.template) AS t"),
    "file_list": (("files",), "file_list", f"SELECT file_id, project_id, filename, language, file_id + {UPLOAD_EPOCH} AS uploaded_at, {STATUS} AS status FROM files"),
    "lined": (("files",), "lined", f"""SELECT file_id, language, CASE WHEN parts[-1] = '' THEN list_slice(parts, 1, len(parts) - 1) ELSE parts END AS lines
  FROM (SELECT file_id, language, regexp_split_to_array(source, '{BREAK}') AS parts FROM files)"""),
    "lines": (("lined",), "lines", "SELECT file_id, language, unnest(lines) AS line, unnest(range(1, len(lines) + 1))::INT AS line_no FROM lined"),
    "fed_lines": (("files",), "fed_lines", "SELECT file_id, language, unnest(l) AS line, unnest(range(1, len(l) + 1))::INT AS line_no FROM (SELECT file_id, language, string_split(source, chr(10)) AS l FROM files)"),
    "rules": ((), f"rules({RULE_COLUMNS})", rule_rows(PACKS)),
    "line_hits": (("lines",), "line_hits", hits(PACKS)),
    "line_found": (("line_hits", "rules"), "line_found",
                   finding_select(f"NULL::INT AS line_end, r.description, {snippet('h.line')} AS code_snippet", "h.ordinal")
                   + " FROM line_hits h JOIN rules r ON h.language = r.language AND h.ordinal = r.ordinal"),
    "python_lines": (("files",), "python_lines", r"""SELECT file_id, n, line, length(regexp_extract(line, '^[ \t]*')) AS indent, regexp_matches(line, '[^\s"]') AS filled,
  regexp_extract(line, '^\s*(?:async\s+)?def\s+(\w+)', 1) AS name, len(regexp_extract_all(line, '(?:^|[:;])\s*(?:if|elif|while|except|with|assert)\b'))
  + len(regexp_extract_all(line, '\bfor\b')) - regexp_matches(line, '^\s*async for\b')::INT + regexp_matches(line, '\band\b')::INT + regexp_matches(line, '\bor\b')::INT AS paths
  FROM (SELECT file_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT file_id, regexp_split_to_array(regexp_replace(
    array_to_string(list_transform(regexp_split_to_array(source, '\"\"\"|'''''''), lambda p, n: CASE WHEN n % 2 = 0 THEN regexp_replace(p, '[^\n\r]+', '', 'g') ELSE p END), '""'),
    '"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|#[^\n]*', '""', 'g'), '\r\n|\n|\r') AS l FROM files WHERE language = 'python'))"""),
    "complex": (("python_lines",), "complex", """SELECT h.file_id, h.name, h.n AS line_no, 1 + sum(b.paths) AS paths
  FROM (SELECT *, (SELECT min(n) FROM python_lines e WHERE e.file_id = o.file_id AND e.n > o.n AND e.filled AND e.indent <= o.indent) AS stop FROM python_lines o WHERE name <> '') h
  JOIN python_lines b ON b.file_id = h.file_id AND b.n >= h.n AND b.n < coalesce(h.stop, 1e9) GROUP BY ALL HAVING sum(b.paths) >= 10"""),
    "complex_found": (("complex", "lines", "rules"), "complex_found", finding_select(
        "NULL::INT AS line_end, 'Function ''' || c.name || ''' has cyclomatic complexity of ' || c.paths || ' (threshold: 10).' AS description, "
        + snippet("h.line") + " AS code_snippet", "1000").replace("r.confidence AS", "least(0.95::DOUBLE, 0.7::DOUBLE + (c.paths - 10) * 0.02::DOUBLE) AS")
        + " FROM complex c JOIN lines h ON h.file_id = c.file_id AND h.line_no = c.line_no JOIN rules r ON r.rule_id = 'PY-CMPLX-001'"),
    "heads": (("lines",), "heads", f"""SELECT *, lead(line_no) OVER w AS next_no, lead(line) OVER w AS next_line,
  CASE language {' '.join(f"WHEN {q(k)} THEN regexp_extract(line, {q(p)}, 1)" for k, p in HEADER.items())} END AS name
  FROM lines WHERE {by_language(HEADER)} WINDOW w AS (PARTITION BY file_id ORDER BY line_no)"""),
    "long_found": (("heads", "rules"), "long_found", finding_select(
        "(h.next_no - 1)::INT AS line_end, 'Function ''' || coalesce(nullif(h.name, ''), 'unknown') || ''' is ' || (h.next_no - h.line_no) || ' lines long.' AS description, "
        + snippet("h.next_line") + " AS code_snippet", "2000")
        + " FROM heads h JOIN rules r ON r.language = h.language AND r.ordinal = 2000 WHERE h.next_no - h.line_no > 60"),
    "findings": (("line_found", "complex_found", "long_found"), "findings",
                 "SELECT *, sha256(file_id || '|' || rule_id || '|' || line_start) AS finding_id, " + RANK.format("severity") + " AS sev_rank FROM ("
                 "SELECT * FROM line_found UNION ALL SELECT * FROM complex_found UNION ALL SELECT * FROM long_found)"),
    "ranked": (("findings",), "ranked", "SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sev_rank, line_start, ordinal) AS rank, count(*) OVER (PARTITION BY file_id) AS in_file FROM findings"),
    "risk": (("ranked",), "risk", f"SELECT file_id, {rounded('least(sum(' + RISK_WEIGHT.format('severity') + ' * confidence_score * (1.0 / sqrt(rank)) * 0.35::DOUBLE ORDER BY rank), 0.98)', 4)} AS risk_score, "
             "count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM ranked GROUP BY file_id"),
    "scored": (("file_list", "risk"), "scored", "SELECT f.*, CASE WHEN status = 'complete' THEN coalesce(r.risk_score, 0.0::DOUBLE) END AS risk_score, coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high FROM file_list f LEFT JOIN risk r USING (file_id)"),
    "projects": ((), "projects", f"SELECT source AS project_id, 'Project ' || source AS name, 'Documents, among them ' || max(lang) AS description, min(doc_id) * 86400 + {UPLOAD_EPOCH} AS created_at FROM documents GROUP BY source"),
    "signals": (("findings", "lined"), "signals", "SELECT file_id, rule_id, line_start, finding_id, title, severity, confidence_score, features, "
                + ", ".join(signal(n) for n in SIGNALS) + """ FROM (SELECT *, lower(line) || ' ' || around AS both_text FROM (
  SELECT f.*, l.lines[f.line_start] AS line, lower(array_to_string(list_slice(l.lines, greatest(f.line_start - 5, 1), least(f.line_start + 4, len(l.lines))), ' ')) AS around
  FROM findings f JOIN lined l USING (file_id)))"""),
    "weights": ((), "weights(name, weight)", values([(q(k), f"{v}::DOUBLE") for k, v in WEIGHTS.items()])),
    "wording": ((), "wording(name, display)", values([(q(k), q(v)) for k, v in DISPLAY.items()])),
    "features": (("signals", "weights", "wording"), "features", f"""SELECT finding_id, file_id, rule_id, line_start, title, confidence_score, i, u.name, round_even({presence()}, 0)::INT AS value,
  {rounded('coalesce(w.weight, 0.0::DOUBLE) * (0.7::DOUBLE + ' + presence() + ' * 0.3::DOUBLE)', 4)} AS shap_value,
  coalesce(d.display, upper(left(replace(u.name, '_', ' '), 1)) || lower(substr(replace(u.name, '_', ' '), 2))) AS display
  FROM (SELECT *, unnest(features) AS name, unnest(range(len(features))) AS i FROM signals) u
  JOIN signals s USING (finding_id) LEFT JOIN weights w ON w.name = u.name LEFT JOIN wording d ON d.name = u.name""".replace(
        "SELECT finding_id, file_id, rule_id, line_start, title, confidence_score, i,",
        "SELECT u.finding_id, u.file_id, u.rule_id, u.line_start, u.title, u.confidence_score, u.i,")),
    "sized": (("features",), "sized", "SELECT *, (row_number() OVER (PARTITION BY finding_id ORDER BY abs(shap_value) DESC, i) - 1)::INT AS position FROM features"),
    "predicted": (("features",), "predicted", f"""SELECT finding_id, file_id, rule_id, line_start, title, 0.25::DOUBLE AS base_value,
  {rounded('least(greatest(0.25::DOUBLE + sum(shap_value ORDER BY i), max(confidence_score) - 0.1::DOUBLE), least(max(confidence_score) + 0.05::DOUBLE, 0.99::DOUBLE))', 3)} AS prediction
  FROM features GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY finding_id, file_id, rule_id, line_start, title")),
    "tops": (("sized",), "tops", "SELECT finding_id, file_id, rule_id, line_start, display AS top_feature_name, abs(shap_value) AS top_feature_importance FROM sized WHERE position = 0"),
    "grave": (("findings",), "grave", "SELECT * FROM findings WHERE severity IN ('critical', 'high')"),
    "summaries": (("sized", "predicted"), "summaries", """SELECT p.finding_id, p.file_id, p.rule_id, p.line_start, p.title,
  'The model flagged this as ' || p.title || ' with ' || printf('%.0f', p.prediction * 100) || '% confidence.'
  || coalesce(' The primary contributing factor is ''' || s.plus[1].display || ''' (SHAP: +' || printf('%.3f', s.plus[1].v) || '), which strongly indicates vulnerable code.', '')
  || CASE WHEN len(s.plus) > 1 THEN ' Additional risk signals include: ' || array_to_string(list_transform(s.plus[2:3], lambda x: '''' || x.display || ''''), ', ') || '.' ELSE '' END
  || coalesce(' The risk is partially mitigated by ''' || s.minus[1].display || ''' (SHAP: ' || printf('%.3f', s.minus[1].v) || '), which reduces the score.', '') AS summary
  FROM predicted p JOIN (SELECT finding_id, coalesce(list({'display': display, 'v': shap_value} ORDER BY position) FILTER (shap_value > 0), []) AS plus,
  coalesce(list({'display': display, 'v': shap_value} ORDER BY position) FILTER (shap_value < 0), []) AS minus FROM sized GROUP BY finding_id) s USING (finding_id)"""),
    "java_kept": ((), "java_kept", f"""SELECT l_orderkey // 15 AS file_id, l_orderkey * 10 + l_linenumber AS seq, {TIE} AS sub,
  CASE WHEN l_returnflag = 'A' THEN 'ERROR' WHEN l_linestatus = 'O' OR l_returnflag = 'R' THEN 'WARNING' END AS kind,
  CASE WHEN l_quantity >= 49 THEN 'n/a' ELSE (l_linenumber * 3 - 5)::VARCHAR END AS line,
  CASE WHEN l_tax = 0.08 THEN 'Compiler diagnostic' ELSE 'part ' || l_partkey END AS message,
  CASE WHEN l_discount = 0 THEN '' ELSE 'use(' || l_suppkey || ')' END AS fragment FROM lineitem"""),
    "java_found": (("java_kept", "lined"), "java_found", f"""SELECT k.file_id, {picked('k.kind', JAVA_KINDS, 3)} AS rule_id, {line_of('k.line')} AS line_start, NULL::INT AS line_end,
  {picked('k.kind', JAVA_KINDS, 4)} AS title, k.message AS description, {picked('k.kind', JAVA_KINDS, 1)} AS category, {picked('k.kind', JAVA_KINDS, 0)} AS severity,
  {picked('k.kind', JAVA_KINDS, 2)} AS confidence_score,
  substring(CASE WHEN k.fragment <> '' THEN k.fragment ELSE {strip('coalesce(f.lines[' + line_of('k.line') + "], '')")} END, 1, 500) AS code_snippet,
  '' AS cwe_id, '' AS owasp_category, (100000 + n - 1)::INT AS ordinal, {picked('k.kind', JAVA_KINDS, 5)} AS features
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq, sub) AS n FROM java_kept WHERE kind IS NOT NULL) k
  JOIN lined f ON f.file_id = k.file_id AND f.language = 'java'"""),
    "cs_items": ((), "cs_items", f"""SELECT l_orderkey // 15 AS file_id, 0 AS part, l_orderkey * 10 + l_linenumber AS seq, {TIE} AS sub, * FROM (
  SELECT *, {SEVERITY_FEED} AS sev, CASE WHEN l_tax = 0 THEN 'UNKNOWN' ELSE 'CS0' || (l_suppkey % 7 + 100) END AS number FROM lineitem WHERE l_tax <> 0.07) WHERE sev IS NOT NULL"""),
    "cs_rows": (("cs_items",), "cs_rows", f"""SELECT file_id, part, seq, sub, 'CS-ROS-' || number AS rule_id, {picked('sev', CSHARP_SEVERITIES, 3)} || ' (' || number || ')' AS title,
  'part ' || l_partkey AS description, {picked('sev', CSHARP_SEVERITIES, 0)} AS severity, {picked('sev', CSHARP_SEVERITIES, 1)} AS category,
  {picked('sev', CSHARP_SEVERITIES, 2)} AS confidence_score, '' AS cwe_id, (l_linenumber * 3 - 5) AS line, '' AS fragment, {picked('sev', CSHARP_SEVERITIES, 4)} AS features FROM cs_items
  UNION ALL SELECT l_orderkey // 15, 1, l_orderkey * 10 + l_linenumber, {TIE}, CASE WHEN l_linestatus = 'O' THEN 'CS-SEC-002' ELSE 'CS-PERF-001' END,
  'Service rule', 'Service rule', CASE WHEN l_discount < 0.03 THEN 'high' ELSE 'medium' END, CASE WHEN l_discount < 0.05 THEN 'style' ELSE 'security' END,
  0.75::DOUBLE, 'CWE-1', l_linenumber, 's' || l_linenumber, 'roslyn_rule_match' FROM lineitem WHERE l_tax <> 0.07 AND l_discount <> 0.1"""),
    "cs_found": (("cs_rows", "lined"), "cs_found", f"""SELECT k.file_id, k.rule_id, {line_of('k.line')} AS line_start, NULL::INT AS line_end, k.title, k.description, k.category, k.severity, k.confidence_score,
  substring(CASE WHEN k.fragment <> '' THEN k.fragment ELSE {strip('coalesce(f.lines[' + line_of('k.line') + "], '')")} END, 1, 500) AS code_snippet,
  k.cwe_id, '' AS owasp_category, (100000 + n - 1)::INT AS ordinal, k.features
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY part, seq, sub) AS n FROM cs_rows) k
  JOIN lined f ON f.file_id = k.file_id AND f.language = 'csharp'"""),
    "merged": (("findings", "java_found", "cs_found"), "merged", """SELECT * EXCLUDE (place, first_ordinal), first_ordinal AS ordinal FROM (
  SELECT file_id, rule_id, line_start, severity, confidence_score, title, min(ordinal) OVER k AS first_ordinal,
  row_number() OVER (PARTITION BY file_id, rule_id, line_start ORDER BY confidence_score DESC, ordinal) AS place
  FROM (SELECT file_id, rule_id, line_start, severity, confidence_score, title, ordinal FROM findings
  UNION ALL SELECT file_id, rule_id, line_start, severity, confidence_score, title, ordinal FROM java_found
  UNION ALL SELECT file_id, rule_id, line_start, severity, confidence_score, title, ordinal FROM cs_found)
  WINDOW k AS (PARTITION BY file_id, rule_id, line_start)) WHERE place = 1"""),
    "status_events": ((), "status_events", "SELECT user_id AS file_id, ts, event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'analyzing' WHEN 'purchase' THEN 'complete' ELSE 'pending' END AS status FROM events"),
    "last_status": (("status_events",), "last_status", "SELECT file_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts, count(*) AS changes FROM status_events GROUP BY file_id"),
    "links": ((), "links", r"""SELECT page_id, url, part AS raw, regexp_extract(part, '^\s*(\S*)', 1) AS link, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site
  FROM (SELECT page_id, url, unnest(string_split(href, ',')) AS part FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS href FROM pages))"""),
    "page_targets": (("links",), "page_targets", "SELECT DISTINCT page_id, url, link, site || link AS target, CASE WHEN link LIKE '%.html' OR link LIKE '%/' THEN 'page' ELSE 'asset' END AS kind FROM links WHERE link LIKE '/%'"),
    "raw_files": ((), "raw_files", """SELECT doc_id AS file_id, source AS project_id, text, source = 'src3' AS damaged,
  'up/f' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.JAVA' WHEN 'de' THEN '.txt' ELSE '.mjs' END AS filename,
  CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.java' WHEN 'de' THEN '.txt' ELSE '.mjs' END AS extension,
  octet_length(encode(text)) + CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS size FROM documents"""),
}


def sql(body, *needs):
    """A statement with the tables it needs, each after its own."""
    ordered = []

    def add(name):
        for other in CTE[name][0]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{CTE[n][1]} AS MATERIALIZED ({CTE[n][2]})" for n in ordered) + "\n" + body


def reason(limit):
    return f"CASE WHEN size = 0 THEN 'empty' WHEN size > {limit} THEN 'too_large' WHEN extension = '.txt' THEN 'bad_extension' WHEN damaged THEN 'not_utf8' END"


MAIN = "file_id, rule_id, line_start, line_end, title, description, category, severity, confidence_score, code_snippet, cwe_id, owasp_category, ordinal"
BAND = "CASE WHEN risk_score IS NULL THEN 'info' WHEN risk_score >= 0.7 THEN 'critical' WHEN risk_score >= 0.4 THEN 'high' WHEN risk_score >= 0.1 THEN 'medium' ELSE 'low' END"
MEAN = "CASE WHEN count(risk_score) > 0 THEN sum(round(risk_score * 10000)::BIGINT)::DOUBLE / 10000.0::DOUBLE / count(risk_score) END"
ESCAPE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
SEVERITY_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))
SECURITY_ONLY = "rule_id LIKE '%-SEC-%'"


def token_sql():
    parts = []
    for language, rules in TOKENS.items():
        pattern = "|".join(p for _, p in rules)
        cases = " ".join(f"WHEN regexp_full_match(t, {q(p)}) THEN {q(k)}" for k, p in rules)
        parts.append(f"SELECT {q(language)} AS language, CASE {cases} END AS kind, t FROM (SELECT unnest(regexp_extract_all(line, {q(pattern)}, 0)) AS t FROM lines WHERE language = {q(language)})")
        parts.append(f"SELECT {q(language)}, 'default', t FROM (SELECT unnest(regexp_split_to_array(line, {q(pattern)})) AS t FROM lines WHERE language = {q(language)}) WHERE t <> ''")
    return "SELECT language, kind, count(*) AS tokens, sum(length(t))::BIGINT AS characters FROM (" + "\nUNION ALL ".join(parts) + ") GROUP BY language, kind"


METRICS = f"""SELECT f.file_id, coalesce(c.n, 0)::INT AS line_count, coalesce(blank, 0)::INT AS blank_lines, coalesce(comments, 0)::INT AS comment_lines,
  coalesce(functions, 0)::INT AS function_count, coalesce(classes, 0)::INT AS class_count, coalesce(round_even(total / greatest(n - blank, 1), 0), 0)::INT AS avg_line_length,
  coalesce(longest, 0)::INT AS max_line_length, (length(f.source) - length(replace(f.source, chr(10), '')) + 1)::INT AS stored_line_count, octet_length(encode(f.source))::INT AS size_bytes
  FROM files f LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (NOT regexp_matches(line, '\\S')) AS blank,
  count(*) FILTER ({by_language(COMMENT_LINE)}) AS comments, count(*) FILTER ({by_language(FUNCTION_LINE)}) AS functions, count(*) FILTER ({by_language(CLASS_LINE)}) AS classes,
  coalesce(sum(length(line)) FILTER (regexp_matches(line, '\\S')), 0)::DOUBLE AS total, max(length(line)) FILTER (regexp_matches(line, '\\S')) AS longest
  FROM lines GROUP BY file_id) c USING (file_id)"""

SERVICE_SQL = sql(f"""SELECT h.file_id, r.rule_id, h.line_no::INT AS line_start, r.title, r.severity, r.category, r.confidence AS confidence_score,
  substring(regexp_replace(h.line, '^\\s+', ''), 1, 200) AS snippet FROM ({hits(SERVICE_PACK).replace("FROM lines", "FROM fed_lines")}) h
  JOIN ({rule_rows(SERVICE_PACK)}) r({RULE_COLUMNS}) ON h.ordinal = r.ordinal""", "fed_lines")

RULE_COVERAGE = """SELECT k.rule_id, k.title, k.severity, coalesce(u.findings, 0) AS findings, coalesce(u.files, 0) AS files
  FROM (SELECT rule_id, min(title) AS title, min(severity) AS severity FROM rules GROUP BY rule_id) k
  LEFT JOIN (SELECT rule_id, count(*) AS findings, count(DISTINCT file_id) AS files FROM findings GROUP BY rule_id) u USING (rule_id)"""

ORACLE = {
    "ingest_files": sql("SELECT file_id, project_id, filename, CASE extension WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' ELSE 'javascript' END AS language, size::INT AS size_bytes, "
                        "(length(text) - length(replace(text, chr(10), '')) + 1)::INT AS line_count, 'pending' AS status, md5(text) AS text_md5 FROM raw_files WHERE " + reason(registry.RAW_LIMIT) + " IS NULL", "raw_files"),
    "ingest_rejects": sql(f"SELECT file_id, filename, reason FROM (SELECT *, {reason(registry.RAW_LIMIT)} AS reason FROM raw_files) WHERE reason IS NOT NULL", "raw_files"),
    "ingest_totals": sql(f"SELECT count(*) FILTER (reason IS NULL) AS total_created, count(*) FILTER (reason IS NOT NULL) AS total_errors FROM (SELECT {reason(registry.RAW_LIMIT)} AS reason FROM raw_files)", "raw_files"),
    "detect_language": sql("SELECT file_id, extension, CASE WHEN file_id % 5 = 0 THEN 'csharp' WHEN extension = '.java' THEN 'java' WHEN extension = '.mjs' THEN 'javascript' ELSE 'python' END AS language FROM raw_files", "raw_files"),
    "project_validation": r"""SELECT doc_id, CASE WHEN name = '' THEN 'blank' WHEN length(name) < 2 THEN 'too_short' WHEN length(name) > 255 THEN 'too_long' ELSE 'ok' END AS reason
  FROM (SELECT doc_id, regexp_replace(CASE WHEN lang = 'es' THEN substring(text, 1, 1) ELSE text END, '^\s+|\s+$', '', 'g') AS name FROM documents)""",
    "encrypt_roundtrip": sql("SELECT file_id, (length(source) - length(replace(source, chr(10), '')) + 1)::INT AS line_count, octet_length(encode(source))::INT AS size_bytes, "
                             "(octet_length(encode(source)) + 28)::INT AS blob_bytes, md5(source) AS text_md5, true AS other_key_refused, true AS altered_refused FROM files", "files"),
    "explode_lines": sql("SELECT file_id, language, line_no, line FROM lines", "lines"),
    "line_findings": sql(f"SELECT {MAIN}, recommendation, array_to_string(features, ',') AS features FROM line_found", "line_found"),
    "rule_join_findings": sql("SELECT file_id, rule_id, line_start, severity, confidence_score, ordinal, code_snippet FROM line_found", "line_found"),
    "service_findings": SERVICE_SQL,
    "long_functions": sql("SELECT file_id, rule_id, line_start, line_end, code_snippet, description FROM long_found", "long_found"),
    "function_complexity": sql("SELECT file_id, rule_id, line_start, confidence_score, code_snippet, description FROM complex_found", "complex_found"),
    "all_findings": sql(f"SELECT finding_id, {MAIN}, recommendation FROM findings", "findings"),
    "findings_in_pieces": sql(f"SELECT finding_id, {MAIN}, recommendation FROM findings", "findings"),
    "dedup_findings": """SELECT file_id, rule_id, line_start, confidence_score, first_ordinal AS ordinal FROM (
  SELECT *, min(ordinal) OVER k AS first_ordinal, row_number() OVER (PARTITION BY file_id, rule_id, line_start ORDER BY confidence_score DESC, ordinal) AS place FROM (
  SELECT l_orderkey // 15 AS file_id, 'R' || l_returnflag AS rule_id, l_linenumber::INT AS line_start, 0.5::DOUBLE + l_discount AS confidence_score,
  l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS ordinal FROM lineitem) WINDOW k AS (PARTITION BY file_id, rule_id, line_start)) WHERE place = 1""",
    "findings_by_severity": sql("SELECT file_id, rule_id, line_start, severity FROM findings WHERE severity = 'high'", "findings"),
    "search_findings": sql("SELECT file_id, rule_id, line_start, title FROM findings WHERE language = 'python' AND (title ILIKE '%injection%' OR description ILIKE '%injection%' OR rule_id ILIKE '%injection%' OR cwe_id ILIKE '%injection%')", "findings"),
    "indexed_search_findings": sql("SELECT file_id, rule_id, line_start, title FROM findings WHERE language = 'python' AND (title ILIKE '%injection%' OR description ILIKE '%injection%' OR rule_id ILIKE '%injection%' OR cwe_id ILIKE '%injection%')", "findings"),
    "indexed_search_documents": "SELECT doc_id FROM documents WHERE (lower(text) LIKE '%src1%' OR lower(source) LIKE '%src1%') AND (lower(text) LIKE '%ata%' OR lower(source) LIKE '%ata%') AND (lower(text) LIKE '%er%' OR lower(source) LIKE '%er%')",
    "search_files": sql("""SELECT f.file_id, f.filename, p.name AS project_name FROM file_list f JOIN projects p USING (project_id) WHERE status = 'complete'
  AND (filename ILIKE '%src1%' OR p.name ILIKE '%src1%') AND (filename ILIKE '%.py%' OR p.name ILIKE '%.py%')""", "file_list", "projects"),
    "search_projects": sql("""SELECT project_id, name, created_at FROM projects WHERE (name ILIKE '%documents%' OR description ILIKE '%documents%') AND (name ILIKE '%src%' OR description ILIKE '%src%')
  AND epoch_ms(created_at * 1000)::DATE BETWEEN DATE '2023-11-18' AND DATE '2023-11-25'""", "projects"),
    "search_explanations": sql("""SELECT s.finding_id, s.title AS finding_title, t.top_feature_name FROM summaries s JOIN tops t USING (finding_id) JOIN grave g USING (finding_id)
  WHERE concat_ws(chr(10), s.title, top_feature_name, summary) ILIKE '%sql%' AND concat_ws(chr(10), s.title, top_feature_name, summary) ILIKE '%user%'""", "summaries", "tops", "grave"),
    "file_metrics": sql(METRICS, "files", "lines"),
    "csharp_metrics": sql("SELECT f.file_id, len(string_split(source, chr(10)))::INT AS line_count, c.classes AS class_count, c.methods AS method_count, c.properties AS property_count, c.namespaces AS namespace_count, "
                          "c.usings AS using_count, len(list_filter(string_split(source, chr(10)), lambda x: regexp_matches(x, '^\\s*(//|/\\*)')))::INT AS comment_count, c.depth AS max_nesting_depth, "
                          "c.has_async AS has_async_methods, c.has_unsafe AS has_unsafe_blocks FROM files f JOIN ("
                          + values([tuple([str(t)] + [str(x).lower() for x in row]) for t, row in CSHARP.items()])
                          + ") c(template, classes, methods, properties, namespaces, usings, depth, has_async, has_unsafe) USING (template)", "files"),
    "class_name": sql(r"""SELECT file_id, coalesce(CASE WHEN regexp_full_match(hint, '[A-Za-z_][A-Za-z0-9_]*') THEN hint END, nullif(regexp_extract(source, 'class\s+(\w+)', 1), ''), 'Solution') AS class_name
  FROM (SELECT *, CASE WHEN file_id % 3 = 0 THEN filename WHEN file_id % 4 = 1 THEN project_id END AS hint FROM files WHERE language = 'java')""", "files"),
    "token_counts": sql(token_sql(), "lines"),
    "html_escaped": "SELECT doc_id, " + ESCAPE.format("text") + " AS escaped FROM documents",
    "file_risk": sql("SELECT f.file_id, coalesce(risk_score, 0.0::DOUBLE) AS risk_score, coalesce(findings, 0)::INT AS findings, coalesce(critical, 0)::INT AS critical, coalesce(high, 0)::INT AS high FROM files f LEFT JOIN risk USING (file_id)", "files", "risk"),
    "file_risk_of_table": sql("SELECT file_id, risk_score, findings FROM risk", "risk"),
    "top_risk_files": sql("SELECT file_id, risk_score, findings::INT AS findings FROM risk ORDER BY risk_score DESC, file_id LIMIT 25", "risk"),
    "project_risk": sql(f"SELECT project_id, {MEAN} AS overall_risk_score FROM scored GROUP BY project_id", "scored"),
    "risk_bands": sql(f"""SELECT file_id, risk_score, {BAND} AS band, CASE WHEN risk_score IS NULL THEN 'none' WHEN risk_score >= 0.7 THEN 'red' WHEN risk_score >= 0.4 THEN 'amber' ELSE 'green' END AS badge,
  floor(risk_score * 100 + 0.5)::INT AS percent, printf('%.0f', risk_score * 100)::INT AS percent_even FROM scored""", "scored"),
    "severity_weights": sql("SELECT severity, max(CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 WHEN 'info' THEN 0.05 ELSE 0.5 END)::DOUBLE AS severity_weight, count(*) AS findings FROM findings GROUP BY severity", "findings"),
    "project_summary": sql(f"""SELECT project_id, count(*) AS total_files, count(*) FILTER (status = 'complete') AS completed_files, sum(findings)::BIGINT AS total_vulnerabilities,
  sum(critical)::BIGINT AS critical_count, sum(high)::BIGINT AS high_count, {MEAN} AS overall_risk_score FROM scored GROUP BY project_id""", "scored"),
    "file_counts": sql("SELECT f.file_id, coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical FROM files f LEFT JOIN risk USING (file_id)", "files", "risk"),
    "severity_pivot": sql(f"SELECT file_id, {SEVERITY_COUNTS} FROM findings GROUP BY file_id", "findings"),
    "severity_table": sql("SELECT file_id, severity, count(*) AS findings FROM findings GROUP BY file_id, severity", "findings"),
    "line_map": sql("""SELECT file_id, line_no, arg_min(severity, (sev_rank, line_start, ordinal)) AS top_severity, count(*) AS findings,
  string_agg(title, ', ' ORDER BY sev_rank, line_start, ordinal) AS titles, CASE WHEN count(*) > 1 THEN count(*)::VARCHAR ELSE '!' END AS marker
  FROM (SELECT *, unnest(range(line_start, coalesce(line_end, line_start) + 1))::INT AS line_no FROM findings) GROUP BY file_id, line_no""", "findings"),
    "java_diag_findings": sql(f"SELECT {MAIN}, features FROM java_found", "java_found"),
    "csharp_diag_findings": sql(f"SELECT {MAIN}, features FROM cs_found", "cs_found"),
    "diag_counts": sql("SELECT file_id, count(*) FILTER (kind = 'ERROR') AS errors, count(*) FILTER (kind = 'WARNING') AS warnings, count(*) FILTER (kind = 'ERROR') = 0 AS compile_ok FROM java_kept GROUP BY file_id", "java_kept"),
    "enriched_findings": sql("SELECT file_id, rule_id, line_start, severity, confidence_score, title, ordinal FROM merged", "merged"),
    "enriched_risk": sql(f"""SELECT file_id, {rounded('least(sum(' + RISK_WEIGHT.format('severity') + ' * confidence_score * (1.0 / sqrt(rank)) * 0.35::DOUBLE ORDER BY rank), 0.98)', 4)} AS risk_score, count(*) AS findings
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {RANK.format('severity')}, line_start, ordinal) AS rank FROM merged) GROUP BY file_id""", "merged"),
    "enrich_optional": sql("SELECT file_id, rule_id, line_start, severity, confidence_score FROM findings", "findings"),
    "file_detail": sql("""SELECT f.file_id, f.filename, CASE f.language WHEN 'python' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'csharp' THEN 'C#' ELSE 'JavaScript' END AS language_display, f.status,
  v.finding_id, v.rule_id, CASE WHEN v.line_end IS NOT NULL AND v.line_end <> v.line_start THEN v.line_start || '–' || v.line_end ELSE v.line_start::VARCHAR END AS line_range, v.severity
  FROM file_list f LEFT JOIN findings v USING (file_id)""", "file_list", "findings"),
    "file_lookup": sql("""SELECT f.file_id, f.filename, CASE f.language WHEN 'python' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'csharp' THEN 'C#' ELSE 'JavaScript' END AS language_display, f.status,
  v.finding_id, v.rule_id, CASE WHEN v.line_end IS NOT NULL AND v.line_end <> v.line_start THEN v.line_start || '–' || v.line_end ELSE v.line_start::VARCHAR END AS line_range, v.severity
  FROM file_list f LEFT JOIN findings v USING (file_id) WHERE file_id = 8""", "file_list", "findings"),
    "stored_order": sql("SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY severity DESC, line_start, ordinal) AS position, rule_id, line_start, severity FROM findings", "findings"),
    "project_tree": sql("""SELECT p.project_id, p.name, f.file_id, f.filename, v.finding_id, v.rule_id, v.line_start, t.top_feature_name FROM projects p LEFT JOIN file_list f USING (project_id)
  LEFT JOIN findings v USING (file_id) LEFT JOIN (SELECT finding_id, top_feature_name FROM tops JOIN grave USING (finding_id)) t USING (finding_id)""", "projects", "file_list", "findings", "tops", "grave"),
    "project_listing": sql("""SELECT p.*, coalesce(f.files, 0) AS files, (SELECT count(*) FROM projects) AS count FROM projects p
  LEFT JOIN (SELECT project_id, count(*) AS files FROM file_list GROUP BY project_id) f USING (project_id) ORDER BY created_at DESC, project_id LIMIT 25""", "projects", "file_list"),
    "default_file": sql("SELECT project_id, arg_min(file_id, (status <> 'complete', uploaded_at, file_id)) AS file_id FROM file_list GROUP BY project_id", "file_list"),
    "file_status": sql("""SELECT f.file_id, CASE WHEN l.file_id IS NOT NULL THEN 'failed' ELSE 'complete' END AS status, CASE WHEN l.file_id IS NULL THEN coalesce(r.risk_score, 0.0::DOUBLE) END AS risk_score,
  CASE WHEN l.file_id IS NOT NULL THEN substring(d.text, 1, 2000) ELSE '' END AS error_message, epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT AS analyzed_at
  FROM file_list f JOIN documents d ON d.doc_id = f.file_id LEFT JOIN risk r USING (file_id) LEFT JOIN (SELECT * FROM last_status WHERE status = 'failed') l ON l.file_id = f.file_id""", "file_list", "risk", "last_status"),
    "report_header": sql(f"""SELECT f.file_id, f.filename, f.language, f.status, floor(risk_score * 100 + 0.5)::INT AS risk_percent, coalesce(c.total, 0)::INT AS total,
  coalesce(c.critical, 0)::INT AS critical, coalesce(c.high, 0)::INT AS high, coalesce(c.medium, 0)::INT AS medium, coalesce(c.low, 0)::INT AS low, coalesce(c.info, 0)::INT AS info
  FROM scored f LEFT JOIN (SELECT file_id, count(*) AS total, {SEVERITY_COUNTS} FROM findings GROUP BY file_id) c USING (file_id)""", "scored", "findings"),
    "file_report": sql(f"""SELECT file_id, rank AS position, upper(severity) AS label, {ESCAPE.format('title')} AS title,
  'line ' || line_start || CASE WHEN line_end IS NOT NULL THEN '–' || line_end ELSE '' END AS place, rule_id, cwe_id,
  CASE WHEN cwe_id <> '' THEN 'https://cwe.mitre.org/data/definitions/' || substr(cwe_id, 5) || '.html' END AS link,
  {ESCAPE.format('description')} AS description, {ESCAPE.format('recommendation')} AS recommendation,
  CASE WHEN length(description) > 160 THEN left(description, 157) || '…' ELSE description END AS callout FROM ranked""", "ranked"),
    "export_heads": sql(f"""SELECT f.file_id, f.filename, f.language, f.status, floor(risk_score * 100 + 0.5)::INT AS risk_percent, coalesce(c.total, 0)::INT AS total,
  coalesce(c.critical, 0)::INT AS critical, coalesce(c.high, 0)::INT AS high, coalesce(c.medium, 0)::INT AS medium, coalesce(c.low, 0)::INT AS low, coalesce(c.info, 0)::INT AS info
  FROM scored f LEFT JOIN (SELECT file_id, count(*) AS total, {SEVERITY_COUNTS} FROM findings GROUP BY file_id) c USING (file_id)""", "scored", "findings"),
    "export_findings": sql(f"""SELECT file_id, rank AS position, upper(severity) AS label, {ESCAPE.format('title')} AS title,
  'line ' || line_start || CASE WHEN line_end IS NOT NULL THEN '–' || line_end ELSE '' END AS place, rule_id, cwe_id,
  CASE WHEN cwe_id <> '' THEN 'https://cwe.mitre.org/data/definitions/' || substr(cwe_id, 5) || '.html' END AS link,
  {ESCAPE.format('description')} AS description, {ESCAPE.format('recommendation')} AS recommendation,
  CASE WHEN length(description) > 160 THEN left(description, 157) || '…' ELSE description END AS callout FROM ranked""", "ranked"),
    "risk_rollup": sql("SELECT project_id, file_id, severity, count(*) AS findings, grouping(project_id, file_id, severity)::INT AS level FROM findings JOIN file_list USING (file_id) GROUP BY ROLLUP (project_id, file_id, severity)", "findings", "file_list"),
    "facet_cube": sql("SELECT v.language, severity, count(*) AS findings FROM findings v GROUP BY CUBE (v.language, severity)", "findings"),
    "rule_coverage": sql(RULE_COVERAGE, "rules", "findings"),
    "finding_navigation": sql("""SELECT file_id, rank AS position, finding_id, coalesce(lead(finding_id) OVER w, first_value(finding_id) OVER w) AS next_id,
  coalesce(lag(finding_id) OVER w, last_value(finding_id) OVER (PARTITION BY file_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_id
  FROM ranked WINDOW w AS (PARTITION BY file_id ORDER BY rank)""", "ranked"),
    "fix_diff": sql(f"""SELECT file_id, rule_id, line_start, (unnest([0, 1]))::INT AS position, unnest(['removed', 'added']) AS change, unnest([{ESCAPE.format('code_snippet')}, '']) AS text FROM findings""", "findings"),
    "has_explanation": sql("SELECT finding_id, severity IN ('critical', 'high') AS has_explanation FROM findings", "findings"),
    "missing_explanations": sql("SELECT p.finding_id, p.prediction, t.top_feature_name, t.top_feature_importance FROM predicted p JOIN tops t USING (finding_id) JOIN findings f USING (finding_id) WHERE f.severity NOT IN ('critical', 'high')", "predicted", "tops", "findings"),
    "cascade_delete": sql("""SELECT 'projects' AS table_name, project_id AS key FROM projects WHERE project_id NOT IN ('src3', 'src7')
  UNION ALL SELECT 'files', file_id::VARCHAR FROM file_list WHERE project_id NOT IN ('src3', 'src7')
  UNION ALL SELECT 'findings', finding_id FROM findings JOIN file_list USING (file_id) WHERE project_id NOT IN ('src3', 'src7')
  UNION ALL SELECT 'explanations', finding_id FROM grave JOIN file_list USING (file_id) WHERE project_id NOT IN ('src3', 'src7')""", "projects", "file_list", "findings", "grave"),
    "reanalyze_replace": sql(f"SELECT file_id, rule_id, line_start, v.severity FROM findings v JOIN file_list f USING (file_id) WHERE f.status <> 'analyzing' OR ({SECURITY_ONLY} AND v.ordinal < 1000)", "findings", "file_list"),
    "latest_runs": sql("SELECT file_id, arg_max(event_id, (ts, event_id)) AS run_id, epoch_us(max(ts)) AS analyzed_at, arg_max(status, (ts, event_id)) AS status FROM status_events GROUP BY file_id", "status_events"),
    "run_diff": sql("SELECT file_id, rule_id, line_start, CASE WHEN rule_id LIKE '%MAINT%' THEN 'new' ELSE 'unchanged' END AS change FROM line_found", "line_found"),
    "context_signals": sql("SELECT file_id, rule_id, line_start, " + ", ".join(f'"{n}"' for n in SIGNALS) + " FROM signals", "signals"),
    "shap_features": sql("SELECT file_id, rule_id, line_start, position, name, value, shap_value, display FROM sized", "sized"),
    "shap_prediction": sql("SELECT file_id, rule_id, line_start, base_value, prediction FROM predicted", "predicted"),
    "lime_features": sql(f"""SELECT s.file_id, s.rule_id, s.line_start, {rounded('0.25::DOUBLE * 0.9::DOUBLE', 3)} AS intercept, {rounded('1 - p.prediction', 3)} AS p_clean, p.prediction AS p_risk,
  s.position, s.name, s.shap_value AS weight FROM sized s JOIN predicted p USING (finding_id)""", "sized", "predicted"),
    "lime_fallback": sql("SELECT file_id, rule_id, line_start, 0.25::DOUBLE AS intercept, position, name, floor(shap_value * 0.9::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE AS weight FROM sized", "sized"),
    "top_feature": sql("SELECT file_id, rule_id, line_start, top_feature_name, top_feature_importance FROM tops", "tops"),
    "top_features_k": sql("SELECT file_id, rule_id, line_start, position, name, shap_value FROM sized WHERE position < 3", "sized"),
    "finding_summary": sql("SELECT file_id, rule_id, line_start, summary FROM summaries", "summaries"),
    "explanation_json": sql(f"""SELECT p.file_id, p.rule_id, p.line_start, 'shap' AS method, p.base_value, p.prediction, len(f.features)::INT AS features, {rounded('0.25::DOUBLE * 0.9::DOUBLE', 3)} AS intercept
  FROM predicted p JOIN findings f USING (finding_id)""", "predicted", "findings"),
    "page_links": sql("SELECT page_id, url, link, target, kind FROM page_targets", "page_targets"),
    "broken_links": sql("""SELECT page_id, 'BROKEN' AS problem, target FROM (SELECT DISTINCT page_id, target FROM page_targets) t
  WHERE target NOT IN (SELECT regexp_replace(url, '#.*', '') FROM pages)
  UNION ALL SELECT page_id, 'PARSE ERROR', url FROM pages WHERE page_id IN (SELECT page_id FROM links WHERE link = '')""", "page_targets", "links"),
    "page_weight": sql(r"""SELECT p.page_id, octet_length(encode(html))::INT AS html_bytes, coalesce(a.assets, 0) AS assets, coalesce(a.bytes, 0)::BIGINT AS asset_bytes,
  (octet_length(encode(html)) + coalesce(a.bytes, 0))::BIGINT AS total_bytes, octet_length(encode(html)) + coalesce(a.bytes, 0) > 512000 AS over_budget
  FROM pages p LEFT JOIN (SELECT t.page_id, count(*) AS assets, sum(k.size) AS bytes FROM (
  SELECT DISTINCT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || link AS asset FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1)) AS link FROM pages)
  WHERE link LIKE '/%') t LEFT JOIN (SELECT url, max(octet_length(encode(html))) AS size FROM pages GROUP BY url) k ON k.url = t.asset
  WHERE regexp_matches(asset, '\.(css|js|png|svg|ico|woff|woff2|jpg)$') OR regexp_matches(asset, '/(assets|css|js)/') GROUP BY t.page_id) a USING (page_id)"""),
    "rate_limit_violations": """SELECT user_id, second, count(*) AS events, max(requests) AS requests FROM (SELECT user_id, second, count(*) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW) AS requests
  FROM (SELECT user_id, floor(epoch(ts))::BIGINT AS second FROM events)) WHERE requests > 2 GROUP BY user_id, second""",
    "stuck_files": sql("SELECT file_id, (epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT) AS age_seconds, changes FROM last_status WHERE status = 'analyzing' AND epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT > 120", "last_status"),
    "user_sessions": """SELECT user_id, session::BIGINT AS session, min(us) AS started, max(us) AS ended, count(*) AS events FROM (SELECT user_id, us, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session
  FROM (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN lag(epoch_us(ts)) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800000000 THEN 1 ELSE 0 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, session""",
    "stream_findings": sql("SELECT file_id, rule_id, line_start, severity FROM findings", "findings"),
    "stream_rate_windows": "SELECT epoch(w)::BIGINT AS window_start, user_id, count(*) AS requests FROM (SELECT user_id, date_trunc('hour', ts) AS w FROM events) GROUP BY w, user_id",
    "stream_stuck_files": sql("""SELECT file_id, epoch_us(ts) // 1000 AS since_ms FROM last_status WHERE status = 'analyzing' AND epoch_us(ts) // 1000 + 120000 < (SELECT epoch_us(max(ts)) // 1000 FROM events) - 600000""", "last_status"),
    "stream_stuck_now": sql("SELECT file_id, (epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT) AS age_seconds FROM last_status WHERE status = 'analyzing' AND epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT > 120", "last_status"),
    "stream_uploads": "SELECT DISTINCT user_id AS file_id FROM events",
}
