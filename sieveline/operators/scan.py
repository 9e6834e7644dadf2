"""Rule matching: files to findings.

``scan_files`` keeps the lines of a file as an array inside its row and turns only matching
lines into rows, so a whole corpus is scanned, rated and explained without one shuffle.
``scan_with_table`` takes rules from a table instead.
"""

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sieveline.functions.text import NOT_BLANK_SQL, STRIP_SQL, is_blank, odd_letters, quote, strip
from sieveline.operators.lines import explode_lines, unnest, with_lines
from sieveline.operators.literals import fold, folded, grams, index
from sieveline.operators.signals import signals_sql
from sieveline.operators.structure import complex_functions, long_functions_sql
from sieveline.rules import PACKS
from sieveline.schema import FINDING_COLUMNS, MAX_SNIPPET, severity_rank_sql
from sieveline.session import written

#: ignore case, Unicode classes
FLAGS = "(?iU)"

# Order of the file-level findings behind all line findings.
COMPLEXITY_ORDINAL = 1000
LONG_FUNCTION_ORDINAL = 2000

LONG_FUNCTION_FEATURES = ("function_length", "cyclomatic_complexity", "test_coverage_risk")


def check_packs(packs: dict) -> dict:
    """Ids must be unique inside a language; the de-duplication of local findings rests on it."""
    for language, rules in packs.items():
        ids = [rule.rule_id for rule in rules]
        if len(ids) != len(set(ids)):
            raise ValueError(f"duplicate rule id in the {language} pack")
    return packs


def rule_table(spark, packs: dict = PACKS, structural: bool = True) -> DataFrame:
    """The packs as a table, one row per rule, a few dozen rows."""
    rows = []
    for language, rules in packs.items():
        for ordinal, rule in enumerate(rules):
            rows.append((language, ordinal, *rule[:6], float(rule.confidence), *rule[7:9],
                         list(rule.shap_features), *rule[10:]))
    if structural:
        for language in packs:
            rows.append((
                language, LONG_FUNCTION_ORDINAL, f"{language[:2].upper()}-MAINT-LONGFN",
                "Long Function (> 60 lines)", "low", "maintainability", None, (), 0.80, "", "",
                list(LONG_FUNCTION_FEATURES), "", "Move parts of it into functions of their own."))
    rows = [(*row[:7], list(row[7]), *row[8:]) for row in rows]
    return spark.createDataFrame(
        rows,
        "language string, rule_ordinal int, rule_id string, title string, severity string, "
        "category string, pattern string, keywords array<string>, confidence double, "
        "cwe_id string, owasp_category string, shap_features array<string>, "
        "description string, recommendation string")


def _rules_hit_sql(packs: dict, guarded: bool) -> str:
    """SQL text for the rules of the file's language that match the line ``x``, in pack order.

    A rule's expression runs only where one of its keywords occurs.  ``odd`` marks files
    with letters whose lower case is not what the expressions fold them to; there the
    keywords are not consulted.
    """
    cases = []
    for name, rules in packs.items():
        tests = []
        for ordinal, rule in enumerate(rules):
            if rule.pattern is None:
                continue
            test = f"x.line RLIKE {quote(FLAGS + rule.pattern)}"
            if guarded and rule.keywords:
                words = " OR ".join(f"contains(x.folded, {quote(word)})" for word in rule.keywords)
                test = f"(odd OR {words}) AND {test}"
            tests.append(
                f"CASE WHEN {test} THEN named_struct('rule_id', {quote(rule.rule_id)}, 'severity', "
                f"{quote(rule.severity)}, 'confidence_score', {float(rule.confidence)}D, 'ordinal', {ordinal}) END")
        cases.append(f"WHEN {quote(name)} THEN array_compact(array({', '.join(tests)}))")
    return f"CASE language {' '.join(cases)} END"


def _hits_sql(packs: dict, guarded: bool) -> str:
    """SQL text for the matching lines of a file: ``array<struct<line_no, line, rules>>``."""
    numbered = ("transform(lines, (line, i) -> named_struct("
                "'line_no', i + 1, 'line', line, 'folded', lower(line)))")
    tested = (f"transform(filter({numbered}, x -> {NOT_BLANK_SQL.format('x.line')}), x -> named_struct("
              f"'line_no', x.line_no, 'line', x.line, 'rules', {_rules_hit_sql(packs, guarded)}))")
    return f"filter({tested}, x -> size(x.rules) > 0)"


def _finding_sql(rule_id, severity, confidence, ordinal, start, end, snippet, description, signals) -> str:
    fields = (f"'rule_id', {rule_id}, 'severity', {severity}, 'confidence_score', {confidence}, "
              f"'ordinal', {ordinal}, 'line_start', {start}, 'line_end', {end}, "
              f"'code_snippet', {snippet}, 'description', {description}")
    return f"named_struct({fields}{', ' + repr('signals') + ', ' + signals if signals else ''})"


def _snippet_sql(text: str) -> str:
    return f"substring({STRIP_SQL.format(text)}, 1, {MAX_SNIPPET})"


def _line_findings_sql(packs: dict, guarded: bool, signals: bool) -> str:
    """SQL text for the findings of single lines, over ``language``, ``lines``, ``odd``."""
    around = f", 'signals', {signals_sql('lines', 'h.line_no')}" if signals else ""
    ready = (f"transform({_hits_sql(packs, guarded)}, h -> named_struct("
             f"'line_no', h.line_no, 'rules', h.rules, 'snippet', {_snippet_sql('h.line')}{around}))")
    one = _finding_sql("r.rule_id", "r.severity", "r.confidence_score", "r.ordinal", "h.line_no",
                       "cast(NULL AS int)", "h.snippet", "cast(NULL AS string)", "h.signals" if signals else "")
    return f"flatten(transform({ready}, h -> transform(h.rules, r -> {one})))"


def _complexity_sql(signals: bool) -> str:
    """SQL text for the findings of complex functions, over ``complex`` and ``lines``."""
    one = _finding_sql(
        "'PY-CMPLX-001'", "'medium'", "least(0.95D, 0.7D + (c.complexity - 10) * 0.02D)",
        COMPLEXITY_ORDINAL, "c.line", "cast(NULL AS int)", _snippet_sql("coalesce(get(lines, c.line - 1), '')"),
        "concat('Function \\'', c.name, '\\' has cyclomatic complexity of ', c.complexity, ' (threshold: 10).')",
        signals_sql("lines", "c.line") if signals else "")
    return f"transform(complex, c -> {one})"


def _long_function_sql(signals: bool) -> str:
    """SQL text for the findings of long functions, over ``language`` and ``lines``."""
    one = _finding_sql(
        "concat(upper(substring(language, 1, 2)), '-MAINT-LONGFN')", "'low'", "0.8D", LONG_FUNCTION_ORDINAL,
        "f.start + 1", "f.stop", _snippet_sql("f.next_line"),
        "concat('Function \\'', f.name, '\\' is ', f.stop - f.start, ' lines long.')",
        signals_sql("lines", "f.start + 1") if signals else "")
    return f"transform({long_functions_sql()}, f -> {one})"


def local_findings(files: DataFrame, packs: dict = PACKS, signals: bool = True,
                   structural: bool = True, guarded: bool = True) -> DataFrame:
    """Each file row with its ``lines`` and a ``found`` array in reporting order:
    severity rank, line, then the order in which the checks run."""
    check_packs(packs)
    base = files.withColumn("odd", odd_letters(F.col("source")))
    parts = [_line_findings_sql(packs, guarded, signals)]
    if structural:
        base = base.withColumn("complex", complex_functions(F.col("language"), F.col("source")))
        if any(rule.rule_id == "PY-CMPLX-001" for rule in packs.get("python", ())):
            parts.append(_complexity_sql(signals))
        parts.append(_long_function_sql(signals))
    parts = [f"coalesce({part}, array())" for part in parts]
    found = f"concat({', '.join(parts)})"
    ordered = (f"array_sort(transform({found}, f -> named_struct("
               f"'rank', {severity_rank_sql('f.severity')}, 'line', f.line_start, 'ordinal', f.ordinal, 'finding', f)))")
    return with_lines(base).withColumn("found", F.expr(f"transform({ordered}, x -> x.finding)")) \
        .drop("complex", "odd")


def scan_files(files: DataFrame, packs: dict = PACKS, signals: bool = False, structural: bool = True,
               guarded: bool = True, keep=(), outer: bool = False) -> DataFrame:
    """Findings of every file as rows.  No shuffle; the rule table is broadcast, it is a
    few dozen rows by construction.

    ``keep`` names file columns to carry along, which saves joining them back later;
    ``outer`` keeps one row for a file without findings.
    """
    found = local_findings(files, packs, signals, structural, guarded)
    return finding_rows(found, packs, keep, outer)


def finding_rows(found: DataFrame, packs: dict = PACKS, keep=(), outer: bool = False) -> DataFrame:
    """Rows of the ``found`` arrays of an analysed table."""
    columns = ["file_id", "language", *[c for c in keep if c not in ("file_id", "language")]]
    rows = found.select(*columns, F.explode_outer("found").alias("f")) if outer \
        else unnest(found, "found", "f", columns)
    return describe(rows.select(*columns, "f.*"), packs, keep)


#: characters that part lines elsewhere, but not for the service
_OTHER_BREAKS = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SERVICE_SNIPPET = 200


def service_findings(files: DataFrame, packs: dict) -> DataFrame:
    """Findings as the service reports them: lines end at line feeds alone, and a snippet is the
    line without leading white space, up to 200 characters."""
    flat = files.withColumn("original", F.col("source")).withColumn("source", F.regexp_replace("source", _OTHER_BREAKS, " "))
    line = F.get(F.split("original", "\n"), F.col("line_start") - 1)
    return scan_files(flat, packs, structural=False, keep=("original",)).withColumn(
        "snippet", F.substring(F.regexp_replace(line, r"(?U)^\s+", ""), 1, SERVICE_SNIPPET))


def describe(rows: DataFrame, packs: dict = PACKS, keep=()) -> DataFrame:
    """Add the rule's wording and references to findings that carry only its id."""
    rules = rule_table(rows.sparkSession, packs).select(
        "language", "rule_id", "title", "category", "cwe_id", "owasp_category", "recommendation",
        "shap_features", F.col("description").alias("rule_description"))
    full = rows.join(F.broadcast(rules), ["language", "rule_id"], "left") \
        .withColumn("description", F.coalesce("description", "rule_description")) \
        .withColumn("fixed_snippet", F.lit(""))
    extra = ["language"] + [c for c in rows.columns if c == "signals" or c in keep and c not in ("file_id", "language")]
    return full.select(*FINDING_COLUMNS, *extra)


#: an index of rules up to this many bytes goes to every task; a larger one meets the lines by a shuffle on the gram
BROADCAST_BYTES = 64 << 20
#: rules without a literal are spread over so many salts
RULE_SALTS = 64


def automaton_hits(lines: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of lines and rules whose literal occurs in the line, each once: the lines run through an automaton of all
    literals of their language, whose size has been checked."""
    entries = index.select("language", "rule_id", "rule_ordinal", "literal").collect()

    def find(batches):
        import ahocorasick
        automata = {}
        for language in {e["language"] for e in entries}:
            held = automata[language] = ahocorasick.Automaton()
            of = {}
            for e in entries:
                if e["language"] == language:
                    of.setdefault(e["literal"], []).append((e["rule_id"], e["rule_ordinal"]))
            for literal, rules in of.items():
                held.add_word(literal, tuple(rules))
            held.make_automaton()
        for batch in batches:
            out = []
            for language, file_id, line_no, line in zip(*(batch[c] for c in ("language", "file_id", "line_no", "line"))):
                held = automata.get(language)
                if held is not None:
                    rules = {r for _, found in held.iter(folded(line)) for r in found}
                    out += [(language, file_id, line_no, line, *r) for r in rules]
            yield pd.DataFrame(out, columns=["language", "file_id", "line_no", "line", "rule_id", "rule_ordinal"])

    return lines.select("language", "file_id", "line_no", "line").mapInPandas(
        find, "language string, file_id long, line_no int, line string, rule_id string, rule_ordinal int")


def gram_hits(lines: DataFrame, index: DataFrame, sizes) -> DataFrame:
    """The same pairs by a join on language and gram, for an index of any size.

    A line holds each of its grams once and a literal is filed under one gram, so a literal hits a line once; of a rule's
    literals the first that occurs makes the pair.
    """
    grammed = lines.withColumn("folded", fold(F.col("line"))).withColumn("gram", F.explode(grams(F.col("folded"), sizes)))
    hits = grammed.join(index, ["language", "gram"])
    return hits.filter(F.contains("folded", "literal") & ~F.exists("earlier", lambda s: F.contains("folded", s)))


def scan_with_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Match lines against rules given as a table (``language, rule_id, pattern, rule_ordinal, severity, confidence``).

    A rule is tried only on lines that hold one of the literals its expression requires (``literals.index``). The index is
    written once and measured: within ``BROADCAST_BYTES`` it goes to every task as an automaton and no line is moved, beyond
    that lines and index meet by language and gram, where adaptive execution splits frequent grams. Rules that require nothing meet every
    line of their language, dealt over salts if there are too many to send.
    """
    usable = rules.filter(F.col("pattern").isNotNull()).select(
        "language", "rule_id", "rule_ordinal", "severity", "confidence", "pattern")
    entries = written(index(usable), "rule-index").withColumn("pattern", F.concat(F.lit(FLAGS), F.col("pattern")))
    size = F.sum(F.octet_length("pattern") + F.coalesce(F.octet_length("literal"), F.lit(0)) + F.octet_length("rule_id")
                 + F.coalesce(F.octet_length(F.array_join("earlier", "")), F.lit(0)) + 128)
    facts = entries.agg(F.coalesce(F.sum(F.when(F.col("literal").isNotNull(), F.lit(1))), F.lit(0)), F.count(F.lit(1)), size,
                        F.collect_set(F.length("gram"))).first()
    small = (facts[2] or 0) <= BROADCAST_BYTES
    lines = explode_lines(files).filter(~is_blank(F.col("line")))
    found = []
    if facts[0]:
        some = entries.filter("literal IS NOT NULL")
        facts_of = F.broadcast(entries.select("language", "rule_id", "rule_ordinal", "severity", "confidence", "pattern").distinct())
        found.append(automaton_hits(lines, some).join(facts_of, ["language", "rule_id", "rule_ordinal"]) if small else
                     gram_hits(lines, some, sorted(facts[3])))
    if facts[1] > facts[0]:
        free = entries.filter("literal IS NULL")
        if small:
            found.append(lines.join(F.broadcast(free), "language"))
        else:
            salted = free.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(RULE_SALTS - 1))))
            dealt = lines.withColumn("salt", F.pmod(F.hash("file_id", "line_no"), F.lit(RULE_SALTS)))
            found.append(dealt.join(salted, ["language", "salt"]))
    columns = ["file_id", "rule_id", "line_no", "line", "severity", "confidence", "rule_ordinal", "pattern"]
    pairs = [f.select(*columns) for f in found] or [lines.join(entries.limit(0), "language").select(*columns)]
    out = pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])
    return out.filter(F.expr("line RLIKE pattern")).select(
        "file_id", "rule_id", F.col("line_no").alias("line_start"), "severity",
        F.col("confidence").alias("confidence_score"), F.col("rule_ordinal").alias("ordinal"),
        F.substring(strip(F.col("line")), 1, MAX_SNIPPET).alias("code_snippet"))
