"""Compiler and service diagnostics as findings.

Feeds are tables.  A feed first meets the numbers of lines of the files it speaks of, so that nothing is parsed for files of
other languages; its items are numbered in feed order and joined with single lines where these are shown.  All items are kept
unless a limit per file is given; ``beyond_limit`` counts what it leaves out.  A missing feed, or broken JSON
in it, leaves the local findings as they are.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sieveline.functions.text import or_default, split_lines, strip
from sieveline.operators.dedup import merge
from sieveline.operators.lines import computed_once, explode_lines
from sieveline.operators.numbering import block_of, numbered
from sieveline.schema import CATEGORIES, CSHARP_RESPONSE, FINDING_COLUMNS, MAX_SNIPPET, SEVERITIES
from sieveline.session import written

#: external findings come behind every local one
EXTERNAL_ORDINAL = 100_000

# What a diagnostic of each kind becomes.
JAVA_KINDS = {
    "ERROR": ("high", "correctness", 0.98, "JAVA-COMPILE-ERROR", "Java Compilation Error",
              "compile_error", "Correct the code until the file compiles."),
    "WARNING": ("low", "maintainability", 0.85, "JAVA-COMPILE-WARNING", "Java Compilation Warning",
                "compiler_warning", "Look into the warning of the compiler."),
}
CSHARP_SEVERITIES = {
    "error": ("high", "correctness", 0.98, "C# Compilation Error",
              "compile_error", "Correct the code until the file compiles."),
    "warning": ("low", "maintainability", 0.85, "C# Compilation Warning",
                "compiler_warning", "Look into the warning of the compiler."),
}
SERVICE_CONFIDENCE = 0.75
SERVICE_FEATURE = "roslyn_rule_match"
NO_MESSAGE = "Compiler diagnostic"


def clamp_line(line: Column, line_count: Column) -> Column:
    """A reported line inside the file; text that is no number counts as line 1."""
    number = F.coalesce(line.try_cast("bigint"), F.lit(1))
    return F.greatest(F.lit(1), F.least(number, F.greatest(line_count, F.lit(1)))).cast("int")


def normal_severity(col: Column, default: str = "medium") -> Column:
    text = F.lower(strip(F.coalesce(col, F.lit(""))))
    return F.when(text.isin(*SEVERITIES), text).otherwise(F.lit(default))


def normal_category(col: Column, default: str = "correctness") -> Column:
    text = F.lower(strip(F.coalesce(col, F.lit(""))))
    return F.when(text.isin(*CATEGORIES), text).otherwise(F.lit(default))


def _pick(key: Column, table: dict, field: int) -> Column:
    out = None
    for name, spec in table.items():
        value = F.lit(spec[field])
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def java_kind(kind: Column) -> Column:
    """ERROR or WARNING; NULL for kinds that are only remarks."""
    known = {name: name for name in JAVA_KINDS} | {"MANDATORY_WARNING": "WARNING"}
    return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.upper(strip(kind)))


def _item(kind: str, **fields):
    """One entry of a feed as it was reported; wording and clean-up come after the cap."""
    names = ("code", "title", "text", "severity", "category", "recommendation", "cwe_id", "line", "fragment")
    parts = [F.lit(kind).alias("kind")]
    parts += [fields.get(n, F.lit(None)).cast("string").alias(n) for n in names]
    return F.struct(*parts)


def of_files(feed: DataFrame, files: DataFrame, language: str) -> DataFrame:
    """The rows of a feed that speak of files of a language, with ``line_counts``: the number of lines of the file, of each
    where files share an id.

    The counts are a row a file and written first. So Spark knows their size: it sends few to every task and the feed stays
    where it is; many meet the feed by a shuffle.
    """
    own = files.filter(F.col("language") == language)
    counts = own.select("file_id", F.coalesce(F.size(split_lines(F.col("source"))), F.lit(0)).alias("line_count")) \
        .groupBy("file_id").agg(F.collect_list("line_count").alias("line_counts"))
    return feed.join(written(counts, "line-counts"), "file_id")


def java_items(diagnostics: DataFrame, keep=()) -> DataFrame:
    """Diagnostics that become findings: ``file_id, language, position, item`` and the columns named by ``keep``."""
    kept = diagnostics.withColumn("code", java_kind(F.col("kind"))).filter(F.col("code").isNotNull())
    return kept.select(
        "file_id", F.lit("java").alias("language"),
        F.struct(F.lit(0).alias("part"), "seq", "sub", F.lit(0).alias("pos")).alias("position"),
        _item("java", code=F.col("code"), text=F.col("message"), line=F.col("line"),
              fragment=F.col("source_fragment")).alias("item"), *keep)


def csharp_items(responses: DataFrame, keep=()) -> DataFrame:
    """Diagnostics, then rule findings of the service, in the same shape.  The JSON text is
    parsed once."""
    parsed = computed_once(
        responses.select("file_id", "seq", "sub", F.from_json("response", CSHARP_RESPONSE).alias("r"), *keep), "r")

    def level(d):
        return F.lower(strip(d["severity"]))

    def filled(col):
        return F.coalesce(col, F.lit("")) != ""

    empty = F.array()
    diags = F.transform(
        F.filter(F.coalesce("r.diagnostics", empty), lambda d: level(d).isin(*CSHARP_SEVERITIES)),
        lambda d: _item("diagnostic", code=d["id"], text=d["message"], severity=level(d),
                        line=d["line"], fragment=d["source_fragment"]))
    rules = F.transform(
        F.filter(F.coalesce("r.findings", empty), lambda f: filled(f["title"]) & filled(f["rule_id"])),
        lambda f: _item("rule", code=f["rule_id"], title=f["title"], text=f["description"],
                        severity=f["severity"], category=f["category"], recommendation=f["recommendation"],
                        cwe_id=f["cwe_id"], line=f["line"], fragment=f["snippet"]))
    rows = parsed.select("file_id", "seq", "sub", F.posexplode_outer(F.concat(diags, rules)).alias("pos", "item"), *keep) \
        .filter(F.col("item").isNotNull())
    part = F.when(F.col("item.kind") == "diagnostic", 0).otherwise(1)
    return rows.select("file_id", F.lit("csharp").alias("language"),
                       F.struct(part.alias("part"), "seq", "sub", "pos").alias("position"), "item", *keep)


def capped(items: DataFrame, limit: int = None) -> DataFrame:
    """The first ``limit`` items of each file in feed order; all of them without a limit.  Spark
    keeps only so many per task before it shuffles them."""
    if limit is None:
        return items
    order = Window.partitionBy("file_id", "language").orderBy("position")
    return items.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def beyond_limit(items: DataFrame, limit: int) -> DataFrame:
    """How many items of each file a limit leaves out: ``file_id, language, left_out``."""
    return items.groupBy("file_id", "language").agg((F.count(F.lit(1)) - limit).alias("left_out")) \
        .filter(F.col("left_out") > 0)


def place(items: DataFrame, files: DataFrame, limit: int = None) -> DataFrame:
    """Items with the ``line_counts`` of their files: place in the feed, clamped line, and the text of that line where it is shown.

    No text of a file is moved. Only an item without a fragment of its own meets a line, by file and line together, and of
    lines no more than a snippet travels. Items of one file are numbered and joined in as many tasks as they fill.
    """
    own = files.filter(F.col("language").isin("java", "csharp"))
    kept = capped(items, limit).select("file_id", "language", "position.*", "item", F.explode("line_counts").alias("line_count")) \
        .withColumn("block", block_of(F.col("seq")))
    placed = numbered(kept, ["file_id", "language"], ["part", "block"], ["seq", "sub", "pos", "item"]).select(
        "file_id", "n", clamp_line(F.col("item.line"), F.col("line_count")).alias("line_start"), "item.*")
    # an item with a fragment needs no line: it looks for one that is not there, and not all of them for the same
    shown = F.coalesce(strip(F.col("fragment")), F.lit("")) != ""
    keyed = placed.withColumn("at", F.when(shown, (-1 - F.col("n") % 4096).cast("int")).otherwise(F.col("line_start")))
    snippets = explode_lines(own).select("file_id", F.col("line_no").cast("int").alias("at"),
                                         F.substring(strip(F.col("line")), 1, MAX_SNIPPET).alias("line_text"))
    return keyed.join(snippets, ["file_id", "at"], "left").withColumn("line_text", F.coalesce("line_text", F.lit(""))).drop("at")


def worded(placed: DataFrame) -> DataFrame:
    """Placed items as findings."""
    kind, code = F.col("kind"), F.col("code")
    number = or_default(code, "UNKNOWN")

    def choose(java_field, csharp_field, rule):
        return F.when(kind == "java", _pick(code, JAVA_KINDS, java_field)) \
            .when(kind == "diagnostic", _pick(F.col("severity"), CSHARP_SEVERITIES, csharp_field)).otherwise(rule)

    rule_id = F.when(kind == "java", _pick(code, JAVA_KINDS, 3)) \
        .when(kind == "diagnostic", F.concat(F.lit("CS-ROS-"), number)).otherwise(code)
    title = F.when(kind == "java", _pick(code, JAVA_KINDS, 4)) \
        .when(kind == "diagnostic", F.concat(_pick(F.col("severity"), CSHARP_SEVERITIES, 3), F.lit(" ("), number, F.lit(")"))) \
        .otherwise(F.col("title"))
    text = F.when(kind == "rule", F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("title"))) \
        .otherwise(or_default(F.col("text"), NO_MESSAGE))
    fragment = strip(F.coalesce("fragment", F.lit("")))
    snippet = F.when(fragment != "", fragment).otherwise(F.col("line_text"))
    return placed.select(
        "file_id", rule_id.alias("rule_id"), "line_start",
        F.lit(None).cast("int").alias("line_end"), F.substring(title, 1, 255).alias("title"),
        text.alias("description"),
        choose(1, 1, normal_category(F.col("category"), "security")).alias("category"),
        choose(0, 0, normal_severity(F.col("severity"))).alias("severity"),
        choose(2, 2, F.lit(SERVICE_CONFIDENCE)).alias("confidence_score"),
        choose(6, 5, F.coalesce("recommendation", F.lit(""))).alias("recommendation"),
        F.substring(snippet, 1, MAX_SNIPPET).alias("code_snippet"), F.lit("").alias("fixed_snippet"),
        F.substring(F.coalesce("cwe_id", F.lit("")), 1, 20).alias("cwe_id"), F.lit("").alias("owasp_category"),
        F.array(choose(5, 4, F.lit(SERVICE_FEATURE))).alias("shap_features"),
        (F.lit(EXTERNAL_ORDINAL) + F.col("n")).alias("ordinal")).select(*FINDING_COLUMNS)


def external_findings(files: DataFrame, java: DataFrame = None, csharp: DataFrame = None, limit: int = None) -> DataFrame:
    """Findings of the feeds that are there; None without any.  Both feeds are numbered and meet the lines in one join."""
    items, counted = None, ("line_counts",)
    if java is not None:
        items = java_items(of_files(java, files, "java"), counted)
    if csharp is not None:
        more = csharp_items(of_files(csharp, files, "csharp"), counted)
        items = more if items is None else items.unionByName(more)
    return None if items is None else worded(place(items, files, limit))


def java_findings(diagnostics: DataFrame, files: DataFrame, limit: int = None) -> DataFrame:
    return external_findings(files, java=diagnostics, limit=limit)


def csharp_findings(responses: DataFrame, files: DataFrame, limit: int = None) -> DataFrame:
    return external_findings(files, csharp=responses, limit=limit)


def enrich(local: DataFrame, files: DataFrame, java: DataFrame = None, csharp: DataFrame = None,
           enabled: bool = True, limit: int = None, columns=FINDING_COLUMNS) -> DataFrame:
    """Local findings with the feeds merged in; only Java and C# have one.  ``columns`` names those wanted, so that no others
    travel with the merge; it needs the key, the confidence and the ordinal."""
    external = external_findings(files, java, csharp, limit) if enabled else None
    return merge(local.select(*columns), None if external is None else external.select(*columns))


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    """Errors and warnings per file, and whether it would compile."""
    kind = java_kind(F.col("kind"))
    return diagnostics.groupBy("file_id").agg(
        F.count_if(kind == "ERROR").alias("errors"),
        F.count_if(kind == "WARNING").alias("warnings")) \
        .withColumn("compile_ok", F.col("errors") == 0)
