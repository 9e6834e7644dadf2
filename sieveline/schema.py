"""Enumerations, severity order and table schemas."""

from pyspark.sql import Column, functions as F, types as T

# Enumerations of the data model.
LANGUAGES = ("python", "java", "csharp", "javascript")
LANGUAGE_LABELS = {"python": "Python", "java": "Java", "csharp": "C#", "javascript": "JavaScript"}
STATUSES = ("pending", "analyzing", "complete", "failed")
SEVERITIES = ("critical", "high", "medium", "low", "info")
CATEGORIES = ("security", "performance", "maintainability", "style", "correctness", "complexity")
METHODS = ("shap", "lime", "rule")
EXTENSIONS = {".py": "python", ".java": "java", ".cs": "csharp",
              ".js": "javascript", ".mjs": "javascript"}

# Limits.
MAX_SNIPPET = 500
MAX_ERROR_TEXT = 2000

FILES = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("project_id", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("source", T.StringType()),
])

#: a feed keeps its order in ``seq`` and, where that is not unique, ``sub``
JAVA_DIAGNOSTICS = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("sub", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("source_fragment", T.StringType()),
])

#: body of a C# analysis response (JSON text in column ``response``)
CSHARP_RESPONSE = T.StructType([
    T.StructField("diagnostics", T.ArrayType(T.StructType([
        T.StructField("severity", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("source_fragment", T.StringType()),
    ]))),
    T.StructField("findings", T.ArrayType(T.StructType([
        T.StructField("rule_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("cwe_id", T.StringType()),
    ]))),
])

#: every finding table carries these columns, in this order
FINDING_COLUMNS = (
    "file_id", "rule_id", "line_start", "line_end", "title", "description", "category",
    "severity", "confidence_score", "recommendation", "code_snippet", "fixed_snippet",
    "cwe_id", "owasp_category", "shap_features", "ordinal",
)


def one_of(col: Column, values) -> Column:
    return col.isin(*values)


def severity_rank(severity: Column) -> Column:
    """0 for critical .. 4 for info, 5 for anything else."""
    out = F.lit(len(SEVERITIES))
    for rank, name in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def severity_rank_sql(severity: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {rank}" for rank, name in enumerate(SEVERITIES))
    return f"CASE {severity} {cases} ELSE {len(SEVERITIES)} END"
