"""Text helpers as Column expressions."""

from pyspark.sql import Column, functions as F

# White space characters.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

#: every line boundary, carriage return + line feed counting once
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def quote(text: str) -> str:
    """A text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: the same helpers as SQL text, for long expressions that are written in SQL
NOT_BLANK_SQL = "{0} RLIKE " + quote(r"(?U)[^\s\x1c-\x1f]")
STRIP_SQL = "btrim({0}, " + quote(WHITE_SPACE) + ")"


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone removes blanks only)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def is_blank(col: Column) -> Column:
    return ~col.rlike(r"(?U)[^\s\x1c-\x1f]")


def split_lines(source: Column) -> Column:
    """Lines of a text without their terminators; a final terminator opens no new line."""
    parts = F.split(source, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stored_line_count(source: Column) -> Column:
    """Number of line feeds plus one, the count kept with a stored file."""
    return (F.length(source) - F.length(F.replace(source, F.lit("\n"), F.lit(""))) + 1).cast("int")


def odd_letters(col: Column) -> Column:
    """Whether a text has a long s or a dotless i: letters that match "s" and "i" when case
    is ignored although their lower case differs."""
    return contains_any(col, ("ſ", "ı"))


def contains_any(col: Column, words) -> Column:
    out = F.lit(False)
    for n, word in enumerate(words):
        hit = F.contains(col, F.lit(word))
        out = hit if n == 0 else out | hit
    return out


def humanise(name: Column) -> Column:
    """``sql_string_concat`` -> ``Sql string concat``."""
    words = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substr(words, F.lit(2))))


def line_range(start: Column, end: Column) -> Column:
    """``12`` or ``12–18``."""
    spans = end.isNotNull() & (end != 0) & (end != start)
    return F.when(spans, F.concat(start.cast("string"), F.lit("–"), end.cast("string"))) \
            .otherwise(start.cast("string"))


def html_escape(col: Column) -> Column:
    out = F.coalesce(col, F.lit(""))
    # Escapes, the ampersand first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def ellipsis(col: Column, limit: int = 160) -> Column:
    """Texts over ``limit`` characters are cut three short and marked."""
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit - 3), F.lit("…"))).otherwise(col)


def cwe_link(cwe_id: Column) -> Column:
    number = F.replace(cwe_id, F.lit("CWE-"), F.lit(""))
    return F.when(cwe_id != "", F.concat(
        F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")))


def or_default(col: Column, default: str) -> Column:
    """The stripped text, or ``default`` when it is missing or blank."""
    text = strip(col)
    return F.when(col.isNull() | (text == ""), F.lit(default)).otherwise(text)
