"""Context signals: how strongly the surroundings of a line show a property."""

from pyspark.sql import DataFrame, functions as F

from sieveline.functions.text import quote
from sieveline.operators.lines import with_lines
from sieveline.rules.features import CONTEXT_LINES, SIGNALS


def signals_sql(lines: str, line_no: str) -> str:
    """SQL text for all signals of one line: a struct of doubles between 0 and 1.

    The surroundings are five lines above, the line itself and four below.
    """
    first = f"greatest({line_no} - {CONTEXT_LINES}, 1)"
    last = f"least({line_no} + {CONTEXT_LINES - 1}, size({lines}))"
    around = f"lower(array_join(slice({lines}, {first}, greatest({last} - {first} + 1, 0)), ' '))"
    line = f"lower(coalesce(get({lines}, {line_no} - 1), ''))"
    fields = []
    for name, spec in SIGNALS.items():
        text = "t.both" if spec["with_line"] else "t.around"
        hits = " + ".join(f"cast(contains({text}, {quote(word)}) AS int)" for word in spec["words"])
        fields.append(f"'{name}', least(({hits}) / {float(spec['need'])}D, 1D)")
    # the one-element array gives the two texts a name, so each is built once
    texts = f"transform(array({around}), a -> named_struct('around', a, 'both', concat({line}, ' ', a)))"
    return f"element_at(transform({texts}, t -> named_struct({', '.join(fields)})), 1)"


def signals_for(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Signals for findings that arrive without them, e.g. from a stored table.

    The flagged lines of a file are packed (there are no more of them than lines), so a
    file's text meets them once.
    """
    flagged = findings.groupBy("file_id").agg(F.collect_set("line_start").alias("flagged"))
    lined = with_lines(files.select("file_id", "source"))
    each = F.expr("transform(flagged, n -> named_struct('line_start', n, 'signals', "
                  + signals_sql("lines", "n") + "))")
    found = lined.join(flagged, "file_id").select("file_id", F.explode_outer(each).alias("s")) \
        .filter(F.col("s").isNotNull()).select("file_id", "s.*")
    return findings.join(found, ["file_id", "line_start"], "left")
