"""Token classes of source lines, as an editor colours them."""

from pyspark.sql import Column, DataFrame, functions as F

from sieveline.operators.lines import explode_lines

# Token expressions per language in order of precedence.  At one position the
# earlier expression wins.
TOKENS = {
    "python": (
        ("comment", r"""#.*"""),
        ("string", r'''"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\''''),
        ("string", r"""f"(?:[^"\\]|\\.)*"|f'(?:[^'\\]|\\.)*'"""),
        ("string", r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""),
        ("decorator", r"""@\w+"""),
        ("keyword", r"""\b(?:and|as|assert|async|await|break|class|continue|def|del|elif|else|except|False|finally|for|from|global|if|import|in|is|lambda|None|nonlocal|not|or|pass|raise|return|True|try|while|with|yield)\b"""),
        ("builtin", r"""\b(?:print|len|range|type|int|str|float|list|dict|set|tuple|bool|open|input|zip|map|filter|enumerate|sorted|reversed|sum|min|max|abs|round|hasattr|getattr|setattr|isinstance|issubclass|super|property|staticmethod|classmethod)\b"""),
        ("number", r"""\b(?:\d+\.?\d*(?:[eE][+-]?\d+)?|0x[0-9a-fA-F]+)\b"""),
    ),
    "javascript": (
        ("comment", r"""//.*"""),
        ("string", r"""`(?:[^`\\]|\\.)*`"""),
        ("string", r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""),
        ("regex", r"""/(?:[^/\n\\]|\\.)+/[gimsuy]*"""),
        ("keyword", r"""\b(?:async|await|break|case|catch|class|const|continue|debugger|default|delete|do|else|export|extends|false|finally|for|from|function|if|import|in|instanceof|let|new|null|of|return|static|super|switch|this|throw|true|try|typeof|undefined|var|void|while|with|yield)\b"""),
        ("builtin", r"""\b(?:console|document|window|Array|Object|String|Number|Boolean|Promise|fetch|JSON|Math|Date|Error|Map|Set|Symbol|Proxy|Reflect|setTimeout|setInterval|clearTimeout|clearInterval)\b"""),
        ("number", r"""\b(?:\d+\.?\d*(?:[eE][+-]?\d+)?|0x[0-9a-fA-F]+)\b"""),
        ("decorator", r"""@\w+"""),
    ),
    "java": (
        ("comment", r"""//.*"""),
        ("string", r'''"(?:[^"\\]|\\.)*"'''),
        ("keyword", r"""\b(?:abstract|assert|boolean|break|byte|case|catch|char|class|const|continue|default|do|double|else|enum|extends|final|finally|float|for|goto|if|implements|import|instanceof|int|interface|long|native|new|null|package|private|protected|public|return|short|static|strictfp|super|switch|synchronized|this|throw|throws|transient|true|false|try|void|volatile|while|var|record|sealed|permits)\b"""),
        ("type", r"""\b(?:String|Integer|Long|Double|Float|Boolean|Byte|Character|Short|Object|List|Map|Set|Collection|ArrayList|HashMap|Optional|Stream|StringBuilder)\b"""),
        ("number", r"""\b(?:\d+\.?\d*[dDfFlL]?|0x[0-9a-fA-F]+)\b"""),
        ("decorator", r"""@\w+"""),
    ),
    "csharp": (
        ("comment", r"""//.*"""),
        ("string", r'''@"(?:[^"]|"")*"|"(?:[^"\\]|\\.)*"'''),
        ("keyword", r"""\b(?:abstract|as|base|bool|break|byte|case|catch|char|checked|class|const|continue|decimal|default|delegate|do|double|else|enum|event|explicit|extern|false|finally|fixed|float|for|foreach|goto|if|implicit|in|int|interface|internal|is|lock|long|namespace|new|null|object|operator|out|override|params|private|protected|public|readonly|ref|return|sbyte|sealed|short|sizeof|stackalloc|static|string|struct|switch|this|throw|true|try|typeof|uint|ulong|unchecked|unsafe|ushort|using|virtual|void|volatile|while|async|await|var|dynamic|yield|record|init|with|global)\b"""),
        ("type", r"""\b(?:String|Int32|Int64|Double|Boolean|DateTime|List|Dictionary|IEnumerable|Task|CancellationToken|Exception|Console|Math)\b"""),
        ("number", r"""\b(?:\d+\.?\d*[mMfFdDlLuU]?|0x[0-9a-fA-F]+)\b"""),
        ("decorator", r"""\[[\w\s,="'()]+\]"""),
    ),
}


def _ascii_bounds(pattern: str) -> str:
    """Word bounds between ASCII word characters, independent of the Java version; loops over
    characters and escapes made possessive, which matches the same and does not recurse."""
    # an unclosed verbatim string ends at its last quote, which takes going back
    pattern = pattern.replace('@"(?:[^"]|"")*"', '@"(?:[^"]|"")*+"|@"[^"]*+(?:""[^"]*+)*"')
    pattern = pattern.replace(r"\\.)*", r"\\.)*+").replace(r"|\\.)+/", r"|\\.)++/")
    if pattern.startswith(r"\b"):
        pattern = r"(?<![A-Za-z0-9_])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + r"(?![A-Za-z0-9_])"
    return pattern


def token_pattern(language: str) -> str:
    """All token expressions as ordered alternatives: the leftmost match wins, then the
    earlier alternative, which is how the classes take precedence."""
    return "|".join(_ascii_bounds(p) for _, p in TOKENS[language])


def _classify(language: str, token: Column) -> Column:
    out = None
    for kind, pattern in TOKENS[language]:
        bare = _ascii_bounds(pattern.removeprefix(r"\b").removesuffix(r"\b"))
        hit = token.rlike(rf"\A(?:{bare})\z")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def line_tokens(language: Column, line: Column) -> Column:
    """Classified tokens of one line: ``array<struct<kind, text>>``; what lies between them
    is ``default``."""
    def of(name):
        pattern = token_pattern(name)
        tokens = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)),
                             lambda t: F.struct(_classify(name, t).alias("kind"), t.alias("text")))
        between = F.transform(F.filter(F.split(line, pattern), lambda t: t != ""),
                              lambda t: F.struct(F.lit("default").alias("kind"), t.alias("text")))
        return F.concat(tokens, between)

    out = None
    for name in TOKENS:
        both = of(name)
        out = F.when(language == name, both) if out is None else out.when(language == name, both)
    return out


def token_counts(files: DataFrame) -> DataFrame:
    """Tokens and characters per language and class over whole texts."""
    lines = explode_lines(files)
    rows = lines.select("language", F.explode_outer(line_tokens(F.col("language"), F.col("line"))).alias("t")) \
        .filter(F.col("t").isNotNull())
    return rows.groupBy("language", F.col("t.kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("tokens"), F.sum(F.length("t.text")).alias("characters"))
