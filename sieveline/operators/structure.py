"""Structure of a file: function length, complexity and counts."""

from pyspark.sql import Column, DataFrame, functions as F

from sieveline.functions.text import NOT_BLANK_SQL, quote, split_lines, stored_line_count
from sieveline.schema import LANGUAGES

# A line that opens a function, the name in the first group.
HEADER = {
    "python": r"^\s*(?:async\s+)?def\s+(\w+)",
    "java": r"^\s*(?:public|private|protected|static).*?\s+(\w+)\s*\(",
    "csharp": r"^\s*(?:public|private|protected|static|async).*?\s+(\w+)\s*\(",
    "javascript": r"^\s*(?:async\s+)?(?:function\s+(\w+)|\w+\s*=\s*(?:async\s+)?function|\w+\s*:\s*function)",
}
# Lines counted as comment, function and class.
COMMENT_LINE = {
    "python": r"^\s*#",
    "java": r"^\s*(?://|/\*)",
    "csharp": r"^\s*(?://|/\*)",
    "javascript": r"^\s*(?://|/\*)",
}
FUNCTION_LINE = {
    "python": r"^\s*(?:async\s+)?def\s+\w+",
    "java": r"^\s*(?:public|private|protected|static).*\w+\s*\(",
    "csharp": r"^\s*(?:public|private|protected|static|async).*\w+\s*\(",
    "javascript": r"^(?:\bfunction\s+\w+|\w+\s*=\s*(?:async\s+)?\()",
}
CLASS_LINE = {
    "python": r"^\s*class\s+\w+",
    "java": r"^\s*(?:public|private)?\s*class\s+\w+",
    "csharp": r"^\s*(?:public|private)?\s*(?:partial\s+)?class\s+\w+",
    "javascript": r"^\s*class\s+\w+",
}
# Limits.
LONG_FUNCTION_LINES = 60
COMPLEXITY_LIMIT = 10

UNICODE = "(?U)"


def _by_language(build, default: str = "NULL") -> str:
    """SQL text that chooses by the column ``language``."""
    cases = " ".join(f"WHEN {quote(name)} THEN {build(name)}" for name in LANGUAGES)
    return f"CASE language {cases} ELSE {default} END"


def long_functions_sql() -> str:
    """SQL text over ``language`` and ``lines``: functions with more than 60 lines from
    their header to the next header, ``array<struct<start, stop, name, next_line>>`` with
    both positions counted from zero.  The last function of a file has no next header and
    is not judged."""
    def of(name):
        pattern = quote(UNICODE + HEADER[name])
        heads = (f"filter(transform(lines, (line, i) -> named_struct('at', i, 'line', line)), "
                 f"x -> x.line RLIKE {pattern})")
        pairs = ("transform(slice(h, 1, greatest(size(h) - 1, 0)), (head, k) -> named_struct("
                 "'start', head.at, 'stop', get(h, k + 1).at, 'head', head.line, "
                 "'next_line', get(h, k + 1).line))")
        return (f"flatten(transform(array({heads}), h -> transform("
                f"filter({pairs}, p -> p.stop - p.start > {LONG_FUNCTION_LINES}), p -> named_struct("
                f"'start', p.start, 'stop', p.stop, 'name', "
                f"coalesce(nullif(regexp_extract(p.head, {pattern}, 1), ''), 'unknown'), "
                f"'next_line', p.next_line))))")
    # a file of up to 61 lines cannot hold one
    return f"CASE WHEN size(lines) > {LONG_FUNCTION_LINES + 1} THEN {_by_language(of)} END"


# --- complexity of Python functions: a lexer, and a stack over its tokens -------------------

_BRANCH_WORDS = r"\b(?:if|elif|for|while|except|with|assert|and|or)\b"
#: one ordered expression; what it skips decides nothing, and its loops are possessive as they never need to go back
_TOKENS = "(?sU)" + "|".join((
    r'''\b[a-zA-Z]{1,2}+(?=["'])''',
    r'''"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""''', r"""'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'''""",
    r'''"[^"\\\n\r]*+(?:\\(?:\r\n|.)[^"\\\n\r]*+)*+"''', r"""'[^'\\\n\r]*+(?:\\(?:\r\n|.)[^'\\\n\r]*+)*+'""",
    r"#[^\n\r]*+", r"\\(?:\r\n|\n|\r)", r"(?:\r\n|\n|\r)[ \t\f]*+", r"\w++",
    r"[=!<>]=", r"->", r"[-+*/%&|^@<>:]*+=", r"[()\[\]{}:;,@]", r"""["']"""))
_AT_START = ("if", "elif", "while", "except", "assert")
_PARTS = ("if", "else", "for", "lambda", "return", "yield")
_OPEN = "array<struct<name:string,line:int,indent:int,before:int>>"
_DONE = "array<struct<name:string,line:int,complexity:int>>"
_STATE = ("line", "indent", "fresh", "stmt", "prev", "levels", "total", "deco", "open", "done", "broken")


def _after(state: Column, **changed) -> Column:
    return F.struct(*(changed.get(name, state[name]).alias(name) for name in _STATE))


def _closed(functions: Column, total: Column) -> Column:
    grown = F.filter(functions, lambda f: total - f["before"] >= COMPLEXITY_LIMIT)
    return F.transform(grown, lambda f: F.struct(
        f["name"].alias("name"), f["line"].alias("line"), (total - f["before"] + 1).alias("complexity"))).cast(_DONE)


def _breaks(token: Column) -> Column:
    """Line ends inside a token."""
    return F.regexp_count(token, F.lit(r"\r\n|\n|\r")).cast("int")


def _line_begun(state: Column, token: Column) -> Column:
    """The first token of a logical line ends the functions that are not indented less."""
    deco = F.when((token == "@") & (state["deco"] < 0), state["total"]) \
        .when(token.isin("@", "def", "async"), state["deco"]).otherwise(F.lit(-1))
    over = F.filter(state["open"], lambda f: f["indent"] >= state["indent"])
    return F.when(state["fresh"], _after(
        state, fresh=F.lit(False), deco=deco, open=F.filter(state["open"], lambda f: f["indent"] < state["indent"]),
        done=F.concat(state["done"], _closed(over, state["total"])).cast(_DONE))).otherwise(state)


def _token_read(state: Column, token: Column) -> Column:
    """The state after a token that is no line end or remark.

    ``levels`` has a letter for every open bracket, which tells the operators of the expression inside: ``0`` none, ``A`` a
    chain of ``and``, ``O`` one of ``or``, ``B`` a chain of ``and`` within one of ``or``. A chain that begins is a path.
    """
    none, no = F.lit(""), F.lit(False)
    outside = F.length(state["levels"]) == 1
    top = F.right(state["levels"], F.lit(1))
    rest = F.substr(state["levels"], F.lit(1), F.length(state["levels"]) - 1)
    anew = F.concat(rest, F.lit("0"))
    both = F.when(top.isin("0", "A"), "A").otherwise("B")
    either = F.lit("O")
    chain = (top == "0") | ((token == "and") & (top == "O")) | ((token == "or") & (top == "A"))
    counts = F.when(state["stmt"], token.isin(*_AT_START) | (token.isin("for", "with") & (state["prev"] != "async"))) \
        .otherwise(token == "for")
    named = F.struct(token.alias("name"), state["line"].alias("line"), state["indent"].alias("indent"),
                     F.when(state["deco"] >= 0, state["deco"]).otherwise(state["total"]).alias("before"))
    return F.when((state["prev"] == "def") & token.rlike(r"(?U)^\w"), _after(
        state, open=F.concat(state["open"], F.array(named)).cast(_OPEN), prev=none, deco=F.lit(-1), stmt=no)) \
        .when(token.isin("(", "[", "{"), _after(state, levels=F.concat(state["levels"], F.lit("0")), stmt=no, prev=none)) \
        .when(token.isin(")", "]", "}"), _after(
            state, levels=F.when(outside, F.lit("0")).otherwise(rest), broken=state["broken"] | outside, stmt=no, prev=none)) \
        .when(token.isin("and", "or"), _after(
            state, levels=F.concat(rest, F.when(token == "and", both).otherwise(either)),
            total=state["total"] + chain.cast("int"), stmt=no, prev=none)) \
        .when(token.isin(*_AT_START, "with", *_PARTS), _after(
            state, levels=anew, total=state["total"] + counts.cast("int"), stmt=no, prev=none)) \
        .when(token.isin(":", ";"), _after(state, levels=anew, stmt=outside, prev=none)) \
        .when(token.isin(",", "->") | (token.endswith("=") & ~token.isin("==", "!=", "<=", ">=")), _after(
            state, levels=anew, stmt=no, prev=none)) \
        .when(token.isin("async", "def") & state["stmt"], _after(state, prev=token)) \
        .when(token.isin('"', "'"), _after(state, broken=F.lit(True))) \
        .otherwise(_after(state, line=state["line"] + F.when(token.rlike("^[\"']"), _breaks(token)).otherwise(F.lit(0)),
                          stmt=no, prev=none))


def complex_functions(language: Column, source: Column) -> Column:
    """Python functions above complexity 10: ``array<struct<name, line, complexity>>``.

    One ordered expression cuts the text into literals, remarks, words, brackets and signs, so a quote in a remark or a
    remark sign in a literal is what it is to Python. One pass over the tokens keeps the logical line over brackets and
    continued lines, the open functions by their indent, and the chains of ``and`` and ``or`` of every bracket level, as
    their precedence groups them. Files with fewer than ten branch words in total cannot hold such a function and are
    settled by counting; files with unpaired brackets or quotes have none. Against a parser it differs where expressions
    inside f-strings branch, and in files that do not parse for another reason.
    """
    worth = (language == "python") & (F.regexp_count(source, F.lit(_BRANCH_WORDS)) >= COMPLEXITY_LIMIT)
    tokens = F.regexp_extract_all(F.concat(F.lit("\n"), source), F.lit(_TOKENS), F.lit(0))
    zero = F.lit(0)
    first = {"line": zero, "indent": zero, "fresh": F.lit(True), "stmt": F.lit(True), "prev": F.lit(""), "levels": F.lit("0"),
             "total": zero, "deco": F.lit(-1), "open": F.array().cast(_OPEN), "done": F.array().cast(_DONE), "broken": F.lit(False)}

    def line_end(state, token):
        outside = F.length(state["levels"]) == 1
        width = F.length(F.replace(F.regexp_replace(token, r"[\n\r\f]", ""), F.lit("\t"), F.lit(" " * 8)))
        return _after(state, line=state["line"] + 1, indent=F.when(outside, width).otherwise(state["indent"]),
                      fresh=state["fresh"] | outside, stmt=state["stmt"] | outside, prev=F.lit(""),
                      levels=F.when(outside, F.lit("0")).otherwise(state["levels"]))

    def step(state, token):
        # the one-element array computes the state at the line's begin once
        begun = F.transform(F.array(_line_begun(state, token)), lambda s: _token_read(s, token))
        return F.when(token.rlike(r"^[\n\r]"), line_end(state, token)).when(token.startswith("#"), state) \
            .when(token.startswith("\\"), _after(state, line=state["line"] + 1)).otherwise(F.element_at(begun, 1))

    def finish(state):
        broken = state["broken"] | (F.length(state["levels"]) > 1)
        return F.when(broken, F.array().cast(_DONE)).otherwise(
            F.concat(state["done"], _closed(state["open"], state["total"])).cast(_DONE))

    found = F.aggregate(tokens, F.struct(*(first[n].alias(n) for n in _STATE)), step, finish)
    return F.when(worth, found)


def metrics() -> Column:
    """Seven counts of a file as a struct, over ``language`` and ``lines``."""
    def count(patterns):
        return _by_language(
            lambda name: f"size(filter(lines, x -> x RLIKE {quote(UNICODE + patterns[name])}))", "0")

    filled = f"transform(filter(lines, x -> {NOT_BLANK_SQL.format('x')}), x -> length(x))"
    return F.expr(
        f"element_at(transform(array({filled}), n -> named_struct("
        f"'line_count', size(lines), 'blank_lines', size(lines) - size(n), "
        f"'comment_lines', {count(COMMENT_LINE)}, 'function_count', {count(FUNCTION_LINE)}, "
        f"'class_count', {count(CLASS_LINE)}, 'avg_line_length', "
        f"cast(bround(aggregate(n, 0L, (acc, x) -> acc + x) / greatest(size(n), 1)) AS int), "
        f"'max_line_length', coalesce(array_max(n), 0))), 1)")


def file_metrics(files: DataFrame) -> DataFrame:
    """Metrics per file, with the stored line count and size beside them."""
    return files.select(
        "file_id", stored_line_count(F.col("source")).alias("stored_line_count"),
        F.octet_length("source").alias("size_bytes"),
        split_lines(F.col("source")).alias("lines"), "language") \
        .select("file_id", metrics().alias("m"),
                "stored_line_count", "size_bytes") \
        .select("file_id", "m.*", "stored_line_count", "size_bytes")


# --- C# structure -----------------------------------------------------------------------

# loops that never need to go back are possessive: the others recurse once a character and overflow the stack
_LITERAL_OR_COMMENT = (r"""@"(?:[^"]|"")*+"|@"[^"]*+(?:""[^"]*+)*"|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)++'|//[^\n]*|"""
                       r"""(?s:/\*.*?\*/)""")
_BRACES = r"""\b(?:class|struct|interface|enum|record|namespace)\b|;|\{\s*(?:get|set|init)\b|[{}]"""
_NOT_A_TYPE = (r"(?!(?:return|else|new|await|throw|case|goto|yield|in|using|lock|public|private|protected|internal|"
               r"static|virtual|override|abstract|sealed|async|unsafe|partial|extern|readonly)\b)")
_NOT_A_NAME = r"(?!(?:if|for|foreach|while|switch|using|lock|catch|fixed)\b)"
_MODIFIERS = (r"(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|unsafe|"
              r"partial|extern|readonly|new)\s+)*")
_CSHARP = {
    "class_count": r"\b(?:class|struct)\s+\w+",
    "method_count": (rf"(?m)^\s*{_MODIFIERS}{_NOT_A_TYPE}[\w<>\[\],.?]+\s+{_NOT_A_NAME}\w+\s*(?:<[\w, ]+>)?"
                     r"\s*\([^;{}]*\)\s*(?:where[^{;]*)?(?:\{|=>|;)"),
    "property_count": r"\b\w+\s*\{\s*(?:(?:public|private|protected|internal)\s+)?(?:get|set|init)\b",
    "namespace_count": r"\bnamespace\s+[\w.]+",
    "using_count": r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?[\w.= ]+;",
}


def csharp_metrics(files: DataFrame) -> DataFrame:
    """Structure counts of C# files from their text.

    String literals and comments are blanked first.  Blocks are told from type bodies and
    accessor lists by the word in front of the brace; object initialisers and ``switch``
    bodies count as blocks, which a syntax tree would not do.
    """
    code = files.filter(F.col("language") == "csharp").select(
        "file_id", "source", F.regexp_replace("source", _LITERAL_OR_COMMENT, " ").alias("code"))
    raw_lines = F.split("source", "\n")
    comments = F.size(F.filter(raw_lines, lambda x: x.rlike(r"(?U)^\s*(?://|/\*)")))
    return code.select(
        "file_id", F.size(raw_lines).alias("line_count"),
        *[F.regexp_count("code", F.lit(pattern)).alias(name) for name, pattern in _CSHARP.items()],
        comments.alias("comment_count"),
        block_depth(F.col("code")).alias("max_nesting_depth"),
        F.col("code").rlike(rf"\basync\s+[\w<>\[\],.?]+\s+\w+\s*\(").alias("has_async_methods"),
        F.col("code").rlike(r"\bunsafe\s*\{").alias("has_unsafe_blocks"))


def block_depth(code: Column) -> Column:
    """Deepest nesting of blocks: one pass over the braces with the open ones as state,
    ``T`` for a type, namespace or accessor body and ``B`` for a block."""
    tokens = F.regexp_extract_all(code, F.lit(_BRACES), F.lit(0))
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("typed"), F.lit(0).alias("best"))

    def step(acc, token):
        opens = F.startswith(token, F.lit("{"))
        kind = F.when(acc["typed"] | (F.length(token) > 1), "T").otherwise("B")
        stack = F.when(opens, F.concat(acc["open"], kind)) \
            .when((token == "}") & (acc["open"] != ""), F.substr(acc["open"], F.lit(1), F.length(acc["open"]) - 1)) \
            .otherwise(acc["open"])
        typed = F.when(opens | token.isin("}", ";"), F.lit(False)).otherwise(F.lit(True))
        depth = F.length(F.replace(stack, F.lit("T"), F.lit("")))
        return F.struct(stack.alias("open"), typed.alias("typed"),
                        F.greatest(acc["best"], depth).alias("best"))

    return F.aggregate(tokens, start, step, lambda acc: acc["best"])


def class_name(source: Column, hint: Column) -> Column:
    """Class a Java text defines: a usable hint, else the first class, else ``Solution``."""
    # Identifier and class patterns.
    wanted = F.when(hint.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z"), hint)
    first = F.nullif(F.regexp_extract(source, r"(?:public\s+)?class\s+(\w+)", 1), F.lit(""))
    return F.coalesce(wanted, first, F.lit("Solution"))

