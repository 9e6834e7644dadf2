"""Very large files, scanned in pieces.

A file is cut into pieces of whole lines, so one file of any size is spread over many tasks. Pieces come from text files on
disk (``read_pieces``), where one file is never one row, or from file rows (``cut``). ``scan_pieces`` gives the rows that
``scan.scan_files`` gives for the whole file:

* Rules and context signals of a line need the five lines before it and the four behind it; a piece gets those of its
  neighbours.
* The length of a function runs from its header to the next one, which may stand many pieces further on. Every piece tells
  its first header, and one scan backwards over these finds the next header behind every piece.
* Complexity needs the state of a lexer: inside a text literal or not, and the brackets open. Every piece tells what it does
  to each state it might begin in; one scan over these effects finds the state in which it does begin. Then a piece is parted
  at the first line of its own that begins a statement at the left margin, and what lies between two such places, which no
  function crosses, is judged as a text of its own.

What meets in one place is a small row a piece, or the text between two statements at the left margin. So the complexity
check takes one class of a gigabyte as one text; the other checks do not.

Null texts and empty files give nothing. Files with equal ``file_id`` must not occur. A file that ends inside a literal in triple
quotes has no complex functions here; the scan of whole files reads such a quote as three.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sieveline.functions.text import odd_letters, quote, split_lines
from sieveline.operators import scan
from sieveline.operators.lines import unnest
from sieveline.operators.signals import signals_sql
from sieveline.operators.structure import HEADER, LONG_FUNCTION_LINES, UNICODE, _TOKENS, _by_language, complex_functions
from sieveline.rules import PACKS
from sieveline.rules.features import CONTEXT_LINES
from sieveline.session import written

#: lines of a piece, and pieces whose lexer states are composed in one group
PIECE_LINES = 4096
BLOCK_PIECES = 512

_PLACE = ("file_id", "block", "part")


# --- files to pieces --------------------------------------------------------------------

def cut(files: DataFrame, lines: int = PIECE_LINES) -> DataFrame:
    """File rows as pieces: ``source`` gives way to ``block, part, alone, text``, ordered by block and part. Pieces end at line
    feeds; ``alone`` marks the only one of a file."""
    rows = F.split("source", "\n")
    whole = F.when((F.element_at(rows, -1) == "") & (F.size(rows) > 1), F.slice(rows, 1, F.size(rows) - 1)).otherwise(rows)
    others = [c for c in files.columns if c != "source"]
    count = F.ceil(F.size("rows") / lines).cast("int")
    numbered = files.filter(F.col("source").isNotNull()).select(*others, whole.alias("rows")) \
        .select(*others, "rows", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    text = F.concat(F.array_join(F.slice("rows", F.col("k") * lines + 1, F.lit(lines)), "\n"), F.lit("\n"))
    return numbered.select(*others, F.floor(F.col("k") / BLOCK_PIECES).cast("long").alias("block"),
                           F.col("k").cast("long").alias("part"), (F.size("rows") <= lines).alias("alone"), text.alias("text"))


def read_pieces(spark: SparkSession, path: str, lines: int = PIECE_LINES) -> DataFrame:
    """Text files below ``path`` as pieces ``path, block, part, alone, text``. Spark splits large files by bytes; a block is such a
    split, its pieces are runs of lines read one after another. The text moves once, to stand together by piece."""
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("at"), "value")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n")
    return rows.groupBy("path", "block", F.floor(F.col("at") / lines).cast("long").alias("part")) \
        .agg(F.max("bytes").alias("bytes"), F.concat(joined, F.lit("\n")).alias("text")) \
        .select("path", "block", "part", (F.octet_length("text") >= F.col("bytes")).alias("alone"), "text")


# --- what a piece has to know of its neighbours -----------------------------------------

def _headers(lines: str) -> str:
    """SQL text for the function headers among ``lines``: ``array<struct<at, line>>``, counted from zero."""
    return _by_language(lambda name: (
        f"filter(transform({lines}, (line, i) -> named_struct('at', i, 'line', line)), "
        f"x -> x.line RLIKE {quote(UNICODE + HEADER[name])})"))


def neighbours(pieces: DataFrame) -> DataFrame:
    """``file_id, block, part``, the lines of the file before the piece (``first``), its own (``n``), ``before`` and ``after``
    with the lines around it, and ``next_head``, the first function header behind it."""
    edges = pieces.select(*_PLACE, "language", split_lines(F.col("text")).alias("lines")).select(
        *_PLACE, F.size("lines").alias("n"), F.slice("lines", 1, CONTEXT_LINES - 1).alias("head"),
        _last("lines").alias("tail"), F.expr(f"get({_headers('lines')}, 0)").alias("opens"))
    order = Window.partitionBy("file_id").orderBy("block", "part")
    back = Window.partitionBy("file_id").orderBy(F.desc("block"), F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    near = edges.select(
        *_PLACE, "n", "opens",
        F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"),
        F.flatten(F.collect_list("tail").over(order.rowsBetween(-CONTEXT_LINES, -1))).alias("ahead"),
        F.slice(F.flatten(F.collect_list("head").over(order.rowsBetween(1, CONTEXT_LINES - 1))), 1, CONTEXT_LINES - 1).alias("after"))
    opened = F.when(F.col("opens").isNotNull(), F.struct(
        (F.col("first") + F.col("opens.at")).alias("at"), F.col("opens.line").alias("line")))
    return near.select(*_PLACE, "n", "first", _last("ahead").alias("before"), "after",
                       F.last(opened, ignorenulls=True).over(back).alias("next_head"))


def _last(lines: str) -> Column:
    """The last five of some lines."""
    return F.slice(lines, F.greatest(F.size(lines) - (CONTEXT_LINES - 1), F.lit(1)), F.lit(CONTEXT_LINES))


# --- complexity: the lexer over pieces --------------------------------------------------

#: states in which a piece may begin: code, or inside a literal of a kind of quotes
_MODES = ("", '"""', "'''", '"', "'")


def _inside(mode: str) -> str:
    """What stands in a literal up to its closing quotes."""
    q = mode[0]
    if len(mode) == 3:
        return rf"[^{q}\\]*+(?:(?:\\.|{q}(?!{q}{q}))[^{q}\\]*+)*+"
    return rf"[^{q}\\\n\r]*+(?:\\(?:\r\n|.)[^{q}\\\n\r]*+)*+"


def _with_open_literals() -> str:
    """The lexer's expression, with literals that go on behind the end of the piece."""
    out = _TOKENS
    for mode in _MODES[1:]:
        closed = "|" + mode + _inside(mode) + mode
        if closed not in out:
            raise ValueError("the lexer's literals have changed")
        out = out.replace(closed, closed + "|" + mode + _inside(mode) + r"\z", 1)
    return out


def _effect(text: Column, mode: str) -> Column:
    """What a piece does to a lexer that is in ``mode`` at its begin: the mode at its end, the brackets it opens on balance,
    the least balance on the way, and whether it holds a quote without its counterpart."""
    tokens = F.regexp_extract_all(text, F.lit(_with_open_literals()), F.lit(0))
    signs = F.filter(tokens, lambda t: t.isin("(", "[", "{", ")", "]", "}"))
    zero = F.struct(F.lit(0).alias("net"), F.lit(0).alias("low"))

    def step(acc, sign):
        net = acc["net"] + F.when(sign.isin("(", "[", "{"), 1).otherwise(-1)
        return F.struct(net.alias("net"), F.least(acc["low"], net).alias("low"))

    last = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), tokens), -1), F.lit(""))
    end = F.lit("")
    for kind in reversed(_MODES[1:]):
        unclosed = last.startswith(kind) & ~last.rlike(rf"(?s)\A{kind}{_inside(kind)}{kind}\z")
        end = F.when(unclosed, kind).otherwise(end) if len(kind) == 3 else \
            F.when(unclosed & (F.length(last) > 1) & ~last.startswith(kind * 3), kind).otherwise(end)
    code = F.transform(F.array(F.aggregate(signs, zero, step)), lambda a: F.struct(
        end.alias("end"), a["net"].alias("net"), a["low"].alias("low"),
        F.exists(tokens, lambda t: t.isin('"', "'")).alias("stray")))[0]
    return code


def _effects(text: Column) -> Column:
    """The effects of a piece on every mode, in the order of ``_MODES``."""
    out = [_effect(text, "")]
    for mode in _MODES[1:]:
        closes = rf"(?s)\A{_inside(mode)}{mode}"
        stays = F.struct(F.lit(mode).alias("end"), F.lit(0).alias("net"), F.lit(0).alias("low"), F.lit(False).alias("stray"))
        goes_on = text.rlike(rf"(?s)\A{_inside(mode)}\z")
        broken = F.struct(F.lit("").alias("end"), F.lit(0).alias("net"), F.lit(0).alias("low"), F.lit(True).alias("stray"))
        rest = _effect(F.regexp_replace(text, closes, ""), "")
        out.append(F.when(text.rlike(closes), rest).when(goes_on, stays).otherwise(broken))
    return F.array(*out)


def _through(effects, state):
    """A lexer's state (mode, open brackets, broken) behind a piece."""
    mode, depth, broken = state
    effect = effects[_MODES.index(mode)]
    return effect["end"], depth + effect["net"], broken or effect["stray"] or depth + effect["low"] < 0


def _compose(frame: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a block as one: its effect on every mode."""
    rows = frame.sort_values("part")["effects"]
    out = []
    for mode in _MODES:
        end, net, low, stray = mode, 0, 0, False
        for effects in rows:
            effect = effects[_MODES.index(end)]
            low, stray = min(low, net + effect["low"]), stray or effect["stray"]
            end, net = effect["end"], net + effect["net"]
        out.append({"end": end, "net": int(net), "low": int(low), "stray": bool(stray)})
    return pd.DataFrame({"file_id": [frame["file_id"].iloc[0]], "block": [frame["block"].iloc[0]], "effects": [out]})


def _block_starts(frame: pd.DataFrame) -> pd.DataFrame:
    """The state at the begin of every block of a file, and whether the file is broken as a whole."""
    state, rows = ("", 0, False), []
    frame = frame.sort_values("block")
    for block, effects in zip(frame["block"], frame["effects"]):
        rows.append((frame["file_id"].iloc[0], block, state[0], int(state[1])))
        state = _through(effects, state)
    out = pd.DataFrame(rows, columns=["file_id", "block", "mode", "depth"])
    out["broken"] = bool(state[2] or state[0] != "" or state[1] != 0)
    return out


def _part_starts(frame: pd.DataFrame) -> pd.DataFrame:
    """The state at the begin of every piece of a block."""
    frame = frame.sort_values("part")
    state, rows = (frame["mode"].iloc[0], frame["depth"].iloc[0], False), []
    for part, effects in zip(frame["part"], frame["effects"]):
        rows.append((frame["file_id"].iloc[0], frame["block"].iloc[0], part, state[0], int(state[1])))
        state = _through(effects, state)
    return pd.DataFrame(rows, columns=[*_PLACE, "mode", "depth"])


def lexer_starts(pieces: DataFrame) -> DataFrame:
    """``file_id, block, part, mode, depth``: the lexer's state at the begin of every piece; pieces of files with unpaired
    brackets or quotes are left out."""
    kind = pieces.schema["file_id"].dataType.simpleString()
    effect = "array<struct<end:string,net:int,low:int,stray:boolean>>"
    told = written(pieces.select(*_PLACE, _effects(F.col("text")).alias("effects")), "lexer")
    blocks = told.groupBy("file_id", "block").applyInPandas(_compose, f"file_id {kind}, block long, effects {effect}")
    starts = blocks.groupBy("file_id").applyInPandas(
        _block_starts, f"file_id {kind}, block long, mode string, depth int, broken boolean")
    whole = starts.filter(~F.col("broken")).drop("broken")
    return told.join(whole, ["file_id", "block"]).groupBy("file_id", "block").applyInPandas(
        _part_starts, f"file_id {kind}, block long, part long, mode string, depth int")


def _rest_of_literal(text: Column, mode: Column) -> Column:
    """The characters of a piece that belong to a literal begun before it."""
    out = F.lit("")
    for name in _MODES[1:]:
        out = F.when(mode == name, F.coalesce(
            F.nullif(F.regexp_extract(text, rf"(?s)\A{_inside(name)}{name}", 0), F.lit("")), text)).otherwise(out)
    return out


def _first_statement(text: Column, mode: Column, depth: Column) -> Column:
    """How many characters of a piece come before its first statement at the left margin that no decorator leads into; null
    where there is none."""
    lead = _rest_of_literal(text, mode)
    tokens = F.regexp_extract_all(F.substr(text, F.length(lead) + 1), F.lit(rf"{_with_open_literals()}|[ \t\f]++|."), F.lit(0))
    begin = F.struct(F.length(lead).alias("at"), depth.alias("depth"),
                     # a piece begins behind a line feed; the line before it may be a decorator or go on
                     F.lit(False).alias("fresh"), F.lit(True).alias("led"), F.lit(-1).alias("found"))

    def step(s, t):
        ends = t.rlike(r"\A[\n\r]")
        word = t.rlike(r"(?U)\A\w")
        level = s["depth"] + F.when(t.isin("(", "[", "{"), 1).when(t.isin(")", "]", "}"), -1).otherwise(0)
        here = s["fresh"] & (s["found"] < 0) & ~s["led"] & word
        outside = s["depth"] == 0
        return F.struct(
            (s["at"] + F.length(t)).alias("at"), level.alias("depth"),
            F.when(ends, outside & t.rlike(r"[\n\r]\z")).otherwise(F.lit(False)).alias("fresh"),
            # no decorator leads into what follows a statement at the margin
            F.when(s["fresh"] & outside & (t == "@"), True)
             .when(s["fresh"] & outside & word, F.lit(False)).otherwise(s["led"]).alias("led"),
            F.when(here, s["at"]).otherwise(s["found"]).alias("found"))

    return F.aggregate(tokens, begin, step, lambda s: F.when(s["found"] >= 0, s["found"]))


def segments(pieces: DataFrame) -> DataFrame:
    """Texts of Python files from one statement at the left margin to a later one: ``file_id, text, above`` with the number of
    line ends above. Every character of a file without unpaired brackets or quotes stands in one of them."""
    begun = pieces.select(*_PLACE, "text").join(lexer_starts(pieces), [*_PLACE])
    marks = written(begun.withColumn("at", _first_statement(F.col("text"), F.col("mode"), F.col("depth"))).select(
        *_PLACE, "at", _line_ends(F.col("text")).alias("ends"),
        _line_ends(F.substr("text", F.lit(1), F.col("at"))).alias("ends_before")), "statements")
    order = Window.partitionBy("file_id").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("block", "part")
    linked = marks.select(
        *_PLACE, "at", own.alias("own"), F.last(F.when(F.col("at").isNotNull(), own), ignorenulls=True).over(order).alias("open"),
        (F.coalesce(F.sum("ends").over(order), F.lit(0)) + F.col("ends_before")).alias("above"))
    head = F.struct(F.col("open").alias("group"), F.lit(None).cast("long").alias("above"),
                    F.when(F.col("at").isNull(), F.col("text")).otherwise(F.substr("text", F.lit(1), F.col("at"))).alias("text"))
    tail = F.struct(F.col("own").alias("group"), "above", F.substr("text", F.col("at") + 1).alias("text"))
    both = pieces.select(*_PLACE, "text").join(linked, [*_PLACE]).select(
        *_PLACE, F.explode(F.when(F.col("at").isNull(), F.array(head)).otherwise(F.array(head, tail))).alias("x"))
    grouped = both.select(*_PLACE, "x.*").groupBy("file_id", "group").agg(
        F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("texts"), F.max("above").alias("above"))
    return grouped.select("file_id", F.array_join(F.transform("texts", lambda x: x["text"]), "").alias("text"),
                          F.coalesce("above", F.lit(0)).alias("above"))


def _line_ends(text: Column) -> Column:
    """Line ends as the lexer counts them."""
    return F.regexp_count(text, F.lit(r"\r\n|\n|\r")).cast("long")


def complex_in_pieces(pieces: DataFrame, near: DataFrame) -> DataFrame:
    """``file_id, block, part, complex``: the complex functions that begin in a piece, with lines counted in the file."""
    found = segments(pieces.filter(F.col("language") == "python")).select(
        "file_id", "above", F.explode_outer(complex_functions(F.lit("python"), F.col("text"))).alias("c")) \
        .filter(F.col("c").isNotNull()) \
        .select("file_id", F.struct("c.name", (F.col("c.line") + F.col("above")).alias("line"), "c.complexity").alias("c"))
    stands = near.select("file_id", F.col("first").alias("at"), F.struct("block", "part").alias("piece")) \
        .unionByName(found.select("file_id", (F.col("c.line") - 1).alias("at"), "c"), allowMissingColumns=True)
    order = Window.partitionBy("file_id").orderBy("at", F.col("c").isNotNull(), "piece").rowsBetween(Window.unboundedPreceding, 0)
    return stands.withColumn("piece", F.last("piece", ignorenulls=True).over(order)).filter(F.col("c").isNotNull()) \
        .groupBy("file_id", F.col("piece.block").alias("block"), F.col("piece.part").alias("part")) \
        .agg(F.collect_list("c").alias("complex"))


# --- findings ---------------------------------------------------------------------------

def _long_functions(signals: bool) -> str:
    """SQL text for the long functions whose header stands in the piece, over ``own``, ``lines``, ``first``, ``next_head``."""
    heads = (f"concat(transform({_headers('own')}, h -> named_struct('at', first + h.at, 'line', h.line)), "
             f"CASE WHEN next_head IS NULL THEN array() ELSE array(next_head) END)")
    pairs = (f"flatten(transform(array({heads}), h -> transform(slice(h, 1, greatest(size(h) - 1, 0)), (head, k) -> named_struct("
             "'start', head.at, 'stop', get(h, k + 1).at, 'head', head.line, 'next_line', get(h, k + 1).line))))")
    name = _by_language(lambda n: f"coalesce(nullif(regexp_extract(f.head, {quote(UNICODE + HEADER[n])}, 1), ''), 'unknown')")
    one = scan._finding_sql(
        "concat(upper(substring(language, 1, 2)), '-MAINT-LONGFN')", "'low'", "0.8D", scan.LONG_FUNCTION_ORDINAL,
        "cast(f.start + 1 AS int)", "cast(f.stop AS int)", scan._snippet_sql("f.next_line"),
        f"concat('Function \\'', {name}, '\\' is ', f.stop - f.start, ' lines long.')",
        signals_sql("lines", "cast(f.start + 1 - off AS int)") if signals else "")
    return f"transform(filter({pairs}, p -> p.stop - p.start > {LONG_FUNCTION_LINES}), f -> {one})"


def scan_pieces(pieces: DataFrame, packs: dict = PACKS, signals: bool = False, guarded: bool = True, keep=()) -> DataFrame:
    """The rows of ``scan.scan_files`` over whole files, from ``file_id, language, block, part, alone, text`` and the columns in
    ``keep``.

    Pieces that are ``alone`` in their file are scanned where they are. The others are written once, as their edges, the lexer
    and the scan read them. Line numbers stay integers, as in the scan of
    whole files, which bounds a file by two thousand million lines.
    """
    scan.check_packs(packs)
    kept = list(dict.fromkeys(["file_id", "language", *keep]))
    held = written(pieces.filter(~F.col("alone") & F.col("text").isNotNull()).select(*kept, "block", "part", "text"), "pieces")
    near = written(neighbours(held), "neighbours")
    base = held.join(near, [*_PLACE])
    judged = any(rule.rule_id == "PY-CMPLX-001" for rule in packs.get("python", ()))
    parts = [scan._line_findings_sql(packs, guarded, signals)]
    if judged:
        base = base.join(complex_in_pieces(held, near), [*_PLACE], "left")
        parts.append(scan._complexity_sql(signals))
    off = F.col("first") - F.size("before")
    base = base.withColumn("odd", odd_letters(F.col("text"))).withColumn("own", split_lines(F.col("text"))) \
        .withColumn("lines", F.concat("before", "own", "after")).withColumn("off", off.cast("int"))
    if judged:
        base = base.withColumn("complex", F.transform("complex", lambda c: F.struct(
            c["name"].alias("name"), (c["line"] - F.col("off")).cast("int").alias("line"), c["complexity"].alias("complexity"))))
    # line numbers among the piece's lines and its neighbours': those of neighbours go, the others are moved to the file's
    local = f"concat({', '.join(f'coalesce({part}, array())' for part in parts)})"
    moved = ("transform(filter(found, f -> f.line_start > size(before) AND f.line_start <= size(before) + n), "
             "f -> struct(f.line_start + off AS line_start, f AS f))")
    long = f"transform(coalesce({_long_functions(signals)}, array()), f -> struct(f.line_start AS line_start, f AS f))"
    fields = ["rule_id", "severity", "confidence_score", "ordinal", "line_start", "line_end", "code_snippet", "description",
              *(["signals"] if signals else [])]
    found = base.withColumn("found", F.expr(local)).withColumn("found", F.expr(f"concat({moved}, {long})"))
    rows = unnest(found, "found", "x", kept).select(
        *kept, *[F.col("x.line_start") if name == "line_start" else F.col(f"x.f.{name}") for name in fields])
    whole = scan.scan_files(pieces.filter("alone").select(*kept, F.col("text").alias("source")), packs, signals, True, guarded, keep)
    return scan.describe(rows, packs, keep).unionByName(whole)
