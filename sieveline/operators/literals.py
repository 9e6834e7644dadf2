"""Literals that a regular expression cannot match without: the index behind rule tables.

``required`` reads an expression's syntax tree and returns a few literals, at least one of which occurs, lower-cased, in every
line that the expression matches while it ignores case. An expression without such literals, or one whose syntax is unknown
here, gets none and is tried on every line of its language.

A literal is filed under its rarest gram of up to three characters. Lines meet an index of any size by the grams they hold,
and a hit counts when the whole literal occurs; a small index becomes an automaton. Either way candidate pairs are as many
as hits, however many rules there are.
"""

import re
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: longest gram; alternatives and characters of a class that are followed up; length from which literals are as good as longer ones
GRAM, ALTERNATIVES, CHOICES, LONG = 3, 64, 4, 6
#: characters by how common they are in source text, the commonest first; others count as rare
_COMMON = " etaoinsrlcdupmfhg_.()b=y,v:k\"'w;x/-0j1{}z"


def fold(line: Column) -> Column:
    """Lower case as far as ignoring case reaches: the long s and the dotless i match ``s`` and ``i``, too."""
    return F.translate(F.lower(line), "ſı", "si")


def folded(line: str) -> str:
    """The same for a text in Python."""
    return line.lower().replace("ſ", "s").replace("ı", "i")


def _better(one, other):
    """Of two sets of alternatives the one that says more: a longer shortest literal, then fewer literals."""
    if not one or not other:
        return one or other
    return max(one, other, key=lambda s: (min(LONG, min(map(len, s))), -len(s)))


def _texts(op, value):
    """All texts that a part of an expression can match, lower-cased; None where they are many or not plain."""
    from re import _constants as c
    if op is c.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if op is c.IN:
        found = [_texts(*item) if item[0] is c.LITERAL else None for item in value]
        return set().union(*found) if all(found) and len(found) <= CHOICES else None
    if op is c.SUBPATTERN:
        return _joined(value[3])
    if op is c.BRANCH:
        found = [_joined(b) for b in value[1]]
        return set().union(*found) if all(found) and len(found) <= ALTERNATIVES else None
    return None


def _joined(items):
    texts = {""}
    for op, value in items:
        more = _texts(op, value)
        if not more or len(texts) * len(more) > ALTERNATIVES:
            return None
        texts = {a + b for a in texts for b in more}
    return texts


def _from_sequence(items):
    """The best set of alternatives of a sequence: the texts of a run of plain parts, or what one of its parts requires."""
    best, runs = None, {""}
    for op, value in items:
        texts = _texts(op, value)
        if texts and len(runs) * len(texts) <= ALTERNATIVES:
            runs = {a + b for a in runs for b in texts}
            continue
        best, runs = _better(best, None if "" in runs else runs), texts or {""}
        if not texts:
            best = _better(best, _from_part(op, value))
    return _better(best, None if "" in runs else runs)


def _from_part(op, value):
    from re import _constants as c
    if op is c.SUBPATTERN:
        return _from_sequence(value[3])
    if op is c.ATOMIC_GROUP:
        return _from_sequence(value)
    if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
        return _from_sequence(value[2]) if value[0] > 0 else None
    if op is c.BRANCH:
        found = [_from_sequence(b) for b in value[1]]
        if all(found) and sum(map(len, found)) <= ALTERNATIVES:
            return set().union(*found)
    if op is c.ASSERT and value[0] > 0:
        return _from_sequence(value[1])
    return None


def required(pattern) -> list:
    """The literals of an expression, ascending; none where nothing is required or the syntax is unknown."""
    if not isinstance(pattern, str):
        return []
    try:
        found = _from_sequence(re._parser.parse(pattern, re.IGNORECASE))
    except (re.error, OverflowError, RecursionError, AttributeError):
        return []
    # a literal that holds another one adds nothing
    return sorted(s for s in found or () if not any(t != s and t in s for t in found))


def rarest(literal: str) -> str:
    """The gram that a literal is filed under."""
    size = min(GRAM, len(literal))
    grams = [literal[n:n + size] for n in range(len(literal) - size + 1)]
    place = {c: n for n, c in enumerate(_COMMON)}
    return max(grams, key=lambda g: sum(place.get(c, len(_COMMON)) for c in g))


def index(rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """A row for every literal of every rule: the rule's columns, ``literal``, ``gram`` and ``earlier``, the rule's literals
    before this one. Rules without literals have one row with nulls."""
    def read(batches):
        for patterns in batches:
            found = [required(p) for p in patterns]
            yield pd.Series([[{"literal": s, "gram": rarest(s), "earlier": f[:n]} for n, s in enumerate(f)] for f in found])

    read.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    entries = F.pandas_udf(read, "array<struct<literal:string,gram:string,earlier:array<string>>>")(F.col(pattern))
    return rules.withColumn("entry", F.explode_outer(entries)).select(*rules.columns, "entry.*")


def grams(folded: Column, sizes) -> Column:
    """The distinct grams of a line, of each of the given sizes."""
    def of(size):
        last = F.length(folded) - (size - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                            lambda n: F.substr(folded, n, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(size) for size in sizes)))
