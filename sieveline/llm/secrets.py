"""Secret scan: fixed patterns, and password guess cost for values in credential contexts.

Fixed patterns give the base spans: assignments to credential names, access keys and hex runs. Further values that follow a
credential name (or stand as the password of a URL) are judged by the work to guess them: dynamic programming finds the
segmentation into words, dates, repeats, keyboard walks and brute-force spans with the least guesses in total, counted in
bits; from ``MIN_BITS`` on the value is reported as ``guess``. A value that a base span covers only in part is judged whole, so
its guess span lies over the base one; a value inside a base span is not judged again. Words cost the rank they have among the words of the corpus,
counted over all documents; ``RANKS`` is the size of that dictionary, rarer words are spelt out.

Places are code points, ends exclusive; spans come by start, then kind as listed in ``KINDS``. Null texts count as empty and
hold nothing. Long texts and values are read whole; the longest word, walk or unit of a repeat is bounded, and the runs of
repeats are found by one pass, which keeps the work linear. A value is settled as soon as no segmentation can stay below the limit. Repeated rows get equal spans. Only the text is read.
"""

import math
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sieveline.llm.common import stored

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: shortest value of an assignment, shortest access key, shortest hex run
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: names before a value, then what parts them; also the password of a URL
CONTEXT = (r"""(?<![A-Za-z0-9])(?:[A-Za-z0-9]+[_-])?(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|(?:api|access|private|"""
           r"""secret|signing)[_-]?key|auth(?:orization)?|credentials?|bearer|login)["']?\x20*(?::=|=>|[:=])\x20*["'`]?"""
           r"""([^\s"'`,;<>(){}\[\]|]{6,})|://[^\s/:@]++:([^\s/:@]{6,})@""")
_HINTS = ("pass", "pwd", "pin", "secret", "token", "key", "auth", "credential", "bearer", "login", "://")
MIN_BITS = 36.0
RANKS, LEAST_WORD, LONGEST_WORD = 20_000, 3, 24
#: rows of a keyboard, each key half a key right of the one above
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
#: letters that digits and signs stand for
LEET = str.maketrans("4@3105$7", "aaeiosst")
#: rank of the most usual passwords' words, most usual first
USUAL = ("password", "admin", "welcome", "letmein", "login", "master", "secret", "test", "guest", "root", "user", "changeme",
         "default", "dragon", "monkey", "sunshine", "princess", "football", "iloveyou", "qwerty")
LONGEST_UNIT = 8


def _neighbours():
    places = {key: (x + y / 2, y) for y, row in enumerate(KEYBOARD) for x, key in enumerate(row)}
    return {a: {b for b, (bx, by) in places.items() if a != b and abs(bx - ax) <= 1 and abs(by - ay) <= 1}
            for a, (ax, ay) in places.items()}


NEIGHBOURS = _neighbours()
_DATES = (r"(?:19|20)\d\d", r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])",
          r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
#: bits of a year of the last century or so, and of a day in it
_DATE_BITS = (math.log2(120), math.log2(120 * 366), math.log2(120 * 366) + 1)


def spelt(text):
    """Bits to spell a text character by character."""
    return sum(math.log2(10) if c.isdigit() else math.log2(26) if c.isalpha() else math.log2(33) for c in text)


def word_bits(text, ranks):
    """Bits of a text as one dictionary word, in any case and with letters replaced; None if it is none."""
    low = text.lower()
    rank = ranks.get(low)
    extra = 0.0
    if rank is None:
        plain = low.translate(LEET)
        rank = ranks.get(plain) if plain != low else None
        extra = 2.0
    if rank is None:
        return None
    upper = sum(c.isupper() for c in text)
    return math.log2(rank + 1) + extra + (0 if not upper else 1 if upper == len(text) or text[0].isupper() and upper == 1
                                          else math.log2(1 + math.comb(len(text), upper)))


def walk_bits(text):
    """Bits of a keyboard walk or a run of the alphabet or digits; None if it is none."""
    low = text.lower()
    steps = {ord(b) - ord(a) for a, b in zip(low, low[1:])}
    if len(steps) == 1 and abs(steps.pop()) == 1 and (low.isdigit() or low.isalpha()):
        return math.log2(26) + 1 + math.log2(len(text))
    if all(b in NEIGHBOURS.get(a, ()) for a, b in zip(low, low[1:])):
        turns = sum(ord(b) - ord(a) != ord(c) - ord(b) for a, b, c in zip(low, low[1:], low[2:]))
        return math.log2(47) + math.log2(len(text)) + 1.5 * turns
    return None


def _repeats(text):
    """For each unit length how far the text goes on repeating itself behind every place: one pass from right to left."""
    n = len(text)
    out = []
    for unit in range(1, min(LONGEST_UNIT, n // 2) + 1):
        runs = [0] * (n + 1)
        for i in range(n - unit - 1, -1, -1):
            if text[i] == text[i + unit]:
                runs[i] = runs[i + 1] + 1
        out.append(runs)
    return out


def _dates(text):
    """Place to the dates that begin there."""
    out = {}
    for pattern, bits in zip(_DATES, _DATE_BITS):
        for m in re.finditer(f"(?=({pattern}))", text):
            out.setdefault(m.start(), []).append((m.end(1), bits))
    return out


def segments_at(text, i, ranks, repeats, dates):
    """The segments that begin at a place, ``(end, bits)``: the character itself and what is cheaper to name than to spell.

    They are at most a fixed number, however long the text is.
    """
    n = len(text)
    yield i + 1, spelt(text[i])
    for j in range(i + LEAST_WORD, min(n, i + LONGEST_WORD) + 1):
        part = text[i:j]
        bits = word_bits(part, ranks)
        if bits is not None:
            yield j, bits
        bits = walk_bits(part)
        if bits is not None:
            yield j, bits
    for unit, runs in enumerate(repeats, 1):
        times = runs[i] // unit + 1
        if times >= (3 if unit == 1 else 2):
            named = word_bits(text[i:i + unit], ranks) if unit >= LEAST_WORD else None
            bits = spelt(text[i:i + unit]) if named is None else min(named, spelt(text[i:i + unit]))
            yield i + unit * times, bits + math.log2(times)
    yield from dates.get(i, ())


def segments(text, ranks):
    """Every segment ``(begin, end, bits)``."""
    repeats, dates = _repeats(text), _dates(text)
    for i in range(len(text)):
        for j, bits in segments_at(text, i, ranks, repeats, dates):
            yield i, j, bits


def guess_bits(text, ranks, enough: float = math.inf):
    """The least bits over all segmentations; each segment but the first costs one bit more for where it begins.

    Where it is certain that no segmentation has less than ``enough`` bits, what is reached so far is returned: no way leads
    past a place but through one that is already dearer. Places dearer than the whole text are not followed.
    """
    n = len(text)
    best = [0.0] + [math.inf] * n
    repeats, dates = _repeats(text), _dates(text)
    cheap = 0  # the last place that is reached for less than enough
    for i in range(n):
        if i > cheap:
            return enough
        if best[i] >= min(enough, best[n]):
            continue
        for j, bits in segments_at(text, i, ranks, repeats, dates):
            # characters spelt one after another are one span
            total = best[i] + bits + (1 if i and j > i + 1 else 0)
            if total < best[j]:
                best[j] = total
                if total < enough:
                    cheap = max(cheap, j)
    return best[n]


def base_spans(text, low=None):
    """Spans of the fixed patterns: ``(start, kind, end)``."""
    low = text.lower() if low is None else low
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if len(m[0]) >= LEAST_ACCESS]
    # runs of at least that length are the long ones among all runs
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{%d,}" % LEAST_HEX, text)]
    return out


def all_spans(text, ranks):
    """Base spans and hard-to-guess values that none of them holds whole, in order; these may overlap."""
    low = text.lower()
    base = base_spans(text, low)
    more = []
    if any(h in low for h in _HINTS):
        for m in re.finditer(CONTEXT, text, re.I | re.A):
            group = 1 if m[1] is not None else 2
            start, end = m.span(group)
            if not any(s <= start and end <= e for s, _, e in base) and guess_bits(text[start:end], ranks, MIN_BITS) >= MIN_BITS:
                more.append((start, 3, end))
    return sorted(base + more)


def word_ranks(docs: DataFrame, text: str = "text", ranks: int = RANKS) -> dict:
    """The rank of each of the most frequent words of all documents, after the usual passwords; at most ``ranks``."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("w")) \
        .filter(F.length("w").between(LEAST_WORD, LONGEST_WORD)).groupBy("w").count()
    counts = stored(words, "word-counts")
    # how many words lie in each eighth of a power of two of the count tells from which on the first ones are among them
    step = F.floor(F.log2("count") * 8).cast("int")
    least, seen = 0, 0
    for place, size in sorted(map(tuple, counts.groupBy(step.alias("s")).agg(F.count("*")).collect()), reverse=True):
        least, seen = place, seen + size
        if seen >= ranks:
            break
    top = stored(counts.filter(step >= least).orderBy(F.desc("count"), "w").limit(ranks), "word-ranks") \
        .orderBy(F.desc("count"), "w").collect()
    out = {}
    for word in (*USUAL, *(r["w"] for r in top)):
        out.setdefault(word, len(out) + 1)
    return out


_SPANS = "array<struct<kind: string, start: int, end: int>>"


def finder(ranks):
    """A pandas UDF: text to its spans."""
    def find(texts):
        for batch in texts:
            yield pd.Series([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t, ranks)]
                             if isinstance(t, str) else [] for t in batch])

    find.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(find, _SPANS)


def find_secrets(docs: DataFrame, ranks: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with an array ``_secrets`` of kind, start and end."""
    return docs.withColumn("_secrets", finder(ranks)(F.col(text)))


def redact(docs: DataFrame, ranks: dict, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span of secrets in ``text`` replaced by ``mark``, overlapping ones by one; other texts stay as they are."""
    def clean(texts):
        for batch in texts:
            out = []
            for t in batch:
                parts, at = [], 0
                for s, _, e in all_spans(t, ranks) if isinstance(t, str) else ():
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, t[at:]]) if parts else t)
            yield pd.Series(out)

    clean.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(text, F.pandas_udf(clean, "string")(F.col(text)))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans as text."""
    def joined(spans):
        return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = (F.expr(f"CAST(size(filter(_secrets, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS[:3])
    base = joined("filter(_secrets, s -> s.kind <> 'guess')")
    return found.select(key, *counts, F.sha2(F.expr(base).cast("binary"), 256).alias("base_sha256"),
                        F.expr(joined("_secrets")).alias("spans"))
