"""Quality rules as weak supervision, in built-in functions only.

Every rule looks at counts of a document and votes good, bad or abstains. Expectation-maximisation over the counts of vote
patterns of all documents estimates how accurate each rule is (how often it casts its vote on good and on bad documents)
and the share of good documents; a document is kept when its posterior probability of being good is at least one half,
unless a base limit fails. Kinds of bad documents hardly overlap, so a rule finds either one fault or plain prose. At most
``2 ** len(RULES)`` patterns reach the driver, whatever the size of the table.

Null texts count as empty; texts without words fail the base limits. Long texts are counted whole. Repeated rows count as
often as they occur and get equal verdicts; an empty table gives an empty result. Other columns are ignored.
"""

import math

from pyspark.sql import DataFrame, functions as F

from sieveline.llm.common import stored

SYMBOLS = "[#*$%&|<>]"
GAP = r"[\\x20\\x09-\\x0D]"
_PLAIN = "100 * n_symbols <= 5 * n_words AND 100 * n_upper <= 20 * word_chars AND 100 * n_marks <= 5 * n_words"
#: (name, vote, when); otherwise the rule abstains
RULES = (
    ("short", -1, "n_words < 50"),
    ("odd_words", -1, "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words"),
    ("symbols", -1, "100 * n_symbols > 10 * n_words"),
    ("copied_lines", -1, "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("repeated_words", -1, "100 * n_repeat_words > 30 * n_words"),
    ("capitals", -1, "100 * n_upper > 30 * word_chars"),
    ("shouting", -1, "100 * n_marks > 20 * n_words"),
    ("no_sentences", -1, "100 * n_ends < n_words"),
    ("digits", -1, "100 * n_digits > 20 * word_chars"),
    ("sentences", 1, f"2 * n_ends <= n_words AND 40 * n_ends >= n_words AND {_PLAIN}"),
    ("varied", 1, f"n_words >= 50 AND 100 * n_repeat_words <= 10 * n_words AND {_PLAIN}"),
    ("usual_words", 1, f"word_chars BETWEEN 3 * n_words AND 9 * n_words AND 100 * n_digits <= 5 * word_chars AND {_PLAIN}"),
)
#: where the estimation starts: share of good documents, and by a rule's vote how often it casts it on good and on bad ones
START, START_CAST = 0.8, {-1: (0.02, 0.3), 1: (0.9, 0.2)}
ROUNDS, PRIOR_VOTES = 25, 1.0
FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks",
          "n_ends", "n_digits")


def _let(value, name, body):
    """SQL: ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated():
    """Words that lie in a window of three words found twice or more in the array ``ws``."""
    hashed = ("CASE WHEN size(ws) < 3 THEN array() ELSE transform(sequence(0, size(ws) - 3), i -> "
              "named_struct('h', xxhash64(ws[i], ws[i + 1], ws[i + 2]), 'i', i)) END")
    places = ("sort_array(transform(filter(transform(s, (x, k) -> named_struct('i', x.i, 'twice', "
              "get(s, k - 1).h <=> x.h OR get(s, k + 1).h <=> x.h)), x -> x.twice), x -> x.i))")
    covered = "aggregate(transform(p, (x, k) -> least(3, x - coalesce(get(p, k - 1), x - 3))), 0L, (a, x) -> a + x)"
    return _let(f"sort_array({hashed})", "s", _let(places, "p", covered))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts of every document, from its whole text."""
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = f"filter(split(t, '{GAP}+'), w -> w <> '')"
    lines = r"filter(split(t, '\\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')"
    of_words = _let(words, "ws", "named_struct('n_words', CAST(size(ws) AS BIGINT), 'word_chars', "
                    f"aggregate(ws, 0L, (a, w) -> a + length(w)), 'n_repeat_words', {_repeated()})")
    of_lines = _let(lines, "ls", "named_struct('n_lines', CAST(size(ls) AS BIGINT), 'n_dup_lines', "
                    "CAST(size(ls) - size(array_distinct(ls)) AS BIGINT))")
    marks = {"n_symbols": SYMBOLS, "n_upper": "[A-Z]", "n_marks": "[!]", "n_ends": "[.!?]", "n_digits": "[0-9]"}
    found = base.select("k", F.expr(of_words).alias("w"), F.expr(of_lines).alias("l"),
                        *(F.regexp_count("t", F.lit(p)).cast("long").alias(n) for n, p in marks.items()))
    return found.select(F.col("k").alias(key), "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines",
                        "w.n_repeat_words", "l.n_lines", "n_upper", "n_marks", "n_ends", "n_digits")


def vote(rule) -> str:
    return f"CASE WHEN {rule[2]} THEN {rule[1]} ELSE 0 END"


def estimate(patterns, rules=RULES, rounds: int = ROUNDS):
    """Share of good documents, and how often each rule votes on good and on bad ones, from ``(votes, count)`` pairs."""
    share, good, bad = START, *([START_CAST[r[1]][k] for r in rules] for k in (0, 1))
    for _ in range(rounds):
        total = kept = 0.0
        on_good, on_bad = [PRIOR_VOTES] * len(rules), [PRIOR_VOTES] * len(rules)
        for votes, count in patterns:
            q = 1 / (1 + math.exp(-log_odds(votes, share, good, bad)))
            total, kept = total + count, kept + count * q
            for j, v in enumerate(votes):
                if v:
                    on_good[j] += count * q
                    on_bad[j] += count * (1 - q)
        share = (kept + PRIOR_VOTES) / (total + 2 * PRIOR_VOTES)
        good = [x / (kept + 2 * PRIOR_VOTES) for x in on_good]
        bad = [x / (total - kept + 2 * PRIOR_VOTES) for x in on_bad]
    return share, good, bad


def weights(share, good, bad):
    """The log-odds as a constant and what each vote adds."""
    constant = math.log(share / (1 - share)) + sum(math.log((1 - g) / (1 - b)) for g, b in zip(good, bad))
    return constant, [math.log(g / b) - math.log((1 - g) / (1 - b)) for g, b in zip(good, bad)]


def log_odds(votes, share, good, bad):
    constant, each = weights(share, good, bad)
    return constant + sum(w for v, w in zip(votes, each) if v)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Counts, base_failed, kept and quality (the posterior) of every document."""
    counts = stored(counted(docs, key, text), "quality")
    votes = [F.expr(vote(rule)).alias(f"v{j}") for j, rule in enumerate(rules)]
    patterns = counts.select(*votes).groupBy(*(f"v{j}" for j in range(len(rules)))).count().collect()
    constant, each = weights(*estimate(sorted((tuple(r[:-1]), r["count"]) for r in patterns), rules))
    odds = F.lit(constant)
    for v, w in zip(votes, each):
        odds = odds + F.abs(v) * w
    quality = 1 / (1 + F.exp(-odds))
    return counts.withColumn("base_failed", F.expr(FAILED)).withColumn("quality", quality).select(
        key, *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality")


def oracle_sql(rules=RULES, rounds: int = ROUNDS) -> str:
    """The same rows, without the posterior itself, as DuckDB SQL; the estimation is a recursive query."""
    n = range(len(rules))
    s = PRIOR_VOTES
    terms = " + ".join(f"CASE WHEN v{j} <> 0 THEN ln(g{j} / b{j}) ELSE ln((1 - g{j}) / (1 - b{j})) END" for j in n)
    step = ", ".join(f"(sum(c * abs(v{j}) * {q}) + {s}) / (sum(c * {q}) + {2 * s})" for j in n for q in ("q", "(1 - q)"))
    start = ", ".join(f"{START_CAST[r[1]][0]}::DOUBLE AS g{j}, {START_CAST[r[1]][1]}::DOUBLE AS b{j}"
                      for j, r in enumerate(rules))
    votes = ", ".join(f"{vote(rule)} AS v{j}" for j, rule in enumerate(rules))
    names = ", ".join(f"v{j}" for j in n)
    cut = "'[\\x20\\x09-\\x0D]+'"
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT id, list_filter(regexp_split_to_array(t, {cut}), lambda x: x <> '') AS ws FROM d),
    g AS (SELECT id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT id, ws,
          unnest(range(1, greatest(1, len(ws) - 1))) AS i FROM w)),
    h AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, x) AS n FROM g) WHERE n > 1),
    rw AS (SELECT id, count(DISTINCT i + o) AS n_repeat_words FROM h, range(3) AS r(o) GROUP BY id),
    l AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT id,
          unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY id),
    f AS (SELECT id, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
          len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
          coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
          len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_marks,
          len(regexp_extract_all(t, '[.!?]')) AS n_ends, len(regexp_extract_all(t, '[0-9]')) AS n_digits
          FROM d JOIN w USING (id) LEFT JOIN rw USING (id) LEFT JOIN l USING (id)),
    v AS (SELECT *, {votes}, ({FAILED}) AS base_failed FROM f),
    pat AS (SELECT {names}, count(*)::DOUBLE AS c FROM v GROUP BY ALL),
    em AS (SELECT 0 AS i, {START}::DOUBLE AS p, {start} UNION ALL
           SELECT i + 1, (sum(c * q) + {s}) / (sum(c) + {2 * s}), {step}
           FROM (SELECT *, 1 / (1 + exp(-(ln(p / (1 - p)) + {terms}))) AS q FROM em, pat WHERE i < {rounds}) GROUP BY i)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           (NOT base_failed) AND 1 / (1 + exp(-(ln(p / (1 - p)) + {terms}))) >= 0.5 AS kept
    FROM v, (SELECT * FROM em WHERE i = {rounds}) AS em"""
