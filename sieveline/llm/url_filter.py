"""URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule names a host with a path prefix; it fits the host and all its subdomains, and the longest fitting rule decides. URLs
without a rule are judged by their terms: a term counts where neither neighbour is an ASCII letter or digit; one strict
term, or ``min_soft`` distinct soft terms, reject the URL. Only the URL column is read.

Null, empty and scheme-less URLs have an empty host and path, fit no rule and are allowed unless their own text holds
terms (a null holds none). Repeated rows are judged alike; further columns of the input are ignored.
"""

from typing import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: one of these is enough
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "escorts", "viagra", "cialis", "warez", "keygen", "casino",
          "jackpot", "malware", "phishing", "link-farm", "spam-farm", "spam")
#: several different ones of these are needed
SOFT = ("adult", "sex", "nude", "dating", "singles", "bet", "betting", "poker", "slots", "bonus", "win", "prize", "loan",
        "loans", "credit", "pharmacy", "pills", "diet", "cheap", "free", "discount", "coupon", "promo", "download",
        "torrent", "crack", "hack", "ads", "ad", "affiliate", "click", "popup", "farm")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _by_length(rules):
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def _quoted(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def term_counter(strict=STRICT, soft=SOFT):
    """A pandas UDF: URL to the distinct strict and soft terms found in it."""
    strict, soft = tuple(strict), tuple(soft)
    to_lower = {ord(a): b for a, b in zip(_UPPER, _LOWER)}

    def inside(c):
        return "a" <= c <= "z" or "0" <= c <= "9"

    def found(url, terms):
        text = url.translate(to_lower)
        hits = set()
        for last, term in terms.iter(text):
            first = last - len(term) + 1
            if not (first and inside(text[first - 1])) and not (last + 1 < len(text) and inside(text[last + 1])):
                hits.add(term)
        return hits

    def count(batches):
        terms = ahocorasick.Automaton()
        for term in strict + soft:
            terms.add_word(term, term)
        terms.make_automaton()
        known = set(strict)
        for urls in batches:
            hits = [found(u, terms) if isinstance(u, str) else set() for u in urls]
            yield pd.DataFrame({"strict_hits": [len(h & known) for h in hits], "soft_hits": [len(h - known) for h in hits]},
                               dtype="int32")

    # the iterator form builds the automaton once per task
    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(count, "strict_hits int, soft_hits int")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, strict=STRICT, soft=SOFT,
          min_soft: int = 2) -> DataFrame:
    """One row per page: key, host, path, rule, verdict, strict_hits, soft_hits."""
    base = pages.select(F.col(key).alias("k"), F.col(url).alias("u"))
    after = base.withColumn("a", F.expr("CASE WHEN instr(u, '://') > 0 THEN substring(u, instr(u, '://') + 3) ELSE '' END"))
    parts = after.withColumn("h", F.regexp_extract("a", r"^[^/?#]*", 0)).withColumn(
        "p", F.regexp_extract(F.expr("substring(a, length(h) + 1)"), r"^[^?#]*", 0)).withColumn(
        "h", F.translate("h", _UPPER, _LOWER))
    rule = verdict = "CASE"
    for kind, host, path in _by_length(rules):
        fits = (f" WHEN (h = {_quoted(host)} OR endswith(h, {_quoted('.' + host)})) AND startswith(p, {_quoted(path)})")
        rule += f"{fits} THEN {_quoted(host + path)}"
        verdict += f"{fits} THEN {_quoted(kind)}"
    end = " ELSE CAST(NULL AS STRING) END"
    ruled = parts.withColumn("r", F.expr(rule + end if rules else "CAST(NULL AS STRING)")) \
        .withColumn("v", F.expr(verdict + end if rules else "CAST(NULL AS STRING)")) \
        .withColumn("n", term_counter(strict, soft)("u"))
    by_terms = F.when((F.col("n.strict_hits") > 0) | (F.col("n.soft_hits") >= min_soft), "block").otherwise("allow")
    return ruled.select(F.col("k").alias(key), F.col("h").alias("host"), F.col("p").alias("path"), F.col("r").alias("rule"),
                        F.coalesce("v", by_terms).alias("verdict"), "n.strict_hits", "n.soft_hits")


def oracle_sql(rules=RULES, strict=STRICT, soft=SOFT, min_soft=2):
    """The same rows as DuckDB SQL."""
    def sql(text):
        return "'" + text.replace("'", "''") + "'"

    def hits(terms):
        return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in terms)

    fits = [(k, h + p, f"(host = {sql(h)} OR ends_with(host, {sql('.' + h)})) AND starts_with(path, {sql(p)})")
            for k, h, p in _by_length(rules)]
    rule = "CASE " + " ".join(f"WHEN {c} THEN {sql(r)}" for _, r, c in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN {sql(k)}" for k, _, c in fits) + " END"
    return f"""
    WITH cut AS (SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS u,
                 CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
    host AS (SELECT *, regexp_extract(a, '^[^/?#]*') AS h FROM cut),
    part AS (SELECT page_id, u, translate(h, '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(substr(a, length(h) + 1), '^[^?#]*') AS path FROM host),
    hit AS (SELECT *, {rule} AS rule, {verdict} AS v, ({hits(strict)})::INT AS strict_hits, ({hits(soft)})::INT AS soft_hits
            FROM part)
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN strict_hits > 0 OR soft_hits >= {min_soft} THEN 'block'
           ELSE 'allow' END) AS verdict, strict_hits, soft_hits FROM hit"""
