"""Mixing to target weights by soft membership.

A classifier, trained on the documents of a labelled table, gives each document a posterior over domains. Nonnegative
rates are then fitted so that the expected tokens of each domain, sum of rate x tokens x posterior, meet their targets, by
projected-gradient least squares: every rate starts at 1 and moves against the gradient, cut at 0. Rates stay with their
documents. A step is one pass that sums a few numbers a domain over all documents; the driver turns them into the next
gradient, and every ``HELD`` steps the rates are written.

The gradient is taken in the metric of the documents whose rate can still move (the second moments of their posteriors,
weighted by tokens, and a damping), so that what a step does to a rate depends on the document's posterior alone and a
change is spread over all documents that can bring it. The damping falls while steps help; a step that does not is taken
back and repeated with more of it, down to short steps along the plain gradient.

Rates lie within a trust region around 1, at most ``TRUST`` at first. If the targets cannot be met in it, it grows by that
factor, but only as long as that at least halves the misfit: targets that no rates can meet move the rates no further than
``TRUST``, and nothing is thrown away for them. ``most`` bounds the rates beyond that; the shares that are reached are
returned, ``met`` tells whether they are the targets, and missed ones are logged. A document stays ``copies`` times: its
rate, rounded up or down by a hash.

The classifier averages embeddings of hashed features (what a word looks like, its first letters) under a linear softmax, on
about ``SAMPLE`` labelled documents a domain, at most twice that. Null and empty texts have no tokens and equal posteriors
but for the bias; their rate is 1. Null labels are not learnt from; without any labelled document all posteriors are equal.
Long texts and words are read whole. Repeated rows share posterior, rate and copies. An empty table gives an empty result.
"""

import logging
import math
import re
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sieveline.llm.common import sampled, stored
from sieveline.llm.language import BUCKETS, _softmax, fit

#: shares of the tokens wanted of each domain
TARGETS = {"good": 0.9, "poor": 0.08, "toxic": 0.02}
SAMPLE, TOLERANCE = 1000, 1e-4
#: upper bound of a rate where none is asked for, damping at the start and at least
MOST, FIRST_DAMPING, LEAST_DAMPING = math.inf, 1e-2, 1e-6
#: first bound of the trust region and its factor, steps in one region, and steps from one writing of the rates to the next
TRUST, STEPS, HELD = 16.0, 60, 8
_LOG = logging.getLogger(__name__)
#: words that a task remembers, and the longest of them
REMEMBERED, LONGEST = 300_000, 64
_SHAPE = re.compile(r"(.)\1+")
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def domain_of_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key and domain: toxic, else poor, else good; null without labels."""
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") <= 0, "poor").when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), "good")
    return labels.select(F.col(key).alias("k"), domain.alias("domain")).filter("k IS NOT NULL")


class _Kinds(dict):
    """Code points to ``a``, ``A``, ``0`` or themselves."""

    def __missing__(self, code):
        c = chr(code)
        self[code] = kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        return kind


def _look(word, kinds):
    """Runs of letters, capitals, digits and signs of a word, each once."""
    return _SHAPE.sub(r"\1", word.translate(kinds))


class _Buckets(dict):
    """Features to their buckets."""

    def __missing__(self, feature):
        if len(self) > REMEMBERED:
            self.clear()
        value = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(feature) <= LONGEST:
            self[feature] = value
        return value


class _Features(dict):
    """Words to their two buckets, in one number."""

    def __init__(self):
        super().__init__()
        self.kinds, self.bucket = _Kinds(), _Buckets()

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        low = word.lower()
        look = "a" if word.isalpha() and word == low else _look(word, self.kinds)
        value = self.bucket["l" + look] * BUCKETS + self.bucket["s" + low.lstrip(_SIGNS)[:4]]
        if len(word) <= LONGEST:
            self[word] = value
        return value


def features(text, known):
    """The distinct buckets of a text, their weights, and its number of words."""
    words = text.split() if isinstance(text, str) else []
    both = np.fromiter(map(known.__getitem__, set(words)), np.int64)
    at = np.unique(np.concatenate([both // BUCKETS, both % BUCKETS])).astype(np.int32)
    return at, np.full(len(at), 1 / max(1, len(at)), np.float32), len(words)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text"):
    """Names of the domains, ascending, the fitted classifier, and the log of each domain's labels by those sampled."""
    shares = dict(map(tuple, labels.groupBy("domain").count().collect()))
    chosen = F.broadcast(sampled(labels, "k", "domain", SAMPLE))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL").join(chosen, "k")

    def read(batches):
        known = _Features()
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "y": batch["y"],
                                "at": [features(t, known)[0].tobytes() for t in batch["t"]]})

    got = rows.limit(8 * SAMPLE).select(F.col("k").cast("string").alias("k"), F.col("domain").alias("y"), "t").mapInPandas(
        read, "k string, y string, at binary").collect()
    got = sorted((r for r in got if r["at"]), key=lambda r: (r["y"], r["k"], bytes(r["at"])))
    names = sorted({r["y"] for r in got})
    examples = []
    for r in got:
        at = np.frombuffer(r["at"], np.int32)
        examples.append((at, np.full(len(at), 1 / len(at), np.float32), names.index(r["y"])))
    prior = [np.log(shares[d] / sum(e[2] == y for e in examples)) for y, d in enumerate(names)]
    return names, fit(examples, names) if names else None, prior


def posteriors(docs: DataFrame, model, domains, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, row (a hash of key and text), tokens and p, the posterior of each of ``domains``."""
    names, fitted, prior = model
    spots = [names.index(d) if d in names else -1 for d in domains]

    def predict(batches):
        known = _Features()
        for texts in batches:
            tokens, p = [], []
            for text in texts:
                at, share, n = features(text, known)
                if fitted:
                    each = _softmax((share @ fitted[0][at] + fitted[1]) / fitted[2] + prior)
                    p.append([float(each[s]) if s >= 0 else 0.0 for s in spots])
                else:
                    p.append([1 / len(spots)] * len(spots))
                tokens.append(n)
            yield pd.DataFrame({"tokens": tokens, "p": p})

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(predict, "tokens long, p array<double>")(F.col(text))
    return docs.select(F.col(key).alias("k"), F.xxhash64(key, text).alias("row"), found.alias("f")).select(
        "k", "row", "f.tokens", "f.p")


def _moved(steps, most: float):
    """The rate after ``steps``, a gradient a domain each, from the column r."""
    told = F.array(*(F.array(*(F.lit(float(x)) for x in g)) for g in steps))

    def step(rate, g):
        slope = sum((F.col("p")[k] * g[k] for k in range(len(steps[0]))), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), rate - slope))

    return F.when(F.col("tokens") > 0, F.aggregate(told, F.col("r"), step)).otherwise(F.lit(1.0)) if steps else F.col("r")


class Rates:
    """Documents with tokens, p and their rates: written now and then, steps since pending."""

    def __init__(self, members: DataFrame, domains: int, most: float = MOST):
        self.held, self.domains, self.pending, self.most = members.withColumn("r", F.lit(1.0)), domains, [], most

    def rated(self) -> DataFrame:
        return self.held.withColumn("r", _moved(self.pending, self.most))

    def settle(self):
        """Writes the rates."""
        if self.pending:
            self.held, self.pending = stored(self.rated(), "mixing-rates"), []

    def step(self, gradient):
        if len(self.pending) == HELD:
            self.settle()
        self.pending.append([float(x) for x in gradient])

    def back(self):
        """Takes the last step back."""
        self.pending.pop()

    def sums(self, total: float):
        """Each domain's share of all tokens by the rates, and the second moments of the documents whose rate can move."""
        n = self.domains
        weight = [F.col("tokens") * F.col("p")[k] for k in range(n)]
        free = (F.col("r") > 0) & (F.col("r") < self.most)
        pairs = [(k, j) for k in range(n) for j in range(k + 1)]
        got = self.rated().agg(*(F.sum(w * F.col("r")) for w in weight), *(
            F.sum(F.when(free, weight[k] * F.col("p")[j]).otherwise(0.0)) for k, j in pairs)).first()
        got, moments = np.array(got, float) / total, np.zeros((n, n))
        for (k, j), value in zip(pairs, got[n:]):
            moments[k, j] = moments[j, k] = value
        return got[:n], moments


def _descend(rates: Rates, goal, total: float, most: float, enough: float, steps: int):
    """Steps within the bound ``most`` until the targets are met or no step helps, and the shares then."""
    rates.settle()
    rates.most = most
    damping, slow, last = FIRST_DAMPING, 0, None
    for _ in range(steps):
        shares, free = rates.sums(total)
        misfit = float(np.linalg.norm(shares - goal))
        if last is None or misfit < last[0]:
            slow = slow + 1 if last and misfit > 0.999 * last[0] else 0
            last, damping = (misfit, shares, free), max(damping / 4, LEAST_DAMPING)
            if misfit <= enough or slow > 5:
                break
        else:
            rates.back()
            damping *= 8
        misfit, shares, free = last
        if damping > 1e3:  # not even a short step along the gradient helps
            return shares
        rates.step(np.linalg.solve(free + damping * np.eye(len(goal)), shares - goal))
    else:
        rates.back()
    return last[1]


def fit_rates_and_shares(members: DataFrame, targets: list, steps: int = None, most: float = None,
                         tolerance: float = TOLERANCE):
    """``members`` (with tokens and p) with their rate ``r``, and the share of all tokens that each domain gets by the rates.

    ``most`` bounds the rates, ``steps`` those in one trust region.
    """
    most, steps = MOST if most is None else most, STEPS if steps is None else steps
    goal = np.array(targets, float)
    total = float(members.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return members.withColumn("r", F.lit(1.0)), np.zeros(len(goal))
    enough = tolerance * max(np.linalg.norm(goal), 1e-12)
    rates, region = Rates(members, len(goal)), min(TRUST, most)
    shares = _descend(rates, goal, total, region, enough, steps)
    while np.linalg.norm(shares - goal) > enough and region < most:
        rates.settle()
        kept, region = rates.held, min(region * TRUST, most)
        wider = _descend(rates, goal, total, region, enough, steps)
        if np.linalg.norm(wider - goal) > np.linalg.norm(shares - goal) / 2:
            rates.held, rates.pending = kept, []
            break
        shares = wider
    return rates.rated(), shares


def fit_rates(members: DataFrame, targets: list, steps: int = None, most: float = None, tolerance: float = TOLERANCE):
    """``members`` (with tokens and p) with their rate ``r``, and the relative error left; 1 without tokens."""
    rated, shares = fit_rates_and_shares(members, targets, steps, most, tolerance)
    goal = np.array(targets, float)
    return rated, float(np.linalg.norm(shares - goal) / max(np.linalg.norm(goal), 1e-12))


def mix(docs: DataFrame, labels: DataFrame, targets: dict = None, key: str = "doc_id", text: str = "text",
        most: float = None) -> DataFrame:
    """k, row, tokens, p, rate, copies, shares and met of every document; ``labels`` holds k and domain, ``targets`` shares of
    all tokens. ``shares`` and ``met``, the same in all rows, are the shares that the domains get by the rates, and whether
    these are the targets."""
    targets = targets or TARGETS
    domains = sorted(targets)
    members = stored(posteriors(docs, train(docs, labels, key, text), domains, key, text), "mixing")
    goal = [targets[d] for d in domains]
    rated, shares = fit_rates_and_shares(members, goal, most=most)
    missed = bool(np.linalg.norm(shares - goal) > TOLERANCE * np.linalg.norm(goal))
    _LOG.log(logging.WARNING if missed else logging.INFO, "mixing: %s", ", ".join(
        f"{d} {share:.5f} of {wanted:.5f}" for d, share, wanted in zip(domains, shares, goal)))
    chance = F.pmod(F.xxhash64(F.col("k"), F.lit("mixing")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return rated.withColumnRenamed("r", "rate").withColumn(
        "copies", F.floor(F.col("rate") + chance).cast("long")).withColumn(
        "shares", F.array(*(F.lit(float(x)) for x in shares))).withColumn("met", F.lit(not missed))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    row, copies, copy = "_sieveline_row", "_sieveline_copies", "_sieveline_copy"
    counts = stored(mix(docs, labels, targets, key, text).groupBy(F.col("row").alias(row)).agg(
        F.max("copies").alias(copies)).filter(F.col(copies) > 0), "mixing-copies")
    return docs.withColumn(row, F.xxhash64(key, text)).join(counts, row).withColumn(
        copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
