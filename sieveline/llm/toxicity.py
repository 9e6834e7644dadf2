"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled, a noisy-or joins the two.

A sentence is what lies between full stops, exclamation marks, question marks and line ends. Each of its words adds the
weights of three hashed features (the word, its first four and first five characters); the sum and a bias pass through
the logistic function. A document is toxic with probability ``1 - prod(1 - p)`` over its sentences. The weights are trained
from document labels through the noisy-or by gradient descent with adaptive steps, in numpy, on a bounded sample: about
``SAMPLE`` labelled documents a class, at most twice that. Features whose documents do not lean to either class beyond
chance (G statistic) keep the weight 0, lest single documents are learnt by heart. Sentences of probability one half or
more are reported with their places, so offending passages are found though only documents were labelled.

Null and empty texts and texts without words score 0. Null labels are not learnt from; without labels all scores are the
untrained bias. Documents labelled more than once count once for each label. Long texts are scored whole; repeated rows
get equal scores. Only the text reaches a score.
"""

import re
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sieveline.llm.common import remainder, sampled

BUCKETS = 1 << 18
#: labelled documents sampled of a class, at most twice that
SAMPLE = {0: 3000, 1: 1500}
EPOCHS, RATE, DECAY, SEED = 8, 0.3, 1e-6, 11
#: the bias to start from; the G statistic a feature needs; the strength of the prior in its first weight
BIAS, CHANCE, SHRINK = -5.0, 20.0, 10.0
#: words remembered by a task before it starts afresh
REMEMBERED = 400_000
_PIECES = r"[^\W_]+|[.!?\n]"


def word_features(word):
    """Buckets of a lower-cased word."""
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in (word, "4" + word[:4], "5" + word[:5])]


def sentences(text):
    """The features of every sentence with a word: a flat array and where each sentence starts in it."""
    flat, starts, fresh = [], [], True
    for piece in re.findall(_PIECES, text.lower()):
        if piece in ".!?\n":
            fresh = True
        else:
            if fresh:
                starts.append(len(flat))
                fresh = False
            flat += word_features(piece)
    return np.array(flat, np.int32), np.array(starts, np.int32)


def telling(examples):
    """Features whose documents lean to one class beyond chance, with their smoothed log-odds."""
    toxic = [np.unique(flat) for flat, _, label in examples if label]
    clean = [np.unique(flat) for flat, _, label in examples if not label]
    k1, k0 = (np.bincount(np.concatenate(x), minlength=BUCKETS) if x else np.zeros(BUCKETS) for x in (toxic, clean))
    share = (len(toxic) + 0.5) / (len(examples) + 1)
    k = np.maximum(k1 + k0, 1)

    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-9) / expected)

    g = 2 * (part(k1, k * share) + part(k0, k * (1 - share)))
    q = (k1 + SHRINK * share) / (k + SHRINK)
    at = np.flatnonzero((k1 + k0 > 0) & (g >= CHANCE))
    return at, (np.log(q / (1 - q)) - np.log(share / (1 - share)))[at]


def fit(examples):
    """Weights by bucket and bias from ``(features, starts, label)``."""
    rng = np.random.default_rng(SEED)
    at, start = telling(examples)
    number = np.full(BUCKETS, -1)
    number[at] = np.arange(len(at))
    docs = []
    for flat, starts, label in examples:
        sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
        known = number[flat] >= 0
        docs.append((number[flat][known], sentence[known], len(starts), label))
    weights, seen, bias, bias_seen = start.copy(), np.ones(len(at)), BIAS, 1.0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            feature, sentence, n, label = docs[i]
            z = np.bincount(sentence, weights[feature], n) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = max(np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()), 1e-12)
            # d loss / d z: p for a clean document, -p * none / (1 - none) for a toxic one
            slope = p if not label else -p * none / max(1 - none, 1e-12)
            g = np.bincount(feature, slope[sentence], len(at)) + DECAY * weights
            seen += g * g
            weights -= RATE * g / np.sqrt(seen)
            g = slope.sum()
            bias_seen += g * g
            bias -= RATE * g / np.sqrt(bias_seen)
    table = np.zeros(BUCKETS, np.float32)
    table[at] = weights
    return table, float(bias)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"):
    """Weights and bias from the labelled documents; ``labels`` holds key and label."""
    wanted = labels.select(F.col(key).alias("k"), (F.col(label) > 0).cast("int").alias("y")).filter("k IS NOT NULL")
    # at most twice SAMPLE keys a class
    chosen = F.broadcast(sampled(wanted, "k", "y", SAMPLE))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL").join(chosen, "k")

    def read(batches):
        for batch in batches:
            found = [sentences(t) for t in batch["t"]]
            yield pd.DataFrame({"k": batch["k"], "y": batch["y"], "flat": [f.tobytes() for f, _ in found],
                                "starts": [s.tobytes() for _, s in found]})

    # copies of a key in docs do not widen the sample
    got = rows.limit(4 * sum(SAMPLE.values())).select(F.col("k").cast("string").alias("k"), "y", "t").mapInPandas(
        read, "k string, y int, flat binary, starts binary").collect()
    got = sorted((r for r in got if r["flat"]), key=lambda r: (r["k"], r["y"], bytes(r["flat"])))
    return fit([(np.frombuffer(r["flat"], np.int32), np.frombuffer(r["starts"], np.int32), r["y"]) for r in got])


class _Weights(dict):
    """Word to the sum of its features' weights; marks that end a sentence are NaN."""

    def __init__(self, weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, word):
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = np.nan if word in ".!?\n" else float(self.weights[word_features(word)].sum(dtype=np.float64))
        return value


def _sentence_scores(values, bias):
    """Probability of every sentence with a word."""
    ends = np.isnan(values)
    words = np.flatnonzero(~ends)
    if not len(words):
        return np.zeros(0)
    group = np.cumsum(ends)[words]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    z = np.add.reduceat(values[words], starts) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _places(text, scores):
    """Begin, end and score of the offending sentences, in code points."""
    out, n, begin, end = [], -1, None, None
    for m in re.finditer(r"[^\W_]+|[.!?\n]", text):
        if m[0] in ".!?\n":
            begin = None
        elif begin is None:
            n, begin, end = n + 1, m.start(), m.end()
            if scores[n] >= 0.5:
                out.append([begin, end, float(scores[n])])
        elif scores[n] >= 0.5:
            out[-1][1] = m.end()
    return [tuple(x) for x in out]


def scorer(model):
    """A pandas UDF: text to ``struct<score, predicted, offending>``."""
    weights, bias = model

    def score(batches):
        known = _Weights(weights)
        for texts in batches:
            scores, places = [], []
            for text in texts:
                text = text if isinstance(text, str) else ""
                pieces = re.findall(_PIECES, text.lower())
                p = _sentence_scores(np.fromiter(map(known.__getitem__, pieces), np.float64, len(pieces)), bias)
                scores.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0)
                # lower-casing can move places, and then words; such texts are reported whole
                places.append([] if not (p >= 0.5).any() else _places(text, p) if len(text.lower()) == len(text)
                              else [(0, len(text), float(p.max()))])
            yield pd.DataFrame({"score": scores, "predicted": [int(s >= 0.5) for s in scores],
                                "offending": [[{"begin": b, "end": e, "score": s} for b, e, s in x] for x in places]})

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, "score double, predicted int, offending array<struct<begin: int, end: int, score: double>>")


def assess(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a struct ``_toxicity`` of score, predicted and the offending sentences."""
    return docs.withColumn("_toxicity", scorer(model)(F.col(text)))


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return remainder(key, 5) == 0
