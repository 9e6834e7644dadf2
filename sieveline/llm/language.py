"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are the runs of 2, 3 and 4 characters of the lower-cased text whose inner characters are letters; other characters
stand for one boundary mark. Each hashes to one of ``BUCKETS`` embeddings, a text is the mean of its subwords' embeddings,
and a linear softmax over it gives the languages. Embeddings and softmax are trained together by stochastic gradient
descent in numpy on a bounded sample: about ``SAMPLE`` labelled texts a language, at most twice that. On a fifth of the
sample, held back, the temperature of the scores is fitted (as if one more text were wrong).

A text is rejected by how usual its subwords are in the language it is given, not by its score, which is never under one by
the number of languages: the mean log frequency of its subwords there, against the mean of the held-back texts of that
language, by the deviation that a text of its length has. The limit is the ``REJECTED`` quantile of the held-back texts,
``DEVIATIONS`` at least. In a language without held-back texts nothing with letters is rejected.

Texts that are null or have no letter get ``und``, score 0 and are rejected. Null labels are not learnt from; without any
labelled row all texts are ``und``. Long texts are read whole, in pieces. Repeated rows get equal results. Only the text
column reaches a prediction.
"""

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sieveline.llm.common import remainder, sampled

BUCKETS, DIMENSIONS, ORDERS = 1 << 15, 16, (2, 3, 4)
SAMPLE, EPOCHS, RATE, SEED = 400, 12, 0.5, 7
#: share of each label spread over all languages in training, which keeps the weights bounded
SMOOTHING = 0.02
#: share of the held-back texts that may be rejected; subwords that vary as one, as those of a word do
REJECTED, TOGETHER = 0.002, 18
#: deviations that are never rejected, for the held-back texts are few
DEVIATIONS = 6.0
PIECE = 1 << 18
UNKNOWN = "und"


def _letters():
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(text, letters):
    """Bucket numbers of all subwords of a text, piece by piece."""
    reach = max(ORDERS) - 1
    for start in range(0, len(text) + 1, PIECE):
        part = text[max(0, start - 1):start + PIECE + reach].lower()
        if start == 0:
            part = " " + part
        codes = np.frombuffer((part + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letters[np.minimum(codes, 0x10FFFF)]
        codes = np.where(known, codes, 0).astype(np.uint32)
        grams, inner = codes, np.ones(len(codes), bool)
        for n in range(2, reach + 2):
            if len(grams) < 2:
                break
            grams = grams[:-1] * np.uint32(0x01000193) + codes[n - 1:]
            inner = np.ones(len(codes) - 1, bool) if n == 2 else inner[:-1] & known[n - 2:-1]
            if n in ORDERS:
                fits = inner & (known[:len(inner)] | known[n - 1:]) if n == 2 else inner
                kept = grams[:PIECE][fits[:PIECE]]
                kept = (kept ^ (kept >> np.uint32(15))) * np.uint32(0x85EBCA6B + n)
                yield kept >> np.uint32(32 - 15)


def features(text, letters):
    """Bucket numbers and their shares in a text, empty without letters, and its number of subwords."""
    counts = np.zeros(BUCKETS)
    for found in subwords(text, letters):
        counts += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / max(1.0, counts.sum())).astype(np.float32), int(counts.sum())


def _softmax(z):
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit(examples, names):
    """Trains on ``(buckets, shares, class)``; returns a score table by bucket, bias and temperature."""
    rng = np.random.default_rng(SEED)
    embedding = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    order = rng.permutation(len(examples))
    held, train = order[:len(examples) // 5], order[len(examples) // 5:]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(train):
            at, share, y = examples[i]
            rows = embedding[at]
            mean = share @ rows
            slope = _softmax(mean @ weights + bias) - SMOOTHING / len(names)
            slope[y] -= 1 - SMOOTHING
            back = weights @ slope
            weights -= rate * np.outer(mean, slope)
            bias -= 0.1 * rate * slope
            # subwords share the gradient by their share; divided by its square sum, the mean moves as one embedding would
            embedding[at] = rows - rate * (share / (share @ share))[:, None] * back
    table = embedding @ weights
    held = held if len(held) else train
    z = np.array([examples[i][1] @ table[examples[i][0]] + bias for i in held]).reshape(-1, len(names))
    y = np.array([examples[i][2] for i in held], int)

    miss = 1 / (len(y) + 2)  # Laplace's share of errors where none was seen, against boundless certainty

    def loss(t):
        logs = np.log(np.maximum(_softmax(z / t), 1e-12))
        return -((1 - miss) * logs[np.arange(len(y)), y] + miss * logs.mean(axis=1)).mean()

    return table.astype(np.float32), bias, float(min(np.geomspace(0.1, 10, 41), key=loss))


def fit_usual(examples, sizes, names):
    """What is usual in each language: log frequencies by bucket and, by language, their mean, the variance of a subword and
    that of a text, and the least deviation of a text that is not rejected."""
    order = np.random.default_rng(SEED).permutation(len(examples))
    held, train = order[:len(examples) // 5], order[len(examples) // 5:]
    counts = np.zeros((BUCKETS, len(names)))
    for i in train:
        at, share, y = examples[i]
        counts[at, y] += share * sizes[i]
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=0)).astype(np.float32)
    centre, each, whole = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    found = []
    for y in range(len(names)):
        mine = [i for i in held if examples[i][2] == y and sizes[i]]
        if not mine:
            each[y] = np.inf
            continue
        n = np.array([sizes[i] for i in mine], float)
        mean = np.array([examples[i][1] @ logs[examples[i][0], y] for i in mine])
        square = np.array([examples[i][1] @ logs[examples[i][0], y] ** 2 for i in mine])
        weight = n / (n + n.mean())
        centre[y] = weight @ mean / weight.sum()
        each[y] = TOGETHER * max(1e-6, n @ square / n.sum() - (n @ mean / n.sum()) ** 2)
        # what the texts vary beyond their lengths; as if one more text were a subword's deviation off, as few tell little
        whole[y] = (weight @ np.maximum(0, (mean - centre[y]) ** 2 - each[y] / n) + each[y] / TOGETHER / len(mine)) / weight.sum()
        found += ((mean - centre[y]) / np.sqrt(whole[y] + each[y] / n)).tolist()
    return logs, centre, each, whole, min(-DEVIATIONS, float(np.quantile(found, REJECTED))) if found else -np.inf


def train(rows: DataFrame, key: str, text: str, label: str):
    """A model from labelled rows: ``(names, (table, bias, temperature), usual)``, or no names without rows."""
    chosen = sampled(rows.select(key, text, label).filter(F.col(text).isNotNull()), key, label, SAMPLE)

    def counted(batches):
        letters = _letters()
        for batch in batches:
            found = [features(t, letters) for t in batch["t"]]
            yield pd.DataFrame({"k": batch["k"], "y": batch["y"], "at": [a.tobytes() for a, _, _ in found],
                                "share": [s.tobytes() for _, s, _ in found], "n": [n for _, _, n in found]})

    got = chosen.select(F.col(key).cast("string").alias("k"), F.col(label).alias("y"), F.col(text).alias("t")) \
        .mapInPandas(counted, "k string, y string, at binary, share binary, n long").collect()
    got = sorted((r for r in got if r["at"]), key=lambda r: (r["y"], r["k"] or "", bytes(r["at"])))
    names = sorted({r["y"] for r in got})
    number = {y: i for i, y in enumerate(names)}
    examples = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32), number[r["y"]]) for r in got]
    sizes = [r["n"] for r in got]
    return names, *((fit(examples, names), fit_usual(examples, sizes, names)) if names else (None, None))


def predictor(model):
    """A pandas UDF: text to ``struct<lang_pred, score, rejected>``."""
    names, fitted, usual = model
    if names:
        both, limit = np.hstack([fitted[0], usual[0]]), usual[4]

    def predict(batches):
        letters = _letters()
        for texts in batches:
            out = []
            for text in texts:
                total, n = 0.0, 0
                if isinstance(text, str) and fitted:
                    for found in subwords(text, letters):
                        total, n = total + both[found].sum(axis=0, dtype=np.float64), n + len(found)
                if not n:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                mean = total / n
                p = _softmax((mean[:len(names)] + fitted[1]) / fitted[2])
                best = int(p.argmax())
                _, centre, each, whole, _ = usual
                off = mean[len(names) + best] - centre[best]
                out.append((names[best], float(p[best]), bool(off < limit * np.sqrt(whole[best] + each[best] / n))))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(predict, "lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a struct ``_language`` of lang_pred, score and rejected."""
    return docs.withColumn("_language", predictor(model)(F.col(text)))


def held_out(key: str = "doc_id"):
    """Rows that are never learnt from."""
    return remainder(key, 4) == 2
