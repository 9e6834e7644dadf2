"""Explanations: attribution, local weights, summary and top feature.

Everything happens inside the finding's row: its features are an array of a handful of
names, its surroundings are the ``signals`` struct taken during the scan.  Nothing is
joined or shuffled.
"""

import hashlib
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sieveline.functions.scoring import exact_round
from sieveline.functions.text import humanise, quote
from sieveline.operators.lines import computed_once
from sieveline.rules.features import DISPLAY, FEATURE_SIGNAL, WEIGHTS
from sieveline.schema import METHODS

# The explanation model.
BASE_VALUE = 0.25
BASE_SPREAD = 0.05
NOISE = 0.02
LOCAL_SHARE = 0.9
LOCAL_SPREAD = 0.03
LOCAL_NOISE = 0.12
LOCAL_NOISE_FLOOR = 0.01
LOCAL_SALT = 99
FALLBACK_INTERCEPT = 0.3

_DRAWS = T.StructType([T.StructField("u", T.DoubleType()), T.StructField("z", T.ArrayType(T.DoubleType()))])


def draws(rule_id: str, line: int, salt: int, spread: float, count: int):
    """The reproducible noise of a finding: one uniform and ``count`` normal numbers from a
    generator seeded by rule, line and salt."""
    digest = hashlib.sha256(f"{rule_id}-{line}-{salt}".encode()).hexdigest()
    source = random.Random(int(digest[:8], 16))
    return source.uniform(-spread, spread), [source.gauss(0, 1) for _ in range(count)]


def _draw_udf(salt: int, spread: float):
    @F.pandas_udf(_DRAWS)
    def run(rule_id: pd.Series, line: pd.Series, count: pd.Series) -> pd.DataFrame:
        # the same rule fires on the same line number of many files
        known = {key: draws(*key[:2], salt, spread, key[2]) for key in set(zip(rule_id, line, count))}
        rows = [known[key] for key in zip(rule_id, line, count)]
        return pd.DataFrame({"u": [r[0] for r in rows], "z": [r[1] for r in rows]})
    return run


def _map_sql(table: dict) -> str:
    if not table:
        return "CAST(map() AS map<string, string>)"
    pairs = (f"{quote(k)}, {quote(v) if isinstance(v, str) else f'{v}D'}" for k, v in table.items())
    return f"map({', '.join(pairs)})"


def _features_sql(weights: dict, wording: dict, detectors: dict) -> str:
    """SQL text over ``names`` and ``signals``: every feature with its strength in the
    surroundings, its weight and its wording."""
    cases = []
    for feature, signal in detectors.items():
        value = f"1D - signals.{signal[1:]}" if signal.startswith("!") else f"signals.{signal}"
        cases.append(f"WHEN {quote(feature)} THEN {value}")
    return (f"transform(names, (n, i) -> named_struct('name', n, "
            f"'strength', {'CASE n ' + ' '.join(cases) + ' ELSE 1D END' if cases else '1D'}, "
            f"'weight', coalesce(try_element_at({_map_sql(weights)}, n), 0D), "
            f"'display', try_element_at({_map_sql(wording)}, n)))")


def attribute(findings: DataFrame, noise: str = "none", weights: dict = WEIGHTS, wording: dict = DISPLAY,
              detectors: dict = FEATURE_SIGNAL) -> DataFrame:
    """Add ``base_value``, ``prediction`` and ``features``, the latter sorted by size:
    ``array<struct<name, value, shap_value, display>>``.

    ``noise="seeded"`` adds the small reproducible noise drawn per rule and line;
    ``"none"`` leaves the closed form.  ``weights`` and ``wording`` belong to features;
    ``detectors`` names for a feature the signal that gives its strength, ``!`` in front
    turning it round, and features without one have full strength.
    """
    if noise not in ("none", "seeded"):
        raise ValueError(noise)
    rows = findings.withColumn("names", F.coalesce("shap_features", F.array().cast("array<string>")))
    if noise == "seeded":
        rows = rows.withColumn("draw", _draw_udf(0, BASE_SPREAD)("rule_id", "line_start", F.size("names")))
        base = exact_round(F.lit(BASE_VALUE) + F.col("draw.u"), 3)
    else:
        base = F.lit(BASE_VALUE)
    rows = rows.withColumn("base_value", base).withColumn("known", F.expr(_features_sql(weights, wording, detectors)))

    def rated(f, i):
        value = f["weight"] * (F.lit(0.7) + f["strength"] * F.lit(0.3))
        if noise == "seeded":
            value = value + F.get(F.col("draw.z"), i) * F.lit(NOISE)
        return F.struct(f["name"].alias("name"), f["strength"].alias("strength"), value.alias("raw"),
                        f["display"].alias("display"))

    def rounded(f):
        return F.struct(f["name"].alias("name"), F.bround(f["strength"]).cast("int").alias("value"),
                        exact_round(f["raw"], 4).alias("shap_value"),
                        F.coalesce(f["display"], humanise(f["name"])).alias("display"))

    rows = rows.withColumn("given", F.transform(F.transform("known", rated), rounded))
    total = F.aggregate("given", F.lit(0.0), lambda acc, f: acc + f["shap_value"])
    confidence = F.col("confidence_score")
    bounded = F.least(F.greatest(F.col("base_value") + total, confidence - F.lit(0.1)),
                      F.least(confidence + F.lit(0.05), F.lit(0.99)))
    rows = rows.withColumn("prediction", exact_round(bounded, 3))
    rows = rows.withColumn("features", by_size(F.col("given"), "shap_value"))
    return computed_once(rows.drop("names", "draw", "known", "given"), "base_value", "prediction", "features")


def by_size(features: Column, field: str) -> Column:
    """Features by absolute value, largest first; equal ones keep their order."""
    keyed = F.transform(features, lambda f, i: F.struct(
        (-F.abs(f[field])).alias("size"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda x: x["f"])


def localise(explained: DataFrame, noise: str = "none") -> DataFrame:
    """Add the local weights derived from the attribution: ``lime`` with the class
    probabilities, the intercept and ``array<struct<name, weight, display>>``."""
    intercept = F.col("base_value") * F.lit(LOCAL_SHARE)
    rows = explained
    if noise == "seeded":
        rows = rows.withColumn("local", _draw_udf(LOCAL_SALT, LOCAL_SPREAD)(
            "rule_id", "line_start", F.size("features")))
        intercept = intercept + F.col("local.u")

    def weight(f, i):
        value = f["shap_value"]
        if noise == "seeded":
            spread = F.abs(value) * F.lit(LOCAL_NOISE) + F.lit(LOCAL_NOISE_FLOOR)
            value = exact_round(value + F.get(F.col("local.z"), i) * spread, 4)
        return F.struct(f["name"].alias("name"), value.alias("weight"), f["display"].alias("display"))

    return rows.withColumn("lime", F.struct(
        F.lit("lime").alias("method"),
        F.array(exact_round(F.lit(1) - F.col("prediction"), 3),
                exact_round(F.col("prediction"), 3)).alias("prediction_proba"),
        exact_round(intercept, 3).alias("intercept"),
        F.transform("features", weight).alias("features"))).drop("local")


def fallback_local(explained: DataFrame) -> DataFrame:
    """Local weights of old records that lack them: nine tenths of the attribution."""
    p = F.coalesce(F.nullif(F.col("prediction"), F.lit(0.0)), F.lit(0.5))
    return explained.withColumn("lime", F.struct(
        F.lit("lime").alias("method"), F.array(1 - p, p).alias("prediction_proba"),
        F.coalesce(F.nullif(F.col("base_value"), F.lit(0.0)), F.lit(FALLBACK_INTERCEPT)).alias("intercept"),
        F.transform("features", lambda f: F.struct(
            f["name"].alias("name"),
            (F.floor(f["shap_value"] * 0.9 * 10000 + F.lit(0.5)) / F.lit(10000.0)).alias("weight"),
            f["display"].alias("display"))).alias("features")))


def _signed3(value: Column) -> Column:
    return F.format_string("%.3f", exact_round(value, 3))


def summarise(explained: DataFrame) -> DataFrame:
    """Add ``summary``, ``top_feature_name`` and ``top_feature_importance``."""
    features = F.col("features")
    plus = F.slice(F.filter(features, lambda f: f["shap_value"] > 0), 1, 3)
    minus = F.filter(features, lambda f: f["shap_value"] < 0)
    first, other, down = F.get(plus, F.lit(0)), F.slice(plus, 2, 2), F.get(minus, F.lit(0))
    # Sentences of the summary.
    sentences = F.concat_ws(
        " ",
        F.concat(F.lit("The model flagged this as "), F.col("title"), F.lit(" with "),
                 exact_round(F.col("prediction") * 100, 0).cast("int").cast("string"), F.lit("% confidence.")),
        F.when(first.isNotNull(), F.concat(
            F.lit("The primary contributing factor is '"), first["display"], F.lit("' (SHAP: +"),
            _signed3(first["shap_value"]), F.lit("), which strongly indicates vulnerable code."))),
        F.when(F.size(other) > 0, F.concat(
            F.lit("Additional risk signals include: "),
            F.array_join(F.transform(other, lambda f: F.concat(F.lit("'"), f["display"], F.lit("'"))), ", "),
            F.lit("."))),
        F.when(down.isNotNull(), F.concat(
            F.lit("The risk is partially mitigated by '"), down["display"], F.lit("' (SHAP: "),
            _signed3(down["shap_value"]), F.lit("), which reduces the score."))))
    plain = F.concat(F.lit("The model flagged this as "), F.col("title"),
                     F.lit(" based on pattern analysis of the source code."))
    top = F.get(features, F.lit(0))
    return explained.withColumn("summary", F.when(F.size(features) == 0, plain).otherwise(sentences)) \
        .withColumn("top_feature_name", F.coalesce(top["display"], F.lit(""))) \
        .withColumn("top_feature_importance", F.coalesce(F.abs(top["shap_value"]), F.lit(0.0)))


def top_features(explained: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` largest features of every finding, one row each."""
    rows = explained.select("file_id", "rule_id", "line_start",
                            F.posexplode(F.slice("features", 1, k)).alias("position", "f"))
    return rows.select("file_id", "rule_id", "line_start", "position", "f.name", "f.shap_value")


def explanation_json() -> Column:
    """The stored document: the attribution with the local weights under ``lime``."""
    return F.to_json(F.struct(F.lit("shap").alias("method"), "base_value", "prediction", "features", "lime"))


def read_explanation(document: Column) -> Column:
    """A stored document back as a struct; NULL fields where it lacks something."""
    feature = "array<struct<name: string, value: int, shap_value: double, display: string>>"
    return F.from_json(document, (
        f"method string, base_value double, prediction double, features {feature}, "
        "lime struct<method: string, prediction_proba: array<double>, intercept: double, "
        "features: array<struct<name: string, weight: double, display: string>>>"))


def explain(findings: DataFrame, noise: str = "none", method: str = "shap") -> DataFrame:
    """The whole explanation of findings that carry ``signals``.  ``method="rule"`` keeps
    to the rule itself: no features, no local weights; ``"lime"`` tells from the local weights,
    ``"shap"`` from the attribution."""
    if method not in METHODS:
        raise ValueError(method)
    if method == "rule":
        findings = findings.withColumn("shap_features", F.array().cast("array<string>"))
    out = attribute(findings, noise)
    if method != "rule":
        out = localise(out, noise)
    if method == "lime":
        local = F.transform("lime.features", lambda f: F.struct(f["name"].alias("name"), f["weight"].alias("shap_value"),
                                                                f["display"].alias("display")))
        told = summarise(out.withColumn("features", by_size(local, "shap_value")))
        names = [c for c in told.columns if c != "features"]
        out = told.select(*names, F.transform("features", lambda f: F.struct(
            f["name"].alias("name"), F.lit(None).cast("int").alias("value"), f["shap_value"].alias("shap_value"),
            f["display"].alias("display"))).alias("features"))
        return out.withColumn("method", F.lit(method))
    return summarise(out).withColumn("method", F.lit(method))
