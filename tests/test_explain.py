"""Explanations against an independent computation in plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import explain, scan, signals
from sieveline.rules import PACKS
from sieveline.rules.features import DISPLAY, FEATURE_SIGNAL, SIGNALS, WEIGHTS

SOURCE = """import hashlib
for row in request.rows:
    validate(row)
def login(username, password):
    try:
        cur.execute("select " + username)
    except:
        print("bad login")
    token = hashlib.md5(password)
    x = eval(token)
# todo: for
y = objects.get(1)
z = 1""".split("\n")


def strengths(source, line_no):
    around = source[max(0, line_no - 6):line_no + 4]
    line = source[line_no - 1] if 0 < line_no <= len(source) else ""
    out = {}
    for name, spec in SIGNALS.items():
        text = " ".join(([line] if spec["with_line"] else []) + around).lower()
        out[name] = min(sum(word in text for word in spec["words"]) / spec["need"], 1.0)
    return out


def expected(rule, line_no, source, seeded):
    def generator(salt):
        return random.Random(int(hashlib.sha256(f"{rule.rule_id}-{line_no}-{salt}".encode()).hexdigest()[:8], 16))
    draw, found = generator(0), strengths(source, line_no)
    base = round(0.25 + draw.uniform(-0.05, 0.05), 3) if seeded else 0.25
    rows, total = [], 0.0
    for name in rule.shap_features:
        signal = FEATURE_SIGNAL.get(name)
        strength = 1.0 if signal is None else 1.0 - found[signal[1:]] if signal[0] == "!" else found[signal]
        value = WEIGHTS.get(name, 0.0) * (0.7 + strength * 0.3)
        value = round(value + draw.gauss(0, 0.02), 4) if seeded else round(value, 4)
        rows.append((name, round(strength), value, DISPLAY.get(name) or name.replace("_", " ").capitalize()))
        total += value
    conf = rule.confidence
    prediction = round(min(max(base + total, conf - 0.1), min(conf + 0.05, 0.99)), 3)
    rows.sort(key=lambda r: -abs(r[2]))
    local = generator(99)
    shift = local.uniform(-0.03, 0.03) if seeded else 0.0
    weights = [round(v + local.gauss(0, abs(v) * 0.12 + 0.01), 4) if seeded else v for _, _, v, _ in rows]
    return base, prediction, rows, round(base * 0.9 + shift, 3), weights


def sentence(title, prediction, rows):
    if not rows:
        return f"The model flagged this as {title} based on pattern analysis of the source code."
    up, down = [r for r in rows if r[2] > 0][:3], [r for r in rows if r[2] < 0]
    text = [f"The model flagged this as {title} with {prediction * 100:.0f}% confidence."]
    if up:
        text.append(f"The primary contributing factor is '{up[0][3]}' (SHAP: +{up[0][2]:.3f}), which strongly indicates vulnerable code.")
    if up[1:]:
        text.append("Additional risk signals include: " + ", ".join(f"'{r[3]}'" for r in up[1:]) + ".")
    if down:
        text.append(f"The risk is partially mitigated by '{down[0][3]}' (SHAP: {down[0][2]:.3f}), which reduces the score.")
    return " ".join(text)


@pytest.mark.parametrize("noise", ["none", "seeded"])
def test_against_plain_python(spark, make_files, noise):
    rules = {r.rule_id: r for r in PACKS["python"]}
    sources = [SOURCE, ["x = 1"] * 7 + SOURCE, SOURCE[5:9]]
    files = make_files(*[("python", "\n".join(s)) for s in sources])
    found = scan.scan_files(files, signals=True, structural=False)
    rows = explain.explain(found, noise).collect()
    assert len(rows) > 15
    for row in rows:
        rule = rules[row.rule_id]
        base, prediction, features, intercept, weights = expected(rule, row.line_start, sources[row.file_id], noise == "seeded")
        assert (row.base_value, row.prediction) == (base, prediction)
        assert [tuple(f) for f in row.features] == features
        assert row.lime.intercept == intercept
        assert row.lime.prediction_proba == [round(1 - prediction, 3), round(prediction, 3)]
        assert [f.weight for f in row.lime.features] == weights
        assert row.summary == sentence(row.title, prediction, features)
        assert (row.top_feature_name, row.top_feature_importance) == (features[0][3], abs(features[0][2]))


def test_noise_depends_on_the_line_and_repeats(make_files):
    files = make_files(("python", "eval(a)\neval(a)"))
    found = scan.scan_files(files, signals=True, structural=False)
    a = [r.features for r in explain.attribute(found, "seeded").orderBy("line_start").collect()]
    b = [r.features for r in explain.attribute(found, "seeded").orderBy("line_start").collect()]
    assert a == b and a[0] != a[1]
    with pytest.raises(ValueError):
        explain.attribute(found, "loud")


def test_without_features(make_files):
    found = scan.scan_files(make_files(("python", "eval(a)")), signals=True, structural=False)
    row = explain.explain(found, method="rule").collect()[0]
    assert row.features == [] and row.top_feature_name == "" and row.top_feature_importance == 0.0
    assert "based on pattern analysis" in row.summary


def test_document_round_trip_and_damage(make_files):
    found = explain.localise(explain.attribute(scan.scan_files(make_files(("python", "eval(a)")), signals=True)))
    stored = found.select(explain.explanation_json().alias("doc"))
    document = json.loads(stored.collect()[0].doc)
    assert list(document) == ["method", "base_value", "prediction", "features", "lime"]
    back = stored.select(explain.read_explanation(F.col("doc")).alias("d")).collect()[0].d
    assert back.features[0].name == "eval_call" and back.lime.method == "lime"
    bad = stored.select(explain.read_explanation(F.lit('{"method": ')).alias("d")).collect()[0].d
    assert bad is None or bad.features is None


def test_signals_of_stored_findings(make_files):
    files = make_files(("python", "\n".join(SOURCE)))
    found = scan.scan_files(files, signals=True, structural=False)
    again = signals.signals_for(found.drop("signals"), files)
    key = ["rule_id", "line_start", "signals"]
    assert sorted(map(str, found.select(key).collect())) == sorted(map(str, again.select(key).collect()))


def test_own_tables_and_local_method(make_files):
    rows = scan.scan_files(make_files(("python", "eval(x)")), signals=True)
    names = rows.first().shap_features
    own = explain.attribute(rows, weights={names[0]: 0.5}, wording={names[0]: "Mine"}, detectors={}).first()
    assert [(f.display, f.shap_value) for f in own.features][0] == ("Mine", 0.5)
    assert all(f.shap_value == 0 for f in own.features[1:])
    assert explain.attribute(rows, weights={}, wording={}, detectors={names[0]: "!loop"}).first().features[0].shap_value == 0
    shap, lime = (explain.explain(rows, method=m).first() for m in ("shap", "lime"))
    assert lime.method == "lime" and [f.name for f in lime.features] == [f.name for f in shap.features]
    assert [f.shap_value for f in lime.features] == [f.weight for f in lime.lime.features]
    with pytest.raises(ValueError):
        explain.explain(rows, method="other")
