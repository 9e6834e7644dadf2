"""Scores, bands and exact rounding as Column expressions."""

from pyspark.sql import Column, functions as F

# Risk model.
RISK_WEIGHT = {"critical": 1.00, "high": 0.75, "medium": 0.45, "low": 0.20, "info": 0.02}
RISK_WEIGHT_OTHER = 0.1
RISK_FACTOR = 0.35
RISK_CAP = 0.98
DEFAULT_CONFIDENCE = 0.80
# Severity weight shown with a finding; it does not enter the score.
SHOWN_WEIGHT = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25, "info": 0.05}
SHOWN_WEIGHT_OTHER = 0.5


def _lookup(col: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for key in reversed(list(table)):
        out = F.when(col == key, F.lit(table[key])).otherwise(out)
    return out


def risk_weight(severity: Column) -> Column:
    return _lookup(severity, RISK_WEIGHT, RISK_WEIGHT_OTHER)


def shown_weight(severity: Column) -> Column:
    return _lookup(severity, SHOWN_WEIGHT, SHOWN_WEIGHT_OTHER)


def exact_round(col: Column, digits: int) -> Column:
    """Round a double (below 500 in size) by its exact binary value, halves to even.

    ``bround`` looks at the shortest decimal text of a double, so 0.3845, which is stored
    slightly above, would count as a tie.  Only values within 1e-6 of a tie take the exact
    route: the value is split into whole 2**-40 units and a remainder, and the distance to
    the tie is then taken in whole units plus a remainder, without rounding on the way.
    """
    scale = 10 ** digits
    size = F.abs(col)
    below = F.floor(size * F.lit(float(scale)))
    near = F.abs(size * F.lit(float(scale)) - below - F.lit(0.5)) < F.lit(1e-6)
    shifted = size * F.lit(float(2 ** 40))
    units = F.floor(shifted)
    distance = (units * F.lit(scale) - (2 * below + 1) * F.lit(2 ** 39)
                + (shifted - units) * F.lit(float(scale)))
    exact = F.when(distance > 0, below + 1).when(distance < 0, below) \
        .otherwise(below + below % 2)
    rounded = F.when(near, exact / F.lit(float(scale))).otherwise(F.bround(size, digits))
    return F.when(col < 0, -rounded).otherwise(rounded)


def risk_of_ranked(contributions: Column) -> Column:
    """Score of an array of ``weight * confidence`` values already in rank order."""
    damped = F.transform(contributions, lambda x, i: x * (F.lit(1.0) / F.sqrt(i + F.lit(1))) * F.lit(RISK_FACTOR))
    total = F.aggregate(damped, F.lit(0.0), lambda acc, x: acc + x)
    return exact_round(F.least(total, F.lit(RISK_CAP)), 4)


def risk_band(score: Column) -> Column:
    # Band limits.
    return (F.when(score.isNull(), "info").when(score >= 0.7, "critical")
            .when(score >= 0.4, "high").when(score >= 0.1, "medium").otherwise("low"))


def risk_badge(score: Column) -> Column:
    """Three colours for a project or file badge; none without a score."""
    return (F.when(score.isNull(), "none").when(score >= 0.7, "red")
            .when(score >= 0.4, "amber").otherwise("green"))


def percent(score: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(score * 100 + F.lit(0.5)).cast("int")
