"""The rule record shared by every pack.

A rule is data.  ``pattern`` is a regular expression tried on one line at a time,
ignoring case; ``None`` marks a rule that is evaluated on the whole file by a structural
operator.  ``keywords`` are lower-case words of which at least one occurs in every line
the pattern can match: a cheap byte search on them decides whether the regular expression
runs at all.  An empty tuple means "always run it".
"""

from typing import NamedTuple, Optional


class Rule(NamedTuple):
    rule_id: str
    title: str
    severity: str
    category: str
    pattern: Optional[str]
    keywords: tuple
    confidence: float
    cwe_id: str
    owasp_category: str
    shap_features: tuple
    description: str
    recommendation: str


# OWASP Top 10 (2021) labels.
A01 = "A01:2021 – Broken Access Control"
A02 = "A02:2021 – Cryptographic Failures"
A03 = "A03:2021 – Injection"
A05 = "A05:2021 – Security Misconfiguration"
A07 = "A07:2021 – Identification and Authentication Failures"
A08 = "A08:2021 – Software and Data Integrity Failures"
