"""Personal-data patterns: redaction (F4), findings (F5) and the leak gate.

All regex work is JVM-side (``regexp_replace`` / ``regexp_count``), per row,
no Python.  What counts as a word edge (``\\b``) differs between JDKs, so it is
written out: between a letter, digit or underscore of any script and anything else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: ordered (type, pattern, token).
PATTERNS = [
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){13,16}\b", "[REDACTED_CARD]"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "[REDACTED_IBAN]"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("DOB", r"\b(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])\b", "[REDACTED_DOB]"),
    ("DOB", r"\b(?:0[1-9]|[12]\d|3[01])[-/](?:0[1-9]|1[0-2])[-/](?:19|20)\d{2}\b", "[REDACTED_DOB]"),
    ("ACCOUNT_NUMBER", r"\b\d{8,17}\b", "[REDACTED_ACCOUNT]"),
    ("PHONE", r"\b(?:\+?\d{1,3}[ -]?)?(?:\(?\d{3}\)?[ -]?)\d{3}[ -]?\d{4}\b", "[REDACTED_PHONE]"),
]
TYPES = ["SSN", "CREDIT_CARD", "IBAN", "EMAIL", "DOB", "ACCOUNT_NUMBER", "PHONE"]


_IN = r"[\p{L}\p{N}_]"
EDGE = f"(?:(?<={_IN})(?!{_IN})|(?<!{_IN})(?={_IN}))"


# What a match of each pattern starts with (in the order of ``PATTERNS``): looked for before the edge, which costs
# two lookbehinds at every place of the text.
STARTS = [r"\d{3}-", r"\d", r"[A-Z]{2}\d", r"[A-Za-z0-9._%+-]++@", r"[12]", r"[0-3]", r"\d{8}", r"[+(\d]"]


def edged(pattern: str) -> str:
    """``pattern`` with its word edges written out, and its start looked for first."""
    starts = {p: s for (_, p, _), s in zip(PATTERNS, STARTS, strict=True)}
    return (f"(?={starts[pattern]})" if pattern in starts else "") + pattern.replace(r"\b", EDGE)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(edged(pattern)))


def redact(text: Column) -> Column:
    """the eight replacements applied in order, each on the previous result."""
    out = F.coalesce(text, F.lit(""))           # the same steps as in ``redaction_counts``, so that both share them
    for _, pat, tok in PATTERNS:
        out = F.regexp_replace(out, edged(pat), tok)
    return F.when(text.isNotNull(), out)


def redaction_counts(text: Column) -> Column:
    """F4 findings of the sequential redaction, per type (each pattern counted
    on the text as it is when that pattern runs)."""
    cur = F.coalesce(text, F.lit(""))
    counts = {t: F.lit(0) for t in TYPES}
    for name, pat, tok in PATTERNS:
        counts[name] = counts[name] + _count(cur, pat)
        cur = F.regexp_replace(cur, edged(pat), tok)
    return F.struct(*[counts[t].alias(t) for t in TYPES])


def findings(text: Column) -> Column:
    """counts per type, every pattern on the raw text independently."""
    counts = {t: F.lit(0) for t in TYPES}
    for name, pat, _ in PATTERNS:
        counts[name] = counts[name] + _count(text, pat)
    return F.struct(*[counts[t].alias(t) for t in TYPES])


def finding_matches(text: Column) -> Column:
    """F5 detail: array<struct<type, match>> of every match, patterns in order."""
    def matches(name: str, pat: str) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({edged(pat)})"), 1),
                           lambda m: F.struct(F.lit(name).alias("type"), m.alias("match")))

    return F.concat(*[matches(name, pat) for name, pat, _ in PATTERNS])


def total(counts: Column) -> Column:
    return sum((counts[t] for t in TYPES[1:]), counts[TYPES[0]])


def gate(text: Column) -> Column:
    """redact, re-scan the result; blocked when anything still matches
    (the quarantine flag replaces the reference's exception)."""
    red = redact(text)
    residual = findings(red)
    return F.struct(red.alias("redacted"), total(redaction_counts(text)).alias("n_redacted"),
                    total(residual).alias("n_residual"), (total(residual) > 0).alias("blocked"))
