"""Queries for personal-data handling (F4-F6) and audit chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import privacy as PV
from ..operators import audit as AU
from ..operators.retrieval import spread
from .catalog import register
from .views import cte


# The oracle's word edges know ASCII only.  Letters and digits of other scripts are put between underscores,
# which are word characters and in no pattern but the e-mail one (that one is matched on the text as it is).
_WIDE = r"([^\P{L}\x00-\x7F]|[^\P{N}\x00-\x7F])"


def _marked(text: str, name: str) -> str:
    return text if name == "EMAIL" else f"regexp_replace({text}, '{_WIDE}', '_\\1_', 'g')"


def _unmarked(text: str, name: str) -> str:
    return text if name == "EMAIL" else f"regexp_replace({text}, '_{_WIDE}_', '\\1', 'g')"


def _count_sql(text: str, name: str, pat: str) -> str:
    return f"len(regexp_extract_all({_marked(text, name)}, '{pat}'))"


def _findings_sql(text: str) -> str:
    parts = {t: [] for t in PV.TYPES}
    for name, pat, _ in PV.PATTERNS:
        parts[name].append(_count_sql(text, name, pat))
    return ", ".join(f"CAST({' + '.join(v)} AS INTEGER) AS {k}" for k, v in parts.items())


@register("F5_pii_findings", f"""SELECT doc_id, {_findings_sql("coalesce(text, '')")} FROM documents""")
def f5(t):
    """per document, matches of every pattern on the raw text (independent)."""
    d = spread(t.documents.select("doc_id", "text"))
    return d.select("doc_id", PV.findings(F.col("text")).alias("f")).select("doc_id", "f.*")


def _matches_sql() -> str:
    parts = [f"SELECT doc_id, {i} AS pattern_no, '{name}' AS type, unnest(regexp_extract_all({_marked("coalesce(text, '')", name)}, '({pat})', 1)) AS match FROM documents"
             for i, (name, pat, _) in enumerate(PV.PATTERNS)]
    return "SELECT doc_id, type, match, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") x GROUP BY ALL"


@register("F5_pii_matches", _matches_sql())
def f5_matches(t):
    """the matches themselves, counted per document, type and matched text."""
    d = spread(t.documents.select("doc_id", "text"))
    m = d.select("doc_id", F.explode(PV.finding_matches(F.col("text"))).alias("m"))
    return m.groupBy("doc_id", F.col("m.type").alias("type"), F.col("m.match").alias("match")).agg(F.count(F.lit(1)).alias("n"))


def _redact_steps_sql(text: str) -> tuple[str, dict[str, list[str]]]:
    cur = f"coalesce({text}, '')"
    counts = {t: [] for t in PV.TYPES}
    for name, pat, tok in PV.PATTERNS:
        counts[name].append(_count_sql(cur, name, pat))
        cur = _unmarked(f"regexp_replace({_marked(cur, name)}, '{pat}', '{tok}', 'g')", name)
    return cur, counts


def _f4_sql() -> str:
    red, counts = _redact_steps_sql("text")
    cols = ", ".join(f"CAST({' + '.join(v)} AS INTEGER) AS {k}" for k, v in counts.items())
    return f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {red} END AS redacted, {cols} FROM documents"


@register("F4_pii_redact", _f4_sql())
def f4(t):
    """per document the redacted text, and what the ordered redaction replaced, by type."""
    d = spread(t.documents.select("doc_id", "text"))
    return d.select("doc_id", PV.redact(F.col("text")).alias("redacted"),
                    PV.redaction_counts(F.col("text")).alias("c")).select("doc_id", "redacted", "c.*")


def _f6_sql() -> str:
    red, counts = _redact_steps_sql("text")
    n_red = " + ".join(x for v in counts.values() for x in v)
    resid = " + ".join(_count_sql("red", name, pat) for name, pat, _ in PV.PATTERNS)
    return f"""SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN red END AS redacted, CAST(n_redacted AS INTEGER) AS n_redacted, CAST({resid} AS INTEGER) AS n_residual,
  ({resid}) > 0 AS blocked FROM (SELECT conv_id, turn, text, {red} AS red, {n_red} AS n_redacted FROM conversations) x"""


@register("F6_pii_gate", _f6_sql())
def f6(t):
    """every conversation turn redacted and re-linted; blocked when PII survives."""
    c = spread(t.conversations.select("conv_id", "turn", "text"))
    g = c.select("conv_id", "turn", PV.gate(F.col("text")).alias("g"))
    return g.select("conv_id", "turn", F.col("g.redacted").alias("redacted"), F.col("g.n_redacted").alias("n_redacted"),
                    F.col("g.n_residual").alias("n_residual"), F.col("g.blocked").alias("blocked"))


# ------------------------------------------------------------ audit

def _esc_sql(s: str) -> str:
    """ensure_ascii escaping of a JSON text in the oracle."""
    return (f"CASE WHEN regexp_matches({s}, '[^\\x00-\\x7F]') THEN array_to_string(list_transform(string_split({s}, ''), "
            f"lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) <= 65535 THEN printf('\\u%04x', unicode(c)) "
            f"ELSE printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), "
            f"56320 + ((unicode(c) - 65536) & 1023)) END), '') ELSE {s} END")


_SRC_SQL = cte("v_audit_source") + f""",
src AS (SELECT conv_id, turn, event_type, {_esc_sql("to_json({'text': payload, 'turn': turn})")} AS payload_json,
          row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM v_audit_source)
"""

_CHAIN_SQL = """chain AS (
  SELECT conv_id, turn, rn, event_type, payload_json, repeat('0', 64) AS prev_hash,
    sha256(repeat('0', 64) || '|' || coalesce(event_type, 'None') || '|' || payload_json) AS entry_hash
  FROM src WHERE rn = 1
  UNION ALL
  SELECT s.conv_id, s.turn, s.rn, s.event_type, s.payload_json, c.entry_hash,
    sha256(c.entry_hash || '|' || coalesce(s.event_type, 'None') || '|' || s.payload_json)
  FROM chain c JOIN src s ON s.conv_id = c.conv_id AND s.rn = c.rn + 1)
"""


def events(t):
    a = t.view("v_audit_source")
    return a.select("conv_id", "turn", "event_type",
                    AU.canonical_json({"text": F.col("payload"), "turn": F.col("turn")}).alias("payload_json"))


@register("F10_canonical_json", _SRC_SQL + "SELECT conv_id, turn, payload_json FROM src")
def f10(t):
    """canonical payload JSON of every audit event (sorted keys, compact, ASCII)."""
    return events(t).select("conv_id", "turn", "payload_json")


@register("F12_build_hash_chain", _SRC_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _CHAIN_SQL + """
SELECT conv_id, turn, event_type, prev_hash, entry_hash FROM chain""")
def f12(t):
    """F11 + F12: one hash chain per conversation in turn order."""
    ch = AU.build_chains(events(t), "conv_id", ["turn"])
    return ch.select("conv_id", "turn", "event_type", "prev_hash", "entry_hash")


_VERIFY_SQL = """,
tam AS (SELECT *, CASE WHEN regexp_matches(payload_json, '"text":"[^"]*[0-9]')
                       THEN payload_json || ' ' ELSE payload_json END AS pj2 FROM chain),
chk AS (SELECT conv_id, turn,
          prev_hash = coalesce(lag(entry_hash) OVER (PARTITION BY conv_id ORDER BY turn), repeat('0', 64))
          AND entry_hash = sha256(prev_hash || '|' || coalesce(event_type, 'None') || '|' || {pj}) AS ok
        FROM tam)
SELECT conv_id, min(CASE WHEN NOT ok THEN turn END) IS NULL AS intact, min(CASE WHEN NOT ok THEN turn END) AS broken_at,
  count(*) AS event_count FROM chk GROUP BY conv_id"""


@register("W10_audit_verify", _SRC_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _CHAIN_SQL
          + _VERIFY_SQL.format(pj="payload_json"))
def w10(t):
    """W10 over the untouched chains: every conversation intact."""
    ch = AU.build_chains(events(t), "conv_id", ["turn"])
    return AU.verify_chains(ch, "conv_id", "turn")


@register("W10_audit_verify_tampered", _SRC_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _CHAIN_SQL
          + _VERIFY_SQL.format(pj="pj2"))
def w10t(t):
    """W10 after altering every stored payload whose text holds a digit: each
    affected chain reports its first altered turn."""
    ch = AU.build_chains(events(t), "conv_id", ["turn"])
    tam = ch.withColumn("payload_json", F.when(F.col("payload_json").rlike("\"text\":\"[^\"]*[0-9]"),
                                               F.concat(F.col("payload_json"), F.lit(" ")))
                        .otherwise(F.col("payload_json")))
    return AU.verify_chains(tam, "conv_id", "turn")


@register("W12_audit_reconstruct", _SRC_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _CHAIN_SQL + """
SELECT conv_id, turn, event_type, entry_hash, length(payload ->> 'text') AS text_chars,
  CAST(payload ->> 'turn' AS BIGINT) AS payload_turn
FROM (SELECT *, CAST(payload_json AS JSON) AS payload FROM chain) c""")
def w12(t):
    """W12 for every conversation: events in order with the payload parsed back."""
    ch = AU.build_chains(events(t), "conv_id", ["turn"])
    parsed = ch.withColumn("payload", F.from_json("payload_json", "text string, turn bigint"))
    return parsed.select("conv_id", "turn", "event_type", "entry_hash",
                         F.length("payload.text").cast("bigint").alias("text_chars"),
                         F.col("payload.turn").alias("payload_turn"))
