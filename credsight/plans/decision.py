"""Queries for the assembled decision: D1-D7, W11, F3, F13, A27."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import explain as EX
from ..functions import scoring as S
from ..operators import audit as AU
from ..operators import decision as DE
from ..sources.corpus import policy_book
from .catalog import register, rounded
from .views import cte

_APPS_COLS = ["application_id", "external_id", "loan_scheme", "amt_income_total", "amt_credit", "amt_annuity",
              "days_employed", "region_rating_client"]


def decisions(t, kill_switch: bool = False, ml_scores=None, **more):
    apps = t.view("v_applications").select(*_APPS_COLS)
    return DE.assess_batch(apps, t.view("v_support_documents"), policy_book(t.spark), kill_switch=kill_switch,
                           ml_scores=ml_scores, **more)


_D1_COLS = ["application_id", "risk_score", "risk_band", "retrieval_failed", "regulatory_status",
            "evidence_complete", "recommendation", "escalation_flag", "escalation_reason_code", "rule_applied"]


@register("D1_assess_batch")
def d1(t):
    """Recommendation, escalation and evidence summary for every application."""
    return _summary(decisions(t))


def _summary(d, *more):
    return rounded(d.select(*_D1_COLS, F.col("cost.cost_usd").alias("estimated_cost_usd"),
                            F.size("policy_clauses").alias("n_clauses"), F.col("document_findings.verified")
                            .alias("documents_verified"), "approve_allowed", *more))


PAUSED_SCHEME = "Personal Loan"


@register("D1_assess_paused")
def d1_paused(t):
    """D1 while one scheme is paused for fairness (another pause was released)."""
    pauses = t.spark.sql(f"""SELECT * FROM VALUES ('{PAUSED_SCHEME}', CAST(NULL AS TIMESTAMP)),
        ('Home Loan', TIMESTAMP '2024-01-01 00:00:00') AS p(scheme, released_at)""")
    return _summary(decisions(t, pauses=pauses))


@register("D1_assess_forced_failure")
def d1_forced(t):
    """D1 with the regulatory checks forced to fail."""
    return _summary(decisions(t, force_regulatory_fail=True))


@register("D1_assess_all_rules")
def d1_all(t):
    """D1 with every rule of the scheme evaluated instead of the retrieved ones."""
    return _summary(decisions(t, clauses="all"))


@register("D3_decision_cascade")
def d3(t):
    """D2 + D3 summarised: applications per (recommendation, escalation reason, missing evidence)."""
    d = decisions(t)
    return d.groupBy("recommendation", "escalation_flag", "escalation_reason_code",
                     F.array_join("missing_evidence", ",").alias("missing_evidence")) \
        .agg(F.count(F.lit(1)).alias("n_applications"))


@register("D7_kill_switch_gate", cte("v_applications") + """
SELECT 'Refer' AS recommendation, true AS escalation_flag, 'kill_switch_active' AS escalation_reason_code,
  'kill_switch' AS rule_applied, count(*) AS n_applications FROM v_applications""")
def d7(t):
    """With the kill switch on every application is referred."""
    d = decisions(t, kill_switch=True)
    return d.groupBy("recommendation", "escalation_flag", "escalation_reason_code", "rule_applied") \
        .agg(F.count(F.lit(1)).alias("n_applications"))


@register("D4_evidence_struct")
def d4(t):
    """The evidence object of every decision, serialised only here at the sink."""
    d = decisions(t)
    return d.select("application_id", F.to_json("evidence", {"ignoreNullFields": "false"}).alias("evidence_json"))


@register("D5_audit_emit")
def d5(t):
    """Two hash-linked audit events per decision, one chain per application."""
    ev = DE.audit_events(decisions(t))
    ch = AU.build_chains(ev, "application_id", ["seq"], returned=["application_id", "seq", "event_type"])
    return ch.select("application_id", "seq", "event_type", "prev_hash", "entry_hash")


@register("F13_explain_claims")
def f13(t):
    """grounded claims and the deterministic narrative for every decision."""
    ex = DE.explanations(decisions(t))
    return rounded(ex.select("application_id", F.size("claims").alias("n_claims"), "narrative"))


@register("A27_faithfulness")
def a27(t):
    """A27 over every decision's explanation (grounded by construction)."""
    return EX.faithfulness(DE.explanations(decisions(t)))


_W11_SQL = cte("v_applications") + """,
c AS (SELECT application_id,
        CASE WHEN amt_income_total > 0 AND amt_credit IS NOT NULL AND amt_annuity IS NOT NULL
              AND days_employed IS NOT NULL THEN 1 ELSE 0 END AS ok,
        0.45 * greatest(0.0, least(1.0, amt_annuity / amt_income_total / 0.5)) AS dti,
        0.35 * greatest(0.0, least(1.0, amt_credit / amt_income_total / 6.0)) AS lti,
        0.20 * greatest(0.0, least(1.0, 1 - (CASE WHEN days_employed >= 0 THEN 0.0
                                          ELSE abs(days_employed) / 365.25 END) / 5.0)) AS ten
      FROM v_applications),
f AS (SELECT application_id, 0 AS pos, 'dti' AS factor, 'Debt-to-income ratio' AS label, dti AS v FROM c WHERE ok = 1
      UNION ALL SELECT application_id, 1, 'lti', 'Loan-to-income ratio', lti FROM c WHERE ok = 1
      UNION ALL SELECT application_id, 2, 'employment_tenure', 'Employment tenure', ten FROM c WHERE ok = 1)
SELECT application_id, row_number() OVER (PARTITION BY application_id ORDER BY round_even(v, 4) DESC, pos) AS rank,
  factor, label, round_even(v, 4) AS contribution,
  CASE WHEN v > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction
FROM f"""


@register("W11_risk_factor_rank", _W11_SQL)
def w11(t):
    """The rule scorer's drivers per application, by contribution, ties in driver order."""
    a = t.view("v_applications").select("application_id", "amt_income_total", "amt_credit", "amt_annuity",
                                        "days_employed")
    f = a.select("application_id", F.posexplode(S.risk_factors()).alias("rank", "f"))
    return rounded(f.select("application_id", (F.col("rank") + 1).cast("bigint").alias("rank"), "f.factor",
                            "f.label", "f.contribution", "f.direction"))


@register("F3_cost_estimate", cte("v_applications") + """
SELECT application_id, n_clauses, n_factors, round(0.002 + round(n_clauses * 0.0005, 6) + 0.001 + round(4 * 0.004, 6)
  + 0.001 + round((300 + 60 * n_clauses + 30 * n_factors) / 1000.0 * 0.03, 6), 6) AS cost_usd
FROM (SELECT application_id, 3 AS n_clauses,
        CASE WHEN amt_income_total > 0 AND amt_credit IS NOT NULL AND amt_annuity IS NOT NULL
              AND days_employed IS NOT NULL THEN 3 ELSE 0 END AS n_factors FROM v_applications) x""")
def f3(t):
    """F3 for every application with three clauses, four checks and its factor count."""
    a = t.view("v_applications")
    nf = F.size(S.risk_factors())
    c = S.cost_estimate(F.lit(3), F.lit(4), F.lit(True), F.lit(True), S.explanation_tokens(F.lit(3), nf))
    return rounded(a.select("application_id", F.lit(3).alias("n_clauses"), nf.alias("n_factors"),
                            c["cost_usd"].alias("cost_usd")))


# ------------------------------------------------------------ D1 oracle
def _d1_oracle(paused: str | None = None, forced: bool = False, every_rule: bool = False, score: str | None = None) -> str:
    from ..operators.policy import RULE_BOOK
    from ..sources.corpus import CLAUSE_TEXT, POLICY_VERSION
    from .policy import _DIGEST_SQL, _DOC_SQL, _METRICS_SQL, _cmp, _obs
    from .retrieval import _index_sql, _retrieve_sql
    from .scoring import _ORACLE_SCORE

    def q(v):
        return "NULL" if v is None else ("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else repr(v))

    book_rows = []
    for (scheme, pos, cid, metric, op, th, act, gm, gop, gth) in RULE_BOOK:
        title, text, tags = CLAUSE_TEXT[cid]
        itext = f"{title}. {text} {' '.join(tags)}"
        book_rows.append("(" + ", ".join(q(x) for x in [POLICY_VERSION, cid, scheme, pos, itext, metric, op, th, act,
                                                         gm, gop, gth]) + ")")
    book = ("SELECT * FROM (VALUES " + ", ".join(book_rows) + ") AS b(corpus_version, clause_id, scheme, clause_pos, "
            "text, metric, operator, threshold, on_violation, guard_metric, guard_operator, guard_threshold)")
    queries = f"""SELECT CAST(application_id AS VARCHAR) AS query_id, '{POLICY_VERSION}' AS corpus_version,
  coalesce(loan_scheme, 'Personal Loan') AS scheme,
  'loan amount ' || coalesce(CAST(amt_credit AS VARCHAR), 'None') || ' annual income '
  || coalesce(CAST(amt_income_total AS VARCHAR), 'None') || ' annuity ' || coalesce(CAST(amt_annuity AS VARCHAR), 'None')
  || ' employment days ' || coalesce(CAST(days_employed AS VARCHAR), 'None') || ' region rating '
  || coalesce(CAST(region_rating_client AS VARCHAR), 'None') AS query FROM v_applications"""
    every = """(SELECT CAST(application_id AS VARCHAR) AS query_id, coalesce(loan_scheme, 'Personal Loan') AS own FROM v_applications) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY clause_pos) AS rank FROM book) b ON b.scheme = a.own"""
    if every_rule:
        every = every.replace(") a\n", ") r\n").replace("a.own", "r.own")
    return (cte("v_applications", "v_support_documents", "v_predictions") + ", " + (score or _ORACLE_SCORE) + ", " + _index_sql(book)
            + _retrieve_sql(queries) + ", " + _METRICS_SQL + ", " + _DOC_SQL + ", " + _DIGEST_SQL + f""",
book AS ({book}),
ret AS (SELECT CAST(query_id AS BIGINT) AS application_id, count(clause_id) AS n_clauses,
          bool_or(retrieval_failed) AS retrieval_failed FROM res GROUP BY query_id),
ev0 AS (SELECT CAST(r.query_id AS BIGINT) AS application_id, {'b.rank' if every_rule else 'r.rank'} AS rank, b.clause_id, b.metric, b.operator, b.threshold,
          coalesce(b.on_violation, 'refer') AS action, {_obs('b.metric')} AS observed, {_obs('b.guard_metric')} AS gobs,
          b.guard_metric, b.guard_operator, b.guard_threshold,
          CASE lower(trim(b.threshold)) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0
               ELSE TRY_CAST(b.threshold AS DOUBLE) END AS th
        FROM {every if every_rule else "res r JOIN book b ON CAST(r.clause_id AS VARCHAR) = b.clause_id"}
        JOIN mm ON mm.application_id = CAST(r.query_id AS BIGINT) WHERE b.metric IS NOT NULL),
ev1 AS (SELECT *, guard_metric IS NOT NULL AND (gobs IS NULL OR NOT coalesce({_cmp('guard_operator', 'gobs',
          'guard_threshold')}, false)) AS na FROM ev0),
ev2 AS (SELECT application_id, rank, clause_id, CASE WHEN NOT na AND observed IS NULL AND action = 'escalate' THEN 'refer'
          ELSE action END AS eff,
          CASE WHEN na THEN true WHEN observed IS NULL THEN false ELSE {_cmp('operator', 'observed', 'th')} END AS sat
        FROM ev1),
pol AS (SELECT application_id, count_if(NOT sat) = 0 AS approve_allowed,
          count_if(NOT sat AND eff = 'escalate') > 0 AS escalation_required,
          arg_max(eff, (CASE eff WHEN 'escalate' THEN 1 WHEN 'refer' THEN 2 WHEN 'decline' THEN 3 ELSE 0 END, -rank))
            FILTER (WHERE NOT sat) AS required_action
        FROM ev2 GROUP BY application_id),
reg AS (SELECT application_id, CASE WHEN {"true" if forced else "false"} THEN 'escalate_for_review'
          WHEN count_if(digest_mod100 < rate) > 0 THEN 'FAIL' ELSE 'PASS' END AS regulatory_status
        FROM dig GROUP BY application_id),
asm AS (
  SELECT f.application_id, f.risk_score, f.risk_band, coalesce(va.loan_scheme, 'Personal Loan') = {q(paused or "")} AS scheme_paused,
    coalesce(ret.retrieval_failed, true) AS retrieval_failed,
    coalesce(ret.n_clauses, 0) AS n_clauses, reg.regulatory_status, len(k.missing_information) = 0
      AND len(k.consistency_findings) = 0 AS documents_verified,
    coalesce(pol.approve_allowed, true) AS approve_allowed, coalesce(pol.escalation_required, false) AS esc_req,
    pol.required_action, CASE WHEN f.ok = 1 THEN 3 ELSE 0 END AS n_factors,
    CASE WHEN f.risk_score IS NOT NULL THEN greatest(f.risk_score, 1 - f.risk_score) END AS conf
  FROM final f JOIN v_applications va ON va.application_id = f.application_id LEFT JOIN ret ON ret.application_id = f.application_id
  LEFT JOIN reg ON reg.application_id = f.application_id LEFT JOIN k ON k.application_id = f.application_id
  LEFT JOIN pol ON pol.application_id = f.application_id),
cst AS (SELECT *, round(0.002 + round(n_clauses * 0.0005, 6) + CASE WHEN risk_score IS NOT NULL THEN 0.001 ELSE 0.0 END
          + round(4 * 0.004, 6) + 0.001 + round((300 + 60 * n_clauses + 30 * n_factors) / 1000.0 * 0.03, 6), 6)
          AS estimated_cost_usd,
          risk_score IS NOT NULL AND n_factors > 0 AND n_clauses > 0 AND regulatory_status IS NOT NULL
            AS evidence_complete FROM asm),
g AS (SELECT *, CASE WHEN estimated_cost_usd > 0.08 THEN 'cost_guardrail' WHEN retrieval_failed THEN 'retrieval_failed'
          WHEN NOT evidence_complete THEN 'incomplete_evidence' WHEN scheme_paused THEN 'scheme_paused_fairness'
          WHEN conf IS NOT NULL AND conf < 0.60 THEN 'low_model_confidence'
          WHEN regulatory_status = 'escalate_for_review' THEN 'regulatory_unresolved' END AS gate,
        CASE WHEN estimated_cost_usd > 0.08 OR retrieval_failed OR NOT evidence_complete OR scheme_paused THEN true ELSE false END AS ks,
        coalesce(CASE regulatory_status || '+' || risk_band WHEN 'PASS+Low' THEN 'Approve' WHEN 'PASS+Medium' THEN 'Refer'
          WHEN 'PASS+High' THEN 'Decline' WHEN 'FAIL+Low' THEN 'Decline' WHEN 'FAIL+Medium' THEN 'Decline'
          WHEN 'FAIL+High' THEN 'Decline' END, 'Refer') AS rec0 FROM cst),
h AS (SELECT *, CASE WHEN NOT approve_allowed AND rec0 = 'Approve'
          THEN coalesce(CASE required_action WHEN 'decline' THEN 'Decline' WHEN 'refer' THEN 'Refer'
                        WHEN 'escalate' THEN 'Refer' END, 'Refer') ELSE rec0 END AS rec1 FROM g),
i AS (SELECT *, NOT coalesce(documents_verified, false) AND rec1 = 'Approve' AS down FROM h),
o AS (SELECT *, CASE WHEN down THEN 'Refer' ELSE rec1 END AS rec2,
        CASE WHEN esc_req THEN coalesce(CASE WHEN down THEN 'document_findings' END, 'policy_escalation')
             ELSE CASE WHEN down THEN 'document_findings' END END AS reason2 FROM i)
SELECT application_id, risk_score, risk_band, retrieval_failed, regulatory_status, evidence_complete,
  CASE WHEN gate IS NOT NULL THEN 'Refer' ELSE rec2 END AS recommendation,
  CASE WHEN gate IS NOT NULL THEN true ELSE rec0 = 'Refer' OR esc_req OR rec2 = 'Refer' END AS escalation_flag,
  CASE WHEN gate IS NOT NULL THEN gate
       WHEN (rec0 = 'Refer' OR esc_req OR rec2 = 'Refer') AND reason2 IS NULL AND rec2 = 'Refer'
         THEN 'refer_recommendation' ELSE reason2 END AS escalation_reason_code,
  CASE WHEN ks THEN 'kill_switch' ELSE coalesce(regulatory_status, 'None') || '+' || coalesce(risk_band, 'None') END
    AS rule_applied,
  estimated_cost_usd, CAST(n_clauses AS INTEGER) AS n_clauses, documents_verified, approve_allowed
FROM o""")


from .catalog import ORACLES as _OR  # noqa: E402

_OR["D1_assess_batch"] = _d1_oracle()
_OR["D1_assess_paused"] = _d1_oracle(paused=PAUSED_SCHEME)
_OR["D1_assess_forced_failure"] = _d1_oracle(forced=True)
_OR["D1_assess_all_rules"] = _d1_oracle(every_rule=True)
_OR["D3_decision_cascade"] = _d1_oracle().rsplit("SELECT application_id, risk_score", 1)[0] + """,
fin AS (SELECT application_id, risk_score, risk_band, retrieval_failed, regulatory_status, evidence_complete,
  CASE WHEN gate IS NOT NULL THEN 'Refer' ELSE rec2 END AS recommendation,
  CASE WHEN gate IS NOT NULL THEN true ELSE rec0 = 'Refer' OR esc_req OR rec2 = 'Refer' END AS escalation_flag,
  CASE WHEN gate IS NOT NULL THEN gate
       WHEN (rec0 = 'Refer' OR esc_req OR rec2 = 'Refer') AND reason2 IS NULL AND rec2 = 'Refer'
         THEN 'refer_recommendation' ELSE reason2 END AS escalation_reason_code,
  array_to_string(list_filter([CASE WHEN risk_score IS NULL THEN 'risk_score' END,
    CASE WHEN n_factors = 0 THEN 'risk_factors' END, CASE WHEN n_clauses = 0 THEN 'policy_clauses' END,
    CASE WHEN regulatory_status IS NULL THEN 'regulatory_result' END], lambda x: x IS NOT NULL), ',')
    AS missing_evidence
FROM o)
SELECT recommendation, escalation_flag, escalation_reason_code, missing_evidence, count(*) AS n_applications
FROM fin GROUP BY ALL"""
