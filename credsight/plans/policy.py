"""Queries for policy rules, regulatory checks and documents: P10, J5, A20, F8,
A21, A19, J8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import documents as DOC
from ..operators import policy as PO
from .catalog import register, rounded
from .views import cte

_APPS = cte("v_applications")


def _sql_val(v):
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(_sql_val(x) for x in r) + ")" for r in PO.RULE_BOOK) + \
    ") AS r(scheme, pos, clause_id, metric, operator, threshold, on_violation, guard_metric, guard_operator, " \
    "guard_threshold))\n"

_METRICS_SQL = """m AS (
  SELECT application_id, external_id, loan_scheme,
    CASE WHEN amt_annuity IS NOT NULL AND amt_income_total > 0 THEN amt_annuity / amt_income_total END AS dti,
    CASE WHEN amt_credit IS NOT NULL AND amt_income_total > 0 THEN amt_credit / amt_income_total END AS lti,
    CAST(amt_income_total AS DOUBLE) AS annual_income,
    CASE WHEN days_employed IS NULL THEN NULL WHEN days_employed >= 0 THEN 0.0
         ELSE abs(days_employed) / 30.44 END AS employment_months,
    CAST(region_rating_client AS DOUBLE) AS region_rating
  FROM v_applications),
mm AS (SELECT *, CASE WHEN employment_months IS NULL THEN NULL WHEN employment_months < 24 THEN 1.0 ELSE 0.0 END
         AS thin_file FROM m)
"""


def _obs(metric: str) -> str:
    return (f"CASE {metric} WHEN 'dti' THEN dti WHEN 'lti' THEN lti WHEN 'annual_income' THEN annual_income "
            f"WHEN 'employment_months' THEN employment_months WHEN 'region_rating' THEN region_rating "
            f"WHEN 'thin_file' THEN thin_file END")


def _cmp(op: str, a: str, b: str) -> str:
    return (f"CASE {op} WHEN '<=' THEN {a} <= {b} WHEN '>=' THEN {a} >= {b} WHEN '<' THEN {a} < {b} "
            f"WHEN '>' THEN {a} > {b} WHEN '==' THEN {a} = {b} WHEN '!=' THEN {a} <> {b} END")


_EVAL_SQL = _METRICS_SQL + ", " + RULES_SQL + f""",
e0 AS (
  SELECT mm.application_id, r.pos, r.clause_id, r.metric, r.operator, r.threshold, r.on_violation AS action,
    {_obs('r.metric')} AS observed, {_obs('r.guard_metric')} AS gobs, r.guard_metric, r.guard_operator,
    r.guard_threshold,
    CASE lower(trim(r.threshold)) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0
         ELSE TRY_CAST(r.threshold AS DOUBLE) END AS th
  FROM mm JOIN rules r ON mm.loan_scheme = r.scheme WHERE r.metric IS NOT NULL),
e1 AS (SELECT *, guard_metric IS NOT NULL AND (gobs IS NULL OR NOT coalesce({_cmp('guard_operator', 'gobs',
         'guard_threshold')}, false)) AS na FROM e0),
ev AS (
  SELECT application_id, pos, clause_id, metric, operator, threshold, observed,
    CASE WHEN NOT na AND observed IS NULL AND coalesce(action, 'refer') = 'escalate' THEN 'refer'
         ELSE coalesce(action, 'refer') END AS on_violation,
    NOT na AS applicable,
    CASE WHEN na THEN true WHEN observed IS NULL THEN false ELSE {_cmp('operator', 'observed', 'th')} END AS satisfied,
    CASE WHEN na THEN 'guard_not_met' WHEN observed IS NULL THEN 'metric_unavailable'
         WHEN NOT {_cmp('operator', 'observed', 'th')} THEN 'threshold_violated' END AS reason
  FROM e1)
"""


@register("P10_policy_metrics", _APPS + ", " + _METRICS_SQL + """
SELECT application_id, round(dti, 6) AS dti, round(lti, 6) AS lti, annual_income,
  round(employment_months, 6) AS employment_months, region_rating,
  CASE WHEN thin_file IS NULL THEN NULL ELSE thin_file = 1.0 END AS thin_file FROM mm""")
def p10(t):
    a = t.view("v_applications")
    return rounded(a.select("application_id", *[v.alias(k) for k, v in S.policy_metrics().items()]))


def _evaluated(t):
    apps = t.view("v_applications").select("application_id", "external_id", "loan_scheme", "amt_income_total",
                                           "amt_credit", "amt_annuity", "days_employed", "region_rating_client")
    return PO.evaluate_rules(apps, PO.rule_table(t.spark))


@register("J5_rule_application_join", _APPS + ", " + _EVAL_SQL + """
SELECT application_id, CAST(pos AS BIGINT) AS pos, clause_id, metric, operator, threshold, round(observed, 6) AS observed,
  on_violation, applicable, satisfied, reason FROM ev""")
def j5(t):
    """Each application against each rule of its scheme (rule book broadcast per scheme)."""
    return rounded(PO.rule_rows(_evaluated(t), ["application_id"]))


@register("A20_policy_rollup", _APPS + ", " + _EVAL_SQL + """,
sev AS (SELECT *, CASE on_violation WHEN 'escalate' THEN 1 WHEN 'refer' THEN 2 WHEN 'decline' THEN 3 ELSE 0 END AS s
        FROM ev)
SELECT application_id,
  coalesce(list(clause_id ORDER BY pos) FILTER (WHERE satisfied), []) AS passed_rules,
  coalesce(list(clause_id || ':' || on_violation || ':' || reason ORDER BY pos) FILTER (WHERE NOT satisfied), [])
    AS failed_rules,
  count_if(NOT satisfied AND on_violation = 'escalate') > 0 AS escalation_required,
  coalesce(list(clause_id ORDER BY pos) FILTER (WHERE NOT satisfied AND on_violation = 'escalate'), [])
    AS escalation_reasons,
  arg_max(on_violation, (s, -pos)) FILTER (WHERE NOT satisfied) AS required_action,
  count_if(NOT satisfied) = 0 AS approve_allowed,
  CASE WHEN count(*) > 0 THEN round_even(count_if(satisfied) / count(*), 4) ELSE 1.0 END AS policy_adherence
FROM sev GROUP BY application_id""")
def a20(t):
    out = PO.policy_rollup(_evaluated(t))
    return rounded(out.select("application_id", "passed_rules", "failed_rules", "escalation_required",
                              "escalation_reasons", "required_action", "approve_allowed", "policy_adherence"))


_DIGEST_SQL = """checks AS (SELECT * FROM (VALUES (0, 'identity', 8), (1, 'employment', 8), (2, 'tax', 8),
                                           (3, 'sanctions', 3)) AS c(i, chk, rate)),
dig AS (SELECT a.application_id, a.external_id, c.i, c.chk, c.rate,
          list_reduce(list_transform(string_split(sha256(a.external_id || '|' || c.chk), ''),
                                     lambda x: strpos('0123456789abcdef', x) - 1),
                      lambda acc, x: (acc * 16 + x) % 100, 0) AS digest_mod100
        FROM v_applications a CROSS JOIN checks c)
"""


@register("F8_hash_bucket_verdict", _APPS + ", " + _DIGEST_SQL + """
SELECT application_id, chk AS "check", CAST(digest_mod100 AS BIGINT) AS digest_mod100,
  CASE WHEN digest_mod100 < rate THEN 'FAIL' ELSE 'PASS' END AS status FROM dig""")
def f8(t):
    """F8: deterministic verdict of the four checks for every application."""
    a = t.view("v_applications").select("application_id", "external_id")
    rows = a.select("application_id", "external_id",
                    F.explode(F.array(*[F.lit(c) for c in PO.CHECKS])).alias("check"))
    return rounded(rows.select("application_id", "check",
                               PO.check_digest_mod100(F.col("external_id"), F.col("check")).alias("digest_mod100"),
                               PO.check_verdict(F.col("external_id"), F.col("check")).alias("status")))


@register("A21_check_rollup", _APPS + ", " + _DIGEST_SQL + """,
st AS (SELECT application_id, list(chk ORDER BY i) FILTER (WHERE digest_mod100 < rate) AS failed FROM dig
       GROUP BY application_id)
SELECT application_id, CASE WHEN len(coalesce(failed, [])) > 0 THEN 'FAIL' ELSE 'PASS' END AS regulatory_status,
  CASE WHEN len(coalesce(failed, [])) > 0 THEN 'failed_checks: ' || array_to_string(failed, ', ') END
    AS regulatory_reason
FROM st""")
def a21(t):
    a = t.view("v_applications").select("application_id", "external_id")
    return PO.check_rollup(PO.regulatory_checks(a)).select("application_id", "regulatory_status",
                                                            "regulatory_reason")


_DOC_SQL = """req AS (SELECT * FROM (VALUES
  ('Personal Loan', ['salary_slip', 'bank_statement', 'id_proof']),
  ('Education Loan', ['salary_slip', 'bank_statement', 'id_proof', 'admission_letter']),
  ('Vehicle Loan', ['salary_slip', 'bank_statement', 'id_proof']),
  ('Business Loan', ['bank_statement', 'id_proof', 'business_registration']),
  ('First-Time Buyer Loan', ['salary_slip', 'bank_statement', 'id_proof', 'address_proof']),
  ('Low-Income Loan', ['bank_statement', 'id_proof'])) AS r(scheme, docs)),
ds AS (SELECT application_id, list_sort(list_distinct(list(doc_type))) AS present_docs,
         count(DISTINCT CASE WHEN declared_name IS NOT NULL AND declared_name <> ''
                             THEN lower(trim(declared_name)) END) AS n_names,
         min(declared_income) AS lo, max(declared_income) AS hi, avg(declared_income) AS mean_,
         count(declared_income) AS n_inc, count(*) AS document_count
       FROM v_support_documents GROUP BY application_id),
j AS (SELECT a.application_id, coalesce(a.loan_scheme, 'Personal Loan') AS scheme, a.amt_income_total AS inc,
        coalesce(r.docs, ['salary_slip', 'bank_statement', 'id_proof']) AS required_docs,
        coalesce(ds.present_docs, []) AS present_docs, ds.n_names, ds.lo, ds.hi, ds.mean_, ds.n_inc,
        coalesce(ds.document_count, 0) AS document_count
      FROM v_applications a LEFT JOIN req r ON coalesce(a.loan_scheme, 'Personal Loan') = r.scheme
      LEFT JOIN ds ON a.application_id = ds.application_id),
k AS (SELECT *, list_filter(required_docs, lambda d: NOT list_contains(present_docs, d)) AS missing_information,
        list_filter([CASE WHEN coalesce(n_names, 0) > 1 THEN 'name_mismatch' END,
                     CASE WHEN coalesce(n_inc, 0) > 0 AND lo > 0 AND (hi - lo) / lo > 0.15
                          THEN 'income_mismatch_across_docs' END,
                     CASE WHEN coalesce(n_inc, 0) > 0 AND inc IS NOT NULL AND inc <> 0 AND abs(mean_ - inc) / inc > 0.15
                          THEN 'income_mismatch_vs_application' END], lambda x: x IS NOT NULL) AS consistency_findings
      FROM j)
"""


@register("A19_document_checks", cte("v_applications", "v_support_documents") + ", " + _DOC_SQL + """
SELECT application_id, scheme, required_docs, present_docs, missing_information, consistency_findings,
  document_count, len(missing_information) = 0 AS complete, len(consistency_findings) = 0 AS consistent,
  len(missing_information) = 0 AND len(consistency_findings) = 0 AS verified FROM k""")
def a19(t):
    """A19 + J8: completeness and consistency of every application's documents."""
    apps = t.view("v_applications").select("application_id", "loan_scheme", "amt_income_total")
    return rounded(DOC.verify_documents(apps, t.view("v_support_documents")))


@register("J8_documents_left", cte("v_applications", "v_support_documents") + ", " + _DOC_SQL + """
SELECT scheme, len(missing_information) = 0 AND len(consistency_findings) = 0 AS verified, count(*) AS n_applications,
  CAST(sum(document_count) AS BIGINT) AS n_documents FROM k GROUP BY 1, 2""")
def j8(t):
    """J8 summarised: verified applications and documents per scheme (left join keeps
    applications without documents)."""
    apps = t.view("v_applications").select("application_id", "loan_scheme", "amt_income_total")
    v = DOC.verify_documents(apps, t.view("v_support_documents"))
    return v.groupBy("scheme", "verified").agg(F.count(F.lit(1)).alias("n_applications"),
                                               F.sum("document_count").cast("bigint").alias("n_documents"))
