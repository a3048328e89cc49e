"""Hand values from the reference's unit tests (FIXTURES.md 1.1-1.4, 1.13)."""

import pytest
from pyspark.sql import functions as F

from credsight.functions import scoring as S
from credsight.operators import ops as OP
from credsight.operators import policy as PO

PROFILE = "amt_income_total double, amt_credit double, amt_annuity double, days_employed int, region_rating_client int"


def score(spark, rows):
    df = spark.createDataFrame(rows, PROFILE)
    return [(r.risk_score, r.risk_band) for r in S.with_rule_score(df).select("risk_score", "risk_band").collect()]


def test_rule_score_goldens(spark):
    got = score(spark, [(250000.0, 300000.0, 15000.0, -3650, 1), (80000.0, 700000.0, 45000.0, -90, 1)])
    assert got == [(0.124, "Low"), (0.9901, "High")]


def test_rule_score_extremes_in_unit_interval_and_sentinel(spark):
    got = score(spark, [(1.0, 1e7, 5e6, -1, 1), (1e6, 0.0, 0.0, -20000, 1), (50000.0, 100000.0, 10000.0, 365243, 1),
                        (140000.0, 350000.0, 18000.0, 365243, 1), (140000.0, 350000.0, 18000.0, 0, 1)])
    assert all(0.0 <= p <= 1.0 for p, _ in got)
    assert got[3] == got[4]                      # sentinel and 0 both mean no tenure


def test_unscorable_profiles_are_null(spark):
    got = score(spark, [(0.0, 1.0, 1.0, -1, 1), (None, 1.0, 1.0, -1, 1), (1.0, None, 1.0, -1, 1)])
    assert got == [(None, None)] * 3


def test_cost_golden(spark):
    c = S.cost_estimate(F.lit(3), F.lit(4), F.lit(True), F.lit(True), S.explanation_tokens(F.lit(3), F.lit(3)))
    r = spark.range(1).select(c.alias("c")).first().c
    assert r.cost_usd == pytest.approx(0.0386) and not r.breached


def test_cost_guardrail(spark):
    def cost(tokens):
        c = S.cost_estimate(F.lit(3), F.lit(4), F.lit(True), F.lit(True), F.lit(tokens))
        return spark.range(1).select(c.alias("c")).first().c

    assert not cost(500).breached and cost(5000).breached


def _policy(spark, rows):
    apps = spark.createDataFrame([("Personal Loan",) + r for r in rows], "loan_scheme string, " + PROFILE)
    ev = PO.evaluate_rules(apps, PO.rule_table(spark))
    return PO.policy_rollup(ev).collect()


def test_policy_metrics(spark):
    df = spark.createDataFrame([(100000.0, 300000.0, 20000.0, -3650, 1), (100000.0, 100000.0, 10000.0, 365243, 1)],
                               PROFILE)
    m = df.select(*[v.alias(k) for k, v in S.policy_metrics().items()]).collect()
    assert m[0].dti == pytest.approx(0.2) and m[0].lti == pytest.approx(3.0) and m[0].thin_file is False
    assert m[1].employment_months == 0.0 and m[1].thin_file is True


def test_policy_rules(spark):
    r = _policy(spark, [(120000.0, 200000.0, 20000.0, -3000, 1),     # all pass
                        (100000.0, 200000.0, 60000.0, -3000, 1),     # dti .6 > .5 fails
                        (None, 100000.0, 10000.0, None, 1)])         # income unknown
    assert r[0].approve_allowed and r[0].policy_adherence == 1.0 and r[0].failed_rules == []
    assert not r[1].approve_allowed and r[1].failed_rules[0].startswith("PL-1:refer:threshold_violated")
    assert not r[2].approve_allowed and r[2].required_action == "refer"


def test_policy_guard_and_escalation(spark):
    # thin file (short tenure) with high lti: the guarded rule applies and escalates
    r = _policy(spark, [(50000.0, 400000.0, 10000.0, -300, 1), (120000.0, 200000.0, 20000.0, -300, 1)])
    assert r[0].escalation_required and r[0].escalation_reasons == ["PL-3"]
    assert not r[1].escalation_required               # guard (lti > 4) not met -> not applicable


def test_normalizer(spark):
    cols = ["SK_ID_CURR", "NAME_CONTRACT_TYPE", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_EMPLOYED",
            "DAYS_BIRTH", "CODE_GENDER"]
    rows = [("100001", "Cash loans", "250000", "300000", "15000", "-3650", "-14200", "F"),
            ("100002", "Cash loans", "250000", "300000", "", "-3650", "-14200", "F"),
            ("100003", "Cash loans", "", "300000", "", "365243", "-14200", "F"),
            ("", "Cash loans", "250000", "300000", "15000", "-3650", "-14200", "F")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    out = OP.normalize_application(df).collect()
    assert out[0].status == "COMPLETE" and out[0].days_employed == -3650 and out[0].loan_scheme == "Personal Loan"
    assert out[1].status == "INCOMPLETE" and out[1].amt_annuity is None and out[1].missing_fields == "AMT_ANNUITY"
    assert out[2].missing_fields == "AMT_INCOME_TOTAL,AMT_ANNUITY" and out[2].days_employed == 365243
    assert out[3].external_id is None and out[3].status == "INCOMPLETE"


def test_protected_attributes_do_not_change_the_score(spark):
    rows = [(120000.0, 400000.0, 20000.0, -900, 1, "M", -10000), (120000.0, 400000.0, 20000.0, -900, 1, "F", -25000)]
    df = spark.createDataFrame(rows, PROFILE + ", code_gender string, days_birth int")
    got = [r.risk_score for r in S.with_rule_score(df).collect()]
    assert got[0] == got[1]
