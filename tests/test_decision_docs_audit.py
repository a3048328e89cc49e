"""Decision table, documents, audit chains, privacy and fairness hand cases."""

from pyspark.sql import functions as F

from credsight.functions import privacy as PV
from credsight.operators import audit as AU
from credsight.operators import decision as DE
from credsight.operators import documents as DOC
from credsight.operators import fairness as FA


def test_recommendation_table_and_gates(spark):
    rows = [("PASS", "Low", True, True), ("PASS", "Medium", True, True), ("PASS", "High", True, True),
            ("FAIL", "Low", True, True), ("FAIL", "High", True, True)]
    base = spark.createDataFrame(rows, "regulatory_status string, risk_band string, approve_allowed boolean, "
                                       "verified boolean")
    df = base.select(
        "*", F.lit(0.85).alias("model_confidence"), F.lit(False).alias("kill_switch_active"),
        F.struct(F.lit(False).alias("breached")).alias("cost"), F.lit(False).alias("retrieval_failed"),
        F.lit(True).alias("evidence_complete"), F.lit(False).alias("scheme_paused"),
        F.lit(False).alias("escalation_required"), F.lit(None).cast("string").alias("required_action"),
        F.struct(F.col("verified")).alias("document_findings"), F.array().cast("array<string>").alias("missing_evidence"))
    j = DE.decision_cascade(df, with_evidence=False)
    got = [(r.recommendation, r.escalation_flag) for r in j.collect()]
    assert got == [("Approve", False), ("Refer", True), ("Decline", False), ("Decline", False), ("Decline", False)]


def test_gate_order_two_gates(spark):
    base = spark.createDataFrame([("PASS", "Low")], "regulatory_status string, risk_band string")
    df = base.select(
        "*", F.lit(0.55).alias("model_confidence"), F.lit(False).alias("kill_switch_active"),
        F.struct(F.lit(True).alias("breached")).alias("cost"), F.lit(False).alias("retrieval_failed"),
        F.lit(True).alias("evidence_complete"), F.lit(True).alias("scheme_paused"), F.lit(True).alias("approve_allowed"),
        F.lit(False).alias("escalation_required"), F.lit(None).cast("string").alias("required_action"),
        F.struct(F.lit(True).alias("verified")).alias("document_findings"),
        F.array().cast("array<string>").alias("missing_evidence"))
    r = DE.decision_cascade(df, with_evidence=False).first()
    assert r.recommendation == "Refer" and r.escalation_reason_code == "cost_guardrail"   # cost before pause


def test_documents(spark):
    apps = spark.createDataFrame([(1, "Personal Loan", 250000.0), (2, "Personal Loan", 250000.0),
                                  (3, "Personal Loan", 250000.0)],
                                 "application_id long, loan_scheme string, amt_income_total double")
    docs = spark.createDataFrame([
        (1, "salary_slip", "A B", 250000.0),
        (2, "salary_slip", "A B", 250000.0), (2, "bank_statement", "a b ", 250000.0), (2, "id_proof", "A b", 100000.0),
        (3, "salary_slip", "A B", 250000.0), (3, "bank_statement", "A B", 250000.0), (3, "id_proof", "A B", 250000.0)],
        "application_id long, doc_type string, declared_name string, declared_income double")
    r = {x.application_id: x for x in DOC.verify_documents(apps, docs).collect()}
    assert r[1].missing_information == ["bank_statement", "id_proof"] and not r[1].verified
    assert "income_mismatch_across_docs" in r[2].consistency_findings and "name_mismatch" not in r[2].consistency_findings
    assert r[3].verified


def _chain(spark):
    ev = spark.createDataFrame([(1, i, "decision", f'{{"n":{i}}}') for i in range(6)],
                               "cid long, seq long, event_type string, payload_json string")
    return AU.build_chains(ev, "cid", ["seq"])


def test_audit_intact_and_tampered(spark):
    ch = _chain(spark)
    assert AU.verify_chains(ch, "cid", "seq", width=2).first().intact
    bad = ch.withColumn("payload_json", F.when(F.col("seq") == 0, F.lit('{"n":99}')).otherwise(F.col("payload_json")))
    r = AU.verify_chains(bad, "cid", "seq", width=2).first()
    assert not r.intact and r.broken_at == 0
    gone = ch.filter(F.col("seq") != 3)               # a middle row removed
    assert AU.verify_chains(gone, "cid", "seq", width=2).first().broken_at == 4
    last = ch.withColumn("payload_json", F.when(F.col("seq") == 5, F.lit("x")).otherwise(F.col("payload_json")))
    assert AU.verify_chains(last, "cid", "seq", width=2).first().broken_at == 5


def test_pii(spark):
    df = spark.createDataFrame([("Applicant SSN 123-45-6789, DOB 1985-03-12, account 12345678901.",),
                                ("nothing personal here",)], "t string")
    rows = df.select(PV.redact(F.col("t")).alias("r"), PV.findings(F.col("t")).alias("f"),
                     PV.gate(F.col("t")).alias("g")).collect()
    assert "[REDACTED_SSN]" in rows[0].r and "[REDACTED_DOB]" in rows[0].r and "[REDACTED_ACCOUNT]" in rows[0].r
    assert rows[0].f.SSN == 1 and rows[0].f.DOB == 1 and rows[0].f.ACCOUNT_NUMBER == 1
    assert not rows[0].g.blocked and rows[1].r == "nothing personal here"


def test_fairness_monitor_breach(spark):
    d = spark.createDataFrame([(i, i, "Approve" if i < 4 else "Refer") for i in range(8)],
                              "decision_id long, application_id long, recommendation string")
    a = spark.createDataFrame([(i, "Personal Loan", "M" if i < 4 else "F", -12000, "x", "y", 1) for i in range(8)],
                              "application_id long, loan_scheme string, code_gender string, days_birth int, "
                              "name_education_type string, name_family_status string, region_rating_client int")
    m = FA.fairness_monitor(FA.decision_application_join(d, a)).first()
    assert m.max_delta_pp == 100.0 and m.worst_attribute == "code_gender" and m.hard_block and m.newly_paused
    ro = FA.fairness_monitor(FA.decision_application_join(d, a), enforce=False).first()
    assert ro.hard_block and not ro.newly_paused


def test_cramers_v_and_eta(spark):
    rows = [(x, g, float(v)) for x, g, v in zip(["x", "x", "y", "y"] * 25, ["m", "m", "f", "f"] * 25,
                                                [25, 25, 65, 65] * 25)]
    df = spark.createDataFrame(rows, "a string, b string, v double")
    assert FA.cramers_v(df, "a", "b").first().cramers_v > 0.8
    assert FA.correlation_ratio(df, "a", "v").first().corr_ratio > 0.9
