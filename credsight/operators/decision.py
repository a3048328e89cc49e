"""Decision assembly for a whole batch of applications.

One DataFrame pipeline keyed by application id: score (F2 / optional model,
D6), risk factors (W11), policy-clause retrieval (R2 over the policy book),
rule evaluation of the retrieved clauses (J5/A20), document checks (A19),
regulatory checks (F8/A21), scheme pause (J7), cost (F3), kill switch (D7),
evidence completeness (D2), the gate cascade (D3), the evidence struct (D4)
and the two audit events per decision (D5).

Every per-application side is either computed in the projection (no shuffle)
or aggregated to one row per application before joining on the same key, so
the joins reuse one hash partitioning.  The small control inputs (policy
book, rules, pauses, kill switch) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import explain as EX
from ..functions import scoring as S
from ..session import materialize
from . import documents as DOC
from . import policy as PO
from . import retrieval as RT
from ..sources.corpus import POLICY_VERSION

# Fixed values that must equal the reference's.
DEFAULT_SCHEME = "Personal Loan"
MIN_MODEL_CONFIDENCE = 0.60
RECOMMENDATION_RULES = {("PASS", "Low"): "Approve", ("PASS", "Medium"): "Refer", ("PASS", "High"): "Decline",
                        ("FAIL", "Low"): "Decline", ("FAIL", "Medium"): "Decline", ("FAIL", "High"): "Decline"}
POLICY_ACTION_TO_RECOMMENDATION = {"decline": "Decline", "refer": "Refer", "escalate": "Refer"}
EVIDENCE_COMPONENTS = ["risk_score", "risk_factors", "policy_clauses", "document_findings", "regulatory_result",
                       "fairness_result"]
N_CHECKS = len(PO.CHECKS)


def retrieve_clauses(apps: DataFrame, book: DataFrame, top_k: int = RT.TOP_K) -> DataFrame:
    """Per application: the retrieved clauses (rank order) for its scheme, as an
    array of <= k structs, and the failure flag.  The book is one version."""
    parts = RT.tfidf_parts(book, text="index_text", extra=["scheme", "clause_pos"])
    q = apps.select("application_id", F.col("application_id").cast("string").alias("query_id"),
                    F.lit(POLICY_VERSION).alias("corpus_version"),
                    F.coalesce(F.col("loan_scheme"), F.lit(DEFAULT_SCHEME)).alias("scheme"),
                    RT.render_query(F.col("amt_credit"), F.col("amt_income_total"), F.col("amt_annuity"),
                                    F.col("days_employed"), F.col("region_rating_client")).alias("query"))
    lists = RT.retrieve_small_lists(q, parts, keep=["application_id"], top_k=top_k)
    # one row per application, dealt by the key of the joins that follow; rows of one id share their clauses
    per = lists.groupBy("application_id").agg(
        F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"), F.max("failed").alias("failed"))
    version = F.lit(POLICY_VERSION)
    return per.select("application_id", version.alias("corpus_version"),
                      F.transform("hits", lambda h: F.struct(h["clause_id"].alias("clause_id"),
                                                             h["clause_id"].alias("source_id"),
                                                             version.alias("corpus_version"),
                                                             h["score"].alias("score"))).alias("policy_clauses"),
                      (F.col("failed") == 1).alias("retrieval_failed"))


def _retrieved_rules(book: DataFrame) -> DataFrame:
    """Per scheme, a map clause_id -> rule struct (small, broadcast)."""
    r = book.filter(F.col("metric").isNotNull())
    rule = F.struct(F.lit(0).alias("pos"), "clause_id", "metric", "operator", "threshold", "on_violation",
                    "guard_metric", "guard_operator", "guard_threshold")
    return r.groupBy("scheme").agg(F.map_from_entries(F.collect_list(F.struct("clause_id", rule))).alias("rmap"))


def assess_batch(apps: DataFrame, docs: DataFrame, book: DataFrame, pauses: DataFrame | None = None,
                 kill_switch: bool = False, ml_scores: DataFrame | None = None, clauses: str = "retrieved",
                 force_regulatory_fail: bool = False) -> DataFrame:
    """One recommendation with its full evidence per application."""
    scheme = F.coalesce(F.col("loan_scheme"), F.lit(DEFAULT_SCHEME))
    # read by scoring, retrieval and documents: written once; spread, so that the CPU-heavy per-row
    # work uses every core even on an under-split scan
    apps = materialize(RT.spread(apps), "applications")
    base = apps.select("application_id", "external_id", scheme.alias("scheme"), "amt_income_total", "amt_credit",
                       "amt_annuity", "days_employed", "region_rating_client", "loan_scheme")
    # Model score when given, else the rule score.
    rule_p = S.rule_score()
    if ml_scores is not None:
        base = base.join(ml_scores.select("application_id", F.col("ml_score"), F.col("ml_band")), "application_id",
                         "left")
        p = F.coalesce(F.col("ml_score"), rule_p)
        band = F.when(F.col("ml_score").isNotNull(), F.col("ml_band")).otherwise(S.rule_band(rule_p))
        scorer = F.when(F.col("ml_score").isNotNull(), "ml_model").when(rule_p.isNotNull(), "rule_based")
    else:
        p, band = rule_p, S.rule_band(rule_p)
        scorer = F.when(rule_p.isNotNull(), F.lit("rule_based"))
    base = base.withColumns({"risk_score": p, "risk_factors": S.risk_factors(), "scorer": scorer})
    base = base.withColumn("risk_band", band if ml_scores is not None else S.rule_band(F.col("risk_score")))
    base = base.withColumn("model_confidence", F.when(F.col("risk_score").isNotNull(),
                                                      F.greatest(F.col("risk_score"), 1 - F.col("risk_score"))))

    # Retrieval (R2) and rule evaluation of the retrieved clauses.
    ret = retrieve_clauses(apps, book)
    j = base.join(ret, "application_id", "left").withColumn(
        "policy_clauses", F.coalesce("policy_clauses", F.array().cast(ret.schema["policy_clauses"].dataType))) \
        .withColumn("retrieval_failed", F.coalesce("retrieval_failed", F.lit(True)))
    rmap = F.broadcast(_retrieved_rules(book).withColumnRenamed("scheme", "_rs"))
    j = j.join(rmap, F.col("scheme") == F.col("_rs"), "left").drop("_rs")
    if clauses == "retrieved":
        picked = F.transform(F.col("policy_clauses"), lambda c, i: F.element_at(F.col("rmap"), c["clause_id"])
                             .withField("pos", i + 1))
        rules = F.filter(picked, lambda r: r.isNotNull())
    else:
        rules = F.transform(F.map_values(F.col("rmap")), lambda r, i: r.withField("pos", i + 1))
    j = j.withColumn("_metrics", PO.metric_map())
    j = j.withColumn("evaluated", PO.evaluated_rules(F.coalesce(rules, F.array()), "_metrics")).drop("_metrics")
    j = PO.policy_rollup(j)

    # Documents (A19 + J8), regulatory checks (F8 + A21), pause.
    dv = DOC.verify_documents(apps.select("application_id", "loan_scheme", "amt_income_total"), docs)
    dv = dv.select("application_id", F.struct("scheme", "required_docs", "present_docs", "missing_information",
                                              "complete", "consistency_findings", "consistent", "verified",
                                              "document_count").alias("document_findings"))
    j = j.join(dv, "application_id", "left")
    j = PO.check_rollup(PO.regulatory_checks(j, "external_id", F.lit(force_regulatory_fail)))
    if pauses is not None:
        open_ = pauses.filter(F.col("released_at").isNull()).select(F.col("scheme").alias("_ps")).distinct()
        j = j.join(F.broadcast(open_), F.col("scheme") == F.col("_ps"), "left") \
            .withColumn("scheme_paused", F.col("_ps").isNotNull()).drop("_ps")
    else:
        j = j.withColumn("scheme_paused", F.lit(False))

    # Cost (F3) and kill switch.
    n_cl = F.size("policy_clauses")
    cost = S.cost_estimate(n_cl, F.lit(N_CHECKS), F.col("risk_score").isNotNull(), F.lit(True),
                           S.explanation_tokens(n_cl, F.size("risk_factors")))
    j = j.withColumn("cost", cost).withColumn("kill_switch_active", F.lit(bool(kill_switch)))

    # Evidence completeness.
    present = {"risk_score": F.col("risk_score").isNotNull(), "risk_factors": F.size("risk_factors") > 0,
               "policy_clauses": F.size("policy_clauses") > 0, "document_findings": F.lit(True),
               "regulatory_result": F.col("regulatory_status").isNotNull(), "fairness_result": F.lit(True)}
    j = j.withColumn("evidence_present", F.struct(*[v.alias(k) for k, v in present.items()]))
    j = j.withColumn("missing_evidence", F.array_compact(F.array(
        *[F.when(~F.col("evidence_present")[k], F.lit(k)) for k in EVIDENCE_COMPONENTS])))
    j = j.withColumn("evidence_complete", F.size("missing_evidence") == 0)
    return decision_cascade(j)


def _table(status: Column, band: Column) -> Column:
    key = F.concat_ws("+", status, band)
    m = F.create_map(*[x for (s, b), r in RECOMMENDATION_RULES.items() for x in (F.lit(f"{s}+{b}"), F.lit(r))])
    return F.coalesce(m[key], F.lit("Refer"))


def decision_cascade(j: DataFrame, with_evidence: bool = True) -> DataFrame:
    """D3: ordered gates, the (check status, band) table, then the policy and
    document downgrades and the escalation reason; plus D4 and the outputs."""
    st, band = F.col("regulatory_status"), F.col("risk_band")
    conf = F.col("model_confidence")
    gate = (F.when(F.col("kill_switch_active"), F.lit("kill_switch_active"))
            .when(F.col("cost.breached"), F.lit("cost_guardrail"))
            .when(F.col("retrieval_failed"), F.lit("retrieval_failed"))
            .when(~F.col("evidence_complete"), F.lit("incomplete_evidence"))
            .when(F.col("scheme_paused"), F.lit("scheme_paused_fairness"))
            .when(conf.isNotNull() & (conf < MIN_MODEL_CONFIDENCE), F.lit("low_model_confidence"))
            .when(st == "escalate_for_review", F.lit("regulatory_unresolved")))
    ks_reason = (F.when(F.col("kill_switch_active"), F.lit("kill_switch_active"))
                 .when(F.col("cost.breached"), F.lit("cost_guardrail_exceeded"))
                 .when(F.col("retrieval_failed"), F.lit("retrieval_failed"))
                 .when(~F.col("evidence_complete"),
                       F.concat(F.lit("missing_evidence: "), F.array_join("missing_evidence", ",")))
                 .when(F.col("scheme_paused"), F.lit("scheme_paused_fairness")))
    j = j.withColumn("_gate", gate).withColumn("kill_switch_reason", ks_reason)
    # each step is a column: mentioned several times, it is worked out once
    j = j.withColumn("_rec0", _table(st, band))
    rec0, rec1 = F.col("_rec0"), F.col("_rec1")
    act_map = F.create_map(*[x for k, v in POLICY_ACTION_TO_RECOMMENDATION.items() for x in (F.lit(k), F.lit(v))])
    j = j.withColumn("_rec1", F.when(~F.col("approve_allowed") & (rec0 == "Approve"),
                                     F.coalesce(act_map[F.col("required_action")], F.lit("Refer"))).otherwise(rec0))
    doc_down = ~F.coalesce(F.col("document_findings.verified"), F.lit(False)) & (rec1 == "Approve")
    rec2 = F.when(doc_down, F.lit("Refer")).otherwise(rec1)
    reason1 = F.when(doc_down, F.lit("document_findings"))
    reason2 = F.when(F.col("escalation_required"), F.coalesce(reason1, F.lit("policy_escalation"))).otherwise(reason1)
    flag = (rec0 == "Refer") | F.col("escalation_required") | (rec2 == "Refer")
    reason3 = F.when(flag & reason2.isNull() & (rec2 == "Refer"), F.lit("refer_recommendation")).otherwise(reason2)
    gated = F.col("_gate").isNotNull()
    j = j.withColumns({
        "recommendation": F.when(gated, F.lit("Refer")).otherwise(rec2),
        "escalation_flag": F.when(gated, F.lit(True)).otherwise(flag),
        "escalation_reason_code": F.when(gated, F.col("_gate")).otherwise(reason3),
        "rule_applied": F.when(F.col("kill_switch_reason").isNotNull(), F.lit("kill_switch"))
        .otherwise(F.concat(F.coalesce(st, F.lit("None")), F.lit("+"), F.coalesce(band, F.lit("None")))),
    }).drop("_gate", "_rec0", "_rec1")
    return j.withColumn("evidence", evidence_struct()) if with_evidence else j


def evidence_struct() -> Column:
    """The complete evidence object (serialised with ``to_json`` only at a sink)."""
    c = F.col
    top = F.element_at(c("policy_clauses"), 1)
    failed = F.transform(F.filter("evaluated", lambda x: ~x["satisfied"]), lambda x: F.struct(
        x["clause_id"].alias("clause_id"), x["on_violation"].alias("on_violation"), x["reason"].alias("reason")))
    return F.struct(
        c("risk_score"), c("risk_band"), F.bround(c("model_confidence"), 4).alias("model_confidence"), c("scorer"),
        c("risk_factors"), c("scheme").alias("loan_scheme"), c("corpus_version").alias("policy_version"),
        top["clause_id"].alias("retrieved_clause_id"), top["source_id"].alias("retrieved_source_id"),
        top["score"].alias("retrieval_confidence"),
        F.transform("policy_clauses", lambda x: F.struct(x["clause_id"].alias("clause_id"),
                                                         x["source_id"].alias("source_id"),
                                                         x["corpus_version"].alias("corpus_version")))
        .alias("policy_clauses"),
        c("passed_rules").alias("policy_passed_rules"), failed.alias("policy_failed_rules"),
        c("policy_adherence"), c("required_action").alias("policy_required_action"), c("document_findings"),
        c("regulatory_status"), c("regulatory_reason"), c("checks").alias("regulatory_checks"),
        F.struct(c("scheme_paused"), c("scheme")).alias("fairness_result"),
        c("cost.cost_usd").alias("estimated_cost_usd"), c("cost.breakdown").alias("cost_breakdown"),
        c("cost.breached").alias("cost_guardrail_breached"), c("kill_switch_active"), c("evidence_present"),
        c("evidence_complete"), c("missing_evidence"), c("escalation_reason_code"), c("rule_applied"),
        c("kill_switch_reason"))


def audit_events(decisions: DataFrame) -> DataFrame:
    """Two events per decision, the external check call then the decision."""
    from .audit import canonical_json, escape_non_ascii
    ext = canonical_json({"service": F.lit("regulatory"), "status": F.col("regulatory_status"),
                          "checks": F.col("checks")}, ensure_ascii=False, kinds={"checks": decisions.schema["checks"].dataType})
    dec = canonical_json({"recommendation": F.col("recommendation"), "evidence_chain": F.col("evidence")},
                         ensure_ascii=False, kinds={"evidence_chain": decisions.schema["evidence"].dataType})
    # the texts are columns before they are escaped: under a lambda they would be interpreted, not compiled
    texts = decisions.select("application_id", ext.alias("_ext"), dec.alias("_dec"))
    texts = texts.select("application_id", escape_non_ascii(F.col("_ext")).alias("_ext"), escape_non_ascii(F.col("_dec")).alias("_dec"))
    return texts.select("application_id", F.inline(F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("external_call").alias("event_type"), F.col("_ext").alias("payload_json")),
        F.struct(F.lit(2).alias("seq"), F.lit("decision").alias("event_type"), F.col("_dec").alias("payload_json")))))


def explanations(decisions: DataFrame) -> DataFrame:
    """F13 for every decision: claims and narrative."""
    cl = EX.claims(F.col("evidence"), F.col("recommendation"))
    return decisions.select("application_id", "recommendation", "evidence", cl.alias("claims")) \
        .withColumn("narrative", EX.narrative(F.col("claims")))
