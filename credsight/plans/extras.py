"""Operators that also run inside larger queries, registered on their own so
each SURVEY id has its entry: P7, P11, P12, P13, P14, P17, D2, F11, F14, J3, J6, X1, X2, X4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import explain as EX
from ..functions import scoring as S
from ..operators import audit as AU
from ..operators import documents as DOC
from ..operators import features as FT
from ..operators import retrieval as RT
from ..session import fresh_scratch
from ..sources import landing as L
from .catalog import ORACLES, register, rounded
from .decision import _d1_oracle, decisions
from .landing import _BAL_SQL, _bal
from .policy import _DOC_SQL
from .privacy_audit import events
from .retrieval import _parts, _index_sql, _retrieve_sql, _Q_ALL, _CORPUS_ACTIVE, ACTIVE, bench_queries
from .views import cte

_AGE_SQL = """CASE WHEN days_birth IS NULL THEN NULL WHEN abs(days_birth) / 365.25 < 30 THEN 'under_30'
  WHEN abs(days_birth) / 365.25 < 45 THEN '30_44' WHEN abs(days_birth) / 365.25 < 60 THEN '45_59' ELSE '60_plus' END"""


@register("P11_age_band", cte("v_applications") + f"SELECT application_id, {_AGE_SQL} AS age_band FROM v_applications")
def p11(t):
    a = t.view("v_applications")
    return a.select("application_id", S.age_band(F.col("days_birth")).alias("age_band"))


@register("P12_risk_band", cte("v_predictions") + """
SELECT band, count(*) AS n FROM (SELECT CASE WHEN y_prob < 0.36 THEN 'LOW' WHEN y_prob < 0.66 THEN 'MEDIUM'
  ELSE 'HIGH' END AS band FROM v_predictions) b GROUP BY band""")
def p12(t):
    p = t.view("v_predictions")
    return p.groupBy(S.model_band(F.col("y_prob")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register("P13_rule_band", ORACLES["F2_rule_score"].rsplit("SELECT application_id", 1)[0]
          + "SELECT risk_band, count(*) AS n FROM final GROUP BY risk_band")
def p13(t):
    a = S.with_rule_score(t.view("v_applications"))
    return a.groupBy("risk_band").agg(F.count(F.lit(1)).alias("n"))


@register("P14_credit_score", cte("v_predictions") + """
SELECT credit_score, count(*) AS n FROM (SELECT CAST(round_even(850.0 - y_prob * 550.0, 0) AS BIGINT) AS credit_score
  FROM v_predictions) s GROUP BY credit_score""")
def p14(t):
    p = t.view("v_predictions")
    return rounded(p.groupBy(S.credit_score(F.col("y_prob")).alias("credit_score")).agg(F.count(F.lit(1)).alias("n")))


@register("P17_decision_support", cte("v_predictions") + """
SELECT CASE WHEN y_prob < 0.36 THEN 'Eligible for approval if policy checks pass'
  WHEN y_prob < 0.66 THEN 'Refer to human underwriter'
  ELSE 'High risk; refer to human underwriter with decline consideration' END AS decision_support, count(*) AS n
FROM v_predictions GROUP BY 1""")
def p17(t):
    p = t.view("v_predictions")
    return p.groupBy(S.decision_support(S.model_band(F.col("y_prob"))).alias("decision_support")) \
        .agg(F.count(F.lit(1)).alias("n"))


_DOC_TYPES = ["salary_slip", "bank_statement", "id_proof", "address_proof", "admission_letter",
              "business_registration", "other"]


@register("P7_document_flag_sum", cte("v_support_documents") + """
SELECT application_id, CAST(count(DISTINCT doc_type) AS DOUBLE) AS TOTAL_DOCUMENT_FLAGS
FROM v_support_documents GROUP BY application_id""")
def p7(t):
    """P7 over FLAG_DOCUMENT_* columns pivoted from the supporting documents
    (1 when the application holds that document type)."""
    d = t.view("v_support_documents")
    flags = d.groupBy("application_id").pivot("doc_type", _DOC_TYPES).agg(F.lit(1))
    flags = flags.select("application_id", *[F.col(c).alias(f"FLAG_DOCUMENT_{c.upper()}") for c in _DOC_TYPES])
    return flags.select("application_id", *[v.alias(k) for k, v in FT.document_flag_sum(flags).items()])


_D2_SQL = _d1_oracle().rsplit("SELECT application_id, risk_score", 1)[0] + """
SELECT application_id, array_to_string(list_filter([CASE WHEN risk_score IS NULL THEN 'risk_score' END,
  CASE WHEN n_factors = 0 THEN 'risk_factors' END, CASE WHEN n_clauses = 0 THEN 'policy_clauses' END,
  CASE WHEN regulatory_status IS NULL THEN 'regulatory_result' END], lambda x: x IS NOT NULL), ',') AS missing_evidence,
  evidence_complete FROM o"""


@register("D2_evidence_completeness", _D2_SQL)
def d2(t):
    d = decisions(t)
    return d.select("application_id", F.array_join("missing_evidence", ",").alias("missing_evidence"),
                    "evidence_complete")


@register("F11_chain_hash", ORACLES["F12_build_hash_chain"].replace(
    "SELECT conv_id, turn, event_type, prev_hash, entry_hash FROM chain",
    "SELECT conv_id, turn, entry_hash AS link_hash FROM chain"))
def f11(t):
    """F11 recomputed from each stored link: sha256(prev | type | payload)."""
    ch = AU.build_chains(events(t), "conv_id", ["turn"])
    return ch.select("conv_id", "turn", AU.chain_hash(F.col("prev_hash"), F.col("event_type"),
                                                      F.col("payload_json")).alias("link_hash"))


@register("J3_anti_hash", ORACLES["S7_land_incremental"])
def j3(t):
    """The anti semi-join on row hashes, batch = whole table, target = rows c_custkey % 3 <> 0."""
    raw = t.view("v_raw_customer")
    path = fresh_scratch(t.spark, "bronze-anti")
    L.land_full_refresh(raw.filter(F.col("c_custkey").cast("bigint") % 3 != 0), path, "customer.csv")
    return L.new_rows(L.add_metadata(raw, "customer.csv"), t.spark.read.parquet(path)).drop("_ingested_at")


@register("J6_query_clause_join", "WITH " + _index_sql(_CORPUS_ACTIVE) + _retrieve_sql(_Q_ALL) + """
SELECT query_id, count(*) AS n_candidates, round(max(score), 6) AS best_score FROM sc GROUP BY query_id""")
def j6(t):
    """Query x clause candidates through the term join (pairs sharing a term only)."""
    parts = _parts(t)
    q = bench_queries(t, per_scheme=False).withColumn("corpus_version", F.lit(ACTIVE))
    sc = RT.tfidf_scores(RT.query_vectors(q, parts[1]), parts, extra=["scheme", "clause_pos"])
    return rounded(sc.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"),
                                              F.max("score").alias("best_score")))


def _labels_sql() -> str:
    rows = ", ".join(f"({i}, '{b}', '{lbl}')" for i, (b, lbl) in enumerate(EX.FEATURE_LABELS))
    return f"labels AS (SELECT * FROM (VALUES {rows}) AS l(i, base, label))"


@register("F14_humanize_feature", f"""WITH {_labels_sql()},
names AS (SELECT DISTINCT 'cat__NAME_EDUCATION_TYPE_' || c_mktsegment AS feature FROM customer
          UNION ALL SELECT DISTINCT 'num__' || upper(n_name) || '_SHARE' FROM nation),
hit AS (SELECT n.feature, arg_min(CASE WHEN split_part(n.feature, '__', 2) = l.base THEN l.label
                                       ELSE l.label || ': ' || substr(split_part(n.feature, '__', 2), length(l.base) + 2)
                                  END, l.i) AS lab
        FROM names n JOIN labels l ON split_part(n.feature, '__', 2) = l.base
          OR starts_with(split_part(n.feature, '__', 2), l.base || '_') GROUP BY n.feature)
SELECT n.feature, coalesce(h.lab, array_to_string(list_transform(string_split(lower(replace(split_part(n.feature, '__', 2),
  '_', ' ')), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')) AS label
FROM names n LEFT JOIN hit h ON n.feature = h.feature""")
def f14(t):
    """F14 over feature names derived from the tables: one-hot education columns
    (one per market segment) and per-nation numeric names (fallback labels)."""
    seg = t.customer.select(F.concat(F.lit("cat__NAME_EDUCATION_TYPE_"), F.col("c_mktsegment")).alias("feature"))
    nat = t.nation.select(F.concat(F.lit("num__"), F.upper("n_name"), F.lit("_SHARE")).alias("feature"))
    names = seg.distinct().unionByName(nat.distinct())
    return names.select("feature", EX.humanize(F.col("feature")).alias("label"))


_DECLARED = ["declared_name", "doc_type", "declared_income"]


@register("X1_drop_duplicates", cte("v_support_documents") + f"SELECT DISTINCT {', '.join(_DECLARED)} FROM v_support_documents")
def x1(t):
    """Exact copies of a declaration are dropped, nulls being equal to one another."""
    return FT.clean_dedupe_sentinel(t.view("v_support_documents").select(*_DECLARED))


@register("X2_union_rejects", cte("v_raw_customer") + ", " + _BAL_SQL + """
SELECT c_custkey, c_acctbal, NULL::VARCHAR AS c_name, NULL::VARCHAR AS c_nationkey, NULL::VARCHAR AS c_mktsegment,
  'cast_failed: c_acctbal' AS _reject_reason FROM bal WHERE TRY_CAST(c_acctbal AS DOUBLE) IS NULL
UNION ALL SELECT c_custkey, NULL, c_name, c_nationkey, c_mktsegment, 'cast_failed: c_mktsegment' FROM v_raw_customer
WHERE c_mktsegment IS NOT NULL""")
def x2(t):
    """The rejects of two loads with different columns in one table."""
    _, balances = L.cast_or_reject(_bal(t), {"c_custkey": "BIGINT", "c_acctbal": "DOUBLE PRECISION"})
    _, segments = L.cast_or_reject(t.view("v_raw_customer"), {"c_mktsegment": "BIGINT"})
    return L.union_rejects([balances, segments])


@register("X4_missing_documents", cte("v_applications", "v_support_documents") + ", " + _DOC_SQL + """
SELECT application_id, unnest(missing_information) AS doc_type FROM k""")
def x4(t):
    """Required minus present documents, one row per missing one."""
    apps = t.view("v_applications").select("application_id", "loan_scheme", "amt_income_total")
    v = DOC.verify_documents(apps, t.view("v_support_documents"))
    return v.select("application_id", F.explode("missing_information").alias("doc_type"))
