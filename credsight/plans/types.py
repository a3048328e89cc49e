"""Result types that an oracle text states through another engine's arithmetic (HUGEINT sums,
32-bit literals, decimals): the columns to cast so that both sides agree in type."""

from __future__ import annotations

RESULT_TYPES: dict[str, dict[str, str]] = {
    "A10_threshold_sweep": {"k": "BIGINT"},
    "A11_business_loss_sweep": {"k": "BIGINT"},
    "A14_segment_delta": {"attribute_pos": "BIGINT"},
    "A1_bureau_agg": {"BUREAU_ACTIVE_COUNT": "BIGINT"},
    "A23_override_rate": {"override_count": "BIGINT"},
    "A29_missing_profile": {"n_incomplete": "BIGINT"},
    "A2_prev_app_agg": {"PREV_APP_REFUSED_COUNT": "BIGINT"},
    "A3_installment_agg": {"INST_LATE_COUNT": "BIGINT"},
    "A6_confusion_metrics": {"tp": "BIGINT", "fp": "BIGINT", "fn": "BIGINT", "tn": "BIGINT"},
    "D1_assess_all_rules": {"n_clauses": "BIGINT"},
    "D1_assess_batch": {"n_clauses": "BIGINT"},
    "D1_assess_forced_failure": {"n_clauses": "BIGINT"},
    "D1_assess_paused": {"n_clauses": "BIGINT"},
    "D4_evidence_fields": {"n_clauses": "BIGINT"},
    "F10_canonical_json": {"payload_json": "VARCHAR"},
    "F3_cost_estimate": {"n_clauses": "BIGINT", "n_factors": "BIGINT"},
    "J1_aux_full_outer": {
        "BUREAU_ACTIVE_COUNT": "BIGINT", "PREV_APP_REFUSED_COUNT": "BIGINT", "INST_LATE_COUNT": "BIGINT",
    },
    "J4_decision_application_join": {"region_rating_client": "BIGINT"},
    "P15_threshold_class": {"l_linenumber": "BIGINT"},
    "P1_normalize_application": {"days_employed": "BIGINT", "days_birth": "BIGINT", "region_rating_client": "BIGINT"},
    "P2_clean_dedupe_sentinel": {"REGION_RATING_CLIENT": "BIGINT"},
    "P3_financial_ratios": {"CREDIT_GOODS_RATIO": "DOUBLE", "CHILDREN_RATIO": "DOUBLE", "INCOME_PER_PERSON": "DOUBLE"},
    "R2_tfidf_retrieve": {"rank": "INTEGER"},
    "R3_versioned_retrieve": {"rank": "INTEGER"},
    "R4_vector_topk": {"query_id": "BIGINT"},
    "S11_results_csv_sink": {"k": "BIGINT"},
    "S8_load_stats": {"rows_loaded": "BIGINT", "rows_rejected": "BIGINT"},
    "S9_parquet_feature_cache": {
        "BUREAU_ACTIVE_COUNT": "BIGINT", "PREV_APP_REFUSED_COUNT": "BIGINT", "INST_LATE_COUNT": "BIGINT",
    },
    "T2_stream_kpis": {"overrides": "BIGINT", "accepts": "BIGINT"},
    "T2_stream_kpis_late": {"overrides": "BIGINT", "accepts": "BIGINT"},
    "T3_stream_fairness": {"attribute_pos": "BIGINT"},
    "W4_threshold_policies": {"k": "BIGINT"},
    "W5_loss_policies": {"k": "BIGINT"},
}


def typed(name: str, sql: str) -> str:
    """``sql`` with the columns of ``name`` cast to their result types."""
    casts = RESULT_TYPES.get(name)
    if not casts:
        return sql
    said = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in casts.items())
    return f"SELECT * REPLACE ({said}) FROM ({sql}) AS result"
