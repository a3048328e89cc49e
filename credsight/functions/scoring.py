"""Row-level scoring expressions: rule score (F2), cost estimate (F3), policy
metrics (P10), bands and labels (P11-P15, P17), risk-factor ranking (W11).

All of these are Catalyst expressions: they stay inside whole-stage codegen
and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
LOW_BAND_MAX = 0.33
MEDIUM_BAND_MAX = 0.66
DTI_SCALE = 0.5
LTI_SCALE = 6.0
TENURE_SCALE_YEARS = 5.0
DTI_WEIGHT = 0.45
LTI_WEIGHT = 0.35
TENURE_WEIGHT = 0.20
FACTOR_LABELS = {"dti": "Debt-to-income ratio", "lti": "Loan-to-income ratio",
                 "employment_tenure": "Employment tenure"}
THIN_FILE_MONTHS = 24
DAYS_PER_MONTH = 30.44
MODEL_LOW_MAX = 0.36
MODEL_HIGH_MIN = 0.66
COST_CEILING_USD = 0.08
COST_FIXED = 0.002
COST_PER_CLAUSE = 0.0005
COST_MODEL = 0.001
COST_PER_CHECK = 0.004
COST_DOCUMENT = 0.001
COST_PER_1K_TOKENS = 0.03
DECISION_SUPPORT = {
    "LOW": "Eligible for approval if policy checks pass",
    "MEDIUM": "Refer to human underwriter",
    "HIGH": "High risk; refer to human underwriter with decline consideration",
}
DECISION_SUPPORT_DEFAULT = "Refer to human underwriter due to unknown risk profile"


def clamp01(c: Column) -> Column:
    """Clamp to [0, 1]; NULL stays NULL (greatest/least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def tenure_years(days_employed: Column) -> Column:
    """Sentinel (any value >= 0) and NULL mean zero tenure."""
    return F.when(days_employed.isNull() | (days_employed >= 0), F.lit(0.0)) \
        .otherwise(F.abs(days_employed) / F.lit(365.25))


def _scorable(income: Column, credit: Column, annuity: Column, days_employed: Column) -> Column:
    return ((income > 0) & credit.isNotNull() & annuity.isNotNull() & days_employed.isNotNull())


def rule_contributions(income="amt_income_total", credit="amt_credit", annuity="amt_annuity",
                       days_employed="days_employed") -> dict[str, Column]:
    """The three weighted risk drivers, NULL when the profile cannot be scored."""
    inc, cre, ann, de = (F.col(c) if isinstance(c, str) else c
                         for c in (income, credit, annuity, days_employed))
    ok = _scorable(inc, cre, ann, de)
    return {
        "dti": F.when(ok, DTI_WEIGHT * clamp01(ann / inc / DTI_SCALE)),
        "lti": F.when(ok, LTI_WEIGHT * clamp01(cre / inc / LTI_SCALE)),
        "employment_tenure": F.when(ok, TENURE_WEIGHT * clamp01(1 - tenure_years(de) / TENURE_SCALE_YEARS)),
    }


def rule_score(**cols) -> Column:
    """probability of default, half-even rounded to 4 places; NULL if unscorable."""
    c = rule_contributions(**cols)
    return F.bround(clamp01(c["dti"] + c["lti"] + c["employment_tenure"]), 4)


def rule_band(score: Column) -> Column:
    """Band of the rounded rule score."""
    return (F.when(score.isNull(), F.lit(None).cast("string"))
            .when(score < LOW_BAND_MAX, "Low").when(score < MEDIUM_BAND_MAX, "Medium").otherwise("High"))


def with_rule_score(df: DataFrame) -> DataFrame:
    s = rule_score()
    return df.withColumn("risk_score", s).withColumn("risk_band", rule_band(F.col("risk_score")))


def risk_factors(**cols) -> Column:
    """array<struct<factor,label,contribution,direction>> sorted by contribution
    descending, ties in driver order; empty when the profile is unscorable."""
    c = rule_contributions(**cols)
    items = []
    for pos, key in enumerate(["dti", "lti", "employment_tenure"]):
        v = c[key]
        items.append(F.struct(
            (-F.bround(v, 4)).alias("neg"), F.lit(pos).alias("pos"), F.lit(key).alias("factor"),
            F.lit(FACTOR_LABELS[key]).alias("label"), F.bround(v, 4).alias("contribution"),
            F.when(v > 0, "increases_risk").otherwise("decreases_risk").alias("direction")))
    ranked = F.sort_array(F.array(*items))
    out = F.transform(ranked, lambda s: F.struct(s["factor"].alias("factor"), s["label"].alias("label"),
                                                 s["contribution"].alias("contribution"),
                                                 s["direction"].alias("direction")))
    return F.when(c["dti"].isNotNull(), out).otherwise(F.array().cast(
        "array<struct<factor:string,label:string,contribution:double,direction:string>>"))


def explanation_tokens(n_clauses: Column, n_factors: Column) -> Column:
    return F.lit(300) + F.lit(60) * n_clauses + F.lit(30) * n_factors


def cost_estimate(n_clauses: Column, n_checks: Column, ran_model: Column, ran_docs: Column,
                  tokens: Column) -> Column:
    """struct(cost_usd, breached, breakdown struct)."""
    breakdown = F.struct(
        F.lit(COST_FIXED).alias("fixed_overhead"),
        F.round(n_clauses * F.lit(COST_PER_CLAUSE), 6).alias("retrieval"),
        F.when(ran_model, F.lit(COST_MODEL)).otherwise(F.lit(0.0)).alias("model_inference"),
        F.round(n_checks * F.lit(COST_PER_CHECK), 6).alias("regulatory"),
        F.when(ran_docs, F.lit(COST_DOCUMENT)).otherwise(F.lit(0.0)).alias("documents"),
        F.round(tokens / F.lit(1000.0) * F.lit(COST_PER_1K_TOKENS), 6).alias("explanation"),
    )
    b = breakdown
    total = F.round(b["fixed_overhead"] + b["retrieval"] + b["model_inference"] + b["regulatory"]
                    + b["documents"] + b["explanation"], 6)
    return F.struct(total.alias("cost_usd"), (total > COST_CEILING_USD).alias("breached"),
                    breakdown.alias("breakdown"))


def policy_metrics(income="amt_income_total", credit="amt_credit", annuity="amt_annuity",
                   days_employed="days_employed", region="region_rating_client") -> dict[str, Column]:
    """P10: dti, lti, annual_income, employment_months, region_rating, thin_file."""
    inc, cre, ann, de, reg = (F.col(c) for c in (income, credit, annuity, days_employed, region))

    def ratio(n, d):
        return F.when(n.isNotNull() & (d > 0), n.cast("double") / d.cast("double"))

    months = (F.when(de.isNull(), F.lit(None).cast("double"))
              .when(de >= 0, F.lit(0.0)).otherwise(F.abs(de) / F.lit(DAYS_PER_MONTH)))
    return {
        "dti": ratio(ann, inc),
        "lti": ratio(cre, inc),
        "annual_income": inc.cast("double"),
        "employment_months": months,
        "region_rating": reg.cast("double"),
        "thin_file": months < THIN_FILE_MONTHS,
    }


def age_band(days_birth: Column) -> Column:
    """P11."""
    years = F.abs(days_birth) / F.lit(365.25)
    return (F.when(days_birth.isNull(), F.lit(None).cast("string"))
            .when(years < 30, "under_30").when(years < 45, "30_44").when(years < 60, "45_59")
            .otherwise("60_plus"))


def model_band(p: Column, low: float = MODEL_LOW_MAX, high: float = MODEL_HIGH_MIN) -> Column:
    """P12."""
    return F.when(p < low, "LOW").when(p < high, "MEDIUM").otherwise("HIGH")


def credit_score(p: Column, lo: int = 300, hi: int = 850) -> Column:
    """Half-even rounding like numpy."""
    return F.rint(F.lit(float(hi)) - p * F.lit(float(hi - lo))).cast("int")


def threshold_class(p: Column, t) -> Column:
    """P15."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return (p >= t).cast("int")


def decision_support(band: Column) -> Column:
    """P17."""
    expr = F.when(band == "LOW", DECISION_SUPPORT["LOW"])
    expr = expr.when(band == "MEDIUM", DECISION_SUPPORT["MEDIUM"]).when(band == "HIGH", DECISION_SUPPORT["HIGH"])
    return expr.otherwise(DECISION_SUPPORT_DEFAULT)
