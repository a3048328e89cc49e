"""Supporting-document checks (A19) and the application/document left join.

Documents are aggregated per application first (one shuffle, partial
aggregation map-side), then joined to the applications.  The only collected
set is the set of document types, which is bounded by the closed list of
types; of the names the first and the last are compared, never collected, so
an application with a huge number of documents cannot blow up one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
REQUIRED_DOCS = {
    "Personal Loan": ["salary_slip", "bank_statement", "id_proof"],
    "Education Loan": ["salary_slip", "bank_statement", "id_proof", "admission_letter"],
    "Vehicle Loan": ["salary_slip", "bank_statement", "id_proof"],
    "Business Loan": ["bank_statement", "id_proof", "business_registration"],
    "First-Time Buyer Loan": ["salary_slip", "bank_statement", "id_proof", "address_proof"],
    "Low-Income Loan": ["bank_statement", "id_proof"],
}
DEFAULT_SCHEME = "Personal Loan"
INCOME_TOLERANCE = 0.15


def required_docs(scheme):
    m = F.create_map(*[x for k, v in REQUIRED_DOCS.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in v]))])
    return F.coalesce(m[scheme], F.array(*[F.lit(d) for d in REQUIRED_DOCS[DEFAULT_SCHEME]]))


def document_summary(docs: DataFrame) -> DataFrame:
    """Per application: present types, whether normalised names differ (a present but
    blank name counts as ''), income min / max / mean / count, document count."""
    name = F.when(F.col("declared_name").isNotNull() & (F.col("declared_name") != ""),
                  F.lower(F.regexp_replace(F.col("declared_name"), r"^\s+|\s+$", "")))
    return docs.groupBy("application_id").agg(
        F.sort_array(F.collect_set("doc_type")).alias("present_docs"),
        (F.min(name) != F.max(name)).alias("names_differ"),
        F.min("declared_income").alias("inc_lo"), F.max("declared_income").alias("inc_hi"),
        F.avg("declared_income").alias("inc_mean"), F.count("declared_income").alias("n_incomes"),
        F.count(F.lit(1)).alias("document_count"))


def verify_documents(apps: DataFrame, docs: DataFrame) -> DataFrame:
    """A19 + J8: completeness and consistency for every application (left join:
    an application without documents misses every required one)."""
    s = document_summary(docs).withColumnRenamed("application_id", "_did")
    j = apps.join(s, apps["application_id"] == F.col("_did"), "left").drop("_did")
    scheme = F.coalesce(F.col("loan_scheme"), F.lit(DEFAULT_SCHEME))
    req = required_docs(scheme)
    present = F.coalesce(F.col("present_docs"), F.array().cast("array<string>"))
    missing = F.array_except(req, present)            # keeps the required order
    lo, hi, mean, inc = F.col("inc_lo"), F.col("inc_hi"), F.col("inc_mean"), F.col("amt_income_total")
    has_inc = F.coalesce(F.col("n_incomes"), F.lit(0)) > 0
    name_mm = F.coalesce(F.col("names_differ"), F.lit(False))
    spread = has_inc & (lo > 0) & ((hi - lo) / lo > INCOME_TOLERANCE)
    vs_app = has_inc & inc.isNotNull() & (inc != 0) & (F.abs(mean - inc) / inc > INCOME_TOLERANCE)
    findings = F.array_compact(F.array(F.when(name_mm, F.lit("name_mismatch")),
                                       F.when(spread, F.lit("income_mismatch_across_docs")),
                                       F.when(vs_app, F.lit("income_mismatch_vs_application"))))
    out = j.select("application_id", scheme.alias("scheme"), req.alias("required_docs"),
                   present.alias("present_docs"), missing.alias("missing_information"),
                   findings.alias("consistency_findings"),
                   F.coalesce(F.col("document_count"), F.lit(0)).alias("document_count"))
    return out.withColumns({"complete": F.size("missing_information") == 0,
                            "consistent": F.size("consistency_findings") == 0}) \
        .withColumn("verified", F.col("complete") & F.col("consistent"))
