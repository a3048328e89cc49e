"""Policy corpora: JSON corpus scan in both shapes (S10) and our own authored
policy book used by the decision assembly.

S10 reads a folder of corpus files (one JSON document per file, so each file
is one task; corpora are small control data).  Older files carry the scheme
and the version at the top level, newer ones per clause; both normalise to
one clause table keyed by (corpus_version, clause_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policy import RULE_BOOK

CLAUSE_TEXT = {
    # clause_id: (title, text, tags) -- our own wording
    "PL-1": ("Personal loan affordability", "The annuity of a personal loan divided by the applicant's annual "
             "income must not exceed one half; otherwise refer the case.", ["annuity", "annual income", "dti"]),
    "PL-2": ("Personal loan income floor", "A personal loan needs a verified annual income of at least 15000.",
             ["annual income", "minimum income"]),
    "PL-3": ("Personal loan short employment", "Short employment history escalates a personal loan when the loan "
             "amount is large against annual income.", ["employment", "thin file", "loan amount"]),
    "PL-4": ("Personal loan fair treatment", "Gender and age never influence a personal loan recommendation.",
             ["fairness"]),
    "ED-1": ("Education loan leverage", "For an education loan the loan amount stays below eight times the "
             "household annual income.", ["loan amount", "annual income", "lti"]),
    "ED-2": ("Education loan employment", "An education loan applicant without any employment days on record is "
             "escalated for review.", ["employment days", "escalation"]),
    "VL-1": ("Vehicle loan affordability", "Vehicle loan annuity stays under forty five percent of annual income.",
             ["annuity", "annual income"]),
    "VL-2": ("Vehicle loan region", "Vehicle loans in the weakest region rating are escalated.",
             ["region rating"]),
    "BL-1": ("Business loan turnover", "Business loans need annual income above 50000; lower income is declined.",
             ["annual income"]),
    "BL-2": ("Business loan leverage", "The business loan amount may reach five times annual income.",
             ["loan amount", "annual income"]),
    "FT-1": ("First home leverage", "First-time buyers may borrow a loan amount up to four and a half times "
             "annual income.", ["loan amount", "annual income"]),
    "FT-2": ("First home employment", "First-time buyers with a short employment record are escalated.",
             ["employment"]),
    "LI-1": ("Low-income eligibility", "The low-income scheme serves annual income up to 60000 only.",
             ["annual income"]),
    "LI-2": ("Low-income affordability", "Low-income loan annuity stays within forty percent of annual income.",
             ["annuity", "annual income"]),
}

POLICY_VERSION = "policy-v1"


def policy_book(spark: SparkSession, version: str = POLICY_VERSION) -> DataFrame:
    """The authored policy clauses with their rules, one row per clause."""
    rows = []
    for (scheme, pos, cid, metric, op, th, act, gm, gop, gth) in RULE_BOOK:
        title, text, tags = CLAUSE_TEXT[cid]
        rows.append((version, cid, scheme, pos, title, text, tags, metric, op, th, act, gm, gop, gth))
    schema = ("corpus_version string, clause_id string, scheme string, clause_pos int, title string, text string, "
              "tags array<string>, metric string, operator string, threshold string, on_violation string, "
              "guard_metric string, guard_operator string, guard_threshold double")
    df = spark.createDataFrame(rows, schema)
    # Indexed text = "title. text tags", as the reference indexes clauses.
    return df.withColumn("index_text", F.concat(F.col("title"), F.lit(". "), F.col("text"), F.lit(" "),
                                                F.array_join("tags", " ")))


def json_corpus_scan(spark: SparkSession, path: str) -> DataFrame:
    """Every clause of every corpus file under ``path``.  Scheme and version
    come from the clause when present, else from the file's top level."""
    raw = spark.read.option("multiLine", True).json(path)
    top_scheme = F.col("scheme") if "scheme" in raw.columns else F.lit(None).cast("string")
    cv = F.col("corpus_version") if "corpus_version" in raw.columns else F.lit(None).cast("string")
    v = F.col("version") if "version" in raw.columns else F.lit(None).cast("string")
    eff = F.col("effective_date") if "effective_date" in raw.columns else F.lit(None).cast("string")
    c = raw.select(F.coalesce(cv, v).alias("corpus_version"), eff.alias("effective_date"),
                   top_scheme.alias("_top_scheme"), F.input_file_name().alias("source_file"),
                   F.posexplode("clauses").alias("clause_pos", "c"))
    fields = c.schema["c"].dataType.fieldNames()

    def f(name, typ="string"):
        return F.col(f"c.{name}") if name in fields else F.lit(None).cast(typ)

    rule = f("rule", "struct<metric:string>")
    out = c.select("corpus_version", "effective_date", "source_file", "clause_pos",
                   f("clause_id").alias("clause_id"),
                   F.coalesce(f("scheme"), F.col("_top_scheme")).alias("scheme"),
                   f("title").alias("title"), f("text").alias("text"),
                   F.coalesce(f("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
                   rule.alias("rule"))
    return out
