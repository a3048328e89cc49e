"""Policy rules and regulatory checks: data-driven rule join (J5), policy
roll-up (A20), deterministic check verdicts (F8) and their roll-up (A21).

Rules are a small control table.  They are grouped into one array per scheme
and broadcast; every application then evaluates its scheme's array with
higher-order functions in a single projection.  No shuffle per application,
no applications x rules row explosion unless the per-rule rows are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import policy_metrics

# Fixed values that must equal the reference's.
ACTION_SEVERITY = {"escalate": 1, "refer": 2, "decline": 3}
CHECKS = ["identity", "employment", "tax", "sanctions"]
CHECK_FAIL_RATE = {"identity": 8, "employment": 8, "tax": 8, "sanctions": 3}
METRICS = ["dti", "lti", "annual_income", "employment_months", "region_rating", "thin_file"]

RULE_SCHEMA = ("scheme string, pos int, clause_id string, metric string, operator string, threshold string, "
               "on_violation string, guard_metric string, guard_operator string, guard_threshold double")

# Our own rule book (authored for the tests): every metric, every operator and
# every action appears, one rule has a guard and one clause has no rule.
RULE_BOOK = [
    ("Personal Loan", 1, "PL-1", "dti", "<=", "0.5", "refer", None, None, None),
    ("Personal Loan", 2, "PL-2", "annual_income", ">=", "15000", "refer", None, None, None),
    ("Personal Loan", 3, "PL-3", "thin_file", "==", "false", "escalate", "lti", ">", 4.0),
    ("Personal Loan", 4, "PL-4", None, None, None, None, None, None, None),
    ("Education Loan", 1, "ED-1", "lti", "<", "8", "decline", None, None, None),
    ("Education Loan", 2, "ED-2", "employment_months", ">", "0", "escalate", None, None, None),
    ("Vehicle Loan", 1, "VL-1", "dti", "<", "0.45", "refer", None, None, None),
    ("Vehicle Loan", 2, "VL-2", "region_rating", "!=", "3", "escalate", None, None, None),
    ("Business Loan", 1, "BL-1", "annual_income", ">", "50000", "decline", None, None, None),
    ("Business Loan", 2, "BL-2", "lti", "<=", "5", "refer", None, None, None),
    ("First-Time Buyer Loan", 1, "FT-1", "lti", "<=", "4.5", "refer", None, None, None),
    ("First-Time Buyer Loan", 2, "FT-2", "thin_file", "!=", "true", "escalate", None, None, None),
    ("Low-Income Loan", 1, "LI-1", "annual_income", "<=", "60000", "decline", None, None, None),
    ("Low-Income Loan", 2, "LI-2", "dti", "<=", "0.4", "refer", None, None, None),
]


def rule_table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or RULE_BOOK, RULE_SCHEMA)


def threshold_value(t: Column) -> Column:
    """Rule thresholds are numbers or booleans: booleans compare as 1/0."""
    lt = F.lower(F.trim(t))
    return F.when(lt == "true", F.lit(1.0)).when(lt == "false", F.lit(0.0)).otherwise(t.try_cast("double"))


def metric_map() -> Column:
    m = policy_metrics()
    vals = {k: (v.cast("double") if k != "thin_file" else v.cast("int").cast("double")) for k, v in m.items()}
    return F.create_map(*[x for k in METRICS for x in (F.lit(k), vals[k])])


def _compare(op: Column, a: Column, b: Column) -> Column:
    return (F.when(op == "<=", a <= b).when(op == ">=", a >= b).when(op == "<", a < b).when(op == ">", a > b)
            .when(op == "==", a == b).when(op == "!=", a != b))


def evaluated_rules(rules: Column, metrics: str) -> Column:
    """The array of rules, each evaluated.  ``metrics`` names a column that holds the metric map, and the two
    values a rule reads are bound first: an expression inside a lambda is worked out again at every mention."""
    read = F.transform(rules, lambda r: F.struct(
        r.alias("rule"), F.element_at(F.col(metrics), r["metric"]).alias("observed"),
        F.element_at(F.col(metrics), F.coalesce(r["guard_metric"], F.lit(""))).alias("guard")))
    return F.transform(read, lambda x: _evaluate(x["rule"], x["observed"], x["guard"]))


def _evaluate(r: Column, observed: Column, gobs: Column) -> Column:
    """One rule against the value it observes and its guard's (trap 14 semantics)."""
    has_guard = r["guard_metric"].isNotNull()
    guard_ok = F.coalesce(_compare(r["guard_operator"], gobs, r["guard_threshold"]), F.lit(False))
    not_applicable = has_guard & (gobs.isNull() | ~guard_ok)
    action = F.coalesce(r["on_violation"], F.lit("refer"))
    satisfied = (F.when(not_applicable, F.lit(True)).when(observed.isNull(), F.lit(False))
                 .otherwise(_compare(r["operator"], observed, threshold_value(r["threshold"]))))
    reason = (F.when(not_applicable, F.lit("guard_not_met")).when(observed.isNull(), F.lit("metric_unavailable"))
              .when(~satisfied, F.lit("threshold_violated")))
    eff_action = F.when(~not_applicable & observed.isNull() & (action == "escalate"), F.lit("refer")) \
        .otherwise(action)
    return F.struct(r["pos"].alias("pos"), r["clause_id"].alias("clause_id"), r["metric"].alias("metric"),
                    r["operator"].alias("operator"), r["threshold"].alias("threshold"), observed.alias("observed"),
                    eff_action.alias("on_violation"), (~not_applicable).alias("applicable"),
                    satisfied.alias("satisfied"), reason.alias("reason"))


def scheme_rules(rules: DataFrame) -> DataFrame:
    """Per scheme: its machine-evaluable rules as an ordered array (clauses without a
    rule are skipped).  A few rows per scheme, broadcast below."""
    r = rules.filter(F.col("metric").isNotNull())
    return r.groupBy("scheme").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in r.columns
                                                                          if c != "scheme"]))).alias("rules"))


def evaluate_rules(apps: DataFrame, rules: DataFrame, scheme_col: str = "loan_scheme") -> DataFrame:
    """Every application with the evaluation of each rule of its scheme
    (array ``evaluated``), via a broadcast equi-join on scheme."""
    sr = F.broadcast(scheme_rules(rules).withColumnRenamed("scheme", "_rs"))
    j = apps.join(sr, apps[scheme_col] == F.col("_rs"), "left").drop("_rs")
    j = j.withColumn("_metrics", metric_map())
    return j.withColumn("evaluated", evaluated_rules(F.coalesce(F.col("rules"), F.array()), "_metrics")).drop("rules", "_metrics")


def rule_rows(evaluated: DataFrame, keep: list[str]) -> DataFrame:
    """J5 as rows: one per (application, evaluated rule)."""
    return evaluated.select(*keep, F.inline("evaluated"))


def policy_rollup(evaluated: DataFrame) -> DataFrame:
    """A20 on the evaluated array: passed / failed lists in rule order, escalation,
    the most severe required action, approve_allowed and adherence."""
    ev, passed, failed, escal = (F.col(c) for c in ("evaluated", "_passed", "_failed", "_escal"))
    parted = evaluated.withColumns({"_passed": F.filter(ev, lambda x: x["satisfied"]),
                                    "_failed": F.filter(ev, lambda x: ~x["satisfied"])}) \
        .withColumn("_escal", F.filter(failed, lambda x: x["on_violation"] == "escalate"))
    sev = F.create_map(*[x for k, v in ACTION_SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    worst = F.array_max(F.transform(failed, lambda x: F.struct(
        F.coalesce(sev[x["on_violation"]], F.lit(0)).alias("s"), (-x["pos"]).alias("p"),
        x["on_violation"].alias("a"))))
    n_eval, n_pass = F.size(ev), F.size(passed)
    return parted.select(
        *evaluated.columns,
        F.transform(passed, lambda x: x["clause_id"]).alias("passed_rules"),
        F.transform(failed, lambda x: F.concat_ws(":", x["clause_id"], x["on_violation"], x["reason"]))
        .alias("failed_rules"),
        (F.size(escal) > 0).alias("escalation_required"),
        F.transform(escal, lambda x: x["clause_id"]).alias("escalation_reasons"),
        worst["a"].alias("required_action"),
        (F.size(failed) == 0).alias("approve_allowed"),
        F.when(n_eval > 0, F.bround(n_pass / n_eval, 4)).otherwise(F.lit(1.0)).alias("policy_adherence"))


# ------------------------------------------------------------ F8 / A21

def digest_mod100(h: Column) -> Column:
    """F8 core: int(h, 16) % 100 for a 64-digit hex digest, exactly, in 64-bit
    arithmetic: Horner over a 4-digit head and four 15-digit (60-bit) chunks,
    using 2**60 % 100 == 76."""
    r = F.conv(F.substring(h, 1, 4), 16, 10).cast("bigint") % 100
    for i in range(4):
        chunk = F.conv(F.substring(h, 5 + 15 * i, 15), 16, 10).cast("bigint")
        r = (r * 76 + chunk % 100) % 100
    return r.cast("int")


def check_digest(app_id: Column, check: Column) -> Column:
    return F.sha2(F.concat_ws("|", app_id.cast("string"), check), 256)


def check_digest_mod100(app_id: Column, check: Column) -> Column:
    """F8: int(sha256(f"{id}|{check}"), 16) % 100."""
    return digest_mod100(check_digest(app_id, check))


def check_verdict(app_id: Column, check: Column) -> Column:
    rate = F.when(check == "sanctions", F.lit(CHECK_FAIL_RATE["sanctions"])).otherwise(F.lit(8))
    return F.when(check_digest_mod100(app_id, check) < rate, "FAIL").otherwise("PASS")


def regulatory_checks(apps: DataFrame, id_col: str = "external_id", force_unresolved: Column | None = None) \
        -> DataFrame:
    """Per application, the four checks in order as an array of struct(check, status).
    The digests are projected once into their own columns (the optimizer keeps
    them instead of recomputing a digest for every chunk that reads it)."""
    down = force_unresolved if force_unresolved is not None else F.lit(False)
    hashed = apps.withColumns({f"_h_{c}": check_digest(F.col(id_col), F.lit(c)) for c in CHECKS})
    checks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("check"),
                                F.when(down, F.lit("escalate_for_review"))
                                .when(digest_mod100(F.col(f"_h_{c}")) < F.lit(CHECK_FAIL_RATE[c]), F.lit("FAIL"))
                                .otherwise(F.lit("PASS")).alias("status"))
                       for i, c in enumerate(CHECKS)])
    return hashed.withColumn("checks", checks).drop(*[f"_h_{c}" for c in CHECKS])


def check_rollup(df: DataFrame) -> DataFrame:
    """FAIL if any check fails, else escalate_for_review if any is
    unresolved, else PASS; reason lists the checks in order."""
    c = F.col("checks")
    failed = F.transform(F.filter(c, lambda x: x["status"] == "FAIL"), lambda x: x["check"])
    unres = F.transform(F.filter(c, lambda x: x["status"] == "escalate_for_review"), lambda x: x["check"])
    df = df.withColumns({"_failing": failed, "_unresolved": unres})
    n_failed, n_open = F.size("_failing"), F.size("_unresolved")
    status = F.when(n_failed > 0, "FAIL").when(n_open > 0, "escalate_for_review").otherwise("PASS")
    reason = (F.when(n_failed > 0, F.concat(F.lit("failed_checks: "), F.array_join("_failing", ", ")))
              .when(n_open > 0, F.concat(F.lit("unresolved_checks: "), F.array_join("_unresolved", ", "))))
    return df.withColumns({"regulatory_status": status, "regulatory_reason": reason}).drop("_failing", "_unresolved")
