"""Domain views over the driver tables.

Each view is one SQL text that runs unchanged in Spark and in DuckDB (the
oracle): base tables are written as ``{name}`` placeholders, which Spark binds
to DataFrames (``spark.sql(text, name=df)``) and the oracle binds to its
registered views.  Catalyst sees through the views, so column pruning and
filter pushdown still reach the parquet scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def _day(c: str) -> str:
    # Portable day number: date subtraction differs between engines.
    return f"(year({c})*360 + month({c})*30 + day({c}) - 720720)"


VIEW_SQL: dict[str, str] = {
    "v_applications": f"""
select o_orderkey as application_id, cast(o_orderkey as string) as external_id, o_custkey as applicant_id,
 case o_orderkey % 6 when 0 then 'Personal Loan' when 1 then 'Education Loan' when 2 then 'Vehicle Loan'
   when 3 then 'Business Loan' when 4 then 'First-Time Buyer Loan' else 'Low-Income Loan' end as loan_scheme,
 c_acctbal*20 as amt_income_total, o_totalprice as amt_credit,
 case when o_orderkey % 29 = 0 then null else o_totalprice*0.08 end as amt_annuity,
 case when o_orderkey % 17 = 0 then 365243 when o_orderkey % 31 = 0 then null
   else -((o_orderkey*7) % 6000) end as days_employed,
 -(7000 + (o_custkey*37) % 18000) as days_birth, case when o_custkey % 3 = 0 then 'M' else 'F' end as code_gender,
 c_mktsegment as name_education_type, o_orderpriority as name_family_status,
 1 + c_nationkey % 3 as region_rating_client,
 concat('occ', cast(o_custkey % 7 as string)) as occupation_type, o_orderdate as created_at
from {{orders}} join {{customer}} on o_custkey = c_custkey""",
    "v_bureau": f"""
select o_custkey as SK_ID_CURR, case l_linestatus when 'O' then 'Active' else 'Closed' end as CREDIT_ACTIVE,
 l_extendedprice as AMT_CREDIT_SUM,
 case when l_returnflag = 'N' then null else l_extendedprice*l_discount end as AMT_CREDIT_SUM_DEBT,
 l_quantity as CREDIT_DAY_OVERDUE, {_day('l_shipdate')} as DAYS_CREDIT
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "v_previous_application": f"""
select o_custkey as SK_ID_CURR,
 case o_orderstatus when 'F' then 'Approved' when 'O' then 'Refused' else 'Canceled' end as NAME_CONTRACT_STATUS,
 o_totalprice as AMT_APPLICATION, o_totalprice*0.9 as AMT_CREDIT, {_day('o_orderdate')} as DAYS_DECISION
from {{orders}}""",
    "v_installments": f"""
select o_custkey as SK_ID_CURR, {_day('o_orderdate')} + 60 as DAYS_INSTALMENT,
 case when l_linenumber = 7 then null else {_day('l_shipdate')} end as DAYS_ENTRY_PAYMENT,
 case when l_quantity = 1 then 0.0 else l_extendedprice end as AMT_INSTALMENT,
 l_extendedprice*(1-l_discount) as AMT_PAYMENT
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
    "v_pos_cash": """
select o_custkey as SK_ID_CURR, l_quantity as SK_DPD, l_linenumber as SK_DPD_DEF
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "v_credit_card": """
select o_custkey as SK_ID_CURR, l_extendedprice as AMT_BALANCE,
 case when l_discount = 0 then 0.0 else l_extendedprice*(1+l_discount*10) end as AMT_CREDIT_LIMIT_ACTUAL,
 l_quantity as SK_DPD
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "v_predictions": """
select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when l_returnflag = 'R' then 1 else 0 end as y_true,
 round(0.6*l_quantity/50.0 + 0.4*l_extendedprice/105000.0, 4) as y_prob, l_linestatus as code_gender,
 cast(l_linenumber as string) as name_education_type
from {lineitem}""",
    "v_decisions": """
select event_id as decision_id, user_id as application_id,
 case when event_type in ('purchase','signup') then 'Approve' when event_type = 'error' then 'Decline'
   else 'Refer' end as recommendation,
 event_type = 'view' as escalation_flag,
 case event_id % 4 when 0 then 'accept' when 1 then 'override' else null end as underwriter_action,
 value/5000 as estimated_cost_usd, ts as created_at
from {events}""",
    "v_audit_source": """
select conv_id, turn, role as event_type, text as payload from {conversations}""",
    "v_support_documents": """
select l_orderkey as application_id,
 case l_linenumber when 1 then 'salary_slip' when 2 then 'bank_statement' when 3 then 'id_proof'
   when 4 then 'address_proof' when 5 then 'admission_letter' when 6 then 'business_registration'
   else 'other' end as doc_type,
 case when l_quantity > 45 then null
   else concat(' Name ', cast(l_orderkey % 50 + case when l_suppkey % 10 = 0 then 1 else 0 end as string)) end
   as declared_name,
 case when l_quantity > 40 then null else c_acctbal*20*(0.95 + l_tax) end as declared_income
from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey""",
    "v_raw_customer": """
select cast(c_custkey as string) as c_custkey, c_name, cast(c_nationkey as string) as c_nationkey,
 case when c_custkey % 11 = 0 then null else c_mktsegment end as c_mktsegment
from {customer}""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def base_tables_of(text: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(text)))


def plain_sql(text: str) -> str:
    """SQL text with placeholders replaced by the plain table names (oracle form)."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), text)


def cte(*names: str) -> str:
    """``WITH`` prefix holding the listed views, for oracle SQL strings."""
    parts = [f"{n} AS ({plain_sql(VIEW_SQL[n]).strip()})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"


class Tables:
    """Lazily opened parquet tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self[name]
        raise AttributeError(name)

    def view(self, name: str) -> DataFrame:
        text = VIEW_SQL[name]
        return self.spark.sql(text, **{t: self[t] for t in base_tables_of(text)})
