"""Base tables and the transaction-shaped views built on them.

The driver's parquet tables are star-schema data; the views FX1..FX8 below
give them the shape of a transaction file (amount, label, time, categories).
Each view is plain SQL that runs unchanged in Spark SQL and in DuckDB, so the
same text serves the engine and the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .ordering import POSITION, with_position

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

FIXTURE_SQL = {
    # Event transactions: hours vary, long-tailed city, text label.
    "fx1": """
select event_id as transaction_id, value as transaction_amount,
 case when value > 147 or (event_type='error' and extract(hour from ts) < 6) then 'Fraud' else 'Legitimate' end as is_fraud,
 ts as created_at, event_type as payment_method,
 concat('loc_', cast(cast(floor(value/10) as int) as string)) as city, user_id as customer_id
from events""",
    # Order transactions: three categoricals, yes/no label, midnight timestamps.
    "fx2": """
select o_orderkey as transaction_id, o_totalprice as price, case when o_orderstatus='F' then 'yes' else 'no' end as fraud,
 o_orderdate as transaction_date, c_mktsegment as merchant_name, n_name as country, o_orderpriority as payment_method, o_custkey as customer_id
from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey""",
    # Line-item transactions: the largest view, integer 0/1 label.
    "fx3": """
select l_extendedprice as amount, case when l_returnflag='R' then 1 else 0 end as label, l_shipdate as date,
 concat('s', cast(l_suppkey as string)) as vendor, l_linestatus as type
from lineitem""",
    # Dirty input: text amounts, negatives, nulls, mixed label spellings.
    "fx4": """
select c_custkey as id,
 case when c_custkey % 20 = 0 then '$1,000' when c_custkey % 20 = 1 then null else cast(c_acctbal as string) end as amount,
 case c_custkey % 7 when 0 then ' TRUE ' when 1 then 'No' when 2 then 'maybe' when 3 then null when 4 then 'genuine' when 5 then '1' else 'fraudulent' end as fraud
from customer""",
    # Quality input: duplicate rows, nulls, zero and negative amounts.
    "fx5": """
select c_nationkey as nation, c_mktsegment as segment, cast(floor(c_acctbal/1000)*1000 as double) as amount_bucket,
 case when c_custkey % 11 = 0 then null else c_mktsegment end as location
from customer""",
    # Date text with odd formats: the timestamp column is dropped by default.
    "fx6": """
select event_id as transaction_id, value as amount, case when value > 147 then 'true' else 'false' end as is_fraud,
 case when event_id % 97 = 5 then '01/02/2024' else cast(cast(ts as date) as string) end as date
from events""",
    # Scored rows with a fixed pseudo-score (metrics, AUC, high-risk).
    "fx7": """
select event_id as transaction_id, value as amount,
 case when value > 147 or event_type='error' then 1 else 0 end as is_fraud,
 case when value > 100 then 1 else 0 end as predicted_fraud, value/(value+100.0) as fraud_probability
from events""",
    # Merchant categories (some known to the risk map, some missing) and US-style time text.
    "fx8": """
select event_id as transaction_id, value as amount, case when value > 147 then 'Fraud' else 'Normal' end as label,
 concat(lpad(cast(extract(month from ts) as string), 2, '0'), '/', lpad(cast(extract(day from ts) as string), 2, '0'), '/',
  cast(extract(year from ts) as string), ' ', lpad(cast(extract(hour from ts) as string), 2, '0'), ':',
  lpad(cast(extract(minute from ts) as string), 2, '0')) as date,
 case event_id % 9 when 0 then 'Gas Station' when 1 then 'ATM Withdrawal' when 2 then 'Online Store' when 3 then 'Restaurant'
  when 4 then 'Grocery Store' when 5 then 'Pharmacy' when 6 then null else concat('shop_', cast(user_id % 50 as string)) end
  as merchant_category
from events""",
}

# Values that CSV must quote and ids of 19 digits, made of fx7 (char 34 is the quote, 10 a line end, 92 a backslash).
QUOTED_SQL = """
select transaction_id, 1234567890123456789 + transaction_id as account,
 case transaction_id % 6 when 0 then concat('Joe ', chr(34), 'Big', chr(34), ' Bar') when 1 then 'a, b;'
  when 2 then concat('two', chr(10), 'lines') when 3 then concat('back', chr(92), 'slash', chr(92))
  when 4 then concat(chr(34), chr(10), ',') else ' plain ' end as merchant,
 concat('98765432109876543210', lpad(cast(transaction_id as string), 9, '0')) as reference, amount
from fx7"""

# Mappings a user of each view would pass by hand (fx4 cannot be detected).
FIXTURE_MAPPINGS = {
    "fx1": {"amount": "transaction_amount", "fraud_label": "is_fraud", "timestamp": "created_at",
            "location": "city", "card_type": "payment_method"},
    "fx2": {"amount": "price", "fraud_label": "fraud", "timestamp": "transaction_date",
            "merchant": "merchant_name", "location": "country", "card_type": "payment_method"},
    "fx3": {"amount": "amount", "fraud_label": "label", "timestamp": "date", "merchant": "vendor",
            "card_type": "type"},
    "fx4": {"amount": "amount", "fraud_label": "fraud"},
    "fx6": {"amount": "amount", "fraud_label": "is_fraud", "timestamp": "date"},
    "fx8": {"amount": "amount", "fraud_label": "label", "timestamp": "date", "merchant": "merchant_category"},
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tables_in(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [t for t in BASE_TABLES if t in words]


def fixture(spark: SparkSession, sf_dir: str, name: str, position: bool = False) -> DataFrame:
    """One of the FX views over the parquet tables under ``sf_dir``.

    The base tables are registered as temp views (the SQL names them) and the
    returned DataFrame is bound to those scans, so later re-registration for
    another directory does not change it.  With ``position`` the rows carry their place in the
    files of the view's first table (``_position``).
    """
    sql, tables = FIXTURE_SQL[name], _tables_in(FIXTURE_SQL[name])
    scans = {t: read_table(spark, sf_dir, t) for t in tables}
    if position:
        first = re.search(r"\nfrom (\w+)", sql).group(1)
        scans[first] = with_position(scans[first])
        sql = sql.replace(f"\nfrom {first}", f", {POSITION}\nfrom {first}")
    for t, scan in scans.items():
        scan.createOrReplaceTempView(t)
    return spark.sql(sql)


def fixture_cte(*names: str) -> str:
    """``with`` clause defining the named views, for oracle SQL."""
    parts = [f"{n} as ({FIXTURE_SQL[n].strip()})" for n in names]
    return "with " + ",\n".join(parts) + "\n"
