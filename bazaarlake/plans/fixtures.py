"""Retail tables derived from the driver's star schema, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINE_SECONDS = "(l_orderkey * 7919 + l_linenumber * 3607) % 86400"

SQL = {
    "users": """
select 'U' || c_custkey as user_id, cast(10 + c_custkey % 95 as integer) as age, c_acctbal * 10 as annual_income,
       n_name as city, c_mktsegment as customer_segment,
       {ARRAY}('CAT_' || (c_custkey % 7), 'CAT_' || (c_custkey % 5)) as preferred_categories, {RD} as registration_date
from {customer} join {nation} on c_nationkey = n_nationkey""",
    "products": """
select 'P' || p_partkey as product_id, p_name as name, p_type as category, p_retailprice as price,
       'M' || (p_partkey % 10) as merchant_id, cast((p_size % 12) as double) / 2 as rating, cast(p_size as integer) as stock
from {part}""",
    "merchants": """
select 'M' || s_suppkey as merchant_id, s_name as name, 'CAT_' || (s_suppkey % 7) as category, r_name as region,
       s_acctbal / 10000 as commission_rate, '2015-01-01' as establishment_date
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "tx_line": """
select 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
         || cast(round(l_extendedprice * 100) as bigint) as transaction_id,
       'U' || o_custkey as user_id, 'P' || l_partkey as product_id, 'M' || l_suppkey as merchant_id,
       l_extendedprice as amount, {LT} as {TS}, 'LOC_' || (l_orderkey % 12) as location,
       case l_linenumber % 4 when 0 then 'crypto' when 1 then 'CARD' when 2 then 'PAYPAL' else 'CASH' end as payment_method,
       'CAT_' || (l_partkey % 7) as category
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "tx_events": """
select 'E' || event_id as transaction_id, 'U' || user_id as user_id, 'P' || (event_id % 250) as product_id,
       'M' || (event_id % 12) as merchant_id, value as amount, {T} as {TS}, 'LOC_' || (event_id % 12) as location,
       case event_type when 'purchase' then 'crypto' else upper(event_type) end as payment_method, 'CAT_' || (event_id % 7) as category
from {events}""",
    "tx_dirty": """
select transaction_id,
       case when n % 97 = 0 then null when n % 89 = 0 then 'U_UNKNOWN' else user_id end as user_id,
       case when n % 83 = 0 then 'P_UNKNOWN' else product_id end as product_id,
       case when n % 79 = 0 then 'M_UNKNOWN' else merchant_id end as merchant_id,
       case when n % 53 = 0 then null when n % 59 = 0 then 0.0 when n % 61 = 0 then -amount else amount end as amount,
       case when n % 41 = 0 then null when n % 43 = 0 then {TS} || '99' when n % 47 = 0 then 'abcdefghijklmn'
            when n % 37 = 0 then '' else {TS} end as {TS},
       case when n % 31 = 0 then null else location end as location, payment_method, category
from (select *, cast(substring(transaction_id, 2) as bigint) as n from {tx_events}) z""",
}

_SPARK = {
    "ARRAY": "array",
    "TS": "`timestamp`",
    "T": "date_format(ts, 'yyyyMMddHHmmss')",
    "LT": f"date_format(timestampadd(SECOND, {_LINE_SECONDS}, o_orderdate), 'yyyyMMddHHmmss')",
    "RD": "date_format(timestampadd(SECOND, (c_custkey % 700) * 86400, cast('2023-01-01 00:00:00' as timestamp)), 'yyyy-MM-dd')",
}
_DUCK = {
    "ARRAY": "list_value",
    "TS": '"timestamp"',
    "T": "strftime(ts, '%Y%m%d%H%M%S')",
    "LT": f"strftime(o_orderdate + to_seconds({_LINE_SECONDS}), '%Y%m%d%H%M%S')",
    "RD": "strftime(cast('2023-01-01 00:00:00' as timestamp) + to_seconds((c_custkey % 700) * 86400), '%Y-%m-%d')",
}
_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name]
    frames = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in _BASE if "{" + b + "}" in text}
    if "{tx_events}" in text:
        frames["tx_events"] = table(spark, sf_dir, "tx_events")
    for key, value in _SPARK.items():
        text = text.replace("{" + key + "}", value)
    return spark.sql(text, **frames)


def duck_sql(name: str) -> str:
    text = SQL[name]
    for key, value in _DUCK.items():
        text = text.replace("{" + key + "}", value)
    for b in (*_BASE, "tx_events"):
        text = text.replace("{" + b + "}", b)
    return text


def with_tables(*names: str) -> str:
    """The ``with`` clause that defines these tables in DuckDB."""
    need = list(dict.fromkeys([*(["tx_events"] if "tx_dirty" in names else []), *names]))
    return "with " + ",\n".join(f"{n} as ({duck_sql(n)})" for n in need)
