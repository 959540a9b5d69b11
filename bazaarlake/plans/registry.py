"""Registered retail queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timefeatures as tf
from ..functions.digest import NULL, content_digest
from ..operators import cohorts, enrich, merchants, products, rfm, skew, validation, windows
from ..sources import io
from ..sources.scratch import scratch_path
from . import jobs
from .fixtures import duck_sql, table, with_tables

Query = Callable[[SparkSession, str], DataFrame]


def _out(spark: SparkSession) -> str:
    """A folder for what a query writes."""
    return scratch_path(spark, "query")


def _dims(s, d):
    return table(s, d, "users"), table(s, d, "products"), table(s, d, "merchants")


def _enriched(s, d):
    return enrich.enrich(table(s, d, "tx_line"), *_dims(s, d))


def _timed(s, d):
    return enrich.timed(table(s, d, "tx_line"), *_dims(s, d))


def _report(s, d):
    users, prods, merch = _dims(s, d)
    return merchants.report_by_customer(merchants.by_customer(enrich.aged(table(s, d, "tx_line"), users, prods)), merch)


def _events(s, d):
    """Enriched events, and the users of very many of them, looked for once."""
    events = table(s, d, "tx_events")
    hot = skew.hot_keys(events, enrich.KEYS)
    return enrich.enrich(events, *_dims(s, d), hot=hot), list(hot["user_id"])


def _windowed(s, d):
    enriched, hot = _events(s, d)
    return windows.window_analysis(enriched, hot_users=hot)


def _suspicious(s, d):
    return jobs.run_detection(*_events(s, d))


def _rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _text_dates(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def _text_arrays(df: DataFrame) -> DataFrame:
    return df.select(*[F.concat_ws(",", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


# Sources and sinks: written by Spark in the source's format and read back.
def read_csv_transactions(s, d):
    path = _out(s)
    io.write_csv(table(s, d, "tx_events"), path, "transactions")
    return io.read_transactions(s, f"{path}/transactions")


def read_json_users(s, d):
    path = f"{_out(s)}/users"
    table(s, d, "users").write.mode("overwrite").json(path)
    return _text_arrays(io.read_users(s, path))


def read_parquet_products(s, d):
    path = f"{_out(s)}/products"
    table(s, d, "products").write.mode("overwrite").parquet(path)
    return io.read_products(s, path)


def read_csv_merchants(s, d):
    path = _out(s)
    io.write_csv(table(s, d, "merchants"), path, "merchants")
    return io.read_merchants(s, f"{path}/merchants")


def _raw(s, d, tx="tx_dirty"):
    users, prods, merch = _dims(s, d)
    return {"transactions": table(s, d, tx), "users": users, "products": prods, "merchants": merch}


def _roundtrip_validated(name: str) -> Query:
    def run(s, d):
        path = _out(s)
        io.write_validated(jobs.run_validation(_raw(s, d))[0], path)
        return _text_arrays(io.read_validated(s, path)[name])

    return run


def roundtrip_enriched(s, d):
    path = _out(s)
    io.write_enriched(lambda: _enriched(s, d), path)
    return io.read_enriched(s, path)


def roundtrip_enriched_csv(s, d):
    path = _out(s)
    io.write_enriched(lambda: _enriched(s, d), path)
    return io.read_csv(s, f"{path}/enriched_transactions_csv", io.read_enriched(s, path).schema)


def roundtrip_quality_report(s, d):
    path, report = _out(s), quality_report(s, d)
    io.write_quality_report(report, path)
    return io.read_csv(s, f"{path}/data_quality_report", report.schema)


def wide_transformation(s, d):
    """The job's mode over validated tables, read back."""
    path = _out(s)
    io.write_validated(_raw(s, d, "tx_line"), path)
    jobs.run_mode(s, "wide_transformation", {}, path)
    return _text_arrays(io.read_wide(s, path))


def _comparison(name: str, columns: list[str]) -> Query:
    """One result of the comparison job as both variants wrote it."""

    def run(s, d):
        path = _out(s)
        jobs.run_comparison(_raw(s, d, "tx_line"), path)
        both = None
        for variant in jobs.VARIANTS:
            one = s.read.option("header", True).option("inferSchema", True).csv(f"{path}/{variant}/{name}").select(F.lit(variant).alias("variant"), *columns)
            both = one if both is None else both.unionByName(one)
        both = _rounded(both, *[c for c in columns if c in _SALES])
        return both.withColumns({c: F.col(c).cast(t) for c, t in (("cohort_month", "string"), ("transaction_count", "long"), ("unique_customers", "long"), ("active_users", "long"), ("cohort_size", "long")) if c in columns})

    return run


def _inputs(s, d) -> tuple[dict[str, str], str]:
    """The dirty events and their dimensions in the formats that the jobs read, and a folder for what these write."""
    path, raw = _out(s), _raw(s, d)
    paths = {n: f"{path}/in/{n}" for n in io.VALIDATED}
    writers = [
        lambda: io.write_csv(raw["transactions"], f"{path}/in", "transactions"),
        lambda: raw["users"].write.mode("overwrite").json(paths["users"]),
        lambda: raw["products"].write.mode("overwrite").parquet(paths["products"]),
        lambda: io.write_csv(raw["merchants"], f"{path}/in", "merchants"),
    ]
    _at_once(writers)
    return paths, f"{path}/out"


def _at_once(work: list[Callable]) -> list:
    with ThreadPoolExecutor(len(work)) as pool:
        return [done.result() for done in [pool.submit(w) for w in work]]


def _digests(s, path: str, names: list[str]) -> DataFrame:
    """Rows and content digest of each result, read back from CSV and from Parquet."""

    def digest(name: str) -> DataFrame:
        parquet = s.read.parquet(f"{path}/{name}_parquet")
        csv = io.read_csv(s, f"{path}/{name}", parquet.schema)
        both = [content_digest(df).toDF(f"{kind}_rows", f"{kind}_digest") for kind, df in (("csv", csv), ("parquet", parquet))]
        return both[0].crossJoin(both[1]).select(F.lit(name).alias("result"), "csv_rows", "csv_digest", "parquet_rows", "parquet_digest")

    return reduce(DataFrame.unionByName, _at_once([lambda n=n: digest(n) for n in sorted(names)]))


def write_results(s, d):
    """The whole pipeline on the dirty events, and the digest of each result as it was written."""
    paths, out = _inputs(s, d)
    return _digests(s, out, jobs.run_all(s, paths, out))


def run_modes(s, d):
    """The same mode by mode, each reading what the one before has written."""
    paths, out = _inputs(s, d)
    for mode in ("ingestion", "transformation", "analytics"):
        jobs.run_mode(s, mode, paths, out)
    return _digests(s, out, list(_RESULTS))


def _split(name: str, rejected: bool) -> Query:
    rule = getattr(validation, f"validate_{name}")

    def run(s, d):
        source = table(s, d, "tx_dirty" if name == "transactions" else name)
        return _text_arrays(rule(source)[1 if rejected else 0])

    return run


def null_count(s, d):
    return validation.count_nulls(validation.reunited(*validation.validate_transactions(table(s, d, "tx_dirty"))))


def _orphans(key: str, dimension: str) -> Query:
    return lambda s, d: validation.orphans(table(s, d, "tx_dirty"), table(s, d, dimension), key)


def quality_report(s, d):
    return validation.quality_report(**_raw(s, d))


def time_features(s, d):
    return tf.with_time_features(table(s, d, "tx_dirty").select("transaction_id", "timestamp"))


def parsed_prefix_dates(s, d):
    return _text_dates(tf.with_parsed_dates(table(s, d, "tx_dirty").select("transaction_id", "timestamp")))


def enrich_broadcast(s, d):
    return _text_arrays(enrich.enrich_broadcast(table(s, d, "tx_line"), *_dims(s, d)))


def broadcast_merchant_join(s, d):
    return enrich.broadcast_merchant_join(table(s, d, "tx_line"), table(s, d, "merchants"))


_WINDOW_COLUMNS = ["transaction_id", "user_id", "amount", "transaction_datetime", "transaction_date", "cumulative_amount_7d", "active_days_7d", "active_user_7d", "days_since_previous_transaction"]
_FLAGS = ["amount_above_300_percent", "night_transaction", "previous_transaction_less_than_5min", "crypto_payment", "suspicion_score"]


def window_analysis(s, d):
    df = _text_dates(_windowed(s, d).select(*_WINDOW_COLUMNS))
    return _rounded(_rounded(df, "cumulative_amount_7d"), "days_since_previous_transaction", digits=9)


def suspicious(s, d):
    return _rounded(_suspicious(s, d).select("transaction_id", "historical_average_amount", *_FLAGS, "is_suspicious"), "historical_average_amount", digits=9)


def suspicious_count(s, d):
    return _suspicious(s, d).where("is_suspicious = 1").agg(F.count(F.lit(1)).alias("suspicious_transactions"))


def top_suspicious(s, d):
    return _rounded(windows.top_suspicious(_suspicious(s, d)), "historical_average_amount", digits=9)


_SALES = ["sales_Jeune", "sales_Adulte", "sales_Age_Moyen", "sales_Senior"]


def merchant_report(s, d):
    return _rounded(_report(s, d), *_SALES)


def merchant_report_with_suspicion(s, d):
    return _rounded(merchants.merchant_report_with_suspicion(_suspicious(s, d)), *_SALES)


def cohort_analysis(s, d):
    return _text_dates(cohorts.cohort_analysis(table(s, d, "tx_line")))


def _rfm(s, d):
    return rfm.rfm(table(s, d, "tx_line"), table(s, d, "users"))


_KPI = ["total_revenue", "transaction_count", "unique_customers", "average_transaction_amount"]
_MERCHANT = ["merchant_id", "merchant_name", "merchant_category", "region", "commission_rate", *_KPI, "total_commission", *_SALES, "rank_in_category", "rank_in_region"]
_COHORTS = ["cohort_month", "period_index", "cohort_size", "active_users", "retention_rate", "revenue", "revenue_per_user"]
_DESCRIBED = [*_KPI, "total_commission", "rank_in_category", "rank_in_region"]


def merchant_kpi_describe(s, d):
    summary = merchants.kpi_describe(_report(s, d))
    return summary.select("summary", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in _DESCRIBED])


def top_products(s, d):
    """Users and merchants give no column, so that they are not joined; products meet sums."""
    users, prods, merch = _dims(s, d)
    lines = enrich.as_often(enrich.as_often(table(s, d, "tx_line"), users, "user_id"), merch, "merchant_id")
    return products.top_products_of(lines, prods)


def category_region(s, d):
    """Users and products give no column, so that they are not joined; merchants meet sums."""
    users, prods, merch = _dims(s, d)
    lines = enrich.as_often(enrich.as_often(table(s, d, "tx_line"), users, "user_id"), prods, "product_id")
    return products.category_region_of(lines, merch)


def flagship(s, d):
    return merchant_report(s, d)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "read_csv_transactions": read_csv_transactions,
        "read_json_users": read_json_users,
        "read_parquet_products": read_parquet_products,
        "read_csv_merchants": read_csv_merchants,
        "roundtrip_validated": _roundtrip_validated("transactions"),
        "roundtrip_validated_users": _roundtrip_validated("users"),
        "roundtrip_validated_products": _roundtrip_validated("products"),
        "roundtrip_validated_merchants": _roundtrip_validated("merchants"),
        "roundtrip_enriched": roundtrip_enriched,
        "roundtrip_enriched_csv": roundtrip_enriched_csv,
        "roundtrip_quality_report": roundtrip_quality_report,
        "wide_transformation": wide_transformation,
        "comparison_global_kpi": _comparison("global_kpi", _KPI),
        "comparison_merchant_performance": _comparison("merchant_performance", _MERCHANT),
        "comparison_cohort_analysis": _comparison("cohort_analysis", _COHORTS),
        "null_count": null_count,
        "orphan_users": _orphans("user_id", "users"),
        "orphan_products": _orphans("product_id", "products"),
        "orphan_merchants": _orphans("merchant_id", "merchants"),
        "quality_report": quality_report,
        "time_features": time_features,
        "parsed_prefix_dates": parsed_prefix_dates,
        "enrich": _enriched,
        "enrich_broadcast": enrich_broadcast,
        "broadcast_merchant_join": broadcast_merchant_join,
        "window_analysis": window_analysis,
        "suspicious": suspicious,
        "suspicious_count": suspicious_count,
        "top_suspicious": top_suspicious,
        "merchant_report": merchant_report,
        "merchant_report_with_suspicion": merchant_report_with_suspicion,
        "merchant_revenue_ranking": lambda s, d: merchants.merchant_revenue_ranking(_timed(s, d)),
        "merchant_kpi_describe": merchant_kpi_describe,
        "cohort_analysis": cohort_analysis,
        "best_cohort_3m": lambda s, d: cohorts.best_cohort_at(cohort_analysis(s, d)),
        "rfm": _rfm,
        "rfm_crosstab": lambda s, d: rfm.rfm_crosstab(_rfm(s, d)),
        "rfm_distribution": lambda s, d: rfm.rfm_distribution(_rfm(s, d)),
        "top_products": top_products,
        "category_region": category_region,
        "payment_period": lambda s, d: products.payment_period(_timed(s, d)),
        "global_kpi_formatted": lambda s, d: merchants.global_kpi_formatted(_timed(s, d)),
        "global_kpi": lambda s, d: merchants.global_kpi(_timed(s, d)),
        "write_results": write_results,
        "run_modes": run_modes,
    }
    for name in io.VALIDATED:
        found[f"validate_{name}_valid"] = _split(name, rejected=False)
        found[f"validate_{name}_rejected"] = _split(name, rejected=True)
    return found


# DuckDB -----------------------------------------------------------------

_DIMS = ("users", "products", "merchants")


def _r2(x: str, digits: int = 2) -> str:
    # Through text, as Spark rounds the shortest decimal form of a double, half up.
    return f"cast(round(cast(cast({x} as varchar) as decimal(38,16)), {digits}) as double)"


def _parsed(x: str) -> str:
    return f"case when length({x}) = 14 then try_strptime({x}, '%Y%m%d%H%M%S') end"


def _features(ts: str) -> str:
    return f"""cast(hour({ts}) as integer) as "hour", upper(dayname({ts})) as day_of_week, upper(monthname({ts})) as "month",
  case when {ts} is null then null when dayofweek({ts}) in (0, 6) then 1 else 0 end as is_weekend,
  case when {ts} is null then null when hour({ts}) between 6 and 11 then 'Morning' when hour({ts}) between 12 and 17 then 'Afternoon'
       when hour({ts}) between 18 and 21 then 'Evening' else 'Night' end as day_period,
  case when {ts} is null then null when hour({ts}) between 9 and 17 then 1 else 0 end as is_working_hours"""


def _enriched_sql(tx: str) -> str:
    return f"""enriched as (
select j.*, {_features("ts_full")},
  cast(row_number() over (partition by user_id order by "timestamp" nulls first, transaction_id) as integer) as transaction_rank,
  count(*) over (partition by user_id) as transaction_count,
  case when age < 25 then 'Jeune' when age between 26 and 44 then 'Adulte' when age between 45 and 64 then 'Âge Moyen' when age >= 65 then 'Senior' end as age_group
from (select t.transaction_id, t.user_id, t.product_id, t.merchant_id, t.amount, t."timestamp", t.location, t.payment_method, t.category as transaction_category,
        u.age, u.annual_income, u.city, u.customer_segment, p.name as product_name, p.category as product_category, p.price, p.rating, p.stock,
        m.name as merchant_name, m.category as merchant_category, m.region, m.commission_rate, {_parsed('t."timestamp"')} as ts_full
      from {tx} t left join users u on t.user_id = u.user_id left join products p on t.product_id = p.product_id left join merchants m on t.merchant_id = m.merchant_id) j)"""


def _with_enriched(tx: str) -> str:
    return with_tables(tx, *_DIMS) + ",\n" + _enriched_sql(tx)


_WINDOWED = f"""windowed as (
select *, {_r2("cum")} as cumulative_amount_7d, case when active_days_7d >= 5 then 1 else 0 end as active_user_7d,
  (epoch(transaction_datetime) - epoch(before)) / 86400.0 as days_since_previous_transaction
from (select *, cast(transaction_datetime as date) as transaction_date,
        sum(amount) over frame as cum,
        case when transaction_datetime is null then 0 else cast(count(distinct cast(transaction_datetime as date)) over frame as integer) end as active_days_7d,
        lag(transaction_datetime) over (partition by user_id order by transaction_datetime nulls first, transaction_id) as before
      from (select *, {_parsed('substring("timestamp", 1, 14)')} as transaction_datetime from enriched) a
      window frame as (partition by user_id order by epoch(transaction_datetime) range between 604800 preceding and current row)) b)"""

_FLAGGED = """flagged as (
select *, case when suspicion_score >= 2 then 1 else 0 end as is_suspicious
from (select *, amount_above_300_percent + night_transaction + previous_transaction_less_than_5min + crypto_payment as suspicion_score
  from (select *,
      case when hist is not null and amount > 3 * hist then 1 else 0 end as amount_above_300_percent,
      case when day_period = 'Night' then 1 else 0 end as night_transaction,
      case when days_since_previous_transaction < 300 / 86400.0 then 1 else 0 end as previous_transaction_less_than_5min,
      case when upper(payment_method) = 'CRYPTO' then 1 else 0 end as crypto_payment
    from (select *, avg(amount) over (partition by user_id order by transaction_datetime nulls first, transaction_id rows between unbounded preceding and 1 preceding) as hist from windowed) a) b) c)"""

_EVENTS_FLAGGED = _with_enriched("tx_events") + ",\n" + _WINDOWED + ",\n" + _FLAGGED
_ENRICHED_COLUMNS = ", ".join(f'"{c}"' for c in [*enrich.ENRICHED, *tf.TIME_FEATURES, "transaction_rank", "transaction_count", "age_group"])


def _merchant_sql(extra: str = "", joined: str = "") -> str:
    each = {name: f"sum(case when age_group = '{label}' then amount else 0.0 end)" for name, label in merchants._GROUPS.items()}
    sales = ", ".join(f"{_r2(total)} as {name}" for name, total in each.items())
    return f"""select k.*, cast(dense_rank() over (partition by merchant_category order by total_revenue desc) as integer) as rank_in_category,
  cast(dense_rank() over (partition by region order by total_revenue desc) as integer) as rank_in_region{extra}
from (select merchant_id, merchant_name, merchant_category, region, commission_rate, {_r2("sum(amount)")} as total_revenue, count(*) as transaction_count,
        count(distinct user_id) as unique_customers, {_r2("avg(amount)")} as average_transaction_amount, {_r2("sum(amount * commission_rate)")} as total_commission, {sales}
      from enriched where merchant_id is not null group by all) k {joined}"""


_SUSPICION_SQL = (
    ", coalesce(s.rate, 0.0) as suspicious_transaction_rate",
    f"left join (select merchant_id as mid, {_r2('sum(is_suspicious) / count(*) * 100')} as rate from flagged where merchant_id is not null group by 1) s on k.merchant_id = s.mid",
)
_COUNTS_SQL = "count(*) as transaction_count, count(distinct user_id) as unique_customers"
# Doubles are added as decimals, so that their order does not show in the text; where one is no such decimal, as they are.
_DECIMAL_SQL = "try_cast(cast(amount as varchar) as decimal(38,16))"
_EXACT_SQL = f"case when count(amount) = count({_DECIMAL_SQL}) then cast(cast(sum({_DECIMAL_SQL}) as varchar) as double) else sum(amount) end"
_KPI_FORMATTED_SQL = f"select format('{{:,.2f}}', {_EXACT_SQL}) as total_revenue, {_COUNTS_SQL}, format('{{:,.2f}}', {_EXACT_SQL} / nullif(count(amount), 0)) as average_transaction_amount from enriched"
_TOP_PRODUCTS_SQL = f"select product_id, product_name, {_r2('sum(amount)')} as total_revenue, {_r2('avg(rating)')} as average_rating, min(stock) as stock from enriched where product_id is not null group by 1, 2 order by total_revenue desc, product_id limit 10"
_CATEGORY_SQL = f"""with cr as (select merchant_category, region, {_r2('sum(amount)')} as total_revenue, count(*) as transaction_count from enriched where merchant_category is not null group by 1, 2)
  select cr.*, {_r2('total_revenue / tot * 100')} as category_share_percent from cr left join (select region as rg, sum(total_revenue) as tot from cr group by 1) z on cr.region = z.rg"""
_PAYMENT_SQL = f"select payment_method, day_period, {_r2('sum(amount)')} as total_revenue, count(*) as transaction_count from enriched group by 1, 2"

_COHORT = f"""monthly as (
  select user_id, amount, cast(date_trunc('month', ts) as date) as mon
  from (select user_id, amount, {_parsed('substring("timestamp", 1, 14)')} as ts from tx_line) a where ts is not null and user_id is not null),
firsts as (select user_id, min(mon) as cohort_month from monthly group by user_id),
acts as (
  select cohort_month, cast(date_diff('month', cohort_month, mon) as integer) as period_index, count(distinct user_id) as active_users, {_r2("sum(amount)")} as revenue
  from monthly join firsts using (user_id) group by 1, 2),
cohorts as (
  select cohort_month, period_index, cohort_size, active_users, {_r2("active_users / cohort_size * 100")} as retention_rate, revenue, {_r2("revenue / active_users")} as revenue_per_user
  from acts join (select cohort_month, count(*) as cohort_size from firsts group by 1) z using (cohort_month))"""

_RFM = f"""dated as (select user_id, amount, {_parsed('substring("timestamp", 1, 14)')} as ts from tx_line),
metrics as (
  select user_id, cast(date_diff('day', cast(max(ts) as date), cast((select max(ts) from dated) as date)) as integer) as recency, count(*) as frequency, {_r2("sum(amount)")} as monetary
  from dated where ts is not null group by user_id),
scored as (
  select *, cast(6 - ntile(5) over (order by recency nulls first, user_id nulls first) as integer) as r, cast(ntile(5) over (order by frequency nulls first, user_id nulls first) as integer) as f,
    cast(ntile(5) over (order by monetary nulls first, user_id nulls first) as integer) as m from metrics),
rfm as (
  select s.user_id, recency, frequency, monetary, r as recency_score, f as frequency_score, m as monetary_score,
    case when r >= 4 and f >= 4 and m >= 4 then 'Champions' when f >= 4 and m >= 3 then 'Clients fidèles' when r >= 4 and f <= 2 then 'Nouveaux'
         when r <= 2 and f >= 3 then 'À risque' when r <= 2 and f <= 2 then 'Perdus' else 'Clients fidèles' end as rfm_segment, customer_segment
  from scored s left join users u on s.user_id = u.user_id)"""

_BROKEN = {
    "transactions": "case when amount is null or amount <= 0 then 'amount invalide (<= 0 ou nul)' when \"timestamp\" is null or length(\"timestamp\") <> 14 then 'timestamp mal formé (doit faire 14 caractères)' end",
    "users": "case when age is null or age < 16 or age > 100 then 'age hors intervalle autorisé' when annual_income is null or annual_income <= 0 then 'annual_income invalide (<= 0 ou nul)' end",
    "products": "case when price is null or price <= 0 then 'price invalide (<= 0 ou nul)' when rating is null or rating < 1 or rating > 5 then 'rating hors intervalle autorisé' end",
    "merchants": "case when commission_rate is null or commission_rate < 0 or commission_rate > 1 then 'commission_rate hors intervalle [0, 1]' end",
}
_COLUMNS = {
    "transactions": 'transaction_id, user_id, product_id, merchant_id, amount, "timestamp", location, payment_method, category',
    "users": "user_id, age, annual_income, city, customer_segment, array_to_string(preferred_categories, ',') as preferred_categories, registration_date",
    "products": "product_id, name, category, price, merchant_id, rating, stock",
    "merchants": "merchant_id, name, category, region, commission_rate, establishment_date",
}


def _nulls_sql(name: str) -> str:
    plain = [c.split(" as ")[-1].strip() for c in _COLUMNS[name].replace("array_to_string(preferred_categories, ',') as ", "").split(",")]
    return " + ".join(f"(count(*) - count({c}))" for c in plain)


def _quality_sql() -> str:
    parts = []
    for name in io.VALIDATED:
        source = "tx_dirty" if name == "transactions" else name
        missing = [
            f"(select count(*) from tx_dirty t where not exists (select 1 from {dim} x where x.{key} = t.{key}))" if name == "transactions" else "cast(null as bigint)"
            for key, dim in (("user_id", "users"), ("product_id", "products"), ("merchant_id", "merchants"))
        ]
        parts.append(
            f"""select '{name}' as dataset, count(*) as nb_lignes_lues, count(*) - count({_BROKEN[name]}) as nb_lignes_valides, count({_BROKEN[name]}) as nb_lignes_rejetees,
  coalesce(round(count({_BROKEN[name]}) / nullif(count(*), 0) * 10000) / 100, 0.0) as taux_rejet, {_nulls_sql(name)} as nb_valeurs_nulles,
  {missing[0]} as nb_refs_user_id_inexistant, {missing[1]} as nb_refs_product_id_inexistant, {missing[2]} as nb_refs_merchant_id_inexistant from {source}"""
        )
    return with_tables("tx_dirty", *_DIMS) + "\n" + "\nunion all\n".join(parts)


#: Columns of each result as it is written; doubles are marked by a star.
_RESULTS = {
    "best_cohort": "cohort_month period_index cohort_size active_users retention_rate* revenue* revenue_per_user*",
    "category_region": "merchant_category region total_revenue* transaction_count category_share_percent*",
    "cohort_analysis": "cohort_month period_index cohort_size active_users retention_rate* revenue* revenue_per_user*",
    "global_kpi": "total_revenue transaction_count unique_customers average_transaction_amount",
    "merchant_performance": "merchant_id merchant_name merchant_category region commission_rate* total_revenue* transaction_count unique_customers average_transaction_amount* total_commission* sales_Jeune* sales_Adulte* sales_Age_Moyen* sales_Senior* rank_in_category rank_in_region",
    "payment_period_revenue": "payment_method day_period total_revenue* transaction_count",
    "rfm_analysis": "user_id recency frequency monetary* recency_score frequency_score monetary_score rfm_segment customer_segment",
    "rfm_cross_tab": "rfm_segment customer_segment customer_count",
    "top_products": "product_id product_name total_revenue* average_rating* stock",
}
_RESULTS["merchant_performance_suspicion"] = _RESULTS["merchant_performance"] + " suspicious_transaction_rate*"


def _digest_sql(columns: str, sql: str) -> str:
    """``rows, digest`` as ``content_digest`` gives them."""
    cells = []
    for name in columns.split():
        value = f"cast(cast({_r2(name[:-1])} as decimal(30,2)) as varchar)" if name.endswith("*") else f"cast({name} as varchar)"
        cells.append(f"coalesce({value}, '{NULL}')")
    return f"select count(*) as n, cast(coalesce(sum(cast('0x' || substr(md5(concat_ws('|', {', '.join(cells)})), 1, 15) as bigint)), 0) as varchar) as digest from ({sql}) q"


def _results_sql() -> str:
    """Rows and digest of every result of the whole job, which validates the dirty events first."""
    valid = [f"tx_events as ({duck_sql('tx_events')})", f"tx_dirty as ({duck_sql('tx_dirty')})", f"tx_line as (select * from tx_dirty where {_BROKEN['transactions']} is null)"]
    valid += [f"{name} as (select * from ({duck_sql(name)}) z where {_BROKEN[name]} is null)" for name in _DIMS]
    results = {
        "global_kpi": _KPI_FORMATTED_SQL,
        "merchant_performance": _merchant_sql(),
        "merchant_performance_suspicion": _merchant_sql(*_SUSPICION_SQL),
        "cohort_analysis": "select * from cohorts",
        "best_cohort": "select * from cohorts where period_index = 3 order by retention_rate desc, cohort_month limit 1",
        "rfm_analysis": "select * from rfm",
        "rfm_cross_tab": "select rfm_segment, customer_segment, count(*) as customer_count from rfm group by 1, 2",
        "top_products": _TOP_PRODUCTS_SQL,
        "category_region": _CATEGORY_SQL,
        "payment_period_revenue": _PAYMENT_SQL,
    }
    digests = [f"select '{name}' as result, n as csv_rows, digest as csv_digest, n as parquet_rows, digest as parquet_digest from ({_digest_sql(_RESULTS[name], sql)}) d" for name, sql in results.items()]
    return "with " + ",\n".join([*valid, _enriched_sql("tx_line"), _WINDOWED, _FLAGGED, _COHORT, _RFM]) + "\n" + "\nunion all\n".join(digests)


def _describe_sql() -> str:
    stats = {"count": "count({0})", "mean": "avg({0})", "stddev": "stddev_samp({0})", "min": "min({0})", "max": "max({0})"}
    rows = [f"select '{name}' as summary, " + ", ".join(f"{_r2(stat.format(f'cast({c} as double)'))} as {c}" for c in _DESCRIBED) + " from rep" for name, stat in stats.items()]
    return _with_enriched("tx_line") + f",\nrep as ({_merchant_sql()})\n" + "\nunion all\n".join(rows)


def _variants(sql: str, columns: list[str]) -> str:
    """A query's rows once for each variant of the comparison."""
    head, _, last = sql.rpartition("\x00")
    names = ", ".join(columns)
    return f"{head}, res as ({last}) " + " union all ".join(f"select '{v}' as variant, {names} from res" for v in jobs.VARIANTS)


def oracle_sql() -> dict[str, str]:
    line = _with_enriched("tx_line")
    valid = f"select {_COLUMNS['transactions']} from tx_dirty where {_BROKEN['transactions']} is null"
    found = {
        "read_csv_transactions": f"{with_tables('tx_events')} select * from tx_events",
        "read_json_users": f"{with_tables('users')} select {_COLUMNS['users']} from users",
        "read_parquet_products": f"{with_tables('products')} select * from products",
        "read_csv_merchants": f"{with_tables('merchants')} select * from merchants",
        "roundtrip_validated": f"{with_tables('tx_dirty')} {valid}",
        "roundtrip_enriched": f"{line} select {_ENRICHED_COLUMNS} from enriched",
        "null_count": f"{with_tables('tx_dirty')} select {_nulls_sql('transactions')} as nb_nulls from tx_dirty",
        "quality_report": _quality_sql(),
        "time_features": f"{with_tables('tx_dirty')} select transaction_id, \"timestamp\", {_features('ts')} from (select *, {_parsed(chr(34) + 'timestamp' + chr(34))} as ts from tx_dirty) a",
        "parsed_prefix_dates": f"""{with_tables('tx_dirty')} select transaction_id, "timestamp", ts as transaction_datetime, cast(cast(ts as date) as varchar) as transaction_date, cast(cast(date_trunc('month', ts) as date) as varchar) as transaction_month
          from (select *, {_parsed('substring("timestamp", 1, 14)')} as ts from tx_dirty) a""",
        "enrich": f"{line} select {_ENRICHED_COLUMNS} from enriched",
        "enrich_broadcast": f"""{with_tables('tx_line', *_DIMS)} select t.*, u.age, u.annual_income, u.city, u.customer_segment, coalesce(array_to_string(u.preferred_categories, ','), '') as preferred_categories, u.registration_date,
          p.name, p.category as product_category, p.price, p.merchant_id as product_merchant_id, p.rating, p.stock,
          m.name as merchant_name, m.category as merchant_category, m.region, m.commission_rate, m.establishment_date, {_features('t.ts_full')}
          from (select *, {_parsed('"timestamp"')} as ts_full from tx_line) t left join users u on t.user_id = u.user_id left join products p on t.product_id = p.product_id left join merchants m on t.merchant_id = m.merchant_id""".replace("select t.*,", "select t.* exclude (ts_full),"),
        "broadcast_merchant_join": f"""{with_tables('tx_line', 'merchants')} select t.*, m.name, m.category as merchant_category, m.region, m.commission_rate, m.establishment_date
          from tx_line t left join merchants m on t.merchant_id = m.merchant_id""",
        "window_analysis": f"{_with_enriched('tx_events')},\n{_WINDOWED} select {', '.join('cast(transaction_date as varchar) as transaction_date' if c == 'transaction_date' else c for c in _WINDOW_COLUMNS[:-1])}, {_r2('days_since_previous_transaction', 9)} as days_since_previous_transaction from windowed",
        "suspicious": f"{_EVENTS_FLAGGED} select transaction_id, {_r2('hist', 9)} as historical_average_amount, {', '.join(_FLAGS)}, is_suspicious from flagged",
        "suspicious_count": f"{_EVENTS_FLAGGED} select count(*) as suspicious_transactions from flagged where is_suspicious = 1",
        "top_suspicious": f"{_EVENTS_FLAGGED} select transaction_id, user_id, amount, {_r2('hist', 9)} as historical_average_amount, {', '.join(_FLAGS)} from flagged where is_suspicious = 1 order by amount desc, transaction_id limit 20",
        "merchant_report": f"{line} {_merchant_sql()}",
        "merchant_report_with_suspicion": _EVENTS_FLAGGED + _merchant_sql(*_SUSPICION_SQL),
        "merchant_revenue_ranking": f"{line} select merchant_id, {_r2('sum(amount)')} as total_revenue, {_COUNTS_SQL} from enriched where merchant_id is not null group by merchant_id",
        "cohort_analysis": f"{with_tables('tx_line')},\n{_COHORT} select * replace (cast(cohort_month as varchar) as cohort_month) from cohorts",
        "best_cohort_3m": f"{with_tables('tx_line')},\n{_COHORT} select * replace (cast(cohort_month as varchar) as cohort_month) from cohorts where period_index = 3 order by retention_rate desc, cohort_month limit 1",
        "rfm": f"{with_tables('tx_line', 'users')},\n{_RFM} select * from rfm",
        "rfm_crosstab": f"{with_tables('tx_line', 'users')},\n{_RFM} select rfm_segment, customer_segment, count(*) as customer_count from rfm group by 1, 2",
        "rfm_distribution": f"{with_tables('tx_line', 'users')},\n{_RFM} select rfm_segment, count(*) as customer_count from rfm group by 1",
        "top_products": f"{line} {_TOP_PRODUCTS_SQL}",
        "category_region": f"{line} select * from ({_CATEGORY_SQL}) z",
        "payment_period": f"{line} {_PAYMENT_SQL}",
        "global_kpi_formatted": f"{line} {_KPI_FORMATTED_SQL}",
        "global_kpi": f"{line} select {_r2('sum(amount)')} as total_revenue, {_COUNTS_SQL}, {_r2('avg(amount)')} as average_transaction_amount from enriched",
    }
    found["write_results"], found["merchant_kpi_describe"] = _results_sql(), _describe_sql()
    found["run_modes"] = found["write_results"]
    found["roundtrip_enriched_csv"], found["roundtrip_quality_report"], found["wide_transformation"] = found["enrich"], found["quality_report"], found["enrich_broadcast"]
    kpis = f"select {_r2('sum(amount)')} as total_revenue, {_COUNTS_SQL}, {_r2('avg(amount)')} as average_transaction_amount from enriched"
    found["comparison_global_kpi"] = _variants(f"{line}\x00{kpis}", _KPI)
    found["comparison_merchant_performance"] = _variants(f"{line}\x00{_merchant_sql()}", _MERCHANT)
    found["comparison_cohort_analysis"] = _variants(f"{with_tables('tx_line')},\n{_COHORT}\x00select * replace (cast(cohort_month as varchar) as cohort_month) from cohorts", _COHORTS)
    for name in _DIMS:
        found[f"roundtrip_validated_{name}"] = f"{with_tables(name)} select {_COLUMNS[name]} from {name} where {_BROKEN[name]} is null"
    for key, dim in (("user_id", "users"), ("product_id", "products"), ("merchant_id", "merchants")):
        found[f"orphan_{dim}"] = f"{with_tables('tx_dirty', dim)} select * from tx_dirty t where not exists (select 1 from {dim} x where x.{key} = t.{key})"
    for name in io.VALIDATED:
        source = "tx_dirty" if name == "transactions" else name
        found[f"validate_{name}_valid"] = f"{with_tables(source)} select {_COLUMNS[name]} from {source} where {_BROKEN[name]} is null"
        found[f"validate_{name}_rejected"] = f"{with_tables(source)} select {_COLUMNS[name]}, {_BROKEN[name]} as rejection_reason from {source} where {_BROKEN[name]} is not null"
    return found
