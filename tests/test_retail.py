"""Edge rows of the retail operators, and helpers against their plain forms."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaarlake import schemas
from bazaarlake.functions import timefeatures as tf
from bazaarlake.functions.digest import content_digest
from bazaarlake.operators import cohorts, enrich, long_users, merchants, products, ranking, rfm, skew, validation, windows
from bazaarlake.plans import fixtures, jobs, registry
from bazaarlake.sources import io, scratch

TX = schemas.TRANSACTIONS


def tx(i, user="U1", amount=10.0, ts="20240105120000", merchant="M1", product="P1", pay="CARD"):
    return (f"T{i}", user, product, merchant, amount, ts, "LOC", pay, "CAT")


def frame(spark, rows):
    return spark.createDataFrame(rows, TX)


def test_age_groups(spark):
    ages = [None, 15, 16, 24, 25, 26, 44, 45, 64, 65, 100, 101]
    got = [r.g for r in spark.createDataFrame([(a,) for a in ages], "age int").select(tf.age_group(F.col("age")).alias("g")).collect()]
    assert got == [None, "Jeune", "Jeune", "Jeune", None, "Adulte", "Adulte", "Âge Moyen", "Âge Moyen", "Senior", "Senior", "Senior"]


def test_time_features(spark):
    stamps = [None, "", "2024010512000", "20240105175900", "2024010517590099", "abcdefghijklmn", "20250230101010", "20240229000000", "20250715240000", "20240106085900"]
    rows = tf.with_time_features(spark.createDataFrame([(s,) for s in stamps], "timestamp string")).collect()
    assert [r.hour for r in rows] == [None, None, None, 17, None, None, None, 0, None, 8]
    assert [r.is_working_hours for r in rows] == [None, None, None, 1, None, None, None, 0, None, 0]
    assert [r.day_period for r in rows] == [None, None, None, "Afternoon", None, None, None, "Night", None, "Morning"]
    assert [r.day_of_week for r in rows] == [None, None, None, "FRIDAY", None, None, None, "THURSDAY", None, "SATURDAY"]
    assert [r.month for r in rows] == [None, None, None, "JANUARY", None, None, None, "FEBRUARY", None, "JANUARY"]
    assert rows[3].day_of_week == "FRIDAY" and rows[3].month == "JANUARY" and rows[9].is_weekend == 1


def test_prefix_parser_keeps_long_values(spark):
    row = tf.with_parsed_dates(spark.createDataFrame([("2024010517590099",)], "timestamp string")).first()
    assert str(row.transaction_datetime) == "2024-01-05 17:59:00" and str(row.transaction_month) == "2024-01-01"


def test_validation_reasons(spark):
    rows = [tx(1), tx(2, amount=None), tx(3, amount=0.0), tx(4, amount=float("nan")), tx(5, ts="abcdefghijklmn"), tx(6, ts=None), tx(7, amount=-1.0, ts="x")]
    valid, rejected = validation.validate_transactions(frame(spark, rows))
    assert sorted(r.transaction_id for r in valid.collect()) == ["T1", "T4", "T5"]
    reasons = {r.transaction_id: r.rejection_reason for r in rejected.collect()}
    assert reasons["T7"].startswith("amount") and reasons["T6"].startswith("timestamp") and "rejection_reason" not in valid.columns


def test_rating_and_commission_bounds(spark):
    items = spark.createDataFrame([(f"P{i}", "n", "c", 1.0, "M", r, 1) for i, r in enumerate([1.0, 5.0, 0.99, 5.01, float("nan")])], schemas.PRODUCTS)
    assert validation.validate_products(items)[0].count() == 2
    shops = spark.createDataFrame([(f"M{i}", "n", "c", "r", r, "d") for i, r in enumerate([0.0, 1.0, -0.01, 1.01, None])], schemas.MERCHANTS)
    assert validation.validate_merchants(shops)[0].count() == 2


def test_quality_report_of_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (schemas.TRANSACTIONS, schemas.USERS, schemas.PRODUCTS, schemas.MERCHANTS)]
    rows = {r.dataset: r for r in validation.quality_report(*empty).collect()}
    assert len(rows) == 4 and rows["users"].taux_rejet == 0.0 and rows["users"].nb_valeurs_nulles == 0
    assert rows["transactions"].nb_refs_user_id_inexistant == 0 and rows["users"].nb_refs_user_id_inexistant is None


def test_null_keys_are_orphans(spark):
    users = spark.createDataFrame([("U1", 30, 1.0, "c", "s", ["a"], "d")] * 2, schemas.USERS)
    rows = frame(spark, [tx(1), tx(2, user=None), tx(3, user="U9")])
    assert validation.orphans(rows, users, "user_id").count() == 2
    counts = validation.referential_integrity(rows, users, spark.createDataFrame([], schemas.PRODUCTS), spark.createDataFrame([], schemas.MERCHANTS)).first()
    assert (counts.nb_refs_user_id_inexistant, counts.nb_refs_product_id_inexistant) == (2, 3)


def test_enrich_keeps_rows_and_breaks_ties(spark):
    users = spark.createDataFrame([("U1", 25, 1.0, "c", "s", ["a"], "d")], schemas.USERS)
    items = spark.createDataFrame([("P1", "pen", "pens", 1.0, "M1", 4.0, 3)], schemas.PRODUCTS)
    shops = spark.createDataFrame([("M1", "shop", "x", "north", 0.1, "d")], schemas.MERCHANTS)
    rows = frame(spark, [tx(2), tx(1), tx(3, user=None)])
    out = enrich.enrich(rows, users, items, shops)
    assert len(out.columns) == 31 and out.count() == 3
    got = {r.transaction_id: (r.transaction_rank, r.transaction_count, r.age_group) for r in out.collect()}
    assert got == {"T1": (1, 2, None), "T2": (2, 2, None), "T3": (1, 1, None)}
    assert sorted(map(str, out.collect())) == sorted(map(str, enrich.enrich(rows, users, items, shops, broadcast=True).collect()))


def test_seven_day_frame_bounds(spark):
    rows = [tx(1, ts="20240101000000"), tx(2, ts="20240108000000"), tx(3, user="U2", ts="20240101000000"), tx(4, user="U2", ts="20240108000001"), tx(5, user="U3", ts=None), tx(6, user="U3", ts=None)]
    got = {r.transaction_id: r for r in windows.window_analysis(frame(spark, rows).withColumn("day_period", F.lit("Night"))).collect()}
    assert got["T2"].active_days_7d == 2 and got["T2"].cumulative_amount_7d == 20.0
    assert got["T4"].active_days_7d == 1 and got["T4"].cumulative_amount_7d == 10.0
    assert got["T5"].active_days_7d == 0 and got["T5"].cumulative_amount_7d == 20.0


def dimensions(spark):
    users = spark.createDataFrame([("A", 30, 1.0, "c", "s", ["a"], "d"), ("B", 50, 1.0, "c", "s", ["a"], "d")], schemas.USERS)
    items = spark.createDataFrame([("P1", "pen", "pens", 1.0, "M1", 4.0, 3)], schemas.PRODUCTS)
    shops = spark.createDataFrame([("M1", "shop", "x", "north", 0.1, "d")], schemas.MERCHANTS)
    return users, items, shops


def test_active_days_equal_the_plain_form(spark):
    rng = random.Random(3)
    stamp = lambda: f"202401{rng.randint(1, 25):02d}{rng.randint(0, 23):02d}{rng.choice([0, 30]):02d}00"
    rows = [tx(i, user=rng.choice(["A", "B", None]), ts=stamp() if i % 20 else rng.choice([None, "bad"])) for i in range(300)]
    df = with_dates(frame(spark, rows))
    span = Window.partitionBy("user_id").orderBy(F.unix_timestamp("transaction_datetime")).rangeBetween(-604800, 0)
    plain = df.withColumn("n", F.size(F.collect_set("transaction_date").over(span))).select("transaction_id", "n")
    for hot in ([], ["A", None]):
        both = windows.window_analysis(frame(spark, rows), hot_users=hot).join(plain, "transaction_id")
        assert both.count() == 300 and both.where("n <> active_days_7d").count() == 0


def with_dates(df):
    return df.withColumn("transaction_datetime", tf.parse_prefix(F.col("timestamp"))).withColumn("transaction_date", F.to_date("transaction_datetime"))


def test_seven_day_sums_equal_the_sliding_frame(spark):
    rng = random.Random(23)
    stamp = lambda: rng.choice([None, "bad", f"{rng.choice([1969, 2024])}01{rng.randint(1, 28):02d}{rng.choice([0, 0, 5, 23]):02d}{rng.choice([0, 59]):02d}{rng.choice([0, 59]):02d}"])
    rows = [tx(i, user=rng.choice(["A", "B", None]), amount=rng.choice([None, 1e17, float("nan"), 0.00000001]) if i % 40 == 0 else round(rng.uniform(0, 9), 8), ts=stamp()) for i in range(900)]
    rows += [tx(1000 + i, user="A", ts=f"202401{d}000000") for i, d in enumerate(("04", "11", "18", "25"))]  # a span begins on these
    df = with_dates(frame(spark, rows))
    sliding = Window.partitionBy("user_id").orderBy(F.unix_timestamp("transaction_datetime")).rangeBetween(-604800, 0)
    want = {r.transaction_id: r.s for r in df.withColumn("s", F.sum("amount").over(sliding)).collect()}
    got = {r.transaction_id: r.cumulative_amount_7d for r in windows.window_analysis(frame(spark, rows), hot_users=[]).collect()}
    assert len(got) == len(rows)
    for k, v in want.items():
        assert got[k] == (pytest.approx(v, rel=1e-13, nan_ok=True) if v is not None else None), k


def test_many_rows_of_one_user_and_second_are_dealt_among_tasks(spark, monkeypatch):
    rows = with_dates(frame(spark, [tx(i, user=None, ts="20240105120000" if i % 3 else f"202401{i % 28 + 1:02d}0000{i % 60:02d}") for i in range(3000)]))
    monkeypatch.setattr(long_users, "hot_keys", lambda df, keys: skew.hot_keys(df, keys, least=50))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = long_users.seven_days(rows, 604_800)
        tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 3000 and max(tasks) < 3 * 3000 / 16, tasks
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def exchanges(df):
    """Shuffles of the physical plan, by what they are dealt by."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_windows_add_no_shuffle_to_enrichment(spark, monkeypatch):
    tables = [frame(spark, [tx(i, user=f"U{i % 5}") for i in range(50)]), *dimensions(spark)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        enriched = enrich.enrich(*tables, hot={})
        flagged = windows.detect_suspicious(windows.window_analysis(enriched, hot_users=[]), hot_users=[])
        before, after = exchanges(enriched), exchanges(flagged)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(before) == 6 and len(after) == len(before)


AMOUNTS = [None, float("nan"), 20.0, 1e17, 2.00000098, 0.00000001]


@pytest.mark.parametrize("amounts", [AMOUNTS, AMOUNTS[2:]])
@pytest.mark.parametrize("splits", [2, 7, 200])
def test_hot_users_give_the_same_rows_as_all_others(spark, monkeypatch, splits, amounts):
    monkeypatch.setattr(long_users, "SPLITS", splits)
    rng = random.Random(17)
    stamp = lambda: rng.choice([None, "bad", "20240115120000", f"2024{rng.randint(1, 3):02d}{rng.randint(1, 28):02d}{rng.randint(0, 23):02d}{rng.choice([0, 30]):02d}{rng.choice([0, 1]):02d}"])
    near = lambda: f"202401{rng.randint(1, 28):02d}{rng.randint(0, 23):02d}3000"
    rows = [tx(i, user=rng.choice(["A", "A", "B", None, None, "C"]), amount=rng.choice([*amounts, round(rng.uniform(1, 500), 8)] if i % 9 == 0 else [round(rng.uniform(1, 500), 8)]), ts=stamp() if rng.random() < 0.3 else near()) for i in range(500)]
    found = skew.hot_keys(frame(spark, rows), enrich.KEYS, least=100)
    assert set(found["user_id"]) == {"A", None} == set(long_users.hot_users(frame(spark, rows), least=100)) and found["merchant_id"]["M1"] == 5

    def run(hot):
        enriched = enrich.enrich(frame(spark, rows), *dimensions(spark), hot=hot)
        users = list(hot.get("user_id", ()))
        out = windows.detect_suspicious(windows.window_analysis(enriched, hot_users=users), hot_users=users)
        return [(f.name, f.dataType) for f in out.schema.fields], {r.transaction_id: r.asDict() for r in out.collect()}

    (names, want), (same, got) = run({}), run(found)
    assert sorted(map(str, names)) == sorted(map(str, same)) and set(got) == set(want) and len(want) == 500
    for k, row in want.items():
        for c, v in row.items():
            # The order of summing may change the last digits of a double, nothing else.
            assert got[k][c] == (pytest.approx(v, rel=1e-13, nan_ok=True) if isinstance(v, float) else v), (k, c)


def test_hot_keys_are_dealt_among_tasks(spark):
    rows = [tx(i, user=None if i % 2 else f"U{i}", merchant="M1" if i % 3 else f"M{i}") for i in range(4000)]
    users = spark.createDataFrame([(f"U{i}", 30, 1.0, "c", "s", ["a"], "d") for i in range(0, 4000, 2)], schemas.USERS)
    _, items, shops = dimensions(spark)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hot = skew.hot_keys(frame(spark, rows), enrich.KEYS, least=50)
        assert set(hot["user_id"]) == {None} and set(hot["merchant_id"]) == {"M1"}
        for df in (enrich.joined(frame(spark, rows), users, items, shops, hot=hot), enrich.enrich(frame(spark, rows), users, items, shops, hot=hot), validation.orphans(frame(spark, rows), users, "user_id", hot)):
            total = df.count()
            tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert max(tasks) < 3 * total / 16, tasks
        assert enrich.joined(frame(spark, rows), users, items, shops, hot=hot).exceptAll(enrich.joined(frame(spark, rows), users, items, shops)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_orphan_counts_shuffle_no_transactions(spark):
    empty = [spark.createDataFrame([], s) for s in (schemas.USERS, schemas.PRODUCTS, schemas.MERCHANTS)]
    rows = frame(spark, [tx(i, user=None if i % 2 else "U1", product=f"P{i % 3}") for i in range(2000)])
    found = validation.referential_integrity(rows, *empty)
    assert tuple(found.first()) == (2000, 2000, 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = validation.referential_integrity(rows, *empty)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Transactions are scanned once, and counted before anything is shuffled.
    assert len(re.findall(r"Scan ExistingRDD\[transaction_id", plan)) == 1
    left = plan[: plan.index("Scan ExistingRDD[transaction_id")]
    assert "partial_count(1)" in left[left.rindex("Exchange hashpartitioning") :]


def test_suspicion_flags(spark):
    rows = [tx(1, ts="20240101120000"), tx(2, ts="20240101120459", amount=30.0), tx(3, ts="20240101120959", amount=60.01), tx(4, ts="20240101120959", amount=1.0, pay="Crypto")]
    df = tf.with_time_features(frame(spark, rows))
    got = {r.transaction_id: r for r in windows.detect_suspicious(windows.window_analysis(df)).collect()}
    assert [got[f"T{i}"].previous_transaction_less_than_5min for i in (1, 2, 3, 4)] == [0, 1, 0, 1]
    assert [got[f"T{i}"].amount_above_300_percent for i in (1, 2, 3)] == [0, 0, 1]
    assert got["T4"].crypto_payment == 1 and got["T4"].is_suspicious == 1


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 7, 23, 400])
@pytest.mark.parametrize("kind", ["equal", "half", "mixed"])
def test_exact_ntile_equals_ntile(spark, n, kind):
    rng = random.Random(n)
    value = {"equal": lambda i: 1, "half": lambda i: i % 2, "mixed": lambda i: rng.choice([None, rng.randint(0, 9)])}[kind]
    df = spark.createDataFrame([(f"u{i}", value(i)) for i in range(n)], "u string, m int")
    got = {r.u: r.m_score for r in ranking.exact_ntile(df, 5, ["m"], "u").collect()}
    want = {r.u: r.t for r in df.withColumn("t", F.ntile(5).over(Window.orderBy("m", "u"))).collect()}
    assert got == want


def test_three_metrics_are_ranked_in_one_shuffle(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(f"u{i}", rng.randint(0, 5), rng.choice([None, rng.random()]), rng.randint(0, 1 << 40)) for i in range(500)], "u string, a int, b double, c long")
    got = ranking.exact_ntile(df, 5, ["a", "b", "c"], "u")
    assert got.columns == ["u", "a", "b", "c", "a_score", "b_score", "c_score"]
    want = df.select("*", *[F.ntile(5).over(Window.orderBy(m, "u")).alias(f"{m}_score") for m in "abc"])
    assert got.count() == 500 and got.exceptAll(want).count() == 0
    assert got._jdf.queryExecution().executedPlan().toString().count("Window [row_number()") == 1


def test_a_merchant_of_two_names_has_one_suspicious_rate(spark):
    rows = [("M1", "a", "x", "n", 0.1, f"U{i}", 10.0, "Adulte", int(i < 2)) for i in range(3)] + [("M1", "b", "x", "n", 0.1, "U1", 5.0, None, 0), (None, None, None, None, None, "U1", 5.0, None, 1)]
    flagged = spark.createDataFrame(rows, "merchant_id string, merchant_name string, merchant_category string, region string, commission_rate double, user_id string, amount double, age_group string, is_suspicious int")
    report = merchants.merchant_report_with_suspicion(flagged)
    assert [(r.merchant_name, r.total_revenue, r.sales_Adulte, r.suspicious_transaction_rate) for r in report.collect()] == [("a", 30.0, 30.0, 50.0), ("b", 5.0, 0.0, 50.0)]
    assert merchants.merchant_report(flagged.drop("is_suspicious")).columns == merchants.REPORT
    kpi = merchants.global_kpi_by_customer(merchants.by_customer(flagged))
    assert kpi.first() == merchants.global_kpi(flagged).first()
    assert merchants.global_kpi_by_customer(merchants.by_customer(flagged), formatted=True).first() == merchants.global_kpi_formatted(flagged).first()


def test_the_report_with_suspicion_enriches_once(spark, sf_dir):
    plan = registry.merchant_report_with_suspicion(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_id#") > 0 and len(re.findall(r"Relation \[event_id", plan)) == 1


def test_digest_of_rows(spark):
    kind = "a string, b double, c int"
    rows = [("x", 1.005, 1), (None, float("nan"), None), ("x", 1.005, 1)]
    one, two = (content_digest(spark.createDataFrame(r, kind)).first() for r in (rows, rows[::-1]))
    assert one == two and one.rows == 3
    assert content_digest(spark.createDataFrame([], kind)).first() == (0, "0")
    assert content_digest(spark.createDataFrame([("x", 1.0, 1)], kind)).first() != content_digest(spark.createDataFrame([("x", 1.01, 1)], kind)).first()


def test_rfm_rule_order(spark):
    cases = [((5, 5, 5), "Champions"), ((3, 4, 3), "Clients fidèles"), ((4, 2, 5), "Nouveaux"), ((2, 3, 1), "À risque"), ((1, 1, 1), "Perdus"), ((3, 3, 3), "Clients fidèles")]
    df = spark.createDataFrame([c for c, _ in cases], "r int, f int, m int")
    assert [x.s for x in df.select(rfm.segment(F.col("r"), F.col("f"), F.col("m")).alias("s")).collect()] == [s for _, s in cases]


def test_null_region_has_no_share(spark):
    df = spark.createDataFrame([("c", None, 5.0), ("c", "north", 5.0), ("d", "north", 15.0), (None, "north", 1.0)], "merchant_category string, region string, amount double")
    got = {(r.merchant_category, r.region): r.category_share_percent for r in products.category_region(df).collect()}
    assert got == {("c", None): None, ("c", "north"): 25.0, ("d", "north"): 75.0}


def test_cohorts(spark):
    rows = [tx(1, "A", 10.0, "20240105000000"), tx(2, "A", 5.0, "20240401000000"), tx(3, "B", 1.0, "20240120000000"), tx(4, None, 9.0, "20240120000000"), tx(5, "C", 9.0, "bad")]
    out = cohorts.cohort_analysis(frame(spark, rows))
    assert [(str(r.cohort_month), r.period_index, r.cohort_size, r.active_users, r.retention_rate) for r in out.collect()] == [("2024-01-01", 0, 2, 2, 100.0), ("2024-01-01", 3, 2, 1, 50.0)]
    assert cohorts.best_cohort_at(out).count() == 1


def test_merchant_report_columns(spark, sf_dir):
    report = registry.merchant_report(spark, sf_dir)
    assert report.columns == merchants.REPORT


def test_jobs_end_to_end(spark, tmp_path, sf_dir):
    tables = {n: fixtures.table(spark, sf_dir, "tx_dirty" if n == "transactions" else n) for n in io.VALIDATED}
    io.write_csv(tables["transactions"], f"{tmp_path}/in", "transactions")
    tables["users"].write.json(f"{tmp_path}/in/users")
    tables["products"].write.parquet(f"{tmp_path}/in/products")
    io.write_csv(tables["merchants"], f"{tmp_path}/in", "merchants")
    paths = {n: f"{tmp_path}/in/{n}" for n in io.VALIDATED}
    jobs.run_mode(spark, "ingestion", paths, f"{tmp_path}/out")
    jobs.run_mode(spark, "transformation", paths, f"{tmp_path}/out")
    assert io.read_enriched(spark, f"{tmp_path}/out").count() == io.read_validated(spark, f"{tmp_path}/out")["transactions"].count()
    jobs.run_mode(spark, "wide_transformation", paths, f"{tmp_path}/out")
    assert io.read_wide(spark, f"{tmp_path}/out").count() == io.read_enriched(spark, f"{tmp_path}/out").count()
    jobs.run_mode(spark, "analytics", paths, f"{tmp_path}/out")
    valid = io.read_validated(spark, f"{tmp_path}/out")
    for name, df in jobs.run_analytics(io.read_enriched(spark, f"{tmp_path}/out"), valid["transactions"], valid["users"]).items():
        written = spark.read.parquet(f"{tmp_path}/out/{name}_parquet")
        assert written.columns == df.columns and content_digest(written).first() == content_digest(df).first() == content_digest(io.read_csv(spark, f"{tmp_path}/out/{name}", df.schema)).first()
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    with pytest.raises(ValueError):
        jobs.run_mode(spark, "none", paths, f"{tmp_path}/out")


def test_comparison_variants_agree(spark, tmp_path, sf_dir):
    tables = {n: fixtures.table(spark, sf_dir, "tx_line" if n == "transactions" else n) for n in io.VALIDATED}
    jobs.run_comparison(tables, str(tmp_path))
    for name in ("global_kpi", "merchant_performance", "cohort_analysis"):
        plain, fast = (spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/{v}/{name}") for v in jobs.VARIANTS)
        assert plain.count() > 0 and content_digest(plain).first() == content_digest(fast).first()


def test_each_variant_enriches_once(spark, tmp_path, monkeypatch):
    tables = {"transactions": frame(spark, [tx(i, user=f"U{i % 3}") for i in range(20)]), **dict(zip(("users", "products", "merchants"), dimensions(spark)))}
    plans, enriched = [], jobs.run_transformation
    monkeypatch.setattr(jobs, "run_transformation", lambda *a: plans.append(a[1]) or enriched(*a))
    seen = []
    monkeypatch.setattr(io, "write_csv", lambda df, path, name: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())))
    jobs.run_comparison(tables, str(tmp_path))
    assert plans == [False, True] and len(seen) == 6
    assert all("transaction_id" not in plan for _, plan in seen)  # made from what is stored, not from transactions


def duck(sf_dir):
    con = duckdb.connect()
    for name in fixtures._BASE:
        con.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", ["run_modes", "comparison_merchant_performance", "rfm", "merchant_report_with_suspicion", "window_analysis", "quality_report"])
def test_results_equal_duckdb(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck(sf_dir).sql(registry.oracle_sql()[name])
    assert set(got.columns) == set(want.columns)
    order = sorted(got.columns)
    text = lambda row: tuple("null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)
    rows = want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()
    assert sorted(map(text, got.select(*order).collect())) == sorted(map(text, rows))


def test_every_query_has_a_name_in_both(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_large_dimensions_are_not_broadcast(spark):
    df = spark.range(10)
    assert "broadcast" in enrich.broadcast_if_small(df, 10)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in enrich.broadcast_if_small(df, 9)._jdf.queryExecution().toString().lower()
    assert enrich.is_small(df, 10, 80) and not enrich.is_small(df, 10, 79)  # {"id":0} has 8 bytes
    assert enrich.is_small(df.where("id < 0"), 0, 0)


def test_formatted_totals_are_exact(spark):
    amounts = [1e13 + 0.25, 0.005, 0.005, -1e13, 0.1, 0.2] * 3 + [None]  # added as doubles, in any order, other cents come out
    columns = [*[F.lit("M").alias(k) for k in merchants._KEYS[:-1]], F.lit(0.1).alias("commission_rate"), "user_id", "amount", F.lit("Adulte").alias("age_group")]
    rows = spark.createDataFrame([(f"U{i}", a) for i, a in enumerate(amounts)], "user_id string, amount double").select(*columns)
    odd = rows.unionByName(rows.limit(1).withColumn("amount", F.lit(float("inf"))))
    con = duckdb.connect()
    con.sql("create table enriched (user_id varchar, amount double)")
    con.executemany("insert into enriched values (?, ?)", [[f"U{i}", a] for i, a in enumerate(amounts)])
    for df, total, mean in ((rows, "1.68", "0.09"), (odd, "∞", "∞"), (rows.where("false"), None, None)):
        got = merchants.global_kpi_formatted(df).first()
        assert (got[0], got[3]) == (total, mean) and merchants.global_kpi_by_customer(merchants.by_customer(df), formatted=True).first() == got
    assert tuple(merchants.global_kpi_formatted(rows).first()) == con.sql(registry._KPI_FORMATTED_SQL).fetchall()[0]


def test_reports_of_narrow_rows_equal_those_of_enriched_ones(spark):
    """Keys that dimensions repeat, that they lack and that are null among them."""
    rng = random.Random(3)
    pick = lambda letter: rng.choice([None, *[f"{letter}{i}" for i in range(6)]])
    lines = frame(spark, [tx(i, pick("U"), rng.choice([None, 1.5, 20.25]), f"202401050{i % 10}0000", pick("M"), pick("P"), rng.choice(["CARD", None])) for i in range(300)])
    users = spark.createDataFrame([(f"U{i}", a, 1.0, "c", "s", ["x"], "2024-01-01") for i, a in ((0, 20), (1, 30), (2, 50), (2, 70), (3, 20), (3, 20), (4, None))], schemas.USERS)
    items = spark.createDataFrame([(f"P{i}", n, "c", 1.0, "M1", r, k) for i, n, r, k in ((0, "a", 4.5, 3), (1, "b", 2.0, 7), (1, "b", 3.0, 5), (2, "c", 1.0, 1), (2, "d", None, None), (3, None, 5.0, 2))], schemas.PRODUCTS)
    shops = spark.createDataFrame([(f"M{i}", n, c, g, 0.25, "2015-01-01") for i, n, c, g in ((0, "a", "x", "n"), (1, "b", "x", "s"), (1, "b", "x", "s"), (2, "c", "y", None), (2, "d", "y", "n"), (3, "e", None, "n"))], schemas.MERCHANTS)
    full, timed = enrich.enrich(lines, users, items, shops, hot={}), enrich.timed(lines, users, items, shops)
    no_items = enrich.as_often(enrich.as_often(lines, users, "user_id"), shops, "merchant_id")
    no_shops = enrich.as_often(enrich.as_often(lines, users, "user_id"), items, "product_id")
    report = merchants.report_by_customer(merchants.by_customer(enrich.aged(lines, users, items, hot={})), shops)
    same = {
        "ranking": (merchants.merchant_revenue_ranking(full), merchants.merchant_revenue_ranking(timed)),
        "kpi": (merchants.global_kpi(full), merchants.global_kpi(timed)),
        "period": (products.payment_period(full), products.payment_period(timed)),
        "top": (products.top_products(full, 20), products.top_products_of(no_items, items, 20)),
        "shares": (products.category_region(full), products.category_region_of(no_shops, shops)),
        "report": (merchants.merchant_report(full), report),
    }
    for name, (wide, narrow) in same.items():
        assert wide.columns == narrow.columns and wide.count() > 0, name
        assert sorted(map(repr, wide.collect())) == sorted(map(repr, narrow.collect())), name


def test_reports_without_a_dimension_join_none(spark, sf_dir):
    plan = lambda name: registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert all("c_custkey" not in plan(n) and "p_partkey" not in plan(n) and "s_suppkey" not in plan(n) for n in ("payment_period", "merchant_revenue_ranking", "global_kpi_formatted"))
    assert all("c_custkey" not in plan(n) for n in ("top_products", "category_region")) and "p_partkey" not in plan("merchant_report")


def test_comparison_moves_and_stores_no_column_of_merchants(spark, tmp_path, monkeypatch):
    lines = frame(spark, [tx(i, user=f"U{i % 3}", merchant=f"M{i % 2}") for i in range(20)])
    users, items, shops = dimensions(spark)
    shops = shops.unionByName(shops).unionByName(shops.limit(1).withColumn("name", F.lit("other")))  # a merchant in three rows, two of them equal
    kept, store = [], jobs.stored
    monkeypatch.setattr(jobs, "stored", lambda df, tag: kept.append((tag, df.columns)) or store(df, tag))
    jobs.run_comparison({"transactions": lines, "users": users, "products": items, "merchants": shops}, str(tmp_path))
    assert [set(c) & {"merchant_name", "merchant_category", "region", "commission_rate"} for tag, c in kept if tag == "customers"] == [set(), set()]
    full = enrich.enrich(lines, users, items, shops, hot={})
    for variant in jobs.VARIANTS:
        read = lambda name, like: io.read_csv(spark, f"{tmp_path}/{variant}/{name}", like.schema)
        for name, want in (("global_kpi", merchants.global_kpi(full)), ("merchant_performance", merchants.merchant_report(full))):
            assert sorted(map(repr, read(name, want).collect())) == sorted(map(repr, want.collect()))


def test_the_comparison_reads_transactions_once(spark, tmp_path, monkeypatch):
    lines = frame(spark, [tx(i) for i in range(5)])
    kept, store = [], jobs.stored
    monkeypatch.setattr(jobs, "stored", lambda df, tag: kept.append((tag, df._jdf.queryExecution().optimizedPlan().toString())) or store(df, tag))
    jobs.run_comparison({"transactions": lines, **dict(zip(("users", "products", "merchants"), dimensions(spark)))}, str(tmp_path))
    assert kept[0][0] == "lines" and all("lines-" in plan or "parquet" in plan.lower() for tag, plan in kept[1:]) and len(kept) == 4


def test_hot_keys_group_no_key_of_a_small_bucket(spark, monkeypatch):
    frame = spark.range(20_000).selectExpr("'U' || id % 9000 as user_id", "if(id % 2 = 0, null, 'P' || id) as product_id", "if(id % 3 = 0, 'M1', 'M' || id % 700) as merchant_id")
    asked, group = [], type(frame).groupBy
    monkeypatch.setattr(type(frame), "groupBy", lambda self, *cols: asked.append((cols, self.columns)) or group(self, *cols))
    assert skew.hot_keys(frame.select("user_id"), ["user_id"], least=500) == {"user_id": {}}
    assert [cols for cols, _ in asked] == [("_of", "_bucket")]
    for buckets in (1, 3, 4096):  # keys that share a bucket with hot ones are not hot
        monkeypatch.setattr(skew, "BUCKETS", buckets)
        found = skew.hot_keys(frame, enrich.KEYS, least=500)
        share = max(500, 20_000 // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
        want = {k: {r[0]: -(-r[1] // share) for r in frame.groupBy(k).count().collect() if r[1] > share} for k in enrich.KEYS}
        assert found == want and set(want["product_id"]) == {None} and set(want["merchant_id"]) == {"M1"}


def test_small_dimensions_are_joined_after_the_shuffle_by_user(spark):
    rows = frame(spark, [tx(i, user=f"U{i % 3}") for i in range(20)])
    users, items, shops = dimensions(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 1)
    try:
        plan = enrich.joined(rows, users, items, shops)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top, below = plan.split("SortMergeJoin", 1)
    assert top.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in below and "BroadcastHashJoin" not in below


def test_wide_form_joins_broadcast_dimensions_last(spark, monkeypatch):
    rows = frame(spark, [tx(i, user=f"U{i % 3}") for i in range(20)])
    users, items, shops = dimensions(spark)
    want = enrich.enrich_broadcast(rows, users, items, shops)
    monkeypatch.setattr(enrich, "is_small", lambda df, *_: "preferred_categories" in df.columns)  # users alone
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = enrich.enrich_broadcast(rows, users, items, shops)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.index("BroadcastHashJoin") < plan.index("SortMergeJoin")
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_supplier_like_tables_of_many_short_rows_are_small(spark):
    assert enrich.is_small(spark.range(300_000).select("id"))


def test_enriched_csv_is_compressed_and_read_back(spark, tmp_path):
    enriched = enrich.enrich(frame(spark, [tx(i, user=f"U{i % 3}") for i in range(20)]), *dimensions(spark))
    io.write_enriched(enriched, str(tmp_path))
    files = [p.name for p in (tmp_path / "enriched_transactions_csv").iterdir() if p.name.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    back = io.read_csv(spark, f"{tmp_path}/enriched_transactions_csv", enriched.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, enriched.collect()))


def large_tables(spark):
    """Transactions with frequent, null and unknown keys, and dimensions of which a key comes twice and one is null."""
    rng = random.Random(5)
    rows = [tx(i, user=rng.choice(["A", "A", "B", None, "X"]), product=rng.choice(["P1", "P2", None, "PX"]), merchant=rng.choice(["M1", None, "M2"]), ts=rng.choice([None, "bad", "20240115120000", "20240210233000"])) for i in range(400)]
    users, items, shops = dimensions(spark)
    users = users.unionByName(users.limit(1).withColumn("city", F.lit("other"))).unionByName(users.limit(1).withColumn("user_id", F.lit(None).cast("string")))
    items = items.unionByName(items.withColumn("product_id", F.lit("P2")).withColumn("name", F.lit("ink")))
    return frame(spark, rows), users, items, shops


def exchanged(df):
    """The shuffles by a key of the physical plan."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


@pytest.fixture
def large(spark, monkeypatch):
    """No dimension is small, none is broadcast by its size."""
    monkeypatch.setattr(scratch, "BUCKETS", 3, raising=False)
    monkeypatch.setattr(enrich, "is_small", lambda df, *_: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_wide_form_of_large_dimensions_shuffles_no_rows(spark, request):
    tables = large_tables(spark)
    want = enrich.enrich_broadcast(*tables)
    columns, want = want.dtypes, sorted(map(str, want.collect()))
    request.getfixturevalue("large")
    got = enrich.enrich_broadcast(*tables)
    assert exchanged(got) == [] and got.dtypes == columns and sorted(map(str, got.collect())) == want


@pytest.mark.parametrize("least", [None, 50])
def test_enrichment_with_large_dimensions_shuffles_no_rows(spark, request, monkeypatch, least):
    tables = large_tables(spark)
    hot = skew.hot_keys(tables[0], enrich.KEYS, least=least) if least else None
    assert not hot or None in hot["user_id"] and "A" in hot["user_id"]
    # A user who comes twice gives equal times, so that only ranks among them may differ.
    rows = lambda df: sorted(map(str, df.drop("transaction_rank").collect()))
    plain = enrich.enrich(*tables)
    want, ranks = rows(plain), sorted((str(r.user_id), r.transaction_rank) for r in plain.collect())
    request.getfixturevalue("large")
    got = enrich.enrich(*tables, hot=hot)
    assert hot or exchanged(got) == []
    assert got.dtypes == plain.dtypes and rows(got) == want and sorted((str(r.user_id), r.transaction_rank) for r in got.collect()) == ranks


def files_below(*folders):
    return {os.path.join(r, f) for folder in folders for r, _, names in os.walk(folder) for f in names}


@pytest.mark.parametrize("name", ["roundtrip_enriched", "roundtrip_enriched_csv"])
def test_round_trips_leave_no_shuffle_files_and_no_intermediate_tables(spark, sf_dir, large, monkeypatch, name):
    folders = [scratch.scratch_dir(spark).removeprefix("file:"), *spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    before, during, write = files_below(*folders), [], io.write_csv
    monkeypatch.setattr(io, "write_csv", lambda df, *a: during.append(files_below(*folders) - before) or write(df, *a))
    out = registry.queries()[name](spark, sf_dir)
    assert during and not [f for f in during[0] if "/shuffle_" in f and f.endswith(".data")]
    assert all("/enriched_transactions/" in f for f in during[0] if f.endswith(".parquet")) and out.count() == 6000
