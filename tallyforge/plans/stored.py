"""Registered queries that go through files and stores: landing, batch job, upserts, views and reports, each with its SQL twin.

Everything is written below a new scratch folder, from the driver tables at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import checks, classify, clusters, job, lookups, reports, store, views
from tallyforge.plans import models
from tallyforge.plans.models import DIRTY_SQL, LINES_SQL, ORDERS_SQL, twin
from tallyforge.plans.twins import over_clean
from tallyforge.schemas import RAW_COLUMNS
from tallyforge.sources import order_files
from tallyforge.sources.scratch import materialize, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
O, L, D = twin(ORDERS_SQL), twin(LINES_SQL), twin(DIRTY_SQL)
STAMP = "2025-01-01T00:00:00"


# IO1-IO5, IO10, P9, V1: files -----------------------------------------------------------------------------------------
#: Rows whose status is blanked, which no rule minds but the contract does.
BLANKED = "source_row_number % 97 = 5"


def _file(spark: SparkSession, sf_dir: str, blanked: bool = False) -> str:
    """The dirty rows as CSV files, in the order of their row numbers."""
    csv = f"{scratch_dir(spark)}/orders.csv"
    if blanked:
        rows = models.dirty_in_order(spark, sf_dir, numbered=True)
        rows = rows.withColumn("status", F.when(~F.expr(BLANKED), F.col("status"))).select(*RAW_COLUMNS)
    else:
        rows = models.dirty_in_order(spark, sf_dir)
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("compression", "gzip").csv(csv)
    return csv


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job.land(spark, _file(spark, sf_dir), scratch_dir(spark), "run-1", STAMP)


def row_numbers(spark, sf_dir):
    return _landed(spark, sf_dir).select("source_row_number", "order_id", "items_json")


def lineage_envelope(spark, sf_dir):
    root = scratch_dir(spark)
    job.land(spark, _file(spark, sf_dir), root, "run-1", STAMP)
    raw = spark.read.parquet(f"{root}/raw")
    return raw.select("source_row_number", "id_run", "source_file", "ingested_at", "engine_used", F.col("raw_record.customer_id").alias("customer_id"), F.size(F.array("raw_record.*")).alias("n_fields"))


def lineage_check(spark, sf_dir):
    return checks.lineage_check(_landed(spark, sf_dir))


def preview(spark, sf_dir):
    root = scratch_dir(spark)
    order_files.ingest(spark, _file(spark, sf_dir), f"{root}/raw", "run-1", STAMP)
    return order_files.preview(spark.read.parquet(f"{root}/raw")).select("source_row_number", "order_id", "status")


def file_sample(spark, sf_dir):
    out = f"{scratch_dir(spark)}/sample"
    order_files.sample(spark, _file(spark, sf_dir), out, 25)
    return order_files.numbered(order_files.scan(spark, out)).select("source_row_number", F.coalesce("order_id", F.lit("")).alias("order_id"), "city")


# IO7, IO11, C19, C20, V2, V5: the batch job ---------------------------------------------------------------------------
def _metrics(spark: SparkSession, done) -> DataFrame:
    rows = [("count", k, int(done[k])) for k in ("n_raw", "n_valid", "n_corrected", "n_quarantined")]
    for kind, field in (("count", "counters"), ("quarantine", "quarantine_counters"), ("rule", "rules"), ("error", "errors")):
        rows += [(kind, k, int(v)) for k, v in done[field].items()]
    return spark.createDataFrame(rows, "kind string, name string, n long")


def run_metrics(spark, sf_dir):
    return _metrics(spark, job.run(spark, _file(spark, sf_dir), scratch_dir(spark), "run-1", STAMP, "quarantine"))


def run_metrics_again(spark, sf_dir):
    """What a second run of the same file returns, some of whose rows break the contract."""
    csv, root = _file(spark, sf_dir, blanked=True), scratch_dir(spark)
    job.run(spark, csv, root, "run-1", STAMP, "quarantine")
    return _metrics(spark, job.run(spark, csv, root, "run-1", STAMP, "quarantine"))


def stored_balance(spark, sf_dir):
    """Where the rows of a file are, some of which break the contract: counted in the stores."""
    root = scratch_dir(spark)
    done = job.run(spark, _file(spark, sf_dir, blanked=True), root, "run-1", STAMP, "quarantine")
    good, bad = (t.read() for t in job.tables(spark, root))
    broken = F.array_contains("error_codes", checks.BROKEN)
    places = [
        spark.read.parquet(f"{root}/raw").select(F.lit("raw").alias("place")),
        good.select(F.lit("orders")),
        bad.select(F.when(broken, F.concat(F.lit("contract: "), F.element_at(F.split("quarantine_reason", ": "), -1))).otherwise("rules")),
    ]
    rows = places[0].union(places[1]).union(places[2]).groupBy("place").agg(F.count("*").alias("n"))
    superseded = done["n_valid"] + done["n_corrected"] - done["counters"]["inserted"]
    return rows.union(spark.createDataFrame([("superseded", superseded)], "place string, n long"))


def _twice(spark: SparkSession, sf_dir: str) -> tuple[store.Table, store.Table]:
    csv, root = _file(spark, sf_dir), scratch_dir(spark)
    for _ in range(2):
        job.run(spark, csv, root, "run-1", STAMP, "quarantine")
    return job.tables(spark, root)


def rerun_keeps_orders(spark, sf_dir):
    return _twice(spark, sf_dir)[0].read().select("id_order", "source_row_number", "status", "classification")


def quarantine_upsert(spark, sf_dir):
    return _twice(spark, sf_dir)[1].read().select("id_run", "source_row_number", F.array_join("error_codes", ",").alias("error_codes"))


def store_check(spark, sf_dir):
    return checks.store_check(_twice(spark, sf_dir)[0].read())


# IO6, C23: upserts ----------------------------------------------------------------------------------------------------
def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.validated(classify.classify(models.dirty(spark, sf_dir)))
    return materialize(rows.select("id_order", "source_row_number", "status"), "valid")


def upsert_last_wins(spark, sf_dir):
    rows, table = _valid(spark, sf_dir), store.Table(spark, f"{scratch_dir(spark)}/orders", ["id_order"])
    table.upsert(rows.where("source_row_number % 3 = 0"), order="source_row_number")
    table.upsert(rows.where("source_row_number % 2 = 0"), order="source_row_number")
    return table.read()


def upsert_counters(spark, sf_dir):
    rows = _valid(spark, sf_dir)
    table = store.Table(spark, f"{scratch_dir(spark)}/orders", ["id_order"])
    table.upsert(rows.where("source_row_number % 3 = 0"), order="source_row_number")
    counts = table.upsert(rows.where("source_row_number % 2 = 0"), order="source_row_number")
    return spark.createDataFrame([tuple(counts[k] for k in ("inserted", "updated", "unchanged"))], "inserted long, updated long, unchanged long")


_V = "v as (select id_order, source_row_number, status_val as status from c where classification <> 'quarantined')"
_ONE = "qualify row_number() over (partition by id_order order by {}source_row_number desc) = 1"
_UPSERT = over_clean(f", {_V} select id_order, source_row_number, status from v where source_row_number % 2 = 0 or source_row_number % 3 = 0 {_ONE.format('source_row_number % 2, ')}")
_COUNTERS = over_clean(f""", {_V}, o as (select * from v where source_row_number % 3 = 0 {_ONE.format('')}), i as (select * from v where source_row_number % 2 = 0), n as (select * from i {_ONE.format('')}),
  k as (select cast(count(*) as bigint) as inserted from n where id_order not in (select id_order from o))
  select inserted, cast((select count(*) from i) - inserted as bigint) as updated, cast((select count(*) from n join o using (id_order) where n.source_row_number = o.source_row_number) as bigint) as unchanged from k""")


# M9-M17, V3, V4: views and reports -------------------------------------------------------------------------------------
def _refreshed(spark: SparkSession, sf_dir: str, one: str | None = None, sides: tuple[DataFrame, DataFrame] | None = None) -> views.Views:
    """Views built over the orders before the change set and brought up to date after it: both, or one of them."""
    from tallyforge.plans.catalog import before_after

    before, after = sides or before_after(spark, sf_dir)
    v = views.Views(spark, f"{scratch_dir(spark)}/views")
    v.refresh(before, "full", STAMP)
    if one:
        v.refresh_one(after, one, "incremental", STAMP)
    else:
        v.refresh(after, "incremental", STAMP)
    return v


def mv_refresh_daily(spark, sf_dir):
    return _refreshed(spark, sf_dir).daily.read().select("date", "order_count", "total_sales", "average_order_value", "min_order_date", "max_order_date")


def mv_refresh_products(spark, sf_dir):
    return _refreshed(spark, sf_dir).products.read().select("sku", "product_name", "total_quantity", "total_sales", "order_count", "distinct_order_count")


def mv_refresh_one(spark, sf_dir):
    return views.read_daily(_refreshed(spark, sf_dir, "daily").daily.read(), "1996-01-01", "1996-12-31", 100).select("date", "order_count", "total_sales")


def mv_status(spark, sf_dir):
    orders = materialize(models.orders_with_items(spark, sf_dir), "orders")
    v = views.Views(spark, f"{scratch_dir(spark)}/views")
    first, again = v.refresh(orders, "full", STAMP), v.refresh(orders, "incremental", STAMP)
    now = v.status(orders)
    row = (now["status"], first["mode"], again["mode"], *[int(now["rows"][k]) for k in ("daily", "products", "digest", "orders")])
    return spark.createDataFrame([row], "status string, first_mode string, second_mode string, n_daily long, n_products long, n_digest long, n_orders long")


def orders_by_sku_indexed(spark, sf_dir):
    """Stored orders of one SKU by the index that the views keep, after an upsert and a refresh."""
    rows = materialize(models.orders_with_items(spark, sf_dir).withColumn("processed_at", F.when(F.col("id_order").cast("long") % 3 == 0, "2024-02-01T00:00:00").otherwise("2024-01-01T00:00:00")), "orders")
    root = scratch_dir(spark)
    orders, v = store.Table(spark, f"{root}/orders", ["id_order"]), views.Views(spark, f"{root}/views")
    for part in ("processed_at < '2024-02'", "processed_at > '2024-02'"):
        orders.upsert(rows.where(part))
        v.refresh(orders.read(), "incremental", STAMP)
    return lookups.orders_by_product_sku_indexed(orders, v.postings, "7").withColumn("n_items", F.size("items").cast("long")).drop("items")


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders along the curve, in small pages so that small tables have some to pass over."""
    orders = materialize(models.orders(spark, sf_dir), "orders")
    return clusters.write(orders, f"{scratch_dir(spark)}/clustered", per_page=500)


def orders_by_city_status_clustered(spark, sf_dir):
    return lookups.orders_by_city_and_status(_clustered(spark, sf_dir))


def customer_history_clustered(spark, sf_dir):
    return lookups.customer_order_history(_clustered(spark, sf_dir))


def high_value_range_clustered(spark, sf_dir):
    return lookups.high_value_orders(_clustered(spark, sf_dir))


def mv_recovered(spark, sf_dir):
    """Both views after a refresh that failed between them, and the one that completes it."""
    from tallyforge.plans.catalog import before_after

    class Stopped(views.Views):
        def _recompute_skus(self, *a):
            raise InterruptedError("between the views")

    before, after = before_after(spark, sf_dir)
    root = f"{scratch_dir(spark)}/views"
    views.Views(spark, root).refresh(before, "full", STAMP)
    try:
        Stopped(spark, root).refresh(after, "incremental", STAMP)
    except InterruptedError:
        pass
    v = views.Views(spark, root)
    failed = v.state()["status"]
    done = v.refresh(after, "incremental", STAMP)
    facts = (F.lit(failed).alias("failed_status"), F.lit(done["recovered"]).alias("recovered"))
    days = v.daily.read().select(F.lit("day").alias("kind"), F.col("date").alias("grp"), "order_count", "total_sales", *facts)
    return days.union(v.products.read().select(F.lit("sku"), "sku", "order_count", "total_sales", *facts))


def mv_top_products(spark, sf_dir):
    """The best sellers of the stored view, products without SKU left out."""
    rows = views.read_products(_refreshed(spark, sf_dir).products.read(), 25, unassigned=False)
    return rows.select("sku", "product_name", "total_quantity", "total_sales", "order_count", "distinct_order_count")


def view_equals_report(spark, sf_dir):
    orders = models.orders(spark, sf_dir)
    view, report = views.daily_view(orders), reports.daily_sales(orders)
    return view.select("date", F.col("total_sales").alias("in_view")).join(report.select("date", F.col("total_sales").alias("in_report")), "date", "full")


def views_equal_reports(spark, sf_dir):
    """Sales by day and by product in the stored views, refreshed by differences, and in the reports over the orders."""
    from tallyforge.plans.catalog import before_after

    before, orders = before_after(spark, sf_dir)
    v = _refreshed(spark, sf_dir, sides=(before, orders))
    named = lambda df, key, side: df.select(F.col(key).alias("grp"), F.col("total_sales").alias(f"in_{side}"))
    days = named(v.daily.read(), "date", "view").join(named(reports.daily_sales(orders), "date", "report"), "grp", "full")
    live = views.product_view(orders)
    return days.union(named(v.products.read(), "sku", "view").join(named(live, "sku", "report"), "grp", "full"))


def job_units(spark, sf_dir):
    """What the two scheduled units leave behind: the stored orders of a file, and the views and reports over them."""
    root = scratch_dir(spark)
    job.run(spark, _file(spark, sf_dir), root, "run-1", STAMP, "quarantine")
    job.refresh(spark, root, "set-1", STAMP)
    v = views.Views(spark, f"{root}/views")
    tables = {n: reports.published(spark, f"{root}/reports", n) for n in reports.REPORTS if n != "top_products"} | {"daily view": v.daily.read()}
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.sum("order_count").alias("n_orders"), F.sum(F.round(F.col("total_sales") * 100).cast("long")).alias("cents"))
        out = row if out is None else out.union(row)
    return out


def published_reports(spark, sf_dir):
    orders, root = models.orders_with_items(spark, sf_dir), f"{scratch_dir(spark)}/reports"
    reports.publish(materialize(orders, "orders"), root, "first")
    rows = [reports.published(spark, root, n).select(F.lit(n).alias("report"), "order_count") for n in reports.REPORTS if n != "top_products"]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("report").agg(F.count("*").alias("n_rows"), F.sum("order_count").alias("n_orders"))


def _named(**groups: str) -> str:
    return " union all ".join(f"select '{name}' as report, cast(count(distinct {expr}) as bigint) as n_rows, cast(count(*) as bigint) as n_orders from o" for name, expr in groups.items())


def registered() -> dict[str, tuple[Query, str]]:
    from tallyforge.plans.catalog import AFTER_L, AFTER_O, BY_CITY_STATUS, BY_CUSTOMER, BY_SKU, BY_VALUE, DAILY_AFTER, PRODUCTS_AFTER

    # the views' side from their definition, the reports' side from sums of orders and of lines
    sides = {
        "view": f"select date as grp, total_sales as in_view from ({DAILY_AFTER}) union all select sku, total_sales from ({PRODUCTS_AFTER})",
        "report": f"with o0 as ({O}), l0 as ({L}), o as ({AFTER_O}), l as ({AFTER_L}) select substr(order_date, 1, 10) as grp, cast(sum(cast(total_amount as decimal(18, 2))) as double) as in_report from o group by 1 union all select sku, cast(sum(cast(total as decimal(18, 2))) as double) from l group by 1",
    }
    cents = "cast(sum(cast(round(total_val * 100) as bigint)) as bigint) as cents"
    groups = {"daily_sales_summary": "substr(iso, 1, 10)", "sales_by_city": "city_val", "payment_method_analysis": "payment_method_val", "order_status_distribution": "status_val", "daily view": "substr(iso, 1, 10)"}
    units = " union all ".join(f"select '{n}' as name, cast(count(distinct {e}) as bigint) as n_rows, cast(count(*) as bigint) as n_orders, {cents} from s" for n, e in groups.items())
    quality = "select '{0}' as kind, split_part(x, '|', 1) as name, cast(count(*) as bigint) as n from (select unnest({1}) as x from c where classification = '{2}') group by 2"
    classes = " union all ".join(f"select 'count', 'n_{k}', cast(count(*) filter ({w}) as bigint) from c" for k, w in {"raw": "true", "valid": "classification = 'valid'", "corrected": "classification = 'corrected'", "quarantined": "classification = 'quarantined'"}.items())
    good = "from c where classification <> 'quarantined'"
    accepted = f"from c where classification <> 'quarantined' and not ({BLANKED})"
    broken = f"from c where classification <> 'quarantined' and {BLANKED}"
    # the cleaned rows of a file of which some are blanked, in place of those of ``c``
    blanked = f", b as (select * replace (case when {BLANKED} then 'quarantined' else classification end as classification, case when {BLANKED} and classification <> 'quarantined' then ['CONTRACT_VIOLATION'] else error_codes end as error_codes) from c) "
    again = f"""select 'count', 'inserted', cast(0 as bigint) union all select 'count', 'updated', cast(count(*) as bigint) {good} union all select 'count', 'unchanged', cast(count(distinct id_order) as bigint) {good}
      union all select 'quarantine', 'inserted', cast(0 as bigint) union all select 'quarantine', 'updated', cast(count(*) as bigint) from c where classification = 'quarantined' union all select 'quarantine', 'unchanged', cast(count(*) as bigint) from c where classification = 'quarantined'"""
    first = """select 'quarantine', 'inserted', cast(count(*) as bigint) from c where classification = 'quarantined' union all select 'quarantine', 'updated', cast(0 as bigint) union all select 'quarantine', 'unchanged', cast(0 as bigint)"""
    kept = f"select 'count', 'inserted', cast(count(distinct id_order) as bigint) {good} union all select 'count', 'updated', cast(count(*) - count(distinct id_order) as bigint) {good} union all select 'count', 'unchanged', cast(0 as bigint)"
    return {
        "row_numbers": (row_numbers, f"select cast(source_row_number as bigint) as source_row_number, order_id, items_json from ({D})"),
        "lineage_check": (lineage_check, f'select cast(min(n) as bigint) as "first", cast(max(n) as bigint) as "last", cast(count(n) as bigint) as n, cast(max(n) - min(n) + 1 - count(distinct n) as bigint) as gaps, cast(count(n) - count(distinct n) as bigint) as repeats from (select source_row_number as n from ({D}))'),
        "preview": (preview, f"select cast(source_row_number as bigint) as source_row_number, order_id, status from ({D}) where source_row_number <= 15"),
        "file_sample": (file_sample, f"select cast(source_row_number as bigint) as source_row_number, order_id, city from ({D}) where source_row_number <= 25"),
        "run_metrics": (run_metrics, over_clean(f"{quality.format('rule', 'corrections', 'corrected')} union all {quality.format('error', 'error_codes', 'quarantined')} union all {classes} union all {kept} union all {first}")),
        "run_metrics_again": (run_metrics_again, over_clean(blanked + f"{quality.format('rule', 'corrections', 'corrected')} union all {quality.format('error', 'error_codes', 'quarantined')} union all {classes} union all {again}".replace(" from c", " from b"))),
        "stored_balance": (stored_balance, over_clean(f"select 'raw' as place, cast(count(*) as bigint) as n from c union all select 'orders', cast(count(distinct id_order) as bigint) {accepted} union all select 'superseded', cast(count(*) - count(distinct id_order) as bigint) {accepted} union all select 'contract: empty_status', cast(count(*) as bigint) {broken} union all select 'rules', cast(count(*) as bigint) from c where classification = 'quarantined'")),
        "lineage_envelope": (lineage_envelope, f"select cast(source_row_number as bigint) as source_row_number, 'run-1' as id_run, 'orders.csv' as source_file, '{STAMP}' as ingested_at, 'spark' as engine_used, customer_id, cast(17 as int) as n_fields from ({D})"),
        "rerun_keeps_orders": (rerun_keeps_orders, over_clean(f"select id_order, source_row_number, status_val as status, classification {good} {_ONE.format('')}")),
        "quarantine_upsert": (quarantine_upsert, over_clean("select 'run-1' as id_run, source_row_number, array_to_string(error_codes, ',') as error_codes from c where classification = 'quarantined'")),
        "store_check": (store_check, over_clean(f", s as (select * {good} {_ONE.format('')}) select cast((select count(*) from (select id_order from s group by 1 having count(*) > 1)) as bigint) as repeated_keys, cast(count(*) filter (least(coalesce(deliv, 0), coalesce(pay_val, 0), coalesce(total_val, 0)) < 0) as bigint) as negative_money, cast(count(*) filter (id_order is null or id_order = '' or iso is null or customer_id_val is null or status_val = '' or total_val is null or items_err is not null or len(items) < 1) as bigint) as contract_failures from s")),
        "upsert_last_wins": (upsert_last_wins, _UPSERT),
        "upsert_counters": (upsert_counters, _COUNTERS),
        "mv_refresh_daily": (mv_refresh_daily, DAILY_AFTER),
        "mv_refresh_products": (mv_refresh_products, PRODUCTS_AFTER),
        "mv_refresh_one": (mv_refresh_one, f"select date, order_count, total_sales from ({DAILY_AFTER}) where date between '1996-01-01' and '1996-12-31' order by date limit 100"),
        "mv_status": (mv_status, f"with o as ({O}), l as ({L}) select 'IDLE' as status, 'full' as first_mode, 'NO_OP' as second_mode, cast(count(distinct substr(order_date, 1, 10)) as bigint) as n_daily, cast((select count(distinct sku) from l) as bigint) as n_products, cast(count(*) as bigint) as n_digest, cast(count(*) as bigint) as n_orders from o"),
        "orders_by_sku_indexed": (orders_by_sku_indexed, BY_SKU),
        "orders_by_city_status_clustered": (orders_by_city_status_clustered, BY_CITY_STATUS),
        "customer_history_clustered": (customer_history_clustered, BY_CUSTOMER),
        "high_value_range_clustered": (high_value_range_clustered, BY_VALUE),
        "mv_recovered": (mv_recovered, f"select 'day' as kind, date as grp, order_count, total_sales, 'IN_PROGRESS' as failed_status, true as recovered from ({DAILY_AFTER}) union all select 'sku', sku, order_count, total_sales, 'IN_PROGRESS', true from ({PRODUCTS_AFTER})"),
        "mv_top_products": (mv_top_products, f"select * from ({PRODUCTS_AFTER}) where sku is not null and sku <> '' order by total_sales desc, sku limit 25"),
        "view_equals_report": (view_equals_report, f"with o as ({O}) select substr(order_date, 1, 10) as date, cast(cast(sum(cast(round(total_amount * 100) as bigint)) as bigint) / 100.0 as double) as in_view, cast(sum(cast(total_amount as decimal(18, 2))) as double) as in_report from o group by 1"),
        "views_equal_reports": (views_equal_reports, f"select v.grp, in_view, in_report from ({sides['view']}) v join ({sides['report']}) r on v.grp = r.grp"),
        "job_units": (job_units, over_clean(f", s as (select * {good} {_ONE.format('')}) " + units)),
        "published_reports": (published_reports, f"with o as ({O}) " + _named(daily_sales_summary="substr(order_date, 1, 10)", sales_by_city="city", payment_method_analysis="payment_method", order_status_distribution="status")),
    }
