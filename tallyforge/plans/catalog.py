"""The registered queries of the order engine over the driver tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import checks, classify, lookups, profile, reports, views
from tallyforge.operators.money import mean_sql
from tallyforge.plans import models, stored
from tallyforge.plans.models import DIRTY_SQL, LINES_SQL, ORDERS_SQL, twin
from tallyforge.plans.twins import over_clean
from tallyforge.schemas import RAW_COLUMNS
from tallyforge.sources.scratch import materialize

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_TWINS: dict[str, str] = {}


def _register(name: str, sql: str | None):
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _TWINS[name] = sql
        return f

    return put


def _with(**parts: str) -> str:
    return "with " + ", ".join(f"{k} as ({v})" for k, v in parts.items()) + " "


O, L, D = twin(ORDERS_SQL), twin(LINES_SQL), twin(DIRTY_SQL)
CENTS = "cast(round(total_amount * 100) as bigint)"


def _sales_sql(by: str, expr: str, where: str = "true", tail: str = "", mean: bool = True) -> str:
    avg = f", {mean_sql('s', 'n')} as average_order_value" if mean else ""
    return _with(o=O, g=f"select {expr} as k, cast(count(*) as bigint) as n, cast(sum({CENTS}) as bigint) as s from o where {where} group by 1") + f"select k as {by}, n as order_count, cast(s / 100.0 as double) as total_sales{avg} from g {tail}"


# R1-R5: reports ------------------------------------------------------------------------------------------------------
_DAY = "substr(order_date, 1, 10)"


@_register("daily_sales", _sales_sql("date", _DAY))
def daily_sales(spark, sf_dir):
    return reports.daily_sales(models.orders(spark, sf_dir))


@_register("daily_sales_range", _sales_sql("date", _DAY, "order_date between '1996-03-01T00:00:00' and '1997-02-28T23:59:59'", "order by date limit 100"))
def daily_sales_range(spark, sf_dir):
    return reports.daily_sales(models.orders(spark, sf_dir), "1996-03-01", "1997-02-28", 100)


@_register("sales_by_city", _sales_sql("city", "city"))
def sales_by_city(spark, sf_dir):
    return reports.sales_by_city(models.orders(spark, sf_dir))


@_register("payment_method_analysis", _sales_sql("payment_method", "payment_method"))
def payment_method_analysis(spark, sf_dir):
    return reports.payment_method_analysis(models.orders(spark, sf_dir))


@_register("status_distribution", _sales_sql("status", "status", mean=False))
def status_distribution(spark, sf_dir):
    return reports.status_distribution(models.orders(spark, sf_dir))


_PRODUCTS = "select sku, arg_min(name, {'a': id_order, 'b': name}) as product_name, cast(sum(qty) as bigint) as total_quantity, cast(sum(cast(round(total * 100) as bigint)) as bigint) / 100.0 as total_sales, cast(count(*) as bigint) as order_count, cast(count(distinct id_order) as bigint) as distinct_order_count from l group by sku"


@_register("top_products", _with(l=L, p=_PRODUCTS) + "select sku, product_name, total_quantity, cast(total_sales as double) as total_sales, order_count from p order by total_sales desc, sku limit 10")
def top_products(spark, sf_dir):
    return reports.top_products(models.orders_with_items(spark, sf_dir))


# Q1-Q5: lookups ------------------------------------------------------------------------------------------------------
_FIRST = "(select {c} from o order by id_order limit 1)"


def _newest(columns: str, where: str, order: str = "order_date desc, id_order") -> str:
    return _with(o=O) + f"select {columns} from o where {where} order by {order} limit 20"


BY_CITY_STATUS = _newest("id_order, order_date, city, district, status, delivery_type, total_amount, quality_status", f"city = {_FIRST.format(c='city')} and status = {_FIRST.format(c='status')}")


@_register("orders_by_city_status", BY_CITY_STATUS)
def orders_by_city_status(spark, sf_dir):
    return lookups.orders_by_city_and_status(models.orders(spark, sf_dir))


@_register("orders_by_city_only", _newest("id_order, order_date, city, district, status, delivery_type, total_amount, quality_status", "city = 'NATION_2' and status = (select status from o where city = 'NATION_2' order by id_order limit 1)"))
def orders_by_city_only(spark, sf_dir):
    return lookups.orders_by_city_and_status(models.orders(spark, sf_dir), city="NATION_2")


BY_CUSTOMER = _newest("id_order, customer_id, customer_name, order_date, status, city, payment_status, total_amount, quality_status", f"customer_id = {_FIRST.format(c='customer_id')}")


@_register("customer_history", BY_CUSTOMER)
def customer_history(spark, sf_dir):
    return lookups.customer_order_history(models.orders(spark, sf_dir))


_MONTH = _FIRST.format(c="substr(order_date, 1, 7)")


BY_VALUE = _newest("id_order, order_date, customer_id, city, status, payment_method, total_amount", f"order_date >= {_MONTH} || '-01T00:00:00' and order_date <= strftime(last_day(cast({_MONTH} || '-01' as date)), '%Y-%m-%dT23:59:59') and total_amount >= round({_FIRST.format(c='total_amount')} * 0.5, 2)")


@_register("high_value_range", BY_VALUE)
def high_value_range(spark, sf_dir):
    return lookups.high_value_orders(models.orders(spark, sf_dir))


BY_SKU = _with(o=O, l=L) + "select o.id_order, order_date, city, status, total_amount, cast((select count(*) from l where l.id_order = o.id_order) as bigint) as n_items from o where id_order in (select id_order from l where sku = '7') order by order_date desc, id_order limit 20"


@_register("orders_by_sku", BY_SKU)
def orders_by_sku(spark, sf_dir):
    found = lookups.orders_by_product_sku(models.orders_with_items(spark, sf_dir), "7")
    return found.withColumn("n_items", F.size("items").cast("long")).drop("items")


@_register("settlement_audit", _newest("id_order, order_date, customer_id, city, payment_method, payment_status, payment_amount, total_amount", f"payment_status = {_FIRST.format(c='payment_status')} and payment_method = {_FIRST.format(c='payment_method')} and total_amount >= 1000", "total_amount desc, id_order"))
def settlement_audit(spark, sf_dir):
    orders = models.orders(spark, sf_dir).withColumn("corrections", F.array())
    return lookups.payment_settlement_audit(orders, min_amount=1000).drop("corrections")


@_register("settlement_by_method_only", _newest("id_order, order_date, customer_id, city, payment_method, payment_status, payment_amount, total_amount", "payment_method = '2-HIGH' and payment_status = (select payment_status from o where payment_method = '2-HIGH' order by id_order limit 1) and total_amount >= 0", "total_amount desc, id_order"))
def settlement_by_method_only(spark, sf_dir):
    orders = models.orders(spark, sf_dir).withColumn("corrections", F.array())
    return lookups.payment_settlement_audit(orders, method="2-HIGH").drop("corrections")


# C1-C19: cleaning ----------------------------------------------------------------------------------------------------
def _rule(spark: SparkSession, sf_dir: str, *columns: F.Column) -> DataFrame:
    return classify.clean(models.dirty(spark, sf_dir)).select("source_row_number", *columns)


def _audit(c: F.Column) -> F.Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws("|", x["rule_code"], x["field"], x["original_value"], x["corrected_value"], x["reason"])), ";")


def _joined(c: str) -> str:
    return f"coalesce(array_to_string({c}, ';'), '')"


@_register("clean_digits", over_clean(f"select source_row_number, order_id_val as value, order_id_err as error, {_joined('order_id_cor')} as audit from c"))
def clean_digits(spark, sf_dir):
    r = F.col("order_id__rule")
    return _rule(spark, sf_dir, r["value"].alias("value"), r["error"].alias("error"), _audit(r["corrections"]).alias("audit"))


@_register("clean_amount", over_clean(f"select source_row_number, delivery_cost_val as value, total_amount_val as stated, total_amount_err as error, {_joined('delivery_cost_cor')} as audit from c"))
def clean_amount(spark, sf_dir):
    a, t = F.col("delivery_cost__amount"), F.col("total_amount__amount")
    return _rule(spark, sf_dir, a["value"].alias("value"), t["value"].alias("stated"), t["error"].alias("error"), _audit(a["corrections"]).alias("audit"))


def _text_rule(name: str, column: str, value: str, audit: str, error: str = "cast(null as varchar)"):
    @_register(name, over_clean(f"select source_row_number, {value} as value, {error} as error, {_joined(audit)} as audit from c"))
    def query(spark, sf_dir):
        r = F.col(f"{column}__rule")
        return _rule(spark, sf_dir, r["value"].alias("value"), r["error"].alias("error"), _audit(r["corrections"]).alias("audit"))


_text_rule("clean_phone", "customer_phone", "phone_val", "phone_cor")
_text_rule("clean_email", "customer_email", "email_val", "email_cor", "email_err")
_text_rule("clean_date", "order_date", "iso", "date_cor", "date_err")
_text_rule("clean_text", "status", "status_val", "status_cor")
_text_rule("clean_city", "city", "city_val", "city_cor")


@_register("clean_items", over_clean("select source_row_number, items_err as error, cast(case when items_err is null then len(items) else 0 end as bigint) as n_items, case when items_err is null then array_to_string(list_transform(items, lambda i: i.sku || ':' || cast(cast(trunc(i.q) as bigint) as varchar)), ',') end as lines from c"))
def clean_items(spark, sf_dir):
    lines = F.expr("array_join(transform(__items, i -> concat(i.sku, ':', i.qty)), ',')")
    return _rule(spark, sf_dir, F.col("__items_error").alias("error"), F.when(F.col("__items").isNotNull(), F.size("__items")).otherwise(0).cast("long").alias("n_items"), lines.alias("lines"))


@_register("recalc_total", over_clean(f"select source_row_number, total_val as value, total_err as error, {_joined('total_cor')} as audit from c"))
def recalc_total(spark, sf_dir):
    r = F.col("__total")
    return _rule(spark, sf_dir, r["value"].alias("value"), r["error"].alias("error"), _audit(r["corrections"]).alias("audit"))


@_register("fix_negative_payment", over_clean(f"select source_row_number, pay_val as value, {_joined('pay_cor')} as audit from c"))
def fix_negative_payment(spark, sf_dir):
    r = F.col("__payment")
    return _rule(spark, sf_dir, r["value"].alias("value"), _audit(r["corrections"]).alias("audit"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(models.dirty(spark, sf_dir))


@_register("classify_orders", over_clean("select source_row_number, id_order, classification, array_to_string(error_codes, ',') as error_codes from c"))
def classify_orders(spark, sf_dir):
    return _classified(spark, sf_dir).select("source_row_number", "id_order", "classification", F.array_join("error_codes", ",").alias("error_codes"))


@_register("classify_counts", over_clean("select classification, cast(count(*) as bigint) as n from c group by 1"))
def classify_counts(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("classification").agg(F.count("*").alias("n"))


@_register("audit_trail", over_clean(f"select source_row_number, cast(len(corrections) as bigint) as n_corrections, {_joined('corrections')} as audit from c"))
def audit_trail(spark, sf_dir):
    return _classified(spark, sf_dir).select("source_row_number", F.size("corrections").cast("long").alias("n_corrections"), _audit(F.col("corrections")).alias("audit"))


@_register("validated_orders", over_clean("select source_row_number, id_order, iso as order_date, status_val as status, customer_id_val as customer_id, phone_val as customer_phone, email_val as customer_email, city_val as city, deliv as delivery_cost, pay_val as payment_amount, total_val as total_amount, classification as quality_status from c where classification <> 'quarantined'"))
def validated_orders(spark, sf_dir):
    rows = classify.validated(_classified(spark, sf_dir))
    return rows.select("source_row_number", "id_order", "order_date", "status", "customer_id", "customer_phone", "customer_email", "city", "delivery_cost", "payment_amount", "total_amount", "quality_status")


@_register("quarantined_orders", over_clean("select source_row_number, id_order, array_to_string(error_codes, ',') as error_codes, 'Record failed validation with errors: ' || array_to_string(error_codes, ', ') as quarantine_reason from c where classification = 'quarantined'"))
def quarantined_orders(spark, sf_dir):
    rows = classify.quarantined(_classified(spark, sf_dir))
    return rows.select("source_row_number", "id_order", F.array_join("error_codes", ",").alias("error_codes"), "quarantine_reason")


@_register("rule_distribution", over_clean("select split_part(x, '|', 1) as rule_code, cast(count(*) as bigint) as n from (select unnest(corrections) as x from c where classification = 'corrected') group by 1"))
def rule_distribution(spark, sf_dir):
    return checks.rule_distribution(_classified(spark, sf_dir))


@_register("quarantine_codes", over_clean("select x as error_code, cast(count(*) as bigint) as n from (select unnest(error_codes) as x from c) group by 1"))
def quarantine_codes(spark, sf_dir):
    return checks.error_distribution(_classified(spark, sf_dir))


@_register("consistency", over_clean("select cast(count(*) as bigint) as n_raw, cast(count(*) filter (classification = 'valid') as bigint) as n_valid, cast(count(*) filter (classification = 'corrected') as bigint) as n_corrected, cast(count(*) filter (classification = 'quarantined') as bigint) as n_quarantined, true as balanced from c"))
def consistency(spark, sf_dir):
    return checks.consistency(_classified(spark, sf_dir))


_BROKEN = """select source_row_number, array_to_string(list_sort(list_filter([case when id_order is null then 'missing_id_order' end, case when status_val = '' then 'empty_status' end,
  case when customer_id_val is null then 'missing_customer_id' end, case when iso is null then 'missing_order_date' end, case when total_val is null then 'missing_total_amount' end,
  case when items_err is not null then 'no_items' end, case when classification = 'quarantined' then 'unknown_classification' end], lambda x: x is not null)), ',') as violations from c"""


@_register("contract_violations", over_clean(_BROKEN))
def contract_violations(spark, sf_dir):
    return checks.contract_violations(_classified(spark, sf_dir)).select("source_row_number", F.array_join("violations", ",").alias("violations"))


# M1-M9: views --------------------------------------------------------------------------------------------------------
_DAILY = f"select date, n as order_count, cast(s / 100.0 as double) as total_sales, {mean_sql('s', 'n')} as average_order_value, min_order_date, max_order_date from (select substr(order_date, 1, 10) as date, cast(count(*) as bigint) as n, cast(sum({CENTS}) as bigint) as s, min(order_date) as min_order_date, max(order_date) as max_order_date from o group by 1)"
_PRODUCT_ROWS = "select sku, product_name, total_quantity, cast(total_sales as double) as total_sales, order_count, distinct_order_count from p"


@_register("mv_daily_full", _with(o=O) + _DAILY)
def mv_daily_full(spark, sf_dir):
    return views.daily_view(models.orders(spark, sf_dir))


@_register("mv_products_full", _with(l=L, p=_PRODUCTS) + _PRODUCT_ROWS)
def mv_products_full(spark, sf_dir):
    return views.product_view(models.orders_with_items(spark, sf_dir))


@_register("order_digest", _with(o=O, l=L) + "select o.id_order, substr(order_date, 1, 10) as order_date_day, coalesce(array_to_string(list_sort(list(distinct sku)), ','), '') as skus from o left join l using (id_order) group by all")
def order_digest(spark, sf_dir):
    d = views.order_digest(models.orders_with_items(spark, sf_dir))
    return d.select("id_order", "order_date_day", F.array_join("skus", ",").alias("skus"))


def before_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders with items before and after a change set: keys k % 10 = 3 are new; of those k % 100 = 13 moved by a day and
    swapped their first SKU, having been there before."""
    # written once, as both sides are read more than once
    after = materialize(models.orders_with_items(spark, sf_dir).withColumn("items", F.expr("array_sort(items)")), "orders")
    k = F.col("id_order").cast("long")
    moved = (k % 100) == 13
    new_date = F.date_format(F.to_timestamp("order_date") + F.expr("interval 1 day"), "yyyy-MM-dd'T'HH:mm:ss")
    swapped = F.expr("transform(items, (x, i) -> if(i = 0, named_struct('sku', 'SKU-NEW', 'name', x.name, 'qty', x.qty, 'unit_price', x.unit_price, 'total', x.total), x))")
    before = after.where((k % 10 != 3) | moved).withColumn("processed_at", F.lit("2024-01-01T00:00:00"))
    changed = F.when(k % 10 == 3, "2024-02-01T00:00:00").otherwise("2024-01-01T00:00:00")
    after = after.withColumns({"order_date": F.when(moved, new_date).otherwise(F.col("order_date")), "items": F.when(moved, swapped).otherwise(F.col("items")), "processed_at": changed})
    return before, after


AFTER_O = "select * replace (case when cast(id_order as bigint) % 100 = 13 then strftime(strptime(order_date, '%Y-%m-%dT%H:%M:%S') + interval 1 day, '%Y-%m-%dT%H:%M:%S') else order_date end as order_date) from o0"
AFTER_L = "select * replace (case when cast(id_order as bigint) % 100 = 13 and row_number() over (partition by id_order order by sku, name, qty, total / qty, total) = 1 then 'SKU-NEW' else sku end as sku) from l0"


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    before, after = before_after(spark, sf_dir)
    changed = views.changed_orders(after, "2024-01-01T00:00:00")
    days, skus = views.affected(changed, views.order_digest(before))
    return before, after, days, skus


DAILY_AFTER = _with(o0=O, o=AFTER_O) + _DAILY
PRODUCTS_AFTER = _with(l0=L, l=AFTER_L, p=_PRODUCTS) + _PRODUCT_ROWS


@_register("mv_daily_incremental", DAILY_AFTER)
def mv_daily_incremental(spark, sf_dir):
    before, after, days, _ = _groups(spark, sf_dir)
    return views.replace_groups(views.daily_view(before), "date", days, views.daily_view(after, days))


@_register("mv_products_incremental", PRODUCTS_AFTER)
def mv_products_incremental(spark, sf_dir):
    before, after, _, skus = _groups(spark, sf_dir)
    return views.replace_groups(views.product_view(before), "sku", skus, views.product_view(after, skus))


_CHANGED = "cast(id_order as bigint) % 10 = 3"
_MOVED = "cast(id_order as bigint) % 100 = 13"


@_register("affected_groups", _with(o0=O, l0=L, o=AFTER_O, l=AFTER_L) + f"select 'day' as kind, substr(order_date, 1, 10) as grp from o where {_CHANGED} union select 'day', substr(order_date, 1, 10) from o0 where {_MOVED} union select 'sku', sku from l where {_CHANGED} union select 'sku', sku from l0 where {_MOVED}")
def affected_groups(spark, sf_dir):
    _, _, days, skus = _groups(spark, sf_dir)
    return days.select(F.lit("day").alias("kind"), F.col("date").alias("grp")).union(skus.select(F.lit("sku"), "sku"))


@_register("watermark", "select strftime(max(ts), '%Y-%m-%dT%H:%M:%S') as last_processed_at, arg_max(cast(event_id as varchar), {'a': strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'b': cast(event_id as varchar)}) as last_id_run, cast(count(*) as bigint) as n_orders from events")
def watermark(spark, sf_dir):
    events = models.table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("processed_at"), F.col("event_id").cast("string").alias("id_run"))
    return views.watermark(events)


# P1-P7: profiles -----------------------------------------------------------------------------------------------------
_MISSING = " union all ".join(f"select '{c}' as field, count(*) filter (coalesce(trim({c}), '') = '') as m, count(*) as n from d" for c in RAW_COLUMNS)


@_register("profile_missing", _with(d=D) + f"select field, cast(m as bigint) as n_missing, round(m * 100 / greatest(n, 1), 4) as percent from ({_MISSING})")
def profile_missing(spark, sf_dir):
    return profile.missing_fields(models.dirty(spark, sf_dir))


@_register("profile_duplicates", _with(d=D, k="select count(*) as c from d group by order_id having count(*) > 1", r=f"select count(*) as c from d group by {', '.join(RAW_COLUMNS)} having count(*) > 1") + "select cast((select count(*) from k) as bigint) as n_keys, cast((select coalesce(sum(c - 1), 0) from k) as bigint) as extra_key_rows, cast((select count(*) from r) as bigint) as n_rows, cast((select coalesce(sum(c - 1), 0) from r) as bigint) as extra_rows")
def profile_duplicates(spark, sf_dir):
    return profile.duplicates(models.dirty(spark, sf_dir))


@_register("profile_negative_payments", over_clean("select cast(count(*) filter (starts_with(trim(payment_amount), '-') and contains(array_to_string(pay_cor, ';'), 'RULE_10')) as bigint) as n_matched, cast(count(*) filter (starts_with(trim(payment_amount), '-') and not contains(coalesce(array_to_string(pay_cor, ';'), ''), 'RULE_10')) as bigint) as n_unmatched from c"))
def profile_negative_payments(spark, sf_dir):
    return profile.negative_payments(_classified(spark, sf_dir))


@_register("profile_histogram", _with(o=O, b="select min(total_amount) as lo, (max(total_amount) - min(total_amount)) / 30 as w from o") + "select cast(least(floor((total_amount - lo) / w), 29) as int) as bin, cast(count(*) as bigint) as n from o, b group by 1")
def profile_histogram(spark, sf_dir):
    return profile.histogram(models.orders(spark, sf_dir))


@_register("profile_quartiles", _with(o=O) + "select min(total_amount) as least, quantile_disc(total_amount, 0.25) as q1, quantile_disc(total_amount, 0.5) as q2, quantile_disc(total_amount, 0.75) as q3, max(total_amount) as greatest from o")
def profile_quartiles(spark, sf_dir):
    return profile.quartiles(models.orders(spark, sf_dir))


@_register("profile_delivery_costs", over_clean("select deliv as value, cast(count(*) as bigint) as n, round(count(*) * 100 / sum(count(*)) over (), 4) as percent from c group by 1"))
def profile_delivery_costs(spark, sf_dir):
    return profile.value_counts(classify.clean(models.dirty(spark, sf_dir)).select(F.col("__delivery").alias("delivery_cost")), "delivery_cost")


@_register("profile_dates", over_clean("select case when list_contains(error_codes, 'INVALID_IMPOSSIBLE_DATE') then 'impossible' when len(date_cor) > 0 then 'repaired' else 'clean' end as date_class, cast(count(*) as bigint) as n from c group by 1"))
def profile_dates(spark, sf_dir):
    return profile.date_quality(classify.verdict(models.dirty(spark, sf_dir), "order_date__rule.error", "order_date__rule.corrections"))


@_register("profile_items", over_clean("select case when items_err = 'CORRUPTED_ITEMS_JSON' then 'corrupt' when items_err = 'EMPTY_ITEMS' then 'empty' else 'valid' end as items_class, cast(count(*) as bigint) as n from c group by 1"))
def profile_items(spark, sf_dir):
    return profile.items_quality(classify.verdict(models.dirty(spark, sf_dir), "__items_error"))


def queries() -> dict[str, Query]:
    return _QUERIES | {name: query for name, (query, _) in stored.registered().items()}


def oracle_sql() -> dict[str, str]:
    return _TWINS | {name: sql for name, (_, sql) in stored.registered().items()}
