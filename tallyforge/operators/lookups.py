"""Five parameterised order lookups. Parameters that are left out are taken from the order with the least id, of those that
agree with the parameters given; that there is none is an error."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallyforge.operators.reports import check_day, check_limit
from tallyforge.operators.store import Table
from tallyforge.operators.views import PARTS
from tallyforge.sources.scratch import materialize


def _text(value: str | None, name: str) -> str | None:
    if value is not None and (not isinstance(value, str) or not value.strip()):
        raise ValueError(f"{name} must not be blank")
    return value


def _least(value: float | None, name: str) -> float | None:
    if value is not None and (isinstance(value, bool) or value < 0):
        raise ValueError(f"{name} must not be negative")
    return value


def sample_order(orders: DataFrame, *columns: str | Column, **given: str | None) -> Row:
    """``columns`` of the order with the least id among those that have the ``given`` values."""
    for name, value in given.items():
        if value is not None:
            orders = orders.where(F.col(name) == value)
    row = orders.orderBy("id_order").select(*columns).first()
    if row is None:
        raise ValueError(f"no order to take {', '.join(given) or 'defaults'} from; give all parameters")
    return row


def month_of(day: str) -> tuple[str, str]:
    """First and last moment of a day's month."""
    year, month = int(day[:4]), int(day[5:7])
    return f"{day[:7]}-01T00:00:00", f"{day[:7]}-{calendar.monthrange(year, month)[1]:02d}T23:59:59"


def _newest(rows: DataFrame, limit: int, *columns: str) -> DataFrame:
    return rows.select(*columns).orderBy(F.desc("order_date"), "id_order").limit(check_limit(limit))


def orders_by_city_and_status(orders: DataFrame, city: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    if _text(city, "city") is None or _text(status, "status") is None:
        city, status = sample_order(orders, "city", "status", city=city, status=status)
    found = orders.where((F.col("city") == city) & (F.col("status") == status))
    return _newest(found, limit, "id_order", "order_date", "city", "district", "status", "delivery_type", "total_amount", "quality_status")


def customer_order_history(orders: DataFrame, customer_id: str | None = None, limit: int = 20) -> DataFrame:
    if _text(customer_id, "customer_id") is None:
        customer_id = sample_order(orders, "customer_id")["customer_id"]
    found = orders.where(F.col("customer_id") == customer_id)
    return _newest(found, limit, "id_order", "customer_id", "customer_name", "order_date", "status", "city", "payment_status", "total_amount", "quality_status")


def high_value_orders(orders: DataFrame, start: str | None = None, end: str | None = None, min_total: float | None = None, limit: int = 20) -> DataFrame:
    """Bounds compare as text, both included; a bare end day is not widened."""
    if check_day(start, "start") is None or check_day(end, "end") is None or _least(min_total, "min_total") is None:
        row = sample_order(orders, "order_date", "total_amount")
        month = month_of(row["order_date"])
        start, end = start or month[0], end or month[1]
        min_total = round(row["total_amount"] * 0.5, 2) if min_total is None else min_total
    if start > end:
        raise ValueError("start is after end")
    found = orders.where(F.col("order_date").between(start, end) & (F.col("total_amount") >= min_total))
    return _newest(found, limit, "id_order", "order_date", "customer_id", "city", "status", "payment_method", "total_amount")


def orders_by_product_sku(orders: DataFrame, sku: str | None = None, limit: int = 20) -> DataFrame:
    if _text(sku, "sku") is None:
        sku = sample_order(orders.where(F.size("items") > 0), F.col("items")[0]["sku"].alias("sku"))["sku"]
    found = orders.where(F.array_contains(F.col("items.sku"), sku))
    return _newest(found, limit, "id_order", "order_date", "city", "status", "total_amount", "items")


def orders_by_product_sku_indexed(orders: Table, postings: Table, sku: str, limit: int = 20, parts: int = PARTS) -> DataFrame:
    """The same by the index of products that a refresh of the views keeps: of it, and of the stored orders, only the buckets
    that can hold the SKU and the orders found are read. As of the last refresh."""
    if _text(sku, "sku") is None:
        raise ValueError("sku must be given")
    wanted = orders.spark.createDataFrame([(sku, part) for part in range(parts)], "sku string, part int")
    index = postings.read()
    if index is None:
        raise ValueError("no index yet; refresh the views")
    newest = materialize(postings.read_by(wanted, index).select("id_order", "order_date").orderBy(F.desc("order_date"), "id_order").limit(check_limit(limit)), "found")
    found = orders.read_by(newest.select("id_order"), orders.read())
    return _newest(found, limit, "id_order", "order_date", "city", "status", "total_amount", "items")


def payment_settlement_audit(orders: DataFrame, status: str | None = None, method: str | None = None, min_amount: float = 0, limit: int = 20) -> DataFrame:
    if _text(status, "status") is None or _text(method, "method") is None:
        status, method = sample_order(orders, "payment_status", "payment_method", payment_status=status, payment_method=method)
    found = orders.where((F.col("payment_status") == status) & (F.col("payment_method") == method) & (F.col("total_amount") >= _least(min_amount, "min_amount")))
    columns = ("id_order", "order_date", "customer_id", "city", "payment_method", "payment_status", "payment_amount", "total_amount", "corrections")
    return found.select(*columns).orderBy(F.desc("total_amount"), "id_order").limit(check_limit(limit))
