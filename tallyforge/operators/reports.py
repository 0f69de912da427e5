"""Five sales reports over the clean orders, and their publication as a set."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.money import cents, mean, money
from tallyforge.sources.paths import exists
from tallyforge.sources.scratch import materialize


def check_limit(limit: int | None) -> int | None:
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        raise ValueError("limit must be a positive whole number")
    return limit


def check_day(value: str | None, name: str) -> str | None:
    """An ISO day or time as given; anything else is an error."""
    if value is not None:
        dt.datetime.fromisoformat(value) if value.strip() else (_ for _ in ()).throw(ValueError(f"{name} is blank"))
    return value


def in_range(orders: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """By text; a bare start day begins, a bare end day ends with the day's last second."""
    start, end = check_day(start, "start"), check_day(end, "end")
    first = f"{start}T00:00:00" if start and len(start) == 10 else start
    last = f"{end}T23:59:59" if end and len(end) == 10 else end
    if first and last and first > last:
        raise ValueError("start is after end")
    if first:
        orders = orders.where(F.col("order_date") >= first)
    return orders.where(F.col("order_date") <= last) if last else orders


def _measures() -> tuple[Column, Column]:
    return F.count("*").alias("order_count"), F.coalesce(F.sum(cents("total_amount")), F.lit(0)).alias("__s")


def _finished(sums: DataFrame, with_mean: bool = True) -> DataFrame:
    out = sums.withColumn("total_sales", money(F.col("__s")))
    if with_mean:
        out = out.withColumn("average_order_value", mean(F.col("__s"), F.col("order_count")))
    return out.drop("__s")


def _sales(orders: DataFrame, by: str, key: Column, with_mean: bool = True) -> DataFrame:
    return _finished(orders.groupBy(key.alias(by)).agg(*_measures()), with_mean)


def day() -> Column:
    return F.substring("order_date", 1, 10)


def daily_sales(orders: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    out = _sales(in_range(orders, start, end), "date", day()).orderBy("date")
    return out.limit(limit) if check_limit(limit) else out


def sales_by_city(orders: DataFrame) -> DataFrame:
    return _sales(orders, "city", F.col("city")).orderBy(F.desc("total_sales"), "city")


def payment_method_analysis(orders: DataFrame) -> DataFrame:
    return _sales(orders, "payment_method", F.col("payment_method")).orderBy(F.desc("total_sales"), "payment_method")


def status_distribution(orders: DataFrame) -> DataFrame:
    return _sales(orders, "status", F.col("status"), with_mean=False).orderBy(F.desc("order_count"), "status")


def product_sums(orders: DataFrame) -> DataFrame:
    """By SKU over all item lines: the name of the least order that has it, quantity, sales in cents, lines."""
    lines = orders.select("id_order", F.explode("items").alias("i")).select("id_order", "i.sku", "i.name", "i.qty", cents("i.total").alias("c"))
    return lines.groupBy("sku").agg(
        F.min_by("name", F.struct("id_order", "name")).alias("product_name"),
        F.sum("qty").alias("total_quantity"),
        F.sum("c").alias("__s"),
        F.count("*").alias("order_count"),
        F.count_distinct("id_order").alias("distinct_order_count"),
    )


def top_products(orders: DataFrame, limit: int = 10) -> DataFrame:
    """``order_count`` counts lines, as the report always has; the view adds distinct orders."""
    out = product_sums(orders).select("sku", "product_name", "total_quantity", money(F.col("__s")).alias("total_sales"), "order_count")
    return out.orderBy(F.desc("total_sales"), "sku").limit(check_limit(limit))


REPORTS: dict[str, Callable[..., DataFrame]] = {
    "daily_sales_summary": daily_sales,
    "sales_by_city": sales_by_city,
    "payment_method_analysis": payment_method_analysis,
    "order_status_distribution": status_distribution,
    "top_products": top_products,
}
#: The reports over whole orders: what they group by, whether they have a mean, and their order.
_GROUPED = {
    "daily_sales_summary": ("date", True, F.asc, "date"),
    "sales_by_city": ("city", True, F.desc, "total_sales"),
    "payment_method_analysis": ("payment_method", True, F.desc, "total_sales"),
    "order_status_distribution": ("status", False, F.desc, "order_count"),
}


def grouped_sums(orders: DataFrame) -> DataFrame:
    """Counts and sums by day, city, payment method and status in one pass: ``by`` tells which, ``key`` the group."""
    names = [by for by, *_ in _GROUPED.values()]
    rows = orders.withColumn("date", day()).select(*names, "total_amount")
    sums = rows.groupingSets([[F.col(c)] for c in names], *names).agg(F.grouping_id().alias("g"), *_measures())
    # bits of the grouping id mark the columns that a row is not grouped by
    whole = (1 << len(names)) - 1
    own = {c: F.col("g") == F.lit(whole - (1 << (len(names) - 1 - i))) for i, c in enumerate(names)}
    pick = lambda value: F.coalesce(*[F.when(cond, value(c)) for c, cond in own.items()])
    return sums.select(pick(F.lit).alias("by"), pick(F.col).alias("key"), "order_count", "__s")


def suite(orders: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """All five reports: four from one scan of the orders' own columns, and the products from their items."""
    sums = materialize(grouped_sums(orders), "sums")
    out = {}
    for name, (by, with_mean, order, first) in _GROUPED.items():
        rows = sums.where(F.col("by") == by).select(F.col("key").alias(by), "order_count", "__s")
        out[name] = _finished(rows, with_mean).orderBy(order(first), by)
    return out | {"top_products": top_products(orders, top)}


def _current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    if not exists(spark, f"{root}/current"):
        return None
    row = spark.read.json(f"{root}/current", schema="n long, run string").orderBy(F.desc("n")).first()
    return (row["n"], row["run"]) if row else None


def publish(orders: DataFrame, root: str, run: str, top: int = 10) -> str:
    """Write all five reports below a folder of their own and only then append the row that makes them the current set; rows are
    numbered and never overwritten, so a failure at any point leaves the last good set current."""
    spark = orders.sparkSession
    last = _current(spark, root)
    n = last[0] + 1 if last else 1
    for name, df in suite(orders, top).items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/{n}-{run}/{name}")
    spark.createDataFrame([(n, run)], "n long, run string").coalesce(1).write.mode("append").json(f"{root}/current")
    return run


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    current = _current(spark, root)
    if current is None:
        raise ValueError("no reports are published yet")
    return spark.read.parquet(f"{root}/runs/{current[0]}-{current[1]}/{name}")
