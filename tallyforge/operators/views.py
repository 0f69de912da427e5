"""Summary views over the clean orders, refreshed in full or by what changed.

An incremental refresh takes the orders stamped after the watermark and, from the digest, what the same orders held when they
were last counted. The difference of the two, signed, is added to the groups it belongs to: counts, sums and, as the pairs
of product and order come and go one by one, distinct orders. Only where a group's least or greatest may have left, a day's
first or last time or the order that names a product, is the group looked up again, in an index of the days' times or of the
products' orders; neither the orders nor other groups are read for that.

All sets stay DataFrames; the driver sees counts and one state row. The state names pending groups before anything changes
and moves the watermark last. A refresh that failed is completed by the next: differences may then have been added or not, so
the pending groups are recomputed whole from the orders; a full refresh that failed is run in full again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.money import cents, mean, money
from tallyforge.operators.reports import check_limit, day, product_sums
from tallyforge.operators.store import Table
from tallyforge.sources.paths import exists
from tallyforge.sources.scratch import job_scratch, materialize


def _stamps(df: DataFrame, refreshed_at: str, mode: str, watermark: str | None) -> DataFrame:
    return df.select("*", F.lit(refreshed_at).alias("refreshed_at"), F.lit(mode).alias("refresh_mode"), F.lit(watermark).cast("string").alias("watermark_processed_at"))


def daily_view(orders: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Sales by day with first and last order time; only ``days`` (date) if given."""
    rows = orders.select(day().alias("date"), "order_date", cents("total_amount").alias("c"))
    if days is not None:
        rows = rows.join(days, "date", "left_semi")
    sums = rows.groupBy("date").agg(F.count("*").alias("order_count"), F.sum("c").alias("s"), F.min("order_date").alias("min_order_date"), F.max("order_date").alias("max_order_date"))
    return sums.select("date", "order_count", money(F.col("s")).alias("total_sales"), mean(F.col("s"), F.col("order_count")).alias("average_order_value"), "min_order_date", "max_order_date")


def product_view(orders: DataFrame, skus: DataFrame | None = None) -> DataFrame:
    """Sales by SKU with distinct orders; only ``skus`` (sku) if given."""
    if skus is not None:
        lines = orders.select("id_order", F.explode("items").alias("i")).join(skus.select(F.col("sku").alias("__sku")), F.col("i.sku") == F.col("__sku"), "left_semi")
        orders = lines.select("id_order", F.array("i").alias("items"))
    out = product_sums(orders)
    return out.select("sku", "product_name", "total_quantity", money(F.col("__s")).alias("total_sales"), "order_count", "distinct_order_count")


def order_digest(orders: DataFrame) -> DataFrame:
    """What each order belonged to when it was last counted, and what it added there: its time and amount, and for each
    SKU its name, quantity, sales and item lines."""
    items = F.coalesce(F.col("items"), F.array().cast(orders.schema["items"].dataType))
    skus = F.array_sort(F.array_distinct(items["sku"]))

    def share(sku: F.Column) -> F.Column:
        own = F.filter(items, lambda i: i["sku"].eqNullSafe(sku))
        total = lambda value: F.aggregate(F.transform(own, lambda i: F.coalesce(value(i), F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
        return F.struct(sku.alias("sku"), F.array_min(own["name"]).alias("name"), total(lambda i: i["qty"]).alias("qty"), total(lambda i: cents(i["total"])).alias("cents"), F.size(own).cast("long").alias("n_lines"))

    held = orders.select("id_order", day().alias("order_date_day"), skus.alias("skus"), "processed_at", "id_run", "order_date", cents("total_amount").alias("cents"), F.transform(skus, share).alias("lines"))
    return held


def whole_digest(rows: DataFrame) -> DataFrame:
    """Digests that were moved without the columns that the others tell."""
    return rows.select("id_order", day().alias("order_date_day"), F.transform("lines", lambda x: x["sku"]).alias("skus"), "processed_at", "id_run", "order_date", "cents", "lines")


#: A group of an index is dealt to so many places, as one day or product may hold a third of all orders.
PARTS = 16


def _part() -> F.Column:
    return F.pmod(F.xxhash64("id_order"), F.lit(PARTS)).cast("int").alias("part")


def day_times(digest: DataFrame) -> DataFrame:
    """The index of days: the time of each order."""
    return digest.select(F.col("order_date_day").alias("date"), _part(), "id_order", "order_date")


def product_orders(digest: DataFrame) -> DataFrame:
    """The index of products: the orders that hold one, when, and under what name."""
    return digest.select("id_order", "order_date", F.explode("lines").alias("l")).select("l.sku", _part(), "id_order", "order_date", "l.name")


def _signed(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))


def daily_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """By day, from the digests of changed orders: what count and cents grow by, and the least and greatest of the times that
    came and of those that went."""
    times = _signed(new, old).groupBy(F.col("order_date_day").alias("date"), "order_date").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("cents")).alias("c"))
    ends = lambda side, cond: (F.min(F.when(cond, F.col("order_date"))).alias(f"{side}_least"), F.max(F.when(cond, F.col("order_date"))).alias(f"{side}_greatest"))
    return times.groupBy("date").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), *ends("came", F.col("n") > 0), *ends("went", F.col("n") < 0))


def product_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """By SKU, from the digests of changed orders: what quantity, cents, lines and distinct orders grow by, the least order that
    has it now and its name, and the least order that had it and has not."""
    lines = _signed(new, old).select("sign", "id_order", F.explode("lines").alias("l")).select("sign", "id_order", "l.*")
    signed = lambda c: F.sum(F.col("sign") * F.col(c)).alias(c)
    pairs = lines.groupBy("sku", "id_order").agg(F.sum("sign").alias("orders"), signed("qty"), signed("cents"), signed("n_lines"), F.max(F.when(F.col("sign") > 0, F.col("name"))).alias("name"), F.max("sign").alias("has"))
    came = F.when(F.col("has") > 0, F.struct("id_order", "name"))
    return pairs.groupBy("sku").agg(*[F.sum(c).alias(c) for c in ("orders", "qty", "cents", "n_lines")], F.min(came).alias("came"), F.min(F.when(F.col("has") < 0, F.col("id_order"))).alias("went"))


def watermark(orders: DataFrame) -> DataFrame:
    """One row: newest stamp, its run, number of orders."""
    return orders.agg(F.max("processed_at").alias("last_processed_at"), F.max_by("id_run", F.struct("processed_at", "id_run")).alias("last_id_run"), F.count("*").alias("n_orders"))


def changed_orders(orders: DataFrame, since: str | None) -> DataFrame:
    return orders if since is None else orders.where(F.col("processed_at") > since)


def affected(changed: DataFrame, digest: DataFrame, pending_days: DataFrame | None = None, pending_skus: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Days and SKUs that changed orders belong to now or belonged to, and those still pending."""
    now = order_digest(changed)
    before = digest.join(changed.select("id_order"), "id_order", "left_semi")
    days, skus = (part.select(F.col("order_date_day").alias("date")) for part in (now, before)), (part.select(F.explode("skus").alias("sku")) for part in (now, before))
    days, skus = next(days).union(next(days)), next(skus).union(next(skus))
    days = days if pending_days is None else days.union(pending_days)
    skus = skus if pending_skus is None else skus.union(pending_skus)
    return days.distinct(), skus.distinct()


def replace_groups(view: DataFrame, key: str, groups: DataFrame, recomputed: DataFrame) -> DataFrame:
    """``view`` with the affected groups taken out and those that still have rows put back."""
    return view.join(groups, key, "left_anti").unionByName(recomputed)


def deleted_groups(view: DataFrame, key: str, groups: DataFrame, recomputed: DataFrame) -> DataFrame:
    return view.join(groups, key, "left_semi").join(recomputed.select(key), key, "left_anti").select(key)


def read_daily(view: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    rows = view
    if start:
        rows = rows.where(F.col("date") >= start[:10])
    if end:
        rows = rows.where(F.col("date") <= end[:10])
    rows = rows.orderBy("date")
    return rows.limit(limit) if check_limit(limit) else rows


def read_products(view: DataFrame, limit: int = 10, unassigned: bool = True) -> DataFrame:
    """Best sellers; ``unassigned`` keeps the group of the empty SKU."""
    rows = view if unassigned else view.where(F.col("sku").isNotNull() & (F.col("sku") != ""))
    return rows.orderBy(F.desc("total_sales"), "sku").limit(check_limit(limit))


#: The stored product view also has the order that names the product.
_NAMED_BY = "named_by"


def _stored_products(orders: DataFrame, skus: DataFrame | None = None) -> DataFrame:
    """The product view with the least order of each product."""
    lines = orders.select("id_order", F.explode("items").alias("i"))
    if skus is not None:
        lines = lines.join(skus.select(F.col("sku").alias("__sku")), F.col("i.sku") == F.col("__sku"), "left_semi")
    return product_view(orders, skus).join(lines.groupBy("i.sku").agg(F.min("id_order").alias(_NAMED_BY)), "sku")


def products_of(digest: DataFrame, skus: DataFrame | None = None) -> DataFrame:
    """The same from the digests of all orders, where an order's lines of one product are summed already: an order counts once
    in each of its lines, so nothing but sums by product is moved. Only ``skus`` (sku) if given; few of them pick the lines,
    many of them the sums."""
    sums = digest.select("id_order", F.explode("lines").alias("l")).groupBy("l.sku").agg(
        F.min("id_order").alias(_NAMED_BY), F.min_by("l.name", "id_order").alias("product_name"), F.sum("l.qty").alias("total_quantity"), F.sum("l.cents").alias("s"), F.sum("l.n_lines").alias("order_count"), F.count("*").alias("distinct_order_count"),
    )
    if skus is not None:
        sums = sums.join(skus, "sku", "left_semi")
    return sums.select("sku", "product_name", "total_quantity", money(F.col("s")).alias("total_sales"), "order_count", "distinct_order_count", _NAMED_BY)


class Views:
    """The stored views below ``root`` and their refresh."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root
        self.daily, self.products, self.digest = Table(spark, f"{root}/daily", ["date"], buckets), Table(spark, f"{root}/products", ["sku"], buckets), Table(spark, f"{root}/digest", ["id_order"], buckets)
        self.times = Table(spark, f"{root}/times", ["date", "part", "id_order"], buckets, by=["date", "part"])
        self.postings = Table(spark, f"{root}/postings", ["sku", "part", "id_order"], buckets, by=["sku", "part"])

    def state(self) -> dict:
        if not exists(self.spark, f"{self.root}/state"):
            return {"n": 0, "status": "UNINITIALIZED"}
        row = self.spark.read.json(f"{self.root}/state", schema="n long, state string").orderBy(F.desc("n")).first()
        return {"n": row["n"], **json.loads(row["state"])}

    def _save(self, **state) -> None:
        n = self.state()["n"] + 1
        self.spark.createDataFrame([(n, json.dumps(state))], "n long, state string").coalesce(1).write.mode("append").json(f"{self.root}/state")

    def _pending(self, n: int, what: str, key: str) -> DataFrame | None:
        path = f"{self.root}/pending/n={n}/{what}"
        return self.spark.read.schema(f"{key} string").parquet(path) if exists(self.spark, path) else None

    def _changed(self, orders: DataFrame, since: str) -> tuple[DataFrame, DataFrame]:
        """The digests of the changed orders, now and as they were last counted; written. Of the digest only the buckets of
        those orders are read."""
        new = materialize(order_digest(changed_orders(orders, since)), "changed")
        with self.digest.found_by(new, new) as old:
            return new, materialize(old, "before")

    def _affected(self, new: DataFrame, old: DataFrame, pending: int | None, n: int) -> tuple[DataFrame, DataFrame]:
        """The days and SKUs that changed orders belong to or belonged to, and those still pending; written as pending ``n``."""
        both = new.unionByName(old)
        out = []
        for what, key, groups in (("days", "date", both.select(F.col("order_date_day").alias("date"))), ("skus", "sku", both.select(F.explode("skus").alias("sku")))):
            more = self._pending(pending, what, key) if pending is not None else None
            (groups if more is None else groups.union(more)).distinct().write.mode("overwrite").parquet(f"{self.root}/pending/n={n}/{what}")
            out.append(self._pending(n, what, key))
        return out[0], out[1]

    def refresh(self, orders: DataFrame, mode: str = "incremental", at: str = "1970-01-01T00:00:00") -> dict:
        """Bring both views up to date. Returns the mode run, whether it recovered a failed one, and counts of groups."""
        if mode not in ("full", "incremental"):
            raise ValueError("mode is full or incremental")
        with job_scratch(self.spark):
            return self._refresh(orders, mode, at)

    def _refresh(self, orders: DataFrame, mode: str, at: str) -> dict:
        state = self.state()
        since = state.get("watermark")
        recovered = state["status"] in ("IN_PROGRESS", "PENDING_JOINT")
        if mode == "full" or since is None or state.get("pending_full"):
            mark = watermark(orders).first()
            stamp = dict(watermark=mark["last_processed_at"], last_id_run=mark["last_id_run"], n_orders=mark["n_orders"], refreshed_at=at)
            self._save(status="IN_PROGRESS", watermark=since, mode="full", pending=None, pending_full=True)
            self._build(orders, at, stamp["watermark"], mark["n_orders"])
            self._save(status="IDLE", mode="full", pending=None, **stamp)
            return {"mode": "full", "recovered": recovered}
        new, old = self._changed(orders, since)
        pending, mark = state.get("pending"), watermark(new).first()
        stamp = dict(watermark=mark["last_processed_at"] or since, last_id_run=mark["last_id_run"] or state.get("last_id_run"), n_orders=orders.count(), refreshed_at=at)
        if pending is None and not mark["n_orders"]:
            self._save(status="IDLE", mode="NO_OP", pending=None, **stamp)
            return {"mode": "NO_OP", "recovered": recovered}
        n = state["n"] + 1
        days, skus = self._affected(new, old, pending, n)
        self._save(status="IN_PROGRESS", watermark=since, mode="incremental", pending=n)
        changed = (new, old) if pending is None else None
        gone = {"days": self._recompute_days(orders, days, at, stamp["watermark"], changed), "skus": self._recompute_skus(orders, skus, at, stamp["watermark"], changed)}
        if pending is not None:
            self._index(new, old)
        self.digest.upsert(new)
        self._save(status="IDLE", mode="incremental", pending=None, **stamp)
        return {"mode": "incremental", "recovered": recovered, "days": days.count(), "skus": skus.count(), "deleted": gone}

    def _build(self, orders: DataFrame, at: str, mark: str | None, n: int) -> None:
        """Everything anew; the products and the indexes from the digests."""
        self.daily.replace(_stamps(daily_view(orders), at, "full", mark))
        self.digest.replace(order_digest(orders).drop("order_date_day", "skus"), about=n, whole=whole_digest)
        digest = self.digest.read(order_digest(orders))
        self.products.replace(_stamps(products_of(digest), at, "full", mark))
        self.times.replace(day_times(digest), about=n)
        self.postings.replace(product_orders(digest), about=digest.agg(F.coalesce(F.sum(F.size("skus")), F.lit(0))).first()[0])

    def _index(self, new: DataFrame, old: DataFrame) -> None:
        """What changed orders hold now in both indexes, in place of what they held. Run again, it changes nothing."""
        for table, rows in ((self.times, day_times), (self.postings, product_orders)):
            table.upsert(rows(new), delete=rows(old))

    def _put(self, table: Table, key: str, made: DataFrame, groups: DataFrame) -> int:
        """Put the groups that have rows in place and take the others out; returns how many of these there were."""
        made = materialize(made, "made")
        gone = deleted_groups(table.read_by(groups, made), key, groups, made).count()
        table.upsert(made, delete=groups)
        return gone

    def _add_to_days(self, new: DataFrame, old: DataFrame, days: DataFrame, at: str, mark: str | None) -> int:
        """Add the signed differences to the days; first and last times that may have left are looked up in the index of times."""
        change = daily_changes(new, old)
        self.times.upsert(day_times(new), delete=day_times(old))
        had = self.daily.read_by(days, self.daily.read()).select("date", "order_count", cents("total_sales").alias("s"), "min_order_date", "max_order_date")
        both = change.join(had, "date", "left")
        lost = (F.col("went_least") <= F.col("min_order_date")) | (F.col("went_greatest") >= F.col("max_order_date"))
        both = materialize(both.withColumn("lost", F.coalesce(lost, F.lit(False))), "days_changed")
        again = both.where("lost").select("date", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        with self.times.found_by(again, self.times.read()) as rows:
            found = materialize(rows.groupBy("date").agg(F.min("order_date").alias("found_least"), F.max("order_date").alias("found_greatest")), "found")
        count, total = F.coalesce("order_count", F.lit(0)) + F.col("n"), F.coalesce("s", F.lit(0)) + F.col("c")
        least = F.when(F.col("lost"), F.col("found_least")).otherwise(F.least("min_order_date", "came_least"))
        greatest = F.when(F.col("lost"), F.col("found_greatest")).otherwise(F.greatest("max_order_date", "came_greatest"))
        made = both.join(found, "date", "left").where(count > 0)
        made = made.select("date", count.alias("order_count"), money(total).alias("total_sales"), mean(total, count).alias("average_order_value"), least.alias("min_order_date"), greatest.alias("max_order_date"))
        return self._put(self.daily, "date", _stamps(made, at, "incremental", mark), days)

    def _add_to_skus(self, new: DataFrame, old: DataFrame, skus: DataFrame, at: str, mark: str | None) -> int:
        """Add the signed differences to the products; where the order that names one may have left, the next is looked up in the
        index of products."""
        change = product_changes(new, old)
        self.postings.upsert(product_orders(new), delete=product_orders(old))
        had = self.products.read_by(skus, self.products.read()).select("sku", "product_name", "total_quantity", cents("total_sales").alias("s"), "order_count", "distinct_order_count", _NAMED_BY)
        both = materialize(change.join(had, "sku", "left").withColumn("lost", F.coalesce(F.col("went") <= F.col(_NAMED_BY), F.lit(False))), "products_changed")
        again = both.where("lost").select("sku", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        with self.postings.found_by(again, self.postings.read()) as rows:
            found = materialize(rows.groupBy("sku").agg(F.min(F.struct("id_order", "name")).alias("found")), "found")
        stands = F.col(_NAMED_BY).isNotNull() & (F.col("came").isNull() | (F.col(_NAMED_BY) < F.col("came.id_order")))
        named = F.when(F.col("lost"), F.col("found")).when(stands, F.struct(F.col(_NAMED_BY).alias("id_order"), F.col("product_name").alias("name"))).otherwise(F.col("came"))
        plus = lambda c, d: F.coalesce(c, F.lit(0)) + F.col(d)
        made = both.join(found, "sku", "left").where(plus("distinct_order_count", "orders") > 0).withColumn("named", named)
        made = made.select("sku", F.col("named.name").alias("product_name"), plus("total_quantity", "qty").alias("total_quantity"), money(plus("s", "cents")).alias("total_sales"), plus("order_count", "n_lines").alias("order_count"), plus("distinct_order_count", "orders").alias("distinct_order_count"), F.col("named.id_order").alias(_NAMED_BY))
        return self._put(self.products, "sku", _stamps(made, at, "incremental", mark), skus)

    def _recompute_days(self, orders: DataFrame, days: DataFrame, at: str, mark: str | None, changed: tuple[DataFrame, DataFrame] | None = None) -> int:
        """Bring the days up to date: by the differences between the changed orders' digests if given, else from the orders."""
        if changed:
            return self._add_to_days(*changed, days, at, mark)
        return self._put(self.daily, "date", _stamps(daily_view(orders, days), at, "incremental", mark), days)

    def _recompute_skus(self, orders: DataFrame, skus: DataFrame, at: str, mark: str | None, changed: tuple[DataFrame, DataFrame] | None = None) -> int:
        """The same for products."""
        if changed:
            return self._add_to_skus(*changed, skus, at, mark)
        return self._put(self.products, "sku", _stamps(products_of(order_digest(orders), skus), at, "incremental", mark), skus)

    def refresh_one(self, orders: DataFrame, view: str, mode: str = "incremental", at: str = "1970-01-01T00:00:00") -> dict:
        """Bring one view up to date. The watermark stays, and the changed groups stay pending for the joint refresh."""
        if view not in ("daily", "products") or mode not in ("full", "incremental"):
            raise ValueError("view is daily or products, mode is full or incremental")
        with job_scratch(self.spark):
            return self._refresh_one(orders, view, mode, at)

    def _refresh_one(self, orders: DataFrame, view: str, mode: str, at: str) -> dict:
        state = self.state()
        since = state.get("watermark")
        if mode == "full" or since is None:
            made = daily_view(orders) if view == "daily" else _stored_products(orders)
            (self.daily if view == "daily" else self.products).replace(_stamps(made, at, "full", since))
            return {"mode": "full"}
        new, old = self._changed(orders, since)
        n, pending = state["n"] + 1, state.get("pending")
        if pending is None and new.isEmpty():
            return {"mode": "NO_OP"}
        days, skus = self._affected(new, old, pending, n)
        self._save(status="PENDING_JOINT", watermark=since, mode="incremental", pending=n, pending_full=state.get("pending_full"))
        gone = self._recompute_days(orders, days, at, since) if view == "daily" else self._recompute_skus(orders, skus, at, since)
        return {"mode": "incremental", "deleted": gone}

    def status(self, orders: DataFrame) -> dict:
        """The state and live row counts of the four tables."""
        counts = {name: (0 if (t := table.read()) is None else t.count()) for name, table in (("daily", self.daily), ("products", self.products), ("digest", self.digest))}
        return {k: v for k, v in self.state().items() if k != "n"} | {"rows": counts | {"orders": orders.count()}}
