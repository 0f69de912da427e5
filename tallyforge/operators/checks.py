"""Contract, balance, counters and verification of the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import values as V
from tallyforge.sources.scratch import materialize

#: The error code of a row that no rule rejects but the contract does.
BROKEN = "CONTRACT_VIOLATION"
RULES = (V.RULE_DIGITS, V.RULE_CURRENCY, V.RULE_COMMAS, V.RULE_WORDS, V.RULE_PHONE, V.RULE_EMAIL, V.RULE_DATE, V.RULE_TEXT, V.RULE_TOTAL, V.RULE_SIGN)
ERRORS = (V.MISSING_ORDER_ID, V.MISSING_CUSTOMER_ID, V.INVALID_DATE, V.CORRUPTED_ITEMS, V.EMPTY_ITEMS, V.UNKNOWN_PRICE, V.NEGATIVE_VALUE, V.SEVERAL_ERRORS, V.UNSAFE_EMAIL, BROKEN)

_REQUIRED = "id_order order_date status customer_id customer_name city district delivery_type payment_method payment_status currency".split()
_MONEY = ("delivery_cost", "payment_amount", "total_amount")


def contract_violations(orders: DataFrame) -> DataFrame:
    """``orders`` with ``violations``, the sorted names of the contract's clauses that a row breaks."""
    filled = ("id_order", "order_date", "status", "customer_id")  # of the required texts, those that must not be empty
    clauses = [(f"missing_{c}", F.col(c).isNull()) for c in _REQUIRED] + [(f"empty_{c}", F.col(c) == "") for c in filled]
    clauses += [("missing_total_amount", F.col("total_amount").isNull()), ("missing_delivery_cost", F.col("delivery_cost").isNull())]
    clauses += [(f"negative_{c}", F.col(c) < 0) for c in _MONEY]
    clauses += [
        ("no_items", F.coalesce(F.size("items"), F.lit(0)) < 1),
        ("negative_item_price", F.exists("items", lambda i: i["unit_price"] < 0)),
        ("negative_item_total", F.exists("items", lambda i: i["total"] < 0)),
        ("unknown_classification", ~F.coalesce(F.col("classification").isin("valid", "corrected"), F.lit(False))),
        ("unknown_rule", F.exists("corrections", lambda c: ~c["rule_code"].rlike("^RULE_(0[1-9]|10)$"))),
        ("row_number", F.col("source_row_number") < 1),
    ]
    broken = F.array_compact(F.array(*[F.when(cond, name) for name, cond in sorted(clauses, key=lambda x: x[0])]))
    any_of = reduce(Column.__or__, [F.coalesce(cond, F.lit(False)) for _, cond in clauses])
    return orders.withColumn("violations", F.when(any_of, broken).otherwise(F.array().cast("array<string>")))


def enforce(orders: DataFrame, mode: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(sound, broken); in mode ``fail`` a broken row is an error, in mode ``quarantine`` it is kept out of ``sound``."""
    if mode not in ("fail", "quarantine"):
        raise ValueError("mode is fail or quarantine")
    checked = contract_violations(orders)
    broken = checked.where(F.size("violations") > 0)
    if mode == "fail":
        row = broken.select("id_order", "violations").first()
        if row is not None:
            raise ValueError(f"order {row['id_order']} breaks the contract: {', '.join(row['violations'])}")
    return checked.where(F.size("violations") == 0).drop("violations"), broken


def quarantine_broken(classified: DataFrame) -> DataFrame:
    """The classified table with rows that break the contract among the quarantined, with a code and the clauses they break."""
    checked = contract_violations(classified)
    broken = (F.size("violations") > 0) & (F.col("classification") != "quarantined")
    changed = {
        "classification": F.lit("quarantined"),
        "quality_status": F.lit("quarantined"),
        "error_codes": F.array(F.lit(BROKEN)),
        "quarantine_reason": F.concat(F.lit("Record breaks the contract of stored orders: "), F.array_join("violations", ", ")),
    }
    marked = checked.select("*", F.inline(F.array(F.struct(broken.alias("__broken")))))
    return marked.select(*[F.when(F.col("__broken"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in classified.columns])


def tallies(unsound: Column | None = None) -> dict[str, Column]:
    """Aggregates for the run log, to be observed while the classified table is written: rows by class, corrections by rule
    (of corrected rows), errors by code (of quarantined ones), and rows that ``unsound`` marks."""
    kind = lambda c: F.col("classification") == c
    corrected = lambda r: F.when(kind("corrected"), F.size(F.filter("corrections", lambda c: c["rule_code"] == r)))
    out = {"n_raw": F.count(F.lit(1))} | {f"n_{c}": F.count_if(kind(c)) for c in ("valid", "corrected", "quarantined")}
    out |= {f"rule {r}": F.coalesce(F.sum(corrected(r)), F.lit(0)) for r in RULES}
    out |= {f"error {e}": F.count_if(kind("quarantined") & F.array_contains("error_codes", e)) for e in ERRORS}
    return out | {"n_unsound": F.count_if(unsound) if unsound is not None else F.lit(0).cast("long")}


def require_stored(id_run: str, accepted: int, keys: int, quarantined: int, good: DataFrame | None, bad: DataFrame | None) -> None:
    """An error unless what a run put into the two tables is there: one row for each of its keys, and each quarantined row.
    ``good`` and ``bad`` are the rows of the buckets that it wrote."""
    for name, want, table in (("orders", keys, good), ("quarantine", quarantined, bad)):
        found = table.where(F.col("id_run") == id_run).count() if want and table is not None else 0
        if found != want:
            raise ValueError(f"run {id_run}: {want} rows went into {name}, but {found} are stored")
    if keys > accepted:
        raise ValueError(f"run {id_run}: {keys} keys of {accepted} rows")


def consistency(classified: DataFrame) -> DataFrame:
    """One row: raw, valid, corrected, quarantined and whether they balance."""
    counts = classified.agg(F.count("*").alias("n_raw"), *[F.count_if(F.col("classification") == c).alias(f"n_{c}") for c in ("valid", "corrected", "quarantined")])
    return counts.withColumn("balanced", F.col("n_raw") == F.col("n_valid") + F.col("n_corrected") + F.col("n_quarantined"))


def require_balance(raw: DataFrame, classified: DataFrame) -> None:
    """An error unless each raw row was classified exactly once."""
    n, row = raw.count(), consistency(classified).first()
    if not row["balanced"] or row["n_raw"] != n:
        raise ValueError(f"{n} raw rows, but {row['n_valid']} valid, {row['n_corrected']} corrected and {row['n_quarantined']} quarantined")


def rule_distribution(classified: DataFrame) -> DataFrame:
    """Corrections by rule over corrected rows only; those of quarantined rows don't count."""
    return classified.where("classification = 'corrected'").select(F.explode("corrections").alias("c")).groupBy("c.rule_code").agg(F.count("*").alias("n"))


def error_distribution(classified: DataFrame) -> DataFrame:
    return classified.where("classification = 'quarantined'").select(F.explode("error_codes").alias("error_code")).groupBy("error_code").agg(F.count("*").alias("n"))


def run_metrics(classified: DataFrame, id_run: str, seconds: float, counters: dict[str, int] | None = None) -> DataFrame:
    """One row of counts, histograms and throughput, for the run log."""
    maps = [(rule_distribution(classified), "rule_code", "rules"), (error_distribution(classified), "error_code", "errors")]
    out = consistency(classified)
    for df, key, name in maps:
        out = out.crossJoin(df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name)))  # one row each: rules and codes are few
    kept = F.create_map(*[F.lit(x) for kv in (counters or {}).items() for x in kv]) if counters else F.create_map().cast("map<string,int>")
    return out.select(F.lit(id_run).alias("id_run"), "*", kept.alias("counters"), F.lit(float(seconds)).alias("seconds"), (F.col("n_raw") / F.lit(max(seconds, 1e-9))).alias("rows_per_second"))


def _intervals(raw: DataFrame) -> DataFrame:
    """One row a task of the scan: least, greatest and number of its row numbers, and whether it is a run without gaps or
    repeats that no other interval meets."""
    n = F.col("source_row_number")
    parts = raw.groupBy(F.spark_partition_id().alias("part")).agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count(n).alias("n")).where("n > 0")
    by_first = Window.orderBy("first", "last", "part")  # one row a task
    before = F.max("last").over(by_first.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("first").over(by_first)
    alone = (F.coalesce(before, F.col("first") - 1) < F.col("first")) & (F.coalesce(after, F.col("last") + 1) > F.col("last"))
    return parts.select("first", "last", "n", (alone & (F.col("n") == F.col("last") - F.col("first") + 1)).alias("clean"))


def lineage_check(raw: DataFrame) -> DataFrame:
    """Row numbers: least, greatest, count, gaps, repeats.

    Tasks read runs of consecutive numbers, so their intervals tell all; only where intervals meet or are not full are the
    numbers themselves counted, in the range that those span. No row number is shuffled otherwise.
    """
    parts = materialize(_intervals(raw), "intervals")
    odd = parts.where("not clean").agg(F.min("first"), F.max("last")).first()
    numbers = raw.select("source_row_number").where(F.col("source_row_number").between(odd[0], odd[1])) if odd[0] is not None else None
    counted = 0 if numbers is None else numbers.agg(F.count_distinct("source_row_number")).first()[0]
    outside = F.lit(True) if numbers is None else (F.col("last") < odd[0]) | (F.col("first") > odd[1])
    got = parts.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)) + counted).alias("n_distinct"))
    return got.select("first", "last", "n", (F.col("last") - F.col("first") + 1 - F.col("n_distinct")).alias("gaps"), (F.col("n") - F.col("n_distinct")).alias("repeats"))


def store_check(orders: DataFrame) -> DataFrame:
    """Repeated keys, negative money and contract failures of a stored table; all should be 0."""
    keys = orders.groupBy("id_order").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("repeated_keys"))
    bad = contract_violations(orders).agg(F.count_if(F.least(*[F.coalesce(F.col(c), F.lit(0.0)) for c in _MONEY]) < 0).alias("negative_money"), F.count_if(F.size("violations") > 0).alias("contract_failures"))
    return keys.crossJoin(bad)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def reports_reconcile(orders: DataFrame, *reports: DataFrame) -> bool:
    """Each report's order counts add up to the number of orders."""
    n = orders.count()
    return all((r.agg(F.sum("order_count")).first()[0] or 0) == n for r in reports)
