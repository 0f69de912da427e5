"""Profiles of raw and clean orders by aggregation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.functions import values as V
from tallyforge.schemas import RAW_COLUMNS
from tallyforge.sources.scratch import materialize


def missing_fields(raw: DataFrame) -> DataFrame:
    """By column: rows where it is null or blank, and their share in percent, to four decimals."""
    sums = raw.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(F.trim(F.col(c)), F.lit("")) == "").alias(c) for c in RAW_COLUMNS])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_missing")) for c in RAW_COLUMNS])
    return sums.select("n", F.explode(pairs).alias("p")).select("p.field", "p.n_missing", F.round(F.col("p.n_missing") * 100 / F.greatest("n", F.lit(1)), 4).alias("percent"))


def duplicates(raw: DataFrame, key: str = "order_id") -> DataFrame:
    """One row: keys and whole rows that occur more than once, and how many rows too many they make.

    Rows are first counted by a 64-bit hash; only those whose hash was seen twice are compared whole.
    """
    keys = raw.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("extra_key_rows"))
    rows = seen_twice(raw).groupBy(*RAW_COLUMNS).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("extra_rows"))
    return keys.crossJoin(rows)  # one row each


def seen_twice(raw: DataFrame) -> DataFrame:
    """The rows whose hash another row has; all that are equal are among them."""
    hashed = raw.select(*RAW_COLUMNS, F.xxhash64(*RAW_COLUMNS).alias("__hash"))
    twice = materialize(hashed.groupBy("__hash").agg(F.count("*").alias("c")).where("c > 1").select("__hash"), "hashes")
    return hashed.join(twice, "__hash", "left_semi").drop("__hash")


def negative_payments(classified: DataFrame) -> DataFrame:
    """Payments written with a minus sign: those that matched the total and were turned, and the rest."""
    sign = text.latin_digits(text.strip(F.col("raw_record.payment_amount"))).startswith("-")
    turned = F.exists("corrections", lambda c: c["rule_code"] == V.RULE_SIGN)
    return classified.agg(F.count_if(sign & turned).alias("n_matched"), F.count_if(sign & ~turned).alias("n_unmatched"))


def histogram(orders: DataFrame, column: str = "total_amount", bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal bins from least to greatest value; the greatest belongs to the last bin."""
    low, high = orders.agg(F.min(column), F.max(column)).first()
    if low is None:
        return orders.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) / bins
    at = F.lit(0) if width == 0 else F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return orders.where(F.col(column).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


#: Ranges that a round cuts each open range into.
CUT = 1024


def by_rank(rows: DataFrame, column: str, shares: tuple[float, ...]) -> tuple[float | None, list[float | None], float | None]:
    """Least value, the values of the data at ``shares`` of the ranks, and greatest value; null and NaN are left out.

    Values are counted by range, and the ranges that hold the wanted ranks are cut again, to their least and greatest value,
    until one value is left. A round is one partial aggregation; no task sees more than counts.
    """
    value = F.col(column)
    rows = rows.where(value.isNotNull() & ~F.isnan(value.cast("double")))
    n, least, greatest = rows.agg(F.count("*"), F.min(column), F.max(column)).first()
    ranks = [max(1, math.ceil(s * n)) for s in shares]
    spans = [(least, greatest, 0)] * len(ranks)  # range, and how many values lie below it
    while n and any(low < high for low, high, _ in spans):
        open_ = sorted({(low, high) for low, high, _ in spans if low < high})
        bins = F.lit(None).cast("struct<r: int, b: int>")
        for r, (low, high) in enumerate(open_):
            width = high / CUT - low / CUT
            at = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(CUT - 1)) if width > 0 else F.when(value == F.lit(low), 0).otherwise(1)
            bins = F.when(value.between(low, high), F.struct(F.lit(r).alias("r"), at.cast("int").alias("b"))).otherwise(bins)
        found = rows.groupBy(bins.alias("x")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).where("x is not null").orderBy("x").collect()  # at most CUT rows a rank
        for i, (low, high, below) in enumerate(spans):
            if low < high:
                for f in (f for f in found if open_[f["x"]["r"]] == (low, high)):
                    if ranks[i] <= below + f["n"]:
                        spans[i] = (f["low"], f["high"], below)
                        break
                    below += f["n"]
    return least, [low for low, _, _ in spans], greatest


def quartiles(orders: DataFrame, column: str = "total_amount") -> DataFrame:
    """Least, three quartiles (values of the data, by rank) and greatest."""
    least, found, greatest = by_rank(orders, column, (0.25, 0.5, 0.75))
    kind = orders.schema[column].dataType.simpleString()
    return orders.sparkSession.createDataFrame([(least, *found, greatest)], ", ".join(f"{c} {kind}" for c in ("least", "q1", "q2", "q3", "greatest")))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts by value and their share in percent, to four decimals."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(total).select("value", "n", F.round(F.col("n") * 100 / F.col("t"), 4).alias("percent"))  # the total is one row


def date_quality(classified: DataFrame) -> DataFrame:
    """Dates that were clean, repaired or impossible."""
    kind = F.when(F.array_contains("error_codes", V.INVALID_DATE), "impossible").when(F.exists("corrections", lambda c: c["field"] == "order_date"), "repaired").otherwise("clean")
    return classified.groupBy(kind.alias("date_class")).agg(F.count("*").alias("n"))


def items_quality(classified: DataFrame) -> DataFrame:
    """Item lists that were valid, corrupt or empty."""
    kind = F.when(F.array_contains("error_codes", V.CORRUPTED_ITEMS), "corrupt").when(F.array_contains("error_codes", V.EMPTY_ITEMS), "empty").otherwise("valid")
    return classified.groupBy(kind.alias("items_class")).agg(F.count("*").alias("n"))
