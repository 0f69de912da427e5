"""Exact money: sums in whole cents, means rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 100).cast("long")


def money(total_cents: Column) -> Column:
    return (total_cents / 100.0).cast("double")


def mean(total_cents: Column, n: Column) -> Column:
    """total / n in money, to cents, ties to the even cent; by whole numbers, so that every engine agrees."""
    low = F.floor(total_cents / n).cast("long")
    twice = 2 * (total_cents - low * n)
    return money(low + F.when(twice > n, 1).when((twice == n) & (F.pmod(low, F.lit(2)) == 1), 1).otherwise(0))


#: The same for the SQL twins: s and n are bigint expressions.
def mean_sql(s: str, n: str) -> str:
    low = f"cast(floor({s} / {n}) as bigint)"
    return f"cast(({low} + case when 2 * ({s} - {low} * {n}) > {n} then 1 when 2 * ({s} - {low} * {n}) = {n} and {low} % 2 = 1 then 1 else 0 end) / 100.0 as double)"
