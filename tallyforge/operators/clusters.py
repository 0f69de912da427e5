"""A copy of the orders that lies along a space-filling curve, for lookups by several columns.

Each clustering column is cut into ``2 ** bits`` ranges of about as many rows each, and a row's place on the Z-order curve
interleaves the bits of its ranges, the highest first. Rows are range-partitioned and sorted by that place, so a Parquet page
holds a small box of all columns at once, and the least and greatest values that its index keeps let a filter on any of
them pass over most pages. With 2 ** p pages and c columns, an equality on one column reads about one page in
2 ** (p / c); columns of few values use up fewer bits and leave the rest to the others.

The ranges' bounds come from a sample of at most about ``sample_rows`` rows, the only thing that reaches the driver; they only
decide where rows lie, never which rows a lookup finds.

Edge cases: nulls lie in the first range; a value that many rows share takes one range and its rows are told apart by the
other columns, then by ``id_order``, so that no partition holds them all; an empty table gives an empty copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns that the lookups ask for.
COLUMNS = ("city", "status", "customer_id", "order_date")
BITS = 8
SAMPLE_ROWS = 20_000
#: Rows of a partition, about, and of a page.
PER_FILE, PER_PAGE = 2_000_000, 20_000
PLACE = "__place"


def range_bounds(orders: DataFrame, columns: tuple[str, ...] = COLUMNS, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, n_rows: int | None = None) -> dict[str, list]:
    """For each column the ``2 ** bits - 1`` values that part its ranges, ascending, some of them equal where values are few.
    Columns without values have none."""
    n_rows = orders.count() if n_rows is None else n_rows
    some = orders.select(*columns)
    if n_rows > sample_rows:
        some = some.sample(sample_rows / n_rows, seed=11)
    rows = some.collect()
    n, bounds = 1 << bits, {}
    for c in columns:
        values = sorted(r[c] for r in rows if r[c] is not None)
        bounds[c] = [values[k * len(values) // n] for k in range(1, n)] if values else []
    return bounds


def _range_number(column: str, kind: str, bounds: list, bits: int) -> Column:
    """How many of the bounds a value reaches, by bisection."""
    if not bounds:
        return F.lit(0).cast("long")
    edges = F.array(*[F.lit(b) for b in bounds]).cast(f"array<{kind}>")

    def halve(low: Column, half: Column) -> Column:
        reached = F.col(column) >= F.get(edges, (low + half - 1).cast("int"))
        return F.when(reached, low + half).otherwise(low)

    return F.aggregate(F.array(*[F.lit(1 << b).cast("long") for b in reversed(range(bits))]), F.lit(0).cast("long"), halve)


def placed(orders: DataFrame, bounds: dict[str, list], bits: int = BITS) -> DataFrame:
    """``orders`` with their place on the curve."""
    if bits * len(bounds) > 63:
        raise ValueError("a place has 63 bits; take fewer columns or bits")
    kinds = dict(orders.dtypes)
    numbers = {f"__range_{i}": _range_number(c, kinds[c], b, bits) for i, (c, b) in enumerate(bounds.items())}
    place, at = F.lit(0).cast("long"), 0
    for bit in range(bits):
        for name in reversed(numbers):  # the first column has the highest bit
            place = place.bitwiseOR(F.shiftleft(F.shiftright(F.col(name), bit).bitwiseAND(F.lit(1).cast("long")), at))
            at += 1
    return orders.withColumns(numbers).withColumn(PLACE, place).drop(*numbers)


def write(orders: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, bits: int = BITS, per_file: int = PER_FILE, per_page: int = PER_PAGE, key: str = "id_order") -> DataFrame:
    """Write the copy and return it as read. ``orders`` is read twice and should be a stored table."""
    n = orders.count()
    rows = placed(orders, range_bounds(orders, columns, bits, n_rows=n), bits)
    rows = rows.repartitionByRange(max(1, -(-n // per_file)), PLACE, key).sortWithinPartitions(PLACE, key).drop(PLACE)
    rows.write.option("parquet.page.row.count.limit", per_page).parquet(path)
    return orders.sparkSession.read.schema(orders.schema).parquet(path)
