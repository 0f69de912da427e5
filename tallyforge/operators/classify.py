"""Cleaning and classification of raw orders in one pass of column expressions: valid, corrected or quarantined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import money, text
from tallyforge.functions import values as V
from tallyforge.schemas import QUARANTINE_COLUMNS, RAW_COLUMNS, VALIDATED_COLUMNS

#: Audit order of the parts of a record.
_AUDIT = ("order_id", "customer_id", "order_date", "status", "customer_name", "city", "district", "delivery_type", "payment_method", "payment_status", "customer_phone", "customer_email")


_WORDS = ("status", "customer_name", "city", "district", "delivery_type", "payment_method", "payment_status")
_AMOUNTS = ("delivery_cost", "total_amount", "payment_amount")


def _odd(c: str) -> Column:
    return F.col(f"{c}__odd")


def _value(c: str) -> Column:
    """What a field's text is cleaned to."""
    return F.when(_odd(c).isNull(), F.col(c)).otherwise(_odd(c)["value"])


def _amount(c: str) -> Column:
    return F.when(_odd(c).isNull(), F.col(c).try_cast("double")).otherwise(_odd(c)["value"])


def _rules(raw: DataFrame) -> DataFrame:
    """All rules over the 17 text columns: a struct ``<column>__odd`` for each, ``__total_odd`` and ``__payment_odd``. A struct is
    null where no rule has anything to do, so that rows carry only what is odd in them from step to step.

    Blank and null fields are alike to every rule.
    """
    plain = lambda c, pattern: F.col(c).rlike(pattern)
    rules = {c: text.unless(plain(c, text.ONE_WORD) & ~F.col(c).isin(V.NO_ID), text.identifier(c, e)) for c, e in (("order_id", V.MISSING_ORDER_ID), ("customer_id", V.MISSING_CUSTOMER_ID))}
    rules["order_date"] = text.unless(text.plain_date("order_date"), text.date("order_date"))
    rules["customer_phone"] = text.unless(plain("customer_phone", text.PLAIN_PHONE), text.phone("customer_phone"))
    rules["customer_email"] = text.unless(plain("customer_email", text.PLAIN_EMAIL), text.email("customer_email"))
    for c in _WORDS:
        standard = text.standards(c)
        rules[c] = text.unless(plain(c, text.SPACED_WORDS) | (F.col(c).isin(standard) if standard else F.lit(False)), text.words(c))
    rules |= {c: text.unless(plain(c, money.PLAIN_AMOUNT), money.amount(c)) for c in _AMOUNTS}
    df = text.apply(raw, money.items() | {f"{c}__odd": [{"": rule}] for c, rule in rules.items()})
    df = df.withColumns({"__delivery": F.coalesce(_amount("delivery_cost"), F.lit(0.0)), "__stated": _amount("total_amount")})
    return money.payment(money.order_total(df))


def clean(raw: DataFrame) -> DataFrame:
    """The results of all rules: a struct ``<column>__rule`` for each text rule, and the money structs."""
    df = _rules(raw)
    whole = lambda odd, plain: F.when(odd.isNull(), plain).otherwise(odd)
    out = {f"{c}__rule": whole(_odd(c), text.sound(c)) for c in _AUDIT}
    out |= {f"{c}__amount": whole(_odd(c), money.plain_amount(c)) for c in _AMOUNTS}
    out["__total"] = whole(F.col("__total_odd"), text.outcome(F.col("__stated"), text.no_corrections()))
    out["__payment"] = whole(F.col("__payment_odd"), money.plain_amount("payment_amount"))
    return df.withColumns(out).drop("__total_odd", "__payment_odd", "__stated", *[f"{c}__odd" for c in (*_AUDIT, *_AMOUNTS)])


def classify(raw: DataFrame, stamp: str = "1970-01-01T00:00:00") -> DataFrame:
    """The classified table: ``classification``, ``error_codes``, ``corrections`` and the columns of both outputs.

    ``raw`` has the 17 text columns, id_run, source_file and source_row_number. ``stamp`` is the run's UTC time.
    """
    df = _rules(raw)
    total, payment = F.col("__total_odd"), F.col("__payment_odd")
    codes = F.array_compact(F.array(*[_odd(c)["error"] for c in ("order_id", "customer_id", "order_date", "customer_email")], total["error"]))
    errors = text.let(lambda found: F.when(F.size(found) > 1, F.array_sort(F.array_append(F.array_distinct(found), F.lit(V.SEVERAL_ERRORS)))).otherwise(found), found=codes)
    parts = [*[_odd(c) for c in (*_AUDIT, "delivery_cost")], total, payment]
    odd = reduce(Column.__or__, [p.isNotNull() for p in parts])
    corrections = F.concat(*[F.coalesce(p["corrections"], text.no_corrections()) for p in parts])
    none = F.array().cast("array<string>")
    df = df.withColumns({"__errors": F.when(odd, errors).otherwise(none), "__corrections": F.when(odd, corrections).otherwise(text.no_corrections())})
    kind = F.when(F.size("__errors") > 0, "quarantined").when(F.size("__corrections") > 0, "corrected").otherwise("valid")
    # Generated from an array of one struct, so that a filter on these columns is applied to them as they stand: through a
    # projection it would be pushed down to the scan with a copy of every rule in it.
    verdict = F.struct(kind.alias("classification"), F.col("__errors").alias("error_codes"), F.col("__corrections").alias("corrections"))
    df = df.select("*", F.inline(F.array(verdict)))
    bad = F.col("classification") == "quarantined"
    shown = F.coalesce(_value("order_id"), F.when(F.col("order_id") != "", F.col("order_id")), F.lit("UNKNOWN_ORDER"))
    value = lambda c: _value(c).alias(c)
    return df.select(
        "classification",
        F.when(bad, shown).otherwise(_value("order_id")).alias("id_order"),
        *[value(c) for c in ("order_date", "status", "customer_id", "customer_name", "customer_phone", "customer_email", "city", "district", "delivery_type")],
        F.col("__delivery").alias("delivery_cost"),
        *[value(c) for c in ("payment_method", "payment_status")],
        F.when(payment.isNull(), F.col("payment_amount").try_cast("double")).otherwise(payment["value"]).alias("payment_amount"),
        F.coalesce(payment["currency"], F.lit(money.DEFAULT_CURRENCY)).alias("currency"),
        F.when(total.isNull(), F.col("__stated")).otherwise(total["value"]).alias("total_amount"),
        F.col("__items").alias("items"),
        F.col("classification").alias("quality_status"),
        "corrections",
        "id_run",
        "source_file",
        F.col("source_row_number").cast("long").alias("source_row_number"),
        F.lit(stamp).alias("processed_at"),
        F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in RAW_COLUMNS]).alias("raw_record"),
        "error_codes",
        F.when(bad, F.concat(F.lit("Record failed validation with errors: "), F.array_join("error_codes", ", "))).alias("quarantine_reason"),
        F.lit(stamp).alias("detected_at"),
    )


#: Columns of a cleaned row and the raw fields that they mostly equal.
_SAME = {"id_order": "order_id"} | {c: c for c in ("order_date", "status", "customer_id", "customer_name", "customer_phone", "customer_email", "city", "district", "delivery_type", "payment_method", "payment_status", "currency")}


def slim(classified: DataFrame) -> DataFrame:
    """The rows, those of the quarantine aside, without what ``whole`` can tell from the rest of the row: raw fields that cleaning
    left as they were, and items that are read from a plain list. It has the same columns."""
    good, raw = F.col("classification") != "quarantined", F.col("raw_record")
    own = {r: F.when(good & F.col(c).eqNullSafe(raw[r]), None).otherwise(raw[r]) for c, r in _SAME.items()}
    record = F.struct(*[own.get(c, raw[c]).alias(c) for c in RAW_COLUMNS])
    items = F.when(~(good & F.coalesce(raw["items_json"].rlike(money.PLAIN_ITEMS), F.lit(False))), F.col("items"))
    return classified.withColumns({"raw_record": record, "items": items})


def whole(rows: DataFrame) -> DataFrame:
    """Rows of ``slim`` as they were; raw fields are never null, and of accepted rows no list of items is."""
    good, raw = F.col("classification") != "quarantined", F.col("raw_record")
    own = {r: F.when(good & raw[r].isNull(), F.col(c)).otherwise(raw[r]) for c, r in _SAME.items()}
    record = F.struct(*[own.get(c, raw[c]).alias(c) for c in RAW_COLUMNS])
    out = {"raw_record": record}
    if "items" in rows.columns:
        out["items"] = F.when(good & F.col("items").isNull(), money.read_items(raw["items_json"])).otherwise(F.col("items"))
    return rows.withColumns(out)


def verdict(raw: DataFrame, error: str, corrections: str | None = None) -> DataFrame:
    """``error_codes`` and ``corrections`` of one rule alone, by the names that ``clean`` gives them; no other rule is run."""
    found = F.lit(None) if corrections is None else F.col(corrections)
    return clean(raw).select(F.array_compact(F.array(F.col(error))).alias("error_codes"), found.alias("corrections"))


def validated(classified: DataFrame) -> DataFrame:
    return classified.where("classification != 'quarantined'").select(*VALIDATED_COLUMNS)


def quarantined(classified: DataFrame) -> DataFrame:
    return classified.where("classification = 'quarantined'").select(*QUARANTINE_COLUMNS)
