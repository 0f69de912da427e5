"""The rules for amounts, item lists, order totals and payments.

Amounts and items are rules (see ``text``). Totals and payments feed on those, so they are applied to a DataFrame in steps;
each step is one projection and none shuffles. As with the rules of texts, a result is null where nothing is to be done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.functions.text import SPACES, Rule, floating, latin_digits, let, no_corrections, note, notes, number, outcome, strip
from tallyforge.schemas import ITEM

DEFAULT_CURRENCY = "YER"


def _any(c: Column, parts: list[str]) -> Column:
    found = c.contains(parts[0])
    for p in parts[1:]:
        found = found | c.contains(p)
    return found


def amount(source: str) -> Rule:
    """A struct (value, corrections, error, currency) of a text column."""
    by_word = F.create_map(*[F.lit(x) for value, forms in V.NUMBER_WORDS.items() for w in forms for x in (w, value)])

    def result(raw: Column, latin: Column, word: Column, is_rial: Column, bare: Column, code: Column, plain: Column, parsed: Column) -> Column:
        absent = raw.isNull() | raw.isin(V.NO_AMOUNT)
        say_word = F.concat(F.lit("Known Arabic number word '"), latin, F.lit("' mapped to "), floating(word))
        counted = ~absent & word.isNull()
        corrections = notes(
            (~absent & (latin != raw), note(V.RULE_DIGITS, "amount", raw, latin, V.SAY_DIGITS_AMOUNT)),
            (~absent & word.isNotNull(), note(V.RULE_WORDS, "amount", raw, floating(word), say_word)),
            (counted & is_rial & (bare != latin), note(V.RULE_CURRENCY, "amount", latin, bare, V.SAY_CURRENCY)),
            (counted & bare.contains(","), note(V.RULE_COMMAS, "amount", bare, plain, V.SAY_COMMAS)),
        )
        error = F.when(absent, V.UNKNOWN_PRICE).when(word.isNotNull(), None).when(parsed.isNull(), V.UNKNOWN_PRICE).when(parsed < 0, V.NEGATIVE_VALUE)
        usable = ~absent & (word.isNotNull() | (parsed >= 0))
        value = F.when(usable, F.coalesce(word, parsed))
        return F.struct(value.alias("value"), corrections.alias("corrections"), error.alias("error"), F.when(absent, DEFAULT_CURRENCY).otherwise(code).alias("currency"))

    def with_bare(*found: Column) -> Column:
        bare = found[4]
        return let(lambda plain: let(lambda parsed: result(*found, plain, parsed), parsed=number(strip(plain))), plain=F.replace(bare, F.lit(","), F.lit("")))

    def with_word(raw: Column, latin: Column, word: Column, is_rial: Column) -> Column:
        without = F.when(is_rial, strip(F.regexp_replace(latin, V.RIAL_PATTERN, "")))
        currency = F.when(word.isNotNull() | is_rial, DEFAULT_CURRENCY)
        for other, parts in V.OTHER_CURRENCIES.items():
            without = without.when(_any(latin, parts), strip(F.regexp_replace(latin, "|".join(parts), "")))
            currency = currency.when(_any(latin, parts), other)
        return let(lambda bare, code: with_bare(raw, latin, word, is_rial, bare, code), bare=without.otherwise(latin), currency=F.coalesce(currency, F.lit(DEFAULT_CURRENCY)))

    def with_latin(raw: Column, latin: Column) -> Column:
        foreign = F.octet_length(latin) != F.char_length(latin)
        rial = F.coalesce(_any(latin, V.RIAL_TRIGGERS), F.lit(False))
        return let(lambda word, is_rial: with_word(raw, latin, word, is_rial), word=F.when(foreign, F.try_element_at(by_word, latin)), rial=rial)

    return [{"": let(lambda raw: let(lambda latin: with_latin(raw, latin), latin=latin_digits(raw)), raw=strip(F.col(source)))}]


#: A number that no rule touches.
PLAIN_AMOUNT = r"^[0-9]{1,15}(\.[0-9]{1,6})?\z"


def plain_amount(source: str) -> Column:
    """The result of a text that is a plain number."""
    return F.struct(F.col(source).try_cast("double").alias("value"), no_corrections().alias("corrections"), F.lit(None).cast("string").alias("error"), F.lit(DEFAULT_CURRENCY).alias("currency"))


_PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_PATHS = ("qty", "unit_price", "total")
_NUMBER = r"(?:0|-?[1-9][0-9]{0,8})"
_FIELDS = [rf'"{n}": ?{v}' for n, v in [(n, r'"[^"\\\x00-\x1F]*+"') for n in ("sku", "name")] + [("qty", _NUMBER)] + [(n, rf"{_NUMBER}(?:\.[0-9]{{1,6}})?") for n in _PATHS[1:]]]
_OBJECT = r"\{" + ", ?".join(_FIELDS) + r"\}"
#: A list of items with all fields in order and numbers that a double holds as they stand (no negative zero among them).
PLAIN_ITEMS = rf"^\[{_OBJECT}(?:, ?{_OBJECT})*+\]\z"


def _item_number(x: Column, truth: Column | None) -> Column:
    """A double: nothing and blanks are 0, text without commas a plain decimal number; null if it is none. ``truth`` is whether
    the text stands for a truth value, which is 1 or 0."""
    clean = F.replace(F.translate(strip(x), V.EASTERN, V.WESTERN), F.lit(","), F.lit(""))
    out = F.when(x.isNull(), 0.0).when(x.rlike(_PLAIN), x.try_cast("double"))
    if truth is not None:
        out = out.when(truth, F.when(x == "true", 1.0).otherwise(0.0))
    return out.when(clean == "", 0.0).when(clean.rlike(_PLAIN), clean.try_cast("double"))


def read_items(text: Column) -> Column:
    """The items of a plain list."""
    return F.from_json(text, f"array<{ITEM}>")


def _found(items: Column, error: Column | None = None) -> Column:
    return F.struct(items.alias("items"), (F.lit(None).cast("string") if error is None else error).alias("error"))


def _listed() -> Column:
    """A struct (items, error) of any list but a plain one.

    A list of objects is taken apart by one cast. Lists that the cast refuses, and those that may hold truth values, which a
    text does not tell from the words, are taken apart one item at a time.
    """
    record = "array<struct<sku: string, name: string, qty: string, unit_price: string, total: string>>"

    def numbers(r: Column, truth: Callable[[str], Column | None]) -> Column:
        return F.struct(*[F.coalesce(r[n], F.lit("")).alias(n) for n in ("sku", "name")], *[_item_number(r[n], truth(n)).alias(n) for n in _PATHS])

    def careful(e: Column) -> Column:
        names = ("sku", "name", *_PATHS)

        def of_texts(*texts: Column) -> Column:
            by_name = dict(zip(names, texts, strict=True))
            return numbers(by_name, lambda n: by_name[n].isin("true", "false") & (F.schema_of_variant(F.try_variant_get(e, f"$.{n}", "variant")) == "BOOLEAN"))

        return F.when(e.isNotNull() & F.schema_of_variant(e).like("OBJECT%"), let(of_texts, **{n: F.try_variant_get(e, f"$.{n}", "string") for n in names}))

    def made(read: Column) -> Column:
        bad = F.exists(read, lambda r: r.isNull() | r["qty"].isNull() | r["unit_price"].isNull() | r["total"].isNull() | r["qty"].try_cast("bigint").isNull())
        error = F.when(read.isNull() | bad, V.CORRUPTED_ITEMS).when(F.size(read) == 0, V.EMPTY_ITEMS)
        items = F.transform(read, lambda r: F.struct(r["sku"].alias("sku"), r["name"].alias("name"), r["qty"].try_cast("bigint").alias("qty"), r["unit_price"].alias("unit_price"), r["total"].alias("total")))
        return let(lambda failed: _found(F.when(failed.isNull(), items.cast(f"array<{ITEM}>")), failed), failed=error)

    def with_typed(whole: Column, typed: Column) -> Column:
        quick = F.transform(typed, lambda r: F.when(r.isNotNull(), numbers(r, lambda n: None)))
        return let(lambda listed: let(made, read=F.when(typed.isNotNull(), quick).when(listed.isNotNull(), F.transform(listed, careful))), listed=F.when(typed.isNull(), F.try_variant_get(whole, "$", "array<variant>")))

    def with_text(text: Column) -> Column:
        usable = ~text.isin(V.NO_ITEMS) & text.startswith("[") & text.endswith("]")
        plain = ~text.contains("true") & ~text.contains("false")
        whole = F.try_parse_json(F.when(usable, text))
        return let(lambda json: let(lambda typed: with_typed(json, typed), typed=F.when(plain, F.try_variant_get(json, "$", record))), json=whole)

    return let(with_text, text=F.coalesce(strip(F.col("items_json")), F.lit("")))


def items() -> dict[str, Rule]:
    """``__items`` (array of items, null where the text is none), ``__items_error``, ``__items_sum``, ``__items_negative``.

    A plain list is read into its items at once.
    """
    found = F.col("__items_found")
    total = F.expr("aggregate(__items_found.items, 0D, (s, i) -> s + if(i.qty > 0 and i.unit_price > 0, i.qty * i.unit_price, i.total))")
    return {
        "__items": [{"__items_found": F.when(F.col("items_json").rlike(PLAIN_ITEMS), _found(read_items(F.col("items_json")))).otherwise(_listed())}, {"": found["items"]}],
        "__items_error": [{"": found["error"]}],
        "__items_sum": [{"": total}],
        "__items_negative": [{"": F.expr("exists(__items_found.items, i -> i.qty < 0)")}],
    }


def order_total(df: DataFrame) -> DataFrame:
    """Adds ``__total_odd``, a rule struct: the stated total if it agrees with items and delivery to 0.01, else their sum. It is
    null where a plain total agrees.

    Needs ``items``, ``total_amount__odd`` and, as doubles, ``__stated`` and ``__delivery``.
    """
    odd, value, total, delivery = F.col("total_amount__odd"), F.col("__stated"), F.col("__items_sum"), F.col("__delivery")
    listed = F.col("__items_error").isNull()
    want = total + F.when(delivery > 0, delivery).otherwise(0.0)
    ambiguous = listed & F.col("__items_negative") & (total <= 0)
    checked = listed & ~ambiguous
    absent, off = checked & odd["error"].isNotNull(), checked & odd["error"].isNull() & (F.abs(value - want) > 0.01)
    sums = F.concat(F.lit("items ("), floating(total), F.lit(") + delivery ("), floating(delivery), F.lit(")"))
    own = notes(
        (absent & (want > 0), note(V.RULE_TOTAL, "total_amount", F.coalesce(F.col("total_amount"), F.lit("")), floating(want), F.concat(F.lit("Recalculated missing/unparseable order total from valid "), sums))),
        (off, note(V.RULE_TOTAL, "total_amount", floating(value), floating(want), F.concat(F.lit("Recalculated mismatched total from "), sums))),
    )
    made = F.when((absent & (want > 0)) | off, want).when(checked & ~absent, value)
    error = F.coalesce(F.col("__items_error"), F.when(ambiguous, V.NEGATIVE_VALUE), F.when(absent & ~(want > 0), odd["error"]))
    corrections = F.when(checked, F.concat(F.coalesce(odd["corrections"], no_corrections()), own)).otherwise(no_corrections())
    agrees = F.coalesce(odd.isNull() & checked & ~off, F.lit(False))
    return df.withColumn("__total_odd", F.when(~agrees, outcome(made, corrections, error)))


def payment(df: DataFrame) -> DataFrame:
    """Adds ``__payment_odd`` (value, corrections, error, currency): a negative payment that equals the total but for its sign is
    made positive. It is null where the payment is plain. Needs ``payment_amount__odd`` and ``order_total``."""
    paid, agreed = F.col("payment_amount__odd"), F.col("__total_odd")
    total = F.when(agreed.isNull(), F.col("__stated")).otherwise(agreed["value"])
    reason = F.concat(F.lit("Corrected negative payment sign to match order total ("), floating(total), F.lit(")"))

    def result(text: Column, signed: Column) -> Column:
        none = text.isNull() | text.isin(V.NO_PAYMENT)
        matched = ~none & F.coalesce((signed < 0) & (F.abs(F.abs(signed) - total) < 0.01), F.lit(False))
        fixed = notes((matched, note(V.RULE_SIGN, "payment_amount", text, floating(F.abs(signed)), reason)))
        return F.struct(
            F.when(matched, F.abs(signed)).when(~none, paid["value"]).alias("value"),
            F.when(none, no_corrections()).otherwise(F.concat(paid["corrections"], fixed)).alias("corrections"),
            F.when(~none & ~matched, paid["error"]).alias("error"),
            F.when(none, DEFAULT_CURRENCY).otherwise(paid["currency"]).alias("currency"),
        )

    plain = lambda text: F.replace(F.replace(latin_digits(text), F.lit("ريال"), F.lit("")), F.lit(","), F.lit(""))
    signed = lambda text: F.when(paid["error"] == V.NEGATIVE_VALUE, number(strip(plain(text))))
    made = let(lambda text: let(lambda s: result(text, s), signed=signed(text)), text=strip(F.col("payment_amount")))
    return df.withColumn("__payment_odd", F.when(paid.isNotNull(), made))
