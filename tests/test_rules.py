"""Each cleaning rule on literal inputs, and whole records."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import money, text
from tallyforge.operators import checks, classify
from tallyforge.schemas import RAW_COLUMNS

GOOD = {
    "order_id": "P-4471", "order_date": "2026-03-09T14:25:30", "status": "new", "customer_id": "K-88", "customer_name": "Salma", "customer_phone": "733904518",
    "customer_email": "m.saleh@post.org", "city": "Taiz", "district": "east", "delivery_type": "pickup", "delivery_cost": "750.0", "payment_method": "card", "payment_status": "open",
    "payment_amount": "4501.5", "currency": "YER", "total_amount": "4501.5", "items_json": '[{"sku":"T-9","qty":3,"unit_price":1250.5,"total":3751.5}]',
}


@pytest.fixture
def record(spark):
    def run(as_table=False, **changes):
        values = GOOD | changes
        schema = ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", id_run string, source_file string, source_row_number long"
        df = spark.createDataFrame([tuple(values[c] for c in RAW_COLUMNS) + ("run", "file", 1)], schema)
        return classify.classify(df) if as_table else classify.classify(df).first()

    return run


@pytest.fixture
def rule(spark):
    def run(make, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
        rows = text.apply(df, {"r": make("c")}).orderBy("i").collect()
        return [(r.r["value"], [x["rule_code"] for x in r.r["corrections"]], r.r["error"]) for r in rows]

    return run


def amounts(spark, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    rows = text.apply(df, {"c__amount": money.amount("c")}).orderBy("i").collect()
    return [(r.c__amount["value"], [x["rule_code"] for x in r.c__amount["corrections"]], r.c__amount["error"], r.c__amount["currency"]) for r in rows]


def test_amounts(spark):
    got = amounts(spark, "٣٤٠٧٫٥", "860 ريال يمني", "48,250.75", "عشرة آلاف", "????????", None, "", "  31 ", "-12", "7 USD", "85 سعودي", "xyz", "NaN", "2e2", "64 ريال سعودي", "3,500 YER")
    assert got == [
        (3407.5, ["RULE_01"], None, "YER"), (860.0, ["RULE_02"], None, "YER"), (48250.75, ["RULE_03"], None, "YER"), (10000.0, ["RULE_04"], None, "YER"),
        (None, [], "UNKNOWN_PRICE", "YER"), (None, [], "UNKNOWN_PRICE", "YER"), (None, [], "UNKNOWN_PRICE", "YER"), (31.0, [], None, "YER"), (None, [], "AMBIGUOUS_NEGATIVE_VALUE", "YER"),
        (7.0, [], None, "USD"), (85.0, [], None, "SAR"), (None, [], "UNKNOWN_PRICE", "YER"), (None, [], "UNKNOWN_PRICE", "YER"), (200.0, [], None, "YER"),
        (None, ["RULE_02"], "UNKNOWN_PRICE", "YER"), (3500.0, ["RULE_02", "RULE_03"], None, "YER"),
    ]


def test_phones(rule):
    assert rule(text.phone, "733904518", "+967 73 390 4518", "00967711002003", "0788112233", "٧٣٣٩٠٤٥١٨", "604119275", "60-4119275", "55 12", "", None) == [
        ("733904518", [], None), ("733904518", ["RULE_05"], None), ("711002003", ["RULE_05"], None), ("788112233", ["RULE_05"], None), ("733904518", ["RULE_01", "RULE_05"], None),
        ("604119275", [], None), ("604119275", ["RULE_05"], None), ("5512", [], None), (None, [], None), (None, [], None),
    ]


def test_emails(rule):
    assert rule(text.email, "kim@mail.net", "lena@@shop...org", "@@", "none", "nobody at home", "", None, "\t ", "q@w", " z9@y.co ") == [
        ("kim@mail.net", [], None), ("lena@shop.org", ["RULE_06", "RULE_06"], None), (None, [], "UNSAFE_EMAIL"), (None, [], "UNSAFE_EMAIL"), (None, [], "UNSAFE_EMAIL"),
        ("", [], None), ("", [], None), (None, [], "UNSAFE_EMAIL"), (None, [], "UNSAFE_EMAIL"), ("z9@y.co", [], None),
    ]


def test_dates(rule):
    bad = (None, [], "INVALID_IMPOSSIBLE_DATE")
    assert rule(text.date, "2026-03-09T14:25:30", "28-11-2023 21:07:45", "2024/08/30", "3/9/2022", "2026-04-31", "1987-06-05", "2044-01-02", "", None, "tomorrow", "٢٠٢٣-١١-٢٨") == [
        ("2026-03-09T14:25:30", [], None), ("2023-11-28T21:07:45", ["RULE_07"], None), ("2024-08-30T00:00:00", ["RULE_07"], None), ("2022-09-03T00:00:00", ["RULE_07"], None),
        bad, bad, bad, bad, bad, bad, ("2023-11-28T00:00:00", ["RULE_01", "RULE_07"], None),
    ]


def test_words(rule):
    assert rule(lambda c: text.words(c, "city"), " صنعا ", "عدن", "x  y", None) == [("صنعاء", ["RULE_08"], None), ("عدن", [], None), ("x y", ["RULE_08"], None), ("", [], None)]
    assert rule(lambda c: text.words(c, "status"), "مسلم", "قيد  الشحن") == [("تم التسليم", ["RULE_08"], None), ("قيد الشحن", ["RULE_08"], None)]
    assert rule(lambda c: text.words(c, "district"), " a ", "a  b") == [("a", [], None), ("a b", ["RULE_08"], None)]


def test_identifiers(rule):
    make = lambda c: text.identifier(c, "MISSING_ORDER_ID", "order_id")
    missing = (None, [], "MISSING_ORDER_ID")
    assert rule(make, "P-17", "P-١٧", "", " null ", None) == [("P-17", [], None), ("P-17", ["RULE_01"], None), missing, missing, missing]


def test_valid_and_corrected_records(record):
    r = record()
    assert (r.classification, r.error_codes, r.corrections, r.total_amount, r.payment_amount) == ("valid", [], [], 4501.5, 4501.5)
    assert r["items"][0].asDict() == {"sku": "T-9", "name": "", "qty": 3, "unit_price": 1250.5, "total": 3751.5}
    r = record(total_amount="61.0")
    assert r.classification == "corrected" and r.total_amount == 4501.5
    assert r.corrections[0].asDict() == {"rule_code": "RULE_09", "field": "total_amount", "original_value": "61.0", "corrected_value": "4501.5", "reason": "Recalculated mismatched total from items (3751.5) + delivery (750.0)"}
    r = record(total_amount="???", items_json='[{"sku":"a","qty":1,"unit_price":12000000,"total":1}]')
    assert r.corrections[0]["corrected_value"] == "12000750.0"


def test_payments(record):
    r = record(payment_amount="-4501.5")
    assert (r.payment_amount, [c["rule_code"] for c in r.corrections], r.classification) == (4501.5, ["RULE_10"], "corrected")
    r = record(payment_amount="-77.25")
    assert (r.payment_amount, r.corrections, r.classification) == (None, [], "valid")
    assert record(payment_amount=None).payment_amount is None
    assert record(payment_amount="-4501.5 YER").payment_amount is None


def test_quarantined_records(record):
    one = lambda **c: record(**c).error_codes
    for items in ("not-json", "{}", "[1]", '[{"sku":"a","qty":"ABC"}]', '[{"sku":"a"}] x', "", None, '[{"qty":NaN}]'):
        assert one(items_json=items) == ["CORRUPTED_ITEMS_JSON"], items
    assert one(items_json="[]") == ["EMPTY_ITEMS"]
    assert one(items_json='[{"qty":-1,"unit_price":5,"total":-5}]', total_amount="5") == ["AMBIGUOUS_NEGATIVE_VALUE"]
    r = record(order_id="", customer_id="null")
    assert r.error_codes == ["MISSING_CUSTOMER_ID", "MISSING_ORDER_ID", "MULTIPLE_CONFLICTING_ERRORS"] and r.id_order == "UNKNOWN_ORDER"
    assert r.quarantine_reason == "Record failed validation with errors: MISSING_CUSTOMER_ID, MISSING_ORDER_ID, MULTIPLE_CONFLICTING_ERRORS"


def test_item_numbers(record):
    r = record(items_json='[{"sku":1,"name":null,"qty":"٢","unit_price":"1,000.5","total":""},{"qty":2.9,"unit_price":0,"total":7},{"qty":true,"unit_price":3}]', total_amount="x", delivery_cost="0")
    assert [(i["sku"], i["name"], i["qty"], i["unit_price"], i["total"]) for i in r["items"]] == [("1", "", 2, 1000.5, 0.0), ("", "", 2, 0.0, 7.0), ("", "", 1, 3.0, 0.0)]
    assert r.total_amount == 2001.0 + 7.0 + 3.0


def test_cleaning_again_changes_nothing(record):
    r = record(customer_phone="+967 73 390 4518", city=" صنعا ", total_amount="1", order_date="28-11-2023", customer_email="v@@w..org")
    again = record(**{c: r[c] for c in ("order_date", "status", "customer_phone", "customer_email", "city")}, total_amount=str(r.total_amount))
    assert r.corrections and again.corrections == [] and again.classification == "valid"


def test_contract(spark, record):
    df = record(as_table=True)
    assert checks.contract_violations(df).first().violations == []
    broken = df.withColumns({"total_amount": F.lit(-1.0), "status": F.lit(""), "items": F.array().cast(dict(df.dtypes)["items"])})
    assert checks.contract_violations(broken).first().violations == ["empty_status", "negative_total_amount", "no_items"]
    with pytest.raises(ValueError, match="breaks the contract"):
        checks.enforce(broken)
    assert checks.enforce(broken, "quarantine")[1].count() == 1
