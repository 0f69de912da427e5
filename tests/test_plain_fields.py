"""Fields that no rule touches take a short way; its results are those of the rules."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import money, text
from tallyforge.operators import classify
from tallyforge.schemas import RAW_COLUMNS

ITEMS = [
    '[{"sku":"A","name":"b","qty":2,"unit_price":3.5,"total":7}]', '[{"sku": "A", "name": "b", "qty": -2, "unit_price": 3.50, "total": -7.25}, {"sku": "", "name": "", "qty": 0, "unit_price": 0, "total": 0.0}]',
    '[{"sku":"A","name":"true","qty":-0,"unit_price":-0.0,"total":-0.5}]', '[{"sku":"A","name":"b","qty":1.5,"unit_price":1e2,"total":12345678901}]', '[{"sku":"a\\"b","name":"b","qty":1,"unit_price":1,"total":1}]',
    '[{"sku":"A","name":"b","qty":1,"unit_price":1,"total":1},]', '[{"sku":"A","name":"b","qty":01,"unit_price":1,"total":1}]', ' [{"sku":"A","name":"b","qty":1,"unit_price":1,"total":1}]\n', '[]', "", None, "not-json", "[1]",
    '[{"name":"b","sku":"A","qty":1,"unit_price":1,"total":1}]', '[{"sku":"صنعاء","name":"b","qty":999999999,"unit_price":999999999.999999,"total":1}]',
]
TEXTS = {
    "order_id": ["ORD-1", " ORD-1", "ORD-1\n", "ORD 1", "ORD-١", "null", "nan", "none", "", " ", None], "customer_id": ["NaN", "null", "C\u2003", "C-1"],
    "customer_phone": ["771234567", "721234567", "0771234567", "+967 771234567", "771234567\n", "٧٧1234567", "", None], "customer_email": ["a@b.c", "a..b@c.de", ".a@b.c", "a@b..c", "a@@b.c", "a@b.c-d", "a@b", "a b@c.de", "a@b.c\n", "@@", "@", "???", "", None],
    "status": ["paid", "a  b", "a b", " a", "a\tb", "a\n", "مسلم", "", None], "city": ["صنعا", "NATION_2", "a b c", None],
    "delivery_cost": ["2000.0", "0", "007", "1.5\n", "-1", "1,000", "٢", "1e3", ".5", "5.", "999999999999999.999999", "9999999999999999", "ألفان", "5 YER", "nan", "N/A", "", None],
    "items_json": ITEMS,
}


@pytest.fixture(scope="module")
def rows(spark):
    n = max(map(len, TEXTS.values()))
    data = [tuple(TEXTS[c][i % len(TEXTS[c])] if c in TEXTS else None for c in RAW_COLUMNS) for i in range(n)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in RAW_COLUMNS))


def test_short_way_gives_what_the_rules_give(rows):
    whole = {"order_id__rule": text.identifier("order_id", "MISSING_ORDER_ID"), "customer_id__rule": text.identifier("customer_id", "MISSING_CUSTOMER_ID"), "customer_phone__rule": text.phone("customer_phone")}
    whole |= {"customer_email__rule": text.email("customer_email"), "delivery_cost__amount": money.amount("delivery_cost"), **{f"{c}__rule": text.words(c) for c in ("status", "city")}}
    assert classify.clean(rows).select(*whole).collect() == text.apply(rows, whole).select(*whole).collect()


def test_plain_lists_give_what_other_lists_give(spark, rows, monkeypatch):
    made = [f"{c}" for c in money.items()]
    short = text.apply(rows, money.items()).select("items_json", *made).collect()
    monkeypatch.setattr(money, "PLAIN_ITEMS", "^no list$")
    assert repr(short) == repr(text.apply(rows, money.items()).select("items_json", *made).collect())  # repr tells -0.0 from 0.0


def test_long_plain_list_is_read_whole(spark):
    one = '{"sku":"A","name":"b","qty":1,"unit_price":2,"total":2}'
    long = spark.range(1).select(F.concat(F.lit("["), F.repeat(F.lit(one + ","), 49_999), F.lit(one + "]")).alias("items_json"))
    found = text.apply(long, money.items()).select(F.size("__items"), "__items_error", "__items_sum").first()
    assert tuple(found) == (50_000, None, 100_000.0)


def test_profile_of_dates_runs_no_other_rule(rows):
    from tallyforge.operators import profile

    plan = profile.date_quality(classify.verdict(rows, "order_date__rule.error", "order_date__rule.corrections"))._jdf.queryExecution().optimizedPlan().toString()
    assert "__order_date_moment" in plan and not any(x in plan for x in ("__customer_phone_odd", "__items", "__status_odd", "__delivery_cost_odd"))
