"""SQL twins: the cleaning rules and checks once more, as SQL for an independent engine, over the dirty model."""

from __future__ import annotations

from tallyforge.functions import values as V
from tallyforge.plans.models import DIRTY_SQL, twin

NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(values: list[str]) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def latin(c: str) -> str:
    return f"translate({c}, {q(V.EASTERN)}, {q(V.WESTERN)})"


def entry(rule: str, field: str, before: str, after: str, reason: str) -> str:
    return f"'{rule}|{field}|' || {before} || '|' || {after} || '|' || {reason}"


def listed(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when {c} then {e} end" for c, e in pairs) + "], lambda x: x is not null)"


def known(table: dict[str, list[str]], c: str) -> str:
    return f"case {c} " + " ".join(f"when {q(s)} then {q(k)}" for k, others in table.items() for s in [k, *others]) + " end"


def _amount(c: str) -> tuple[str, str, str, str]:
    """Column definitions in four steps for one money column."""
    word = f"case {c}_lat " + " ".join(f"when {q(w)} then cast({v} as double)" for v, forms in V.NUMBER_WORDS.items() for w in forms) + " end"
    rial = " or ".join(f"contains({c}_lat, {q(t)})" for t in V.RIAL_TRIGGERS)
    bare = f"case when {rial} then trim(regexp_replace({c}_lat, {q(V.RIAL_PATTERN.replace('(?U)', ''))}, '', 'g')) else {c}_lat end"
    absent = f"({c} is null or trim({c}) in {among(V.NO_AMOUNT)})"
    err = f"case when {absent} then '{V.UNKNOWN_PRICE}' when {c}_word is not null then null when {c}_num is null then '{V.UNKNOWN_PRICE}' when {c}_num < 0 then '{V.NEGATIVE_VALUE}' end"
    counted = f"not {absent} and {c}_word is null"
    corr = listed(
        (f"not {absent} and {c}_lat <> trim({c})", entry(V.RULE_DIGITS, "amount", f"trim({c})", f"{c}_lat", q(V.SAY_DIGITS_AMOUNT))),
        (f"not {absent} and {c}_word is not null", entry(V.RULE_WORDS, "amount", f"trim({c})", f"cast({c}_word as varchar)", f"'Known Arabic number word ''' || {c}_lat || ''' mapped to ' || cast({c}_word as varchar)")),
        (f"{counted} and ({rial}) and {c}_bare <> {c}_lat", entry(V.RULE_CURRENCY, "amount", f"{c}_lat", f"{c}_bare", q(V.SAY_CURRENCY))),
        (f"{counted} and contains({c}_bare, ',')", entry(V.RULE_COMMAS, "amount", f"{c}_bare", f"replace({c}_bare, ',', '')", q(V.SAY_COMMAS))),
    )
    return (
        f"{latin(f'trim({c})')} as {c}_lat",
        f"{word} as {c}_word, {bare} as {c}_bare",
        f"case when regexp_matches(trim(replace({c}_bare, ',', '')), {q(NUMERIC)}) then try_cast(trim(replace({c}_bare, ',', '')) as double) end as {c}_num",
        f"{err} as {c}_err, case when ({err}) is null then coalesce({c}_word, {c}_num) end as {c}_val, {corr} as {c}_cor",
    )


def _id(c: str, code: str) -> str:
    absent = f"({c} is null or trim({c}) in {among(V.NO_ID)})"
    lat = latin(f"trim({c})")
    cor = listed((f"not {absent} and {lat} <> trim({c})", entry(V.RULE_DIGITS, c, c, lat, q(f"Normalized Arabic digits in {c}"))))
    return f"case when not {absent} then {lat} end as {c}_val, case when {absent} then '{code}' end as {c}_err, {cor} as {c}_cor"


def _words(c: str) -> str:
    text, single = f"trim({c})", f"regexp_replace(trim({c}), '\\s+', ' ', 'g')"
    table = {"city": V.CITIES, "status": V.STATUSES}.get(c)
    spaced = entry(V.RULE_TEXT, c, text, single, q(V.SAY_SPACE))
    if table is None:
        return f"{single} as {c}_val, {listed((f'{single} <> {text}', spaced))} as {c}_cor"
    k = known(table, single)
    ren = f"coalesce(({k}) <> {text}, false)"
    reason = f"'Standardized {c} synonym ''' || {text} || ''' -> ''' || ({k}) || ''''"
    return f"case when {ren} then {k} else {single} end as {c}_val, {listed((ren, entry(V.RULE_TEXT, c, text, f'({k})', reason)), (f'not {ren} and {single} <> {text}', spaced))} as {c}_cor"


_PHONE = "regexp_replace(phone_lat, '[\\s+()-]', '', 'g')"
_LOCAL = f"case when starts_with({_PHONE}, '00967') then substr({_PHONE}, 6) when starts_with({_PHONE}, '967') then substr({_PHONE}, 4) when starts_with({_PHONE}, '0') and length({_PHONE}) = 10 then substr({_PHONE}, 2) else {_PHONE} end"
_DATES = ", ".join(f"'{f}'" for f in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d-%m-%Y %H:%M:%S", "%d-%m-%Y", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d"))


def _number(path: str) -> str:
    given = f"json_extract_string(e, '$.{path}')"
    text = f"replace({latin(f'trim({given})')}, ',', '')"
    return f"case when {given} is null or {text} = '' then 0.0 when regexp_matches({text}, {q(NUMERIC)}) then try_cast({text} as double) end"


def _clean_sql() -> str:
    money = [_amount(c) for c in ("delivery_cost", "total_amount", "payment_amount")]
    step = lambda i: ", ".join(m[i] for m in money)
    texts = ", ".join(_words(c) for c in ("status", "customer_name", "city", "district", "delivery_type", "payment_method", "payment_status"))
    email = "trim(customer_email)"
    at = f"case when contains({email}, '@@') then regexp_replace({email}, '@+', '@', 'g') else {email} end"
    dots = "case when contains(email_at, '..') then regexp_replace(email_at, '\\.+', '.', 'g') else email_at end"
    hopeless = f"({email} in {among(V.NO_EMAIL)} or not contains({email}, '@'))"
    given = "(customer_email is not null and customer_email <> '')"
    sound = f"(not {hopeless} and regexp_matches(email_one, '^[^@\\s]+@[^@\\s]+\\.[a-zA-Z0-9]+$'))"
    email_cor = listed((f"{given} and not {hopeless} and email_at <> {email}", entry(V.RULE_EMAIL, "customer_email", email, "email_at", q(V.SAY_EMAIL_AT))), (f"{given} and not {hopeless} and email_one <> email_at", entry(V.RULE_EMAIL, "customer_email", "email_at", "email_one", q(V.SAY_EMAIL_DOTS))))
    phone_given = "(customer_phone is not null and customer_phone <> '')"
    phone_cor = listed(
        (f"{phone_given} and phone_lat <> trim(customer_phone)", entry(V.RULE_DIGITS, "customer_phone", "trim(customer_phone)", "phone_lat", q(V.SAY_DIGITS_PHONE))),
        (f"{phone_given} and phone_local <> trim(customer_phone) and regexp_matches(phone_local, '^7[01378][0-9]{{7}}$')".replace("{{", "{").replace("}}", "}"), entry(V.RULE_PHONE, "customer_phone", "trim(customer_phone)", "phone_local", q(V.SAY_PHONE_YEMENI))),
        (f"{phone_given} and phone_local <> trim(customer_phone) and not regexp_matches(phone_local, '^7[01378][0-9]{{7}}$') and regexp_matches(phone_local, '^[0-9]{{9}}$')".replace("{{", "{").replace("}}", "}"), entry(V.RULE_PHONE, "customer_phone", "trim(customer_phone)", "phone_local", q(V.SAY_PHONE_PLAIN))),
    )
    iso = f"case when year(moment) between {V.FIRST_YEAR} and {V.LAST_YEAR} then strftime(moment, '%Y-%m-%dT%H:%M:%S') end"
    date_cor = listed(("order_date <> '' and date_lat <> trim(order_date)", entry(V.RULE_DIGITS, "order_date", "trim(order_date)", "date_lat", q(V.SAY_DIGITS_DATE))), ("coalesce(iso <> trim(order_date), false)", entry(V.RULE_DATE, "order_date", "trim(order_date)", "iso", q(V.SAY_DATE))))
    usable = f"(trim(items_json) not in {among(V.NO_ITEMS)} and json_valid(items_json) and json_type(items_json) = 'ARRAY')"
    item = f"{{'sku': coalesce(json_extract_string(e, '$.sku'), ''), 'ok': json_type(e) = 'OBJECT', 'q': {_number('qty')}, 'u': {_number('unit_price')}, 't': {_number('total')}}}"
    deliv = "coalesce(delivery_cost_val, 0.0)"
    fold = "coalesce(list_sum(list_transform(items, lambda i: case when trunc(i.q) > 0 and i.u > 0 then trunc(i.q) * i.u else i.t end)), 0.0)"
    sums = "'items (' || cast(goods as varchar) || ') + delivery (' || cast(deliv as varchar) || ')'"
    absent, off = "(checked and total_amount_err is not null)", "(checked and total_amount_err is null and abs(total_amount_val - want) > 0.01)"
    total_cor = listed(
        (f"{absent} and want > 0", entry(V.RULE_TOTAL, "total_amount", "total_amount", "cast(want as varchar)", f"'Recalculated missing/unparseable order total from valid ' || {sums}")),
        (off, entry(V.RULE_TOTAL, "total_amount", "cast(total_amount_val as varchar)", "cast(want as varchar)", f"'Recalculated mismatched total from ' || {sums}")),
    )
    pay = "trim(payment_amount)"
    signed = f"try_cast(trim(replace(replace({latin(pay)}, 'ريال', ''), ',', '')) as double)"
    none = f"({pay} is null or {pay} in {among(V.NO_PAYMENT)})"
    matched = f"(not {none} and coalesce(payment_amount_err = '{V.NEGATIVE_VALUE}' and {signed} < 0 and abs(abs({signed}) - total_val) < 0.01, false))"
    fixed = listed((matched, entry(V.RULE_SIGN, "payment_amount", pay, f"cast(abs({signed}) as varchar)", "'Corrected negative payment sign to match order total (' || cast(total_val as varchar) || ')'")))
    audit = "order_id_cor, customer_id_cor, date_cor, status_cor, customer_name_cor, city_cor, district_cor, delivery_type_cor, payment_method_cor, payment_status_cor, phone_cor, email_cor, delivery_cost_cor, total_cor, pay_cor"
    codes = "list_sort(list_filter([order_id_err, customer_id_err, date_err, email_err, total_err], lambda x: x is not null))"
    return f"""
with d as ({twin(DIRTY_SQL)}),
s1 as (select *, {step(0)}, {_id('order_id', V.MISSING_ORDER_ID)}, {_id('customer_id', V.MISSING_CUSTOMER_ID)}, {texts},
  {latin('trim(customer_phone)')} as phone_lat, {at} as email_at, {latin('trim(order_date)')} as date_lat,
  case when {usable} then list_transform(from_json(items_json, '["JSON"]'), lambda e: {item}) end as items from d),
s2 as (select *, {step(1)}, {_LOCAL} as phone_local, {dots} as email_one, try_strptime(date_lat, [{_DATES}]) as moment,
  case when items is null or len(list_filter(items, lambda i: not i.ok or i.q is null or i.u is null or i.t is null)) > 0 then '{V.CORRUPTED_ITEMS}' when len(items) = 0 then '{V.EMPTY_ITEMS}' end as items_err from s1),
s3 as (select *, {step(2)}, {iso} as iso, case when items_err is null then {fold} end as goods, len(list_filter(items, lambda i: trunc(i.q) < 0)) > 0 as negative from s2),
s4 as (select *, {step(3)}, {phone_cor} as phone_cor, {email_cor} as email_cor, case when not {given} then '' when {sound} then email_one end as email_val,
  case when {given} and not {sound} then '{V.UNSAFE_EMAIL}' end as email_err, {date_cor} as date_cor, case when iso is null then '{V.INVALID_DATE}' end as date_err,
  case when {phone_given} then phone_local end as phone_val from s3),
s5 as (select *, {deliv} as deliv, goods + {deliv} as want, items_err is null and not (negative and goods <= 0) as checked from s4),
s6 as (select *, case when ({absent} and want > 0) or {off} then want when checked and not {absent} then total_amount_val end as total_val,
  coalesce(items_err, case when not checked then '{V.NEGATIVE_VALUE}' end, case when {absent} and not want > 0 then total_amount_err end) as total_err,
  case when checked then list_concat(total_amount_cor, {total_cor}) else [] end as total_cor from s5),
s7 as (select *, case when {matched} then abs({signed}) when not {none} then payment_amount_val end as pay_val,
  case when {none} then [] else list_concat(payment_amount_cor, {fixed}) end as pay_cor from s6),
s8 as (select *, flatten([{audit}]) as corrections, {codes} as codes from s7),
c as (select *, case when len(codes) > 1 then list_sort(list_append(codes, '{V.SEVERAL_ERRORS}')) else codes end as error_codes,
  case when len(codes) > 0 then 'quarantined' when len(corrections) > 0 then 'corrected' else 'valid' end as classification,
  case when len(codes) > 0 then coalesce(order_id_val, nullif(order_id, ''), 'UNKNOWN_ORDER') else order_id_val end as id_order from s8)
"""


CLEAN_SQL = _clean_sql()


def over_clean(select: str) -> str:
    """A query over ``c``, the cleaned dirty model."""
    return CLEAN_SQL + select
