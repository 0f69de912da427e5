"""Operator 2, PII: format-preserving Feistel pseudonyms. DataFrame and SQL functions only.

One regular expression finds candidates; each is validated by its kind and permuted within its format by a keyed Feistel
network, so that equal values get equal pseudonyms in every document, distinct values stay distinct, and a holder of the
key can invert the map:

* card numbers (13-19 digits that begin with 3 to 6 and have a right Luhn digit; in one piece, in fours, or 4-6-5, parted by
  single spaces or dashes): the first digit stays, the body is permuted and the Luhn digit recomputed;
* phone numbers: the country code stays, all other digits are permuted, punctuation stays where it was;
* social security numbers: permuted among the valid ones (area 001-899 but 666, group 01-99, serial 0001-9999);
* dates from 1900-01-01 (73,000 days; ISO, day/month/year and month/day/year with /, . or -; days and months of two digits):
  permuted as day numbers;
* IPv4 addresses: permuted as a pair of 16-bit halves;
* e-mail addresses (local part and first domain label), access keys and values of password/token/secret assignments:
  letters move within their case, digits within digits, everything else stays. A text that has none of the marks of
  ``GATE`` is passed on as it is, so an access key of letters alone is found only beside one of them.

Values that fail validation (a wrong Luhn digit, an octet over 255, the 31st of February, a 000 area) are left as they are.

Edge cases: a null text stays null, an empty one empty; texts of any length are read whole; repeated rows give repeated
rows; other columns pass through, and a column named ``n_values`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})"
SECRET = r"\bAKIA[A-Z0-9]{16}\b|(?i:\b(?:password|passwd|token|secret|api_?key)[\"']?\s?[=:]\s?[\"']?)[A-Za-z0-9_+/-]{8,}"
IPV4 = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9](?<ds>[/.-])[0-3][0-9]\k<ds>(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])"
_CARD_RUN = r"[3-6][0-9]{12,18}|[3-6][0-9]{3} [0-9]{4} [0-9]{4} [0-9]{1,7}|[3-6][0-9]{3}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|3[47][0-9]{2} [0-9]{6} [0-9]{5}|3[47][0-9]{2}-[0-9]{6}-[0-9]{5}"
CARD = rf"(?<![0-9+])(?:{_CARD_RUN})(?![0-9])"
_NATIONAL = r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
_WORLD = r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?<ps>[ .-])[0-9]{1,4}(?:\k<ps>[0-9]{2,4}){2,4}|\+[0-9]{8,15}"
PHONE = rf"(?<![0-9A-Za-z+])(?:{_WORLD}|{_NATIONAL})(?![0-9])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IPV4, DATE, SSN, PHONE, CARD))
#: No candidate lacks all of these marks; texts without them are passed on unread by the longer pattern.
GATE = "[0-9@=:]"
ROUNDS = 8
DAYS = 365 * 200


def _q(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _digest(key: str, kind: str, rnd: str, other: str) -> str:
    return f"sha2(concat('{key}|{kind}|', {rnd}, '|', {other}), 256)"


def _pair(value: str, left: int, right: int, key: str, kind: str) -> str:
    """A permutation of 0 .. left * right - 1: alternate additions in Z_left and Z_right."""

    def draw(of: str, size: int) -> str:
        return f"cast(pmod(cast(conv(substring({_digest(key, kind, 'k', of)}, 1, 13), 16, 10) as bigint), {size}L) as bigint)"

    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({value} div {right}L as bigint), 'r', cast({value} % {right}L as bigint)), "
        f"(s, k) -> if(k % 2 = 0, named_struct('l', (s.l + {draw('s.r', left)}) % {left}L, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {draw('s.l', right)}) % {right}L)), "
        f"s -> s.l * {right}L + s.r)"
    )


def _chars(value: str, key: str, kind: str, hexed: str = "false") -> str:
    """A permutation of strings of one shape (length two or more): digits, lower and upper letters shift within their class
    by a keyed digest of the other half; ``hexed`` keeps a-f within a-f."""

    def shifted(half: str, other: str) -> str:
        c = f"ascii(substring({half}, i, 1))"
        by = "cast(conv(substring(d, 2 * ((i - 1) % 32) + 1, 2), 16, 10) as int)"
        one = (
            f"case when {c} between 48 and 57 then chr(48 + ({c} - 48 + {by}) % 10) "
            f"when {hexed} and {c} between 97 and 102 then chr(97 + ({c} - 97 + {by}) % 6) "
            f"when {c} between 97 and 122 then chr(97 + ({c} - 97 + {by}) % 26) "
            f"when {c} between 65 and 90 then chr(65 + ({c} - 65 + {by}) % 26) else substring({half}, i, 1) end"
        )
        return f"element_at(transform(array({_digest(key, kind, 'k', other)}), d -> array_join(transform(sequence(1, length({half})), i -> {one}), '')), 1)"

    half = f"length({value}) div 2"
    return (
        f"if(length({value}) < 2, {value}, aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substring({value}, 1, cast({half} as int)), 'r', substring({value}, cast({half} as int) + 1)), "
        f"(s, k) -> if(k % 2 = 0, named_struct('l', {shifted('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {shifted('s.r', 's.l')})), s -> concat(s.l, s.r)))"
    )


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _lay(mask: str, digits: str, skip: str = "0") -> str:
    """``digits`` put in place of the digits of ``mask`` after its first ``skip``."""
    at = f"length(regexp_replace(substring({mask}, 1, j), '[^0-9]', ''))"
    return f"array_join(transform(sequence(1, length({mask})), j -> if(substring({mask}, j, 1) between '0' and '9' and {at} > {skip}, substring({digits}, {at} - {skip}, 1), substring({mask}, j, 1))), '')"


def _luhn_sum(digits: str) -> str:
    """Of a number whose check digit is still to come: every second digit from the right is doubled."""
    d = f"cast(substring({digits}, p, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, p) -> t + if((length({digits}) - p) % 2 = 0, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))"


def _card(m: str, key: str) -> str:
    valid = f"(10 - {_luhn_sum('body')} % 10) % 10 = cast(substring(n, length(n), 1) as int)"
    new = _bind(_chars("substring(body, 2)", key, "card"), "p", _bind("concat(substring(body, 1, 1), p)", "w", f"concat(w, cast((10 - {_luhn_sum('w')} % 10) % 10 as string))"))
    laid = _bind(new, "z", _lay(m, "z"))
    return _bind(f"regexp_replace({m}, '[^0-9]', '')", "n", _bind("substring(n, 1, length(n) - 1)", "body", f"if({valid}, {laid}, {m})"))


def _phone(m: str, key: str) -> str:
    code = f"length(regexp_replace(regexp_extract({m}, {_q('^[+][0-9]{1,3}(?=[ .(-])')}, 0), '[^0-9]', ''))"
    return _bind(code, "cc", _bind(_chars(f"substring(regexp_replace({m}, '[^0-9]', ''), cc + 1)", key, "phone"), "z", _lay(m, "z", "cc")))


def _ssn(m: str, key: str) -> str:
    area = f"cast(substring({m}, 1, 3) as bigint)"
    rank = f"(({area} - 1 - if({area} > 666, 1, 0)) * 99 + cast(substring({m}, 5, 2) as bigint) - 1) * 9999 + cast(substring({m}, 8, 4) as bigint) - 1"
    a = "v div 989901L"
    text = f"format_string('%03d-%02d-%04d', {a} + 1 + if({a} >= 665, 1, 0), (v div 9999L) % 99L + 1, v % 9999L + 1)"
    return _bind(f"({rank})", "r0", _bind(_pair("r0", 898 * 99, 9999, key, "ssn"), "v", text))


def _date(m: str, key: str) -> str:
    """ISO, else day first where that is a date, else month first; other digits are left."""
    sep = f"substring({m}, 3, 1)"
    iso, dmy, mdy = f"try_to_date({m}, 'yyyy-MM-dd')", f"try_to_date(translate({m}, './', '--'), 'dd-MM-yyyy')", f"try_to_date(translate({m}, './', '--'), 'MM-dd-yyyy')"
    kind = f"case when {iso} is not null then 'i' when {dmy} is not null then 'd' when {mdy} is not null then 'm' end"
    day = f"datediff(case f when 'i' then {iso} when 'd' then {dmy} else {mdy} end, date'1900-01-01')"
    new = _bind(f"date_add(date'1900-01-01', cast({_pair('cast(y as bigint)', 365, 200, key, 'date')} as int))", "o", f"case f when 'i' then date_format(o, 'yyyy-MM-dd') when 'd' then replace(date_format(o, 'dd-MM-yyyy'), '-', {sep}) else replace(date_format(o, 'MM-dd-yyyy'), '-', {sep}) end")
    return _bind(kind, "f", f"if(f is null, {m}, {_bind(day, 'y', f'if(y between 0 and {DAYS - 1}, {new}, {m})')})")


def _ipv4(m: str, key: str) -> str:
    octet = lambda n: f"cast(split_part({m}, '.', {n}) as bigint)"
    rank = f"(({octet(1)} * 256 + {octet(2)}) * 256 + {octet(3)}) * 256 + {octet(4)}"
    return _bind(_pair(f"({rank})", 65536, 65536, key, "ipv4"), "v", "concat_ws('.', v div 16777216L, (v div 65536L) % 256L, (v div 256L) % 256L, v % 256L)")


def _email(m: str, key: str) -> str:
    """The top-level domain and everything between it and the first domain label stay."""
    head = _q("^([^@]+@[^.]+)(.+)$")
    return f"concat({_bind(f'regexp_extract({m}, {head}, 1)', 'h', _chars('h', key, 'email'))}, regexp_extract({m}, {head}, 2))"


def _secret(m: str, key: str) -> str:
    parts = _q("^(AKIA|.*?[=:][^A-Za-z0-9_+/-]*)([A-Za-z0-9_+/-]+)$")
    value = _bind(f"regexp_extract({m}, {parts}, 2)", "h", _chars("h", key, "secret", "h rlike '^[0-9a-f]+$'"))
    return f"concat(regexp_extract({m}, {parts}, 1), {value})"


def _pseudonym(m: str, key: str) -> str:
    whole = lambda p: f"{m} rlike {_q('^(?:' + p + ')$')}"
    kinds = ((EMAIL, _email), (SECRET, _secret), (IPV4, _ipv4), (DATE, _date), (SSN, _ssn), (PHONE, _phone), (CARD, _card))
    return "case " + " ".join(f"when {whole(p)} then {f(m, key)}" for p, f in kinds) + f" else {m} end"


def pseudonymize(docs: DataFrame, key: str = "rotate-this-key", text: str = "text") -> DataFrame:
    """``docs`` with every found value in ``text`` replaced, and ``n_values``, the number replaced. No shuffle.

    The key is a literal of the plan and so reaches the event log; give each job its own and keep the logs as you keep it.
    """
    if not key.replace("-", "").replace("_", "").isalnum():
        raise ValueError("key: letters, digits, - and _ only")
    found = f"if(`{text}` rlike '{GATE}', regexp_extract_all(`{text}`, {_q(ANY)}, 0), array())"
    hits = docs.withColumn("__hits", F.expr(f"coalesce({found}, array())"))
    new = hits.withColumn("__new", F.expr(f"transform(__hits, m -> {_pseudonym('m', key)})"))
    joined = f"array_join(flatten(zip_with(split(`{text}`, {_q(ANY)}, -1), __new, (g, p) -> array(g, coalesce(p, '')))), '')"
    changed = F.expr("size(filter(zip_with(__hits, __new, (a, b) -> a != b), c -> c))").cast("long")
    out = new.withColumn("n_values", changed).withColumn(text, F.expr(f"if(n_values = 0, `{text}`, {joined})"))
    return out.drop("__hits", "__new")
