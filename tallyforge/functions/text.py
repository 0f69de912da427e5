"""Building blocks of the rules, and the rules for identifiers, words, phones, e-mails and dates.

A rule of a text column is a list of layers, each a dict of columns that may read those of the layers before it; its last
layer is the rule's result, a struct (value, corrections, error). What a rule needs on the way has a name within the
expression (``let``), so that a text is stripped, translated and matched once however often it is then used, and rows are not
copied for it. Corrections are an array in audit order; error is null where the value is usable. Everything is a built-in
expression.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.schemas import CORRECTION

Rule = list[dict[str, Column]]
#: Characters of the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def apply(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """``df`` with each rule's result under its name; what the rules need on the way is dropped."""
    inner: list[str] = []
    for layer in zip_longest(*([*rule[:-1]] for rule in rules.values()), fillvalue={}):
        columns = {name: c for part in layer for name, c in part.items()}
        inner += columns
        df = df.withColumns(columns)
    return df.withColumns({out: next(iter(rule[-1].values())) for out, rule in rules.items()}).drop(*inner)


def let(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` of the values, each of which is evaluated once."""
    named = F.array(F.struct(*[c.alias(name) for name, c in values.items()]))
    return F.transform(named, lambda s: body(*[s[name] for name in values]))[0]


def no_corrections() -> Column:
    return F.expr(f"cast(array() as array<{CORRECTION}>)")


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.btrim(c, F.lit(SPACES))


def latin_digits(c: Column) -> Column:
    """Eastern digits and marks as Western ones; a text of ASCII has none."""
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, V.EASTERN, V.WESTERN))


def note(rule: str, field: str, before: Column, after: Column, reason: Column | str) -> Column:
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(rule).alias("rule_code"), F.lit(field).alias("field"), before.cast("string").alias("original_value"), after.cast("string").alias("corrected_value"), why.alias("reason"))


def notes(*pairs: tuple[Column, Column]) -> Column:
    """The corrections whose condition holds, in order."""
    if not pairs:
        return no_corrections()
    kept = [F.when(cond, F.array(correction)).otherwise(no_corrections()) for cond, correction in pairs]
    any_of = pairs[0][0]
    for cond, _ in pairs[1:]:
        any_of = any_of | cond
    return kept[0] if len(kept) == 1 else F.when(any_of, F.concat(*kept)).otherwise(no_corrections())


def outcome(value: Column, corrections: Column, error: Column | None = None) -> Column:
    return F.struct(value.alias("value"), corrections.alias("corrections"), (F.lit(None).cast("string") if error is None else error).alias("error"))


def lookup(table: dict[str, list[str]], c: Column) -> Column:
    """The standard form of a known spelling, else null."""
    pairs = [F.lit(x) for standard, others in table.items() for s in [standard, *others] for x in (s, standard)]
    return F.try_element_at(F.create_map(*pairs), c)


def floating(c: Column) -> Column:
    """A double as text with at least one decimal place and no exponent."""
    plain = F.when((F.abs(c) < 1e7) & ((F.abs(c) >= 1e-3) | (c == 0)), c.cast("string"))
    wide = F.regexp_replace(c.cast("string").cast("decimal(38,6)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return F.coalesce(plain, wide)


def number(c: Column) -> Column:
    """A double if the text is a plain decimal number and finite, else null."""
    value = F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def unless(plain: Column, rule: Rule) -> Column:
    """The result of a rule of one layer, null for texts that are plain: a row whose fields are sound carries next to nothing."""
    return F.when(F.coalesce(plain, F.lit(False)), F.lit(None)).otherwise(rule[-1][""])


def sound(source: str) -> Column:
    """The result of a text that stays as it is."""
    return outcome(F.col(source), no_corrections())


#: Visible ASCII without white space, and with single spaces between words.
ONE_WORD, SPACED_WORDS = r"^[!-~]+\z", r"^[!-~]+( [!-~]+)*+\z"
PLAIN_PHONE, PLAIN_EMAIL = r"^7[01378][0-9]{7}\z", r"^[!-\-/-?A-~]++(\.[!-\-/-?A-~]++)*+@([!-\-/-?A-~]++\.)++[a-zA-Z0-9]++\z"


def identifier(source: str, missing: str, field: str | None = None) -> Rule:
    """A required key: absent forms are an error, Eastern digits are converted."""
    field, c = field or source, F.col(source)

    def result(text: Column, clean: Column) -> Column:
        absent = c.isNull() | text.isin(V.NO_ID)
        fixed = note(V.RULE_DIGITS, field, c, clean, f"Normalized Arabic digits in {field}")
        return outcome(F.when(~absent, clean), notes((~absent & (clean != text), fixed)), F.when(absent, missing))

    return [{"": let(lambda text: let(lambda latin: result(text, latin), latin=latin_digits(text)), text=strip(c))}]


def standards(field: str) -> list[str]:
    """The words of a field that are in their standard form."""
    return [*{"city": V.CITIES, "status": V.STATUSES}.get(field, {})]


def words(source: str, field: str | None = None) -> Rule:
    """One space between words; known spellings of cities and states become their standard form."""
    field = field or source
    table = {"city": V.CITIES, "status": V.STATUSES}.get(field)

    def result(text: Column, single: Column, known: Column | None = None) -> Column:
        if known is None:
            return outcome(single, notes((single != text, note(V.RULE_TEXT, field, text, single, V.SAY_SPACE))))
        renamed = F.coalesce(known != text, F.lit(False))
        reason = F.concat(F.lit(f"Standardized {field} synonym '"), text, F.lit("' -> '"), known, F.lit("'"))
        spaced = (~renamed & (single != text), note(V.RULE_TEXT, field, text, single, V.SAY_SPACE))
        return outcome(F.when(renamed, known).otherwise(single), notes((renamed, note(V.RULE_TEXT, field, text, known, reason)), spaced))

    def with_single(text: Column, single: Column) -> Column:
        return result(text, single) if table is None else let(lambda known: result(text, single, known), known=lookup(table, single))

    spread = lambda text: F.when(text.rlike(r"(?U)\s\s|[^\S ]"), F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text)
    return [{"": let(lambda text: let(lambda single: with_single(text, single), single=spread(text)), text=strip(F.coalesce(F.col(source), F.lit(""))))}]


def phone(source: str, field: str = "customer_phone") -> Rule:
    """National nine-digit form; numbers of another shape keep their digits and symbols stripped, without an audit entry."""
    c = F.col(source)
    given = c.isNotNull() & (c != "")
    digits = lambda latin: F.when(latin.rlike("^[0-9]*$"), latin).otherwise(F.regexp_replace(latin, r"(?U)[\s+\-()]", ""))

    def national(bare: Column) -> Column:
        return (
            F.when(bare.startswith("00967"), bare.substr(F.lit(6), F.length(bare)))
            .when(bare.startswith("967"), bare.substr(F.lit(4), F.length(bare)))
            .when(bare.startswith("0") & (F.length(bare) == 10), bare.substr(F.lit(2), F.length(bare)))
            .otherwise(bare)
        )

    def result(text: Column, latin: Column, local: Column) -> Column:
        yemeni, nine = local.rlike(r"^7[01378][0-9]{7}$"), local.rlike(r"^[0-9]{9}$")
        changed = given & (local != text)
        found = notes(
            (given & (latin != text), note(V.RULE_DIGITS, field, text, latin, V.SAY_DIGITS_PHONE)),
            (changed & yemeni, note(V.RULE_PHONE, field, text, local, V.SAY_PHONE_YEMENI)),
            (changed & ~yemeni & nine, note(V.RULE_PHONE, field, text, local, V.SAY_PHONE_PLAIN)),
        )
        return outcome(F.when(given, local), found)

    def with_latin(text: Column, latin: Column) -> Column:
        return let(lambda bare: let(lambda local: result(text, latin, local), local=national(bare)), bare=digits(latin))

    return [{"": let(lambda text: let(lambda latin: with_latin(text, latin), latin=latin_digits(text)), text=strip(c))}]


def email(source: str, field: str = "customer_email") -> Rule:
    """Repeated @ and dots collapse; what is then no address is unsafe. No address at all is not an error."""
    c = F.col(source)
    given = c.isNotNull() & (c != "")
    ats = lambda text: F.when(text.contains("@@"), F.regexp_replace(text, "@+", "@")).otherwise(text)
    dots = lambda one_at: F.when(one_at.contains(".."), F.regexp_replace(one_at, r"\.+", ".")).otherwise(one_at)

    def result(text: Column, one_at: Column, one_dot: Column) -> Column:
        hopeless = text.isin(V.NO_EMAIL) | ~text.contains("@")
        sound = ~hopeless & one_dot.rlike(r"^[^@\s]+@[^@\s]+\.[a-zA-Z0-9]+$")
        repair = given & ~hopeless
        found = notes((repair & (one_at != text), note(V.RULE_EMAIL, field, text, one_at, V.SAY_EMAIL_AT)), (repair & (one_dot != one_at), note(V.RULE_EMAIL, field, one_at, one_dot, V.SAY_EMAIL_DOTS)))
        return outcome(F.when(~given, "").when(sound, one_dot), found, F.when(given & ~sound, V.UNSAFE_EMAIL))

    return [{"": let(lambda text: let(lambda at: let(lambda dot: result(text, at, dot), dot=dots(at)), at=ats(text)), text=strip(c))}]


_ISO = "yyyy-MM-dd'T'HH:mm:ss"
#: The shape of ISO with seconds.
PLAIN_DATE = r"^[0-9]{4}-[01][0-9]-[0-3][0-9]T[0-2][0-9](:[0-5][0-9]){2}\z"


def plain_date(source: str) -> Column:
    """Whether a text is a real time within the years allowed, as it stands."""
    c = F.col(source)
    near = c.substr(1, 4).between(str(V.FIRST_YEAR), str(V.LAST_YEAR))
    return F.when(c.rlike(PLAIN_DATE) & near, F.date_format(F.try_to_timestamp(c, F.lit(V.DATE_FORMATS[0])), _ISO) == c)


def date(source: str, field: str = "order_date") -> Rule:
    """ISO with seconds, from the first format that fits and gives a real day within the years allowed."""
    c = F.col(source)
    given = c.isNotNull() & (c != "")
    # a text of a format's own shape fits no other; anything else is tried with all in turn
    shapes = [(f, "^" + f.replace("'T'", "T").replace("yyyy", "[0-9]{4}").translate({ord(x): "[0-9]{1,2}" for x in "MdHms"}) + "$") for f in V.DATE_FORMATS]

    def parsed(latin: Column) -> Column:
        out = F.when(~given, F.lit(None).cast("timestamp"))
        for f, shape in shapes:
            out = out.when(latin.rlike(shape), F.try_to_timestamp(latin, F.lit(f)))
        return out.otherwise(F.coalesce(*[F.try_to_timestamp(latin, F.lit(f)) for f in V.DATE_FORMATS]))

    def result(text: Column, latin: Column, iso: Column) -> Column:
        sound = given & iso.isNotNull()
        found = notes((given & (latin != text), note(V.RULE_DIGITS, field, text, latin, V.SAY_DIGITS_DATE)), (sound & (iso != text), note(V.RULE_DATE, field, text, iso, V.SAY_DATE)))
        return outcome(F.when(sound, iso), found, F.when(~sound, V.INVALID_DATE))

    standard = lambda moment: F.when(F.year(moment).between(V.FIRST_YEAR, V.LAST_YEAR), F.date_format(moment, _ISO))
    read = lambda latin, body: let(lambda moment: let(body, iso=standard(moment)), **{f"__{source}_moment": parsed(latin)})
    return [{"": let(lambda text: let(lambda latin: read(latin, lambda iso: result(text, latin, iso)), latin=latin_digits(text)), text=strip(c))}]
