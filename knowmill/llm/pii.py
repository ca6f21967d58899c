"""Format-preserving pseudonyms for personal data, as DataFrame expressions only.

A keyed Feistel network over two moduli permutes all digit strings of a length, so that a number maps to another
number of the same format and equal numbers stay equal in all documents. Card numbers keep a valid Luhn digit, IBANs
valid check digits, IPv4 octets stay in range (IPv6 addresses are written in full), social security numbers keep to those
that can be issued. Phone numbers keep their country code and their leading noughts; the rest is permuted, so that the
national and the international form of a number stay linked. Dates are permuted within their own 3,652 days (about ten
years) and written in the form and language they had; of dates with slashes those that can be read both ways are permuted
among such dates, the others among those with a day over twelve. Numbers that fail their check are no personal data and
stay. The local part and the host's name of mail addresses, whose short ones would not leave room for all others, become
keyed tokens of 16 and 12 characters, so that different addresses stay different; secrets and keys take keyed tokens of
their own length.

Null texts stay null; empty texts stay empty; texts without personal data are returned unchanged. Rows that repeat an id
are changed each by itself; ids are not read. Extra columns stay, but n_pii takes the place of a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, table, with_text

ROUNDS = 8
#: Production callers pass their own key; this one is for tests and the registered query.
KEY = "knowmill-demo-key"
#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: A country's IBAN ends at its length, so that a following token is no part of it; other countries' end where the code does.
IBAN = "|".join(
    [rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"\b" for n, c in IBAN_LENGTHS.items()]
    + [r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"]
)
#: Phone numbers: groups of three and four digits behind a country code, an area in brackets, a nought or with three digits
#: and four at the end (else groups of three are a number with thousands); in pairs; an area code and one group; without gaps.
PHONES = (
    r"(?<![\w.+])(?:(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])|\(\d{2,4}\)[ .-]?|0\d{1,3}[ .-])\d{3,4}[ .-]\d{3,4}(?![ .-]?\d|\w)",
    r"(?<![\w.+])(?<!\d[ .-])[2-9]\d{2}[ .-]\d{3}[ .-]\d{4}(?![ .-]?\d|\w)",
    r"(?<![\w.+])(?<!\d[ -])(?:(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?[1-9]|0[1-9])(?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})(?![ .-]?\d|\w)",
    r"(?<![\w.+])(?<!\d[ -])(?:(?:\+|00)\d{1,3}[ .-]?)?(?:[6-9]\d{2} \d{2}|[6-9]\d \d{3})(?: \d{2}){2}(?! ?\d|\w)",
    r"(?<![\w.+])(?<!\d[ -])(?:(?:\+|00)\d{1,3}[ .-]?(?:\(0\)[ .-]?)?[1-9]\d{0,4}|\(0\d{1,4}\)|0[1-9]\d{0,3})[ ./-]{1,3}\d{5,8}(?![ .-]?\d|\w)",
    r"(?<!\w)\+\d{8,15}(?!\w)",
)
#: Calling codes of one and of two digits; others have three.
ONE_DIGIT = "17"
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
#: Names of months by language.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
MONTH = "(?i:" + "|".join(sorted({m for some in MONTHS.values() for m in some.split()}, key=lambda m: (-len(m), m))) + ")"
#: Day, month and year around a month's name; day and year at the ends, or the month first.
NAMED = rf"(?<![\w.,/-])\d{{1,2}}(?:\.|st|nd|rd|th|er)? (?:de )?{MONTH},? (?:de )?\d{{4}}(?!\w)|(?<!\w){MONTH} \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}(?!\w)"
HEX = "[0-9A-Fa-f]{1,4}"
#: Kinds of personal data, tried in this order.
KINDS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?i:\b(?:api[_-]?key|token|secret|password|passwd|pwd)\s*[=:]\s*[\"']?(?:[A-Za-z0-9_-]{16,}|(?=[A-Za-z_-]*\d)[A-Za-z0-9_-]{8,}))",
    "key": r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})(?![\w-])",
    "ipv6": rf"(?<![\w:.])(?:(?:{HEX}:){{7}}{HEX}|(?=[A-Fa-f:]*\d)(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![\w:]|\.\d)",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "iban": rf"\b(?i:(?=[A-Z]{{2}}\d{{2}})(?:{IBAN}))",
    "date": rf"(?<![\w.-])(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}|(?<!/)\d{{1,2}}/\d{{1,2}}/\d{{4}}(?!/))(?![\w-])|{NAMED}",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": "|".join(PHONES),
}
#: Where nothing of this is found, a text holds no personal data.
GATE = r"@|[0-9][0-9]|::|AKIA|AIza|sk-|gh[pousr]_|xox|(?i:api[_-]?key|token|secret|password|passwd|pwd)"
ANY = "|".join(KINDS.values())


def _mix(key: str, *parts: Column) -> Column:
    """60 keyed bits of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """Permutes pairs (left mod a, right mod b): each round adds a keyed function of one half to the other."""
    as_long = lambda c: c.cast("long")
    first = F.struct(as_long(left).alias("l"), as_long(right).alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(_mix(key, tweak, i, s["r"]), a), a)
        right = F.pmod(s["r"] + F.pmod(_mix(key, tweak, i, s["l"]), b), b)
        odd = i % 2 == 1
        return F.struct(F.when(odd, left).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(right).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (at most 36); one to one for each length and kind."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    s = feistel(
        F.coalesce(F.substr(digits, F.lit(1), low).try_cast("long"), F.lit(0)), F.substr(digits, low + 1).cast("long"),
        power(low), power(n - low), key, F.concat(F.lit(kind), n.cast("string")),
    )
    joined = lambda s: F.concat(F.when(low > 0, F.lpad(s["l"].cast("string"), low, "0")).otherwise(""), F.lpad(s["r"].cast("string"), n - low, "0"))
    return F.get(F.transform(F.array(s), joined), F.lit(0))


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of the digits, the last being the check digit."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)


def _with_luhn(body: Column) -> Column:
    return F.concat(body, F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits read as a number, letters as 10 to 35."""
    number = F.transform(F.split(text, ""), lambda c: F.conv(c, 36, 10))
    return F.aggregate(number, F.lit(0), lambda a, x: F.pmod(a * F.when(F.length(x) == 2, 100).otherwise(10) + x.cast("int"), F.lit(97)))


def _refill(shape: Column, digits: Column) -> Column:
    """Puts the digits where shape has digits, other characters stay."""
    seen = lambda i: F.length(F.regexp_replace(F.substr(shape, F.lit(1), i + 1), r"\D", ""))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substr(digits, seen(i), F.lit(1))).otherwise(c)), "")


def _token(value: Column, key: str, kind: str, size: int | None = None) -> Column:
    """As many characters as value (or ``size``), of lower-case letters and digits, keyed."""
    return F.substr(F.repeat(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 256), 4), F.lit(1), F.length(value) if size is None else F.lit(size))


EPOCH = "1600-01-01"


def _moved(n: Column, key: str) -> Column:
    """Another of the same 3,652 = 44 * 83 days; n: days since 1600."""
    k = F.pmod(n, F.lit(3652))
    s = feistel(F.floor(k / 83), F.pmod(k, F.lit(83)), F.lit(44), F.lit(83), key, F.lit("date"))
    return F.get(F.transform(F.array(s), lambda s: (s["l"] * 83 + s["r"]).cast("int")), F.lit(0)) + F.floor(n / 3652).cast("int") * 3652


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1600; null where there is no such day."""
    iso = F.concat_ws("-", *[F.lpad(c.cast("string"), n, "0") for c, n in ((year, 4), (month, 2), (day, 2))])
    return F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(EPOCH).cast("date"))


def _as_date(n: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), n)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _numbers(m: Column) -> tuple[Column, Column, Column]:
    part = F.split(m, r"\D+")
    return tuple(F.get(part, F.lit(k)).cast("int") for k in range(3))


def _date(m: Column, key: str) -> Column:
    """A date of digits: year-month-day, or day.month.year with or without noughts in front."""
    a, b, c = _numbers(m)
    iso = m.contains("-")
    days = F.when(iso, _days(a, b, c)).otherwise(_days(c, b, a))
    form = lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).when(m.rlike(r"^\d\d\.\d\d\."), F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "d.M.yyyy"))
    return F.when(days.isNull(), m).otherwise(_let(_as_date(_moved(days, key)), form))


#: Steps in which a day over twelve is looked for; that there is none in so many has a chance of 10 ** -25.
STEPS = 64


def _slashed(m: Column, key: str) -> Column:
    """A date with slashes. One that can be read day first and month first becomes another such date of its ten years. The
    others say themselves which part is the day: they are permuted until the day is over twelve again."""
    a, b, year = _numbers(m)
    two = m.rlike(r"^\d\d/\d\d/")
    write = lambda x, y, z: F.concat_ws("/", *[F.when(two, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string")) for c in (x, y)], F.lpad(z.cast("string"), 4, "0"))
    both = feistel(F.pmod(year, F.lit(10)) * 12 + a - 1, b - 1, F.lit(120), F.lit(12), key, F.concat(F.lit("slash"), F.floor(year / 10).cast("string")))
    either = _let(both, lambda s: write(F.pmod(s["l"], F.lit(12)) + 1, s["r"] + 1, F.floor(year / 10) * 10 + F.floor(s["l"] / 12)))
    days = F.when(a > 12, _days(year, b, a)).otherwise(_days(year, a, b))
    far = lambda n: F.dayofmonth(_as_date(n)) > 12
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), days, lambda n, i: F.when((i > 1) & far(n), n).otherwise(_moved(n, key)))
    day_first = lambda d: F.when(a > 12, write(F.dayofmonth(d), F.month(d), F.year(d))).otherwise(write(F.month(d), F.dayofmonth(d), F.year(d)))
    sound = a.between(1, 12) & b.between(1, 12) & (year >= 1600)
    return F.when(sound, either).when(days.isNull() | (days < 0), m).otherwise(_let(_as_date(walked), day_first))


def _named_date(m: Column, key: str) -> Column:
    """A date with its month's name, in the language of the name (German after a day with a full stop, else English first)."""
    name = F.regexp_extract(m, f"({MONTH})", 1)
    day, year = F.regexp_extract(m, r"(?<!\d)(\d{1,2})(?!\d)", 1), F.regexp_extract(m, r"(\d{4})$", 1)
    lists = {k: F.array(*[F.lit(x) for x in v.split()]) for k, v in MONTHS.items()}
    place = {k: F.array_position(F.transform(v, F.lower), F.lower(name)) for k, v in lists.items()}
    german = F.when(m.rlike(r"^\d+\.") & (place["de"] > 0), lists["de"])
    own = F.coalesce(german, *[F.when(place[k] > 0, lists[k]) for k in lists])
    days = _days(year.cast("int"), F.greatest(*place.values()), day.cast("int"))

    def write(d: Column) -> Column:
        month = F.get(own, F.month(d) - 1)
        month = F.when(name == F.upper(name), F.upper(month)).when(name == F.lower(name), F.lower(month)).otherwise(F.when(F.rlike(name, F.lit(r"^\p{Lu}")), F.concat(F.upper(F.substring(month, 1, 1)), F.substr(month, F.lit(2)))).otherwise(month))
        n = F.dayofmonth(d)
        english = F.when(n.isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
        suffix = F.when(m.rlike(r"(?i)\d(?:st|nd|rd|th)\b"), english).when(m.rlike(r"^\d+er") & (n == 1), "er").when(m.rlike(r"^\d+\."), ".").otherwise("")
        after_day, after_month = F.when(m.rlike(r"^\d+\D* de "), " de ").otherwise(" "), F.when(m.rlike(r" de \d{4}$"), " de ").when(m.contains(","), ", ").otherwise(" ")
        shown = F.when(m.rlike(r"^0\d"), F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
        day_first = F.concat(shown, suffix, after_day, month, after_month, F.lpad(F.year(d).cast("string"), 4, "0"))
        month_first = F.concat(month, F.lit(" "), shown, suffix, after_month, F.lpad(F.year(d).cast("string"), 4, "0"))
        return F.when(m.rlike(r"^\d"), day_first).otherwise(month_first)

    return F.when(days.isNull() | (days < 0), m).otherwise(_let(_as_date(_moved(days, key)), write))


def _phone(m: Column, digits: Column, key: str) -> Column:
    """The calling code and leading noughts stay; the rest keeps a first digit that is none, and of ten digits one over 1."""
    abroad = F.when(m.rlike(r"^\+"), 0).when(digits.startswith("00"), 2)
    tail = F.substr(digits, F.coalesce(abroad, F.lit(0)) + 1)
    code = F.when(F.substring(tail, 1, 1).isin(*ONE_DIGIT), 1).when(F.substring(tail, 1, 2).isin(*TWO_DIGITS.split()), 2).otherwise(3)
    head = F.when(abroad.isNull(), 0).otherwise(abroad + code)
    rest = F.substr(digits, head + 1)
    noughts = F.length(rest) - F.length(F.ltrim(rest, F.lit("0")))
    own = F.ltrim(rest, F.lit("0"))
    fixed = (F.length(own) == 10) & own.startswith("1")
    start = head + noughts + fixed.cast("int")
    body = F.substr(digits, start + 1)
    least = F.when(fixed, 0).when(F.length(own) == 10, 2).otherwise(1)
    return _refill(m, F.concat(F.substr(digits, F.lit(1), start), permute_number(body, least, key, "phone")))


def permute_number(digits: Column, least: Column, key: str, kind: str) -> Column:
    """Another number of as many digits (2 to 36) whose first is ``least`` (0 to 2) or more, as the given one's is."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    under = least * power(low - 1)
    s = feistel(F.substr(digits, F.lit(1), low).cast("long") - under, F.substr(digits, low + 1).cast("long"), power(low) - under, power(n - low), key, F.concat(F.lit(kind), n.cast("string"), F.lit("from"), least.cast("string")))
    return _let(s, lambda s: F.concat(F.lpad((s["l"] + under).cast("string"), low, "0"), F.lpad(s["r"].cast("string"), n - low, "0")))


def _ipv6(m: Column, key: str) -> Column:
    """Another address, of eight groups: each half of it is permuted."""
    ends = F.split(F.lower(m), "::", -1)
    groups = lambda k: F.filter(F.split(F.coalesce(F.get(ends, F.lit(k)), F.lit("")), ":"), lambda g: g != "")
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(groups(0)) - F.size(groups(1))))
    number = F.transform(F.concat(groups(0), gap, groups(1)), lambda g: F.conv(g, 16, 10).cast("long"))

    def half(all_: Column, k: int) -> Column:
        at = lambda i: F.get(all_, F.lit(4 * k + i))
        s = feistel(at(0) * 65536 + at(1), at(2) * 65536 + at(3), F.lit(2**32), F.lit(2**32), key, F.lit(f"ipv6-{k}"))
        parts = lambda s: F.array(F.floor(s["l"] / 65536), F.pmod(s["l"], F.lit(65536)), F.floor(s["r"] / 65536), F.pmod(s["r"], F.lit(65536)))
        return _let(s, lambda s: F.array_join(F.transform(parts(s), lambda x: F.lower(F.conv(x.cast("string"), 10, 16))), ":"))

    return _let(number, lambda all_: F.when(F.size(all_) == 8, F.concat(half(all_, 0), F.lit(":"), half(all_, 1))).otherwise(m))


def _ssn(m: Column, key: str) -> Column:
    """Another number that can be issued: 898 areas (1 to 899 without 666) with 99 groups, and 9,999 serials."""
    part = lambda at, n: F.substring(m, at, n).cast("long")
    area = part(1, 3) - 1 - (part(1, 3) > 666).cast("long")
    s = feistel(area * 99 + part(5, 2) - 1, part(8, 4) - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))

    def written(s: Column) -> Column:
        a = F.floor(s["l"] / 99) + 1
        two = lambda c, n: F.lpad(c.cast("string"), n, "0")
        return F.concat_ws("-", two(a + (a >= 666).cast("long"), 3), two(s["l"] % 99 + 1, 2), two(s["r"] + 1, 4))

    return F.get(F.transform(F.array(s), written), F.lit(0))


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one match of ``ANY``; a match that fails its check stays as it is."""
    digits = F.regexp_replace(m, r"\D", "")
    whole = lambda p: m.rlike(f"^(?:{p})$")
    site = F.substring_index(m, "@", -1)
    local, host = _token(F.substring_index(m, "@", 1), key, "local", 16), _token(F.substring_index(site, ".", 1), key, "host", 12)
    email = F.concat(local, F.lit("@"), host, F.lit("."), F.regexp_replace(site, r"^[^.]*\.", ""))
    value = F.regexp_extract(m, r"([A-Za-z0-9_-]+)$", 1)
    secret = F.concat(F.regexp_replace(m, r"[A-Za-z0-9_-]+$", ""), _token(value, key, "secret"))
    octets = F.split(m, r"\.")
    ip_pair = feistel(F.get(octets, F.lit(0)).cast("long") * 256 + F.get(octets, F.lit(1)).cast("long"), F.get(octets, F.lit(2)).cast("long") * 256 + F.get(octets, F.lit(3)).cast("long"), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    ip = F.get(F.transform(F.array(ip_pair), lambda s: F.concat_ws(".", F.floor(s["l"] / 256), F.pmod(s["l"], F.lit(256)), F.floor(s["r"] / 256), F.pmod(s["r"], F.lit(256)))), F.lit(0))
    big = F.upper(m)
    compact = F.replace(big, F.lit(" "), F.lit(""))
    country = F.substring(compact, 1, 2)
    account = F.regexp_replace(F.substr(compact, F.lit(5)), r"\D", "")
    moved = _refill(F.substr(compact, F.lit(5)), permute_digits(account, key, "iban"))
    check = F.lpad((98 - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    iban_ok = _mod97(F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))) == 1
    filled = F.concat(country, check, moved)
    spaced = F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(filled, i + 1 - (F.length(F.substr(m, F.lit(1), i)) - F.length(F.replace(F.substr(m, F.lit(1), i), F.lit(" "), F.lit("")))), F.lit(1)))), "")
    iban = F.when(m == big, spaced).otherwise(F.array_join(F.zip_with(F.split(m, ""), F.split(spaced, ""), lambda c, x: F.when(c == F.lower(c), F.lower(x)).otherwise(x)), ""))
    card = _refill(m, _with_luhn(permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")))
    sign = F.regexp_extract(m, r"^(AKIA|sk-|gh[pousr]_|xox[abprs]-|AIza)", 1)
    bare = _token(F.substr(m, F.length(sign) + 1), key, "key")
    return (
        F.when(m.contains("@"), email)
        .when(whole(KINDS["secret"]), secret)
        .when(whole(KINDS["key"]), F.concat(sign, F.when(sign == "AKIA", F.upper(bare)).otherwise(bare)))
        .when(m.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), _ipv6(m, key))
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), ip)
        .when(m.rlike(rf"(?:^|\W){MONTH}\W"), _named_date(m, key))
        .when(m.rlike(r"^[A-Za-z]{2}\d{2}") & iban_ok & (F.length(account) > 3), iban)
        .when(m.rlike(r"^[A-Za-z]{2}\d{2}"), m)
        .when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4})$"), _date(m, key))
        .when(m.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _slashed(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(m, key))
        .when(F.length(digits).between(13, 19) & ~m.startswith("+") & ~m.startswith("00"), F.when(luhn_sum(digits) % 10 == 0, card).otherwise(m))
        .when(F.length(digits).between(7, 15), _phone(m, digits, key))
        .otherwise(m)
    )


def pseudonymise(df: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """Replaces personal data in ``text`` and adds n_pii (long), the number of values replaced."""
    out = beside(df, {"_text": text}, [text, "n_pii"], lambda x: _pseudonymise(x, key).withColumnRenamed("_text", text))
    return out.select(*[f"`{c}`" for c in df.columns if c != "n_pii"], "n_pii")


def _pseudonymise(df: DataFrame, key: str) -> DataFrame:
    t = F.col("_text")
    df = df.withColumn("_found", F.when(t.rlike(GATE), F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1))))
    df = df.withColumn("_new", F.when(F.size("_found") > 0, F.transform("_found", lambda m: pseudonym(m, key))))
    gaps = F.split(t, ANY, -1)
    rebuilt = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("_new", i), F.lit("")))), "")
    df = df.withColumn("n_pii", F.coalesce(F.size(F.filter(F.arrays_zip("_found", "_new"), lambda x: x["_found"] != x["_new"])), F.lit(0)).cast("long"))
    df = df.withColumn("n_pii", F.greatest("n_pii", F.lit(0).cast("long")))
    return df.withColumn("_text", F.when(F.col("_new").isNotNull(), rebuilt).otherwise(t))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_pii")


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts; columns that clash with n_pii stay."""
    return with_text(docs, pseudonymise)
