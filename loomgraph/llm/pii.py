"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations, in DataFrame expressions only.

One regex finds candidates; each is validated by its kind (Luhn, mod-97, calendar, number ranges, octets) and, if valid, moved
within the set of values of its own format: a Feistel network over two halves of the number, with round values from SHA-256 of
the key. It is a bijection, so equal numbers and dates get equal pseudonyms in every document and different ones never meet; nothing is stored or
joined. Dates, whose number is no product of two near sides, are walked through until a member comes up (each step ends the walk with a chance of four in
five, so that WALK steps fail once in 10^45). Mails and secrets, which are no numbers, get keyed digests (64 bits each for a mail's
local part and host). What fails validation stays as it is. The key is a literal of the plan: a deployment sets
spark.redaction.string.regex or keeps the plan's text (UI, event log) as safe as the key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import free_names

ROUNDS = 10
WALK = 64
#: First day and number of days of the dates of 1900 to 2099, moved among themselves, and of those before and after, moved likewise.
FIRST_DAY, DAYS = "1900-01-01", 73_049
ERAS = (("0001-01-01", 693_595), (FIRST_DAY, DAYS), ("2100-01-01", 2_885_415))

# The formats looked for, in this order.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}"  # a host has 127 labels at most
SECRET = r"(?i:\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[ \t]*[:=][ \t]*[\"']?)[A-Za-z0-9+/_-]{16,}"
#: Length of an IBAN by country: the text after one (a word, an amount, the next IBAN) is no part of it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _of_length(n: int, countries: str) -> str:
    last = f"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{last}(?![A-Za-z0-9])"


#: Country calling codes of one and of two digits; all others have three.
CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
#: By country first; what has no such length there, or no known country, in the general form.
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_of_length(n, c) for n, c in IBAN_LENGTHS.items()) + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}[ .-]?[0-9]{1,2}(?:[ .-][0-9]{2}){4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])"
YMD = r"(?<![0-9A-Za-z./-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DMY = r"(?<![0-9A-Za-z./-])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])"
MDY = r"(?<![0-9A-Za-z./-])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IBAN, PHONE, YMD, DMY, MDY, SSN, CARD, IPV4))
KINDS = ("email", "secret", "iban", "phone", "date", "ssn", "card", "ip")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(x) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def _keyed(key: str, *parts: Column) -> Column:
    """60 bits of SHA-256 of the key and the parts, as a long."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, tweak: str) -> Column:
    """struct(a, b): the permuted pair, a below mod_a and b below mod_b; an even number of rounds keeps the sides in place."""

    def turn(s: Column, i: Column) -> Column:
        mod = F.when(i % 2 == 0, mod_a).otherwise(mod_b)
        c = F.pmod(s["a"] + _keyed(key, F.lit(tweak), i, mod_a, mod_b, s["b"]) % mod, mod)
        return F.struct(s["b"].alias("a"), c.alias("b"))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(_long(a).alias("a"), _long(b).alias("b")), turn)


def _ten_to(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(19)]), n.cast("int") + 1)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 36 digits to another of the same length."""

    def cut(d: Column) -> Column:
        u = F.floor(F.length(d) / 2).cast("int")
        v = F.length(d) - u
        pair = feistel(F.substr(d, F.lit(1), u).cast("long"), F.substr(d, u + 1, v).cast("long"), _ten_to(u), _ten_to(v), key, tweak)
        return let(pair, lambda x: F.concat(F.lpad(x["a"].cast("string"), u, "0"), F.lpad(x["b"].cast("string"), v, "0")))

    return let(digits, cut)


def _walk(number: Column, size: int, mod_a: int, mod_b: int, key: str, tweak: str) -> Column:
    """A number below `size` to another, by a permutation of mod_a * mod_b >= size that is repeated until it lands below size."""

    def step(x: Column) -> Column:
        pair = feistel(F.floor(x / mod_b), x % mod_b, _long(mod_a), _long(mod_b), key, tweak)
        return let(pair, lambda p: p["a"] * mod_b + p["b"])

    def turn(s: Column, i: Column) -> Column:
        return F.when((i == 0) | (s >= size), step(s)).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), _long(number), turn)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""
    chars = F.split(m, "")
    seen = lambda i: F.length(_digits(F.substr(m, F.lit(1), i + 1)))
    put = F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(digits, seen(i), F.lit(1))).otherwise(c))
    return F.array_join(put, "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that completes a string of digits."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(payload, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return ((10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    """An IBAN's letters and digits, first four moved to the end, as a number modulo 97."""
    moved = F.concat(F.substr(text, F.lit(5), F.length(text) - 4), F.substring(text, 1, 4))

    def add(total: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        return F.pmod(total * F.when(letter, 100).otherwise(10) + F.when(letter, F.ascii(c) - 55).otherwise(c.try_cast("int")), F.lit(97))

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def move(d: Column) -> Column:
        payload = F.substr(d, F.lit(1), F.length(d) - 1)
        new = lambda: let(permute_digits(payload, key, "card"), lambda p: _refill(m, F.concat(p, luhn_digit(p))))
        return F.when(luhn_digit(payload) == F.substr(d, F.length(d), F.lit(1)), new())

    return let(_digits(m), move)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("long"), F.substring(m, 5, 2).cast("long"), F.substring(m, 8, 4).cast("long")
    place = area - 1 - F.when(area > 666, 1).otherwise(0)

    def write(x: Column) -> Column:
        a = F.floor(x["a"] / 99) + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", a, F.pmod(x["a"], F.lit(99)) + 1, x["b"] + 1)

    new = let(feistel(place * 99 + group - 1, serial - 1, _long(898 * 99), _long(9999), key, "ssn"), write)
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), new)


def _date(m: Column, key: str) -> Column:
    iso = (
        F.when(m.rlike("^[0-9]{4}-"), m)
        .when(m.contains("."), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
        .otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    )

    form = F.when(m.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")

    def move(date: Column) -> Column:
        new = F.lit(None).cast("string")
        for first, days in ERAS:
            side = math.isqrt(days * 5 // 4)  # a square of a fifth more days
            side = 300 if days == DAYS else side
            day = F.datediff(date, F.lit(first).cast("date"))
            moved = F.date_add(F.lit(first).cast("date"), _walk(day, days, side, side, key, "date" if first == FIRST_DAY else f"date {first}").cast("int"))
            new = F.when((day >= 0) & (day < days), F.call_function("date_format", moved, form)).otherwise(new)
        return new

    return let(iso.try_cast("date"), move)


def _ip(m: Column, key: str) -> Column:
    def move(part: Column) -> Column:
        pair = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], _long(65_536), _long(65_536), key, "ip")
        four = lambda x: F.concat_ws(".", *[c.cast("string") for c in (F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)])
        return F.when(F.forall(part, lambda x: x <= 255), let(pair, four))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), move)


def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    short = F.regexp_extract(digits, f"^(?:{CODES})", 0)
    code = F.when(m.startswith("+"), F.when(short != "", short).otherwise(F.substring(digits, 1, 3))).otherwise("")

    def move(x: Column) -> Column:
        rest = F.substr(x["d"], F.length(x["code"]) + 1, F.length(x["d"]) - F.length(x["code"]))
        new = let(F.concat(x["code"], permute_digits(rest, key, "phone")), lambda d: _refill(m, d))
        return F.when((F.length(x["d"]) >= 9) & (F.length(x["d"]) <= 15) & (F.length(rest) >= 4), new)

    return let(F.struct(digits.alias("d"), code.alias("code")), move)


def _iban(m: Column, key: str) -> Column:
    def move(t: Column) -> Column:
        body = F.substr(t, F.lit(5), F.length(t) - 4)
        new_body = let(body, lambda b: F.when(F.length(_digits(b)) >= 2, let(permute_digits(_digits(b), key, "iban"), lambda d: _refill(b, d))).otherwise(b))

        def whole(b: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(F.substring(t, 1, 2), F.lit("00"), b))).cast("string"), 2, "0")
            return F.concat(F.substring(t, 1, 2), check, b)

        at = lambda i: F.length(F.replace(F.substr(m, F.lit(1), i + 1), F.lit(" "), F.lit("")))
        spaced = lambda w: F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(w, at(i), F.lit(1)))), "")
        return F.when((F.length(t) >= 15) & (F.length(t) <= 34) & (_mod97(t) == 1), let(let(new_body, whole), spaced))

    return let(F.replace(m, F.lit(" "), F.lit("")), move)


def _email(m: Column, key: str) -> Column:
    low = F.lower(m)
    local, host = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    tag = lambda kind, x, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), x).cast("binary"), 256), 1, n)
    return F.concat(F.lit("u"), tag("local", local, 16), F.lit("@h"), tag("host", host, 16), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_-]{16,}$", 0)
    head = F.substr(m, F.lit(1), F.length(m) - F.length(value))
    hash_ = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(value)).cast("binary"), 256)
    new = F.substr(F.repeat(hash_, F.ceil(F.length(value) / 64).cast("int")), F.lit(1), F.length(value))
    return F.concat(head, F.when(value.rlike("^[^a-z]*[A-Z][^a-z]*$"), F.upper(new)).otherwise(new))


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(f"^(?:{SECRET})$"), "secret")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})$"), "date")
        .when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
        .when(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"), "card")
        .otherwise("phone")
    )


def _replacement(m: Column, key: str) -> Column:
    """struct(kind, new): new is null where m fails its kind's validation."""
    makers = {"email": _email, "secret": _secret, "iban": _iban, "ssn": _ssn, "date": _date, "ip": _ip, "card": _card}

    def make(kind: Column) -> Column:
        new = F.when(kind == "phone", _phone(m, key))
        for name, f in makers.items():
            new = new.when(kind == name, f(m, key))
        return F.struct(kind.alias("kind"), new.alias("new"))

    return let(_kind(m), make)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii_kinds") -> DataFrame:
    """docs with `text_col` rewritten, and `found_col`: array of the kinds replaced, in order (empty if none, also for a null text).

    Kinds: email, secret, iban, phone, date, ssn, card, ip. Emails and secrets, which have no number to move, get keyed digests in their
    own form. A phone's national number is moved whatever its spelling (with a country code, the code stays), so one number written in
    several ways stays one. Null texts stay null; texts without a digit, @ or secret are not searched further; all other columns pass unchanged (one named found_col
    is replaced); rows are neither dropped nor moved, so repeated rows stay repeated. No shuffle, no Python.
    """
    text = F.col(f"`{text_col}`")
    m, r = free_names([*docs.columns, found_col], "pii_matches", "pii_replacements")
    hot = F.coalesce(text.rlike("[0-9@]") | text.rlike(SECRET), F.lit(False))  # all other formats hold a digit or @
    found = F.when(hot, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    with_r = docs.withColumn(m, found).withColumn(r, F.when(F.size(m) > 0, F.transform(m, lambda x: _replacement(x, key))))
    pieces = F.split(text, ANY, -1)
    put = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(r), i)["new"], F.get(F.col(m), i), F.lit(""))))
    new = F.when(F.size(m) > 0, F.array_join(put, "")).otherwise(text)
    kinds = F.coalesce(F.transform(F.filter(r, lambda x: x["new"].isNotNull()), lambda x: x["kind"]), F.array().cast("array<string>"))
    return with_r.withColumn(found_col, kinds).withColumn(text_col, new).drop(m, r)
