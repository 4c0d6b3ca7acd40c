"""Format-preserving pseudonyms of personal numbers, dates and mail names by a keyed Feistel network.

Card numbers (Luhn), IBANs (mod 97), social security numbers, phone numbers, IPv4 and IPv6 addresses, calendar
dates (day before month, where both can be) and the names of mail addresses are found by one pattern and validated. A valid one is permuted within its
own format: the value is split in two halves, each taken modulo the size of its half of the domain, and in
every round one half is shifted by a keyed hash of the other. Separators stay where they are and check digits
are made anew, so the pseudonym validates too. Equal values get equal pseudonyms in every document, however
they are written; different values of one kind get different ones. Only SQL functions are used.

There is no pseudonym without a key: an empty one is an error. What doesn't validate stays as it is. Null texts stay null, empty ones empty; whole texts are treated; all
other columns pass through, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, written

ROUNDS = 8
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 270, 271  # 73,170 days: to 2100-05-02
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,20}[A-Za-z]{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![A-Za-z0-9:]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+(?:1(?:[ .()-]{0,2}[0-9]){10}|[2-9](?:[ .-]?\(?[0-9]\)?){7,14})(?![0-9]|-[0-9])|(?<![0-9-])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])|(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9]|\.[0-9])|(?<![0-9])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?![0-9]| [0-9])|(?<![A-Za-z0-9.-])[2-9][0-9]{9}(?![A-Za-z0-9]|[.-][0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|3[47][0-9]{2} [0-9]{6} [0-9]{5}|3[47][0-9]{2}-[0-9]{6}-[0-9]{5}|[0-9]{4}(?:([ -])[0-9]{4}(?:\1[0-9]{4}){1,2}\1[0-9]{1,7}))(?![A-Za-z0-9])",
}
# Country calling codes of two digits; zones 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _long(c: Column) -> Column:
    return F.concat(F.lit("0"), c).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column | str, tweak: Column | str) -> Column:
    """A keyed permutation of the pairs (left below a, right below b), as a struct of l and r."""
    tweak, key = (F.lit(x) if isinstance(x, str) else x for x in (tweak, key))

    def shift(i: Column, half: Column) -> Column:
        inner = F.sha2(F.concat_ws("|", key, tweak, i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(F.sha2(F.concat(key, inner), 256), 1, 14), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(((s["l"] + shift(i, s["r"])) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + shift(i, s["l"])) % b).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted(s: Column, radix: int, key: Column | str, tweak: Column | str) -> Column:
    """A string of digits of the radix (10 or 36), permuted among all of its length."""
    n = F.length(s)
    h = F.floor(n / 2).cast("int")
    number = (lambda c: _long(c)) if radix == 10 else (lambda c: F.conv(F.concat(F.lit("0"), c), radix, 10).cast("long"))
    text = (lambda c: c.cast("string")) if radix == 10 else (lambda c: F.lower(F.conv(c.cast("string"), 10, radix)))
    size = lambda k: F.round(F.pow(F.lit(radix), k)).cast("long")
    halves = feistel(number(F.substring(s, F.lit(1), n - h)), number(F.substring(s, n - h + 1, h)), size(n - h), size(h), key, F.concat_ws(":", F.lit(tweak) if isinstance(tweak, str) else tweak, n.cast("string")))
    return _with(halves, lambda p: F.concat(F.lpad(text(p["l"]), n - h, "0"), F.when(h > 0, F.lpad(text(p["r"]), h, "0")).otherwise("")))


def refilled(template: Column, slot: str, filling: Column) -> Column:
    """The template with its characters of the class slot replaced, in order, by those of filling."""

    def step(s: Column, i: Column) -> Column:
        c = F.substring(template, i, F.lit(1))
        return F.when(c.rlike(slot), F.struct(F.concat(s["out"], F.substring(filling, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))

    return F.aggregate(F.sequence(F.lit(1), F.length(template)), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def luhn_digit(payload: Column) -> Column:
    """The check digit that belongs after the payload's digits."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(payload, F.length(payload) - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(payload) - 1), F.lit(0), step)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def mod97(s: Column) -> Column:
    """The remainder by 97 of digits and capital letters, a letter standing for 10 to 35."""

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: Column | str) -> Column:
    def use(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        new = _with(permuted(payload, 10, key, "card"), lambda p: F.concat(p, luhn_digit(p)))
        return F.when(luhn_digit(payload) == F.substring(d, -1, 1), refilled(m, "[0-9]", new))

    return _with(_digits(m), use)


def _iban(m: Column, key: Column | str) -> Column:
    def use(s: Column) -> Column:
        country, body = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
        new = refilled(body, "[0-9]", permuted(_digits(body), 10, key, F.concat(F.lit("iban"), country)))
        whole = _with(new, lambda b: F.concat(country, F.lpad((F.lit(98) - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when((mod97(F.concat(body, F.substring(s, 1, 4))) == 1) & (F.length(_digits(body)) > 0), refilled(m, "[A-Z0-9]", whole))

    return _with(F.replace(m, F.lit(" "), F.lit("")), use)


def _date(m: Column, key: Column | str) -> Column:
    def use(fmt: str) -> Column:
        days = F.date_diff(F.try_to_date(m, fmt), F.lit(FIRST_DAY).cast("date"))
        moved = lambda n: _with(feistel(F.floor(n / DAYS_B), n % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), key, "date"), lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS_B + p["r"]).cast("int")), fmt))
        return _with(days, lambda n: F.when((n >= 0) & (n < DAYS_A * DAYS_B), moved(n)))

    two = F.substring(m, 5, 1)
    return F.when(two == "-", use("yyyy-MM-dd")).when(two == "/", use("yyyy/MM/dd")).when(F.contains(m, F.lit("/")), F.coalesce(use("dd/MM/yyyy"), use("MM/dd/yyyy"))).otherwise(use("dd.MM.yyyy"))


def _ip(m: Column, key: Column | str) -> Column:
    def use(o: Column) -> Column:
        n = lambda i: F.element_at(o, i)
        new = feistel(n(1) * 256 + n(2), n(3) * 256 + n(4), F.lit(65536), F.lit(65536), key, "ip")
        halves = lambda c: F.concat(F.floor(c / 256).cast("string"), F.lit("."), (c % 256).cast("string"))
        return F.when(F.array_max(o) < 256, _with(new, lambda p: F.concat(halves(p["l"]), F.lit("."), halves(p["r"]))))

    return _with(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), use)


def _ip6(m: Column, key: Column | str) -> Column:
    """Both halves of the eight groups, the second one tied to the first; written out without leading zeros."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda x: F.length(x) > 0)

    def use(sides: Column) -> Column:
        left = groups(F.element_at(sides, 1))
        right = F.when(F.size(sides) > 1, groups(F.element_at(sides, -1))).otherwise(F.array().cast("array<string>"))
        gap = F.lit(8) - F.size(left) - F.size(right)
        whole = F.transform(F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right), lambda x: F.conv(x, 16, 10).cast("long"))
        # a shortened address must name three groups: two are as likely a name in program text
        valid = (F.size(sides) <= 2) & F.when(F.size(sides) > 1, (gap > 0) & (gap < 6)).otherwise(gap == 0)
        return F.when(valid, _with(whole, moved))

    def moved(g: Column) -> Column:
        n = lambda i: F.element_at(g, i) * 65536 + F.element_at(g, i + 1)
        size = F.lit(1 << 32)
        text = lambda p: F.transform(F.array(F.floor(p["l"] / 65536), p["l"] % 65536, F.floor(p["r"] / 65536), p["r"] % 65536), lambda x: F.lower(F.hex(x.cast("long"))))
        first = feistel(n(1), n(3), size, size, key, "ip6")
        second = feistel(n(5), n(7), size, size, key, F.concat_ws(":", F.lit("ip6"), n(1).cast("string"), n(3).cast("string")))
        return F.array_join(F.concat(_with(first, text), _with(second, text)), ":")

    return _with(F.split(m, "::", -1), use)


def _ssn(m: Column, key: Column | str) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    place = area - F.when(area > 666, 2).otherwise(1)  # areas 1 to 899 without 666
    new = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def back(p: Column) -> Column:
        at = F.floor(p["l"] / 99)
        return F.concat_ws("-", F.lpad((at + F.when(at >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0"))

    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), _with(new, back))


def _phone(m: Column, key: Column | str) -> Column:
    """The country code stays; a number without one counts as in zone 1."""

    def use(d: Column) -> Column:
        two = F.array_contains(F.split(F.lit(TWO_DIGIT_CODES), " "), F.substring(d, 1, 2))
        code = F.when(~F.startswith(m, F.lit("+")), "").when(d.rlike("^[17]"), F.substring(d, 1, 1)).when(two, F.substring(d, 1, 2)).otherwise(F.substring(d, 1, 3))
        rest = F.substring(d, F.length(code) + 1, F.length(d))
        return F.when((F.length(d) >= 8) & (F.length(d) <= 15), refilled(m, "[0-9]", F.concat(code, permuted(rest, 10, key, F.concat(F.lit("phone"), F.when(code == "", "1").otherwise(code))))))

    return _with(_digits(m), use)


def _email(m: Column, key: Column | str) -> Column:
    """Letters and digits of the name, ten at a time; the domain stays. Case isn't kept, as names that differ in it are one."""

    def use(parts: Column) -> Column:
        name = F.lower(F.element_at(parts, 1))
        plain = F.regexp_replace(name, "[^a-z0-9]", "")
        blocks = F.transform(F.sequence(F.lit(1), F.length(plain), F.lit(10)), lambda i: permuted(F.substring(plain, i, F.lit(10)), 36, key, F.concat_ws(":", F.lit("email"), F.substring(plain, F.lit(1), i - 1))))
        return F.when(F.length(plain) > 0, F.concat(refilled(name, "[a-z0-9]", F.array_join(blocks, "")), F.lit("@"), F.element_at(parts, 2)))

    return _with(F.split(m, "@", 2), use)


def pseudonym(m: Column, key: Column | str) -> Column:
    """(kind, value) of a piece of text that the pattern found; a null kind and the piece itself if it isn't valid."""
    kinds = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ip6": _ip6, "ssn": _ssn, "phone": _phone, "card": _card}
    tell = {"email": F.contains(m, F.lit("@")), "iban": m.rlike("^[A-Z]")} | {k: m.rlike(f"^(?:{PATTERNS[k]})$") for k in ("date", "ip", "ip6", "ssn", "phone")} | {"card": F.lit(True)}
    out = None
    for kind, make in kinds.items():
        pick = F.struct(F.lit(kind).alias("kind"), make(m, key).alias("value"))
        out = F.when(tell[kind], pick) if out is None else out.when(tell[kind], pick)
    return _with(out, lambda p: F.struct(F.when(p["value"].isNotNull(), p["kind"]).alias("kind"), F.coalesce(p["value"], m).alias("value")))


def secret(spark: SparkSession, key: str) -> Column:
    """The key as a value that tasks read from a table in the shared folder, so that plans and event logs don't show it."""
    if not key:
        raise ValueError("pseudonyms need a key")
    return written(spark.createDataFrame([(key,)], "key string"), "key").scalar()


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_as: str | None = None, kinds_as: str | None = None) -> DataFrame:
    """docs with pseudonyms in the text column and, if named, how many there are and of which kinds (sorted)."""
    found, hidden, text = free_name(docs, "_found"), free_name(docs, "_key"), F.col(f"`{text_col}`").cast("string")
    out = docs.withColumn(hidden, secret(docs.sparkSession, key))
    out = out.withColumn(found, F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    some = F.size(F.col(found)) > 0
    out = out.withColumn(found, F.when(some, F.transform(F.col(found), lambda m: pseudonym(m, F.col(f"`{hidden}`")))))
    pieces = F.zip_with(F.split(text, ANY, -1), F.concat(F.transform(F.col(found), lambda p: p["value"]), F.array(F.lit(""))), lambda gap, m: F.concat(gap, m))
    out = out.withColumn(text_col, F.when(F.col(found).isNull(), text).otherwise(F.array_join(pieces, "")))
    kinds = F.filter(F.transform(F.col(found), lambda p: p["kind"]), lambda k: k.isNotNull())
    none = F.col(found).isNull()
    if count_as:
        out = out.withColumn(count_as, F.when(none, 0).otherwise(F.size(kinds)))
    if kinds_as:
        out = out.withColumn(kinds_as, F.when(none, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(kinds))))
    return out.drop(found, hidden)
