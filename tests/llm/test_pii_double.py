"""The pseudonyms against the same rules in plain Python over a whole table; forms, keys and plans."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from serialspark.llm import pii

KEY = "only a test's key"
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def feistel(left, right, a, b, tweak):
    for i in range(8):
        shift = int(sha(KEY + sha(f"{KEY}|{tweak}|{i}|{left if i % 2 else right}"))[:14], 16)
        left, right = (left, (right + shift) % b) if i % 2 else ((left + shift) % a, right)
    return left, right


def base(n, radix, size):
    out = ""
    while n:
        n, d = divmod(n, radix)
        out = DIGITS[d] + out
    return out.rjust(size, "0") if size else ""


def permuted(s, radix, tweak):
    h = len(s) // 2
    left, right = feistel(int("0" + s[: len(s) - h], radix), int("0" + s[len(s) - h :], radix), radix ** (len(s) - h), radix**h, f"{tweak}:{len(s)}")
    return base(left, radix, len(s) - h) + base(right, radix, h)


def refilled(template, slot, filling):
    it = iter(filling)
    return "".join(next(it) if re.match(slot, c) else c for c in template)


def luhn(payload):
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def card(m):
    d = re.sub("[^0-9]", "", m)
    new = permuted(d[:-1], 10, "card")
    return refilled(m, "[0-9]", new + luhn(new)) if luhn(d[:-1]) == d[-1] else None


def iban(m):
    s = m.replace(" ", "")
    body, country = s[4:], s[:2]
    digits = re.sub("[^0-9]", "", body)
    if not digits or mod97(body + s[:4]) != 1:
        return None
    new = refilled(body, "[0-9]", permuted(digits, 10, f"iban{country}"))
    return refilled(m, "[A-Z0-9]", country + f"{98 - mod97(new + country + '00'):02d}" + new)


def date(m):
    for fmt in ["%Y-%m-%d"] if m[4] == "-" else ["%Y/%m/%d"] if m[4] == "/" else ["%d/%m/%Y", "%m/%d/%Y"] if "/" in m else ["%d.%m.%Y"]:
        try:
            n = (datetime.datetime.strptime(m, fmt).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            continue
        if 0 <= n < 270 * 271:
            left, right = feistel(n // 271, n % 271, 270, 271, "date")
            return (datetime.date(1900, 1, 1) + datetime.timedelta(left * 271 + right)).strftime(fmt)
    return None


def ip(m):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return None
    left, right = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{left >> 8}.{left & 255}.{right >> 8}.{right & 255}"


def ip6(m):
    sides = [[x for x in side.split(":") if x] for side in m.split("::")]
    gap = 8 - sum(map(len, sides))
    if len(sides) > 2 or not (0 < gap < 6 if len(sides) == 2 else gap == 0):
        return None
    g = [int(x, 16) for x in [*sides[0], *["0"] * gap, *(sides[1] if len(sides) == 2 else [])]]
    pair = lambda i: g[i] << 16 | g[i + 1]
    halves = [*feistel(pair(0), pair(2), 1 << 32, 1 << 32, "ip6"), *feistel(pair(4), pair(6), 1 << 32, 1 << 32, f"ip6:{pair(0)}:{pair(2)}")]
    return ":".join(f"{x:x}" for h in halves for x in (h >> 16, h & 65535))


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    left, right = feistel((area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    at = left // 99
    return f"{at + (2 if at >= 665 else 1):03d}-{left % 99 + 1:02d}-{right + 1:04d}"


def phone(m):
    d = re.sub("[^0-9]", "", m)
    n = 0 if m[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in pii.TWO_DIGIT_CODES.split() else 3
    return refilled(m, "[0-9]", d[:n] + permuted(d[n:], 10, "phone" + (d[:n] or "1"))) if 8 <= len(d) <= 15 else None


def email(m):
    name, domain = m.split("@", 1)
    plain = re.sub("[^a-z0-9]", "", name.lower())
    new = "".join(permuted(plain[i : i + 10], 36, f"email:{plain[:i]}") for i in range(0, len(plain), 10))
    return refilled(name.lower(), "[a-z0-9]", new) + "@" + domain if plain else None


MAKE = {"email": email, "iban": iban, "date": date, "ip": ip, "ip6": ip6, "ssn": ssn, "phone": phone}


def double(text):
    kinds = set()

    def put(found):
        m = found[0]
        kind = "email" if "@" in m else "iban" if re.match("[A-Z]", m) else next((k for k in ("date", "ip", "ip6", "ssn", "phone") if re.fullmatch(pii.PATTERNS[k], m)), "card")
        new = MAKE.get(kind, card)(m)
        kinds.update({kind} if new else ())
        return new or m

    return re.sub(pii.ANY, put, text, flags=re.ASCII), sorted(kinds)


FORMS = [
    "555.123.4567 and 555 123 4567 and 5551234567", "+33 1 23 45 67 89, +353 1 679 4000, +49 (0)30 1234567", "3782-822463-10005 3782 822463 10005 378282246310005", "2001:db8::ff00:42:8329 2001:0DB8:0:0:0:FF00:42:8329", "fe80::1 std::vector 12:34:56 00:1A:2B:3C:4D:5E",
    "2020/12/31 12/31/2020 31/12/2020 31.12.2020 2020-12-31", "1700000000 v1.2.3 2020/13/31", "",
]


def test_whole_table_as_the_double(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(FORMS)], "doc_id long, text string"))
    got = {r.doc_id: (r.text, r.kinds) for r in pii.pseudonymize(df, KEY, kinds_as="kinds").collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len(got) == len(texts) and sum(got[i][0] != t for i, t in texts.items()) > 5
    for i, t in texts.items():
        assert got[i] == double(t), t


def test_all_forms_are_one_value(spark):
    df = spark.createDataFrame(list(enumerate(FORMS)), "doc_id long, text string")
    by = {r.doc_id: r.text for r in pii.pseudonymize(df, KEY).collect()}
    assert len({re.sub("[^0-9]", "", x) for x in by[0].split(" and ")}) == 1 and "555" not in by[0][:3]
    assert len({re.sub("[ -]", "", x) for x in (by[2][:17], by[2][18:35], by[2][36:])}) == 1
    assert len(set(by[3].split())) == 1 and by[4] == FORMS[4] and by[6] == FORMS[6]


def test_the_key_is_needed_and_hidden(spark):
    df = spark.createDataFrame([(1, "a@b.org", "kept")], "doc_id long, text string, _key string")
    out = pii.pseudonymize(df, "s3cr3t phrase")
    assert "s3cr3t" not in out._jdf.queryExecution().toString() and out.first()._key == "kept"
    assert out.first().text != pii.pseudonymize(df, "another").first().text
    with pytest.raises(ValueError):
        pii.pseudonymize(df, "")
    assert pii.pseudonymize(df.limit(0).withColumn("x", F.lit(1)), KEY).count() == 0
