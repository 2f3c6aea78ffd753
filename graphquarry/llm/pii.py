"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Every match of a personal-data pattern is replaced by a pseudonym of the same
format. Validated numbers and dates go through a keyed Feistel network over
exactly their own domain, so the mapping is a permutation of it: equal values
get equal pseudonyms in every document, different values different ones.

=============  =====================================================================
payment cards  13 to 19 digits, separators kept; all digits but the last are
               permuted and the last keeps its distance from the Luhn digit, so
               valid numbers stay valid and invalid ones invalid
phone numbers  the digits after the country code are permuted, layout kept
SSN            (area, group, serial) permuted over the valid areas, groups, serials
IPv4           the 32-bit address is permuted
IPv6           each half's digits, as many as there are, are permuted in base 16
IBAN           the account's digits are permuted, check digits recomputed (mod 97)
dates          ISO, d/m/y and m/d/y with / . or -, and with an English month's name:
               permuted over the 146,097 days of 1800-01-01 to 2199-12-31;
               impossible dates stay as they are
access keys    the 16 characters after AKIA or ASIA are permuted in base 36
e-mail         the local part's letters and digits are shifted by a keyed stream
               of the whole address, the domain stays
passwords      ``password=...`` and the like, also with quotes round the value or
               the key: the value is shifted the same way, the quotes stay
=============  =====================================================================

The shifts of e-mail names and passwords depend on the whole value, so equal
ones stay equal but two different ones may, rarely, meet in one pseudonym; all
other kinds are permutations.

Defined results: a null text stays null, an empty one empty; a text without
matches is returned as it is; texts of any length are processed whole; where
patterns overlap the first match from the left counts, and at one place the
first kind in the order above with e-mail and passwords leading; repeated rows
and rows sharing an id are each replaced; all columns are kept, and helper
columns never clash because there are none; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For tests and examples only: what registered queries fall back to where the session sets no key.
KEY = "example pseudonym key"
#: The session's setting that holds the secret key.
KEY_SETTING = "spark.graphquarry.pseudonym.key"

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)++[A-Za-z]{2,}+"
#: A value in quotes ends at its quote and may hold spaces; one without, or whose quote is never closed, ends at white space.
QUOTED = r"\\\"[^\"\\\r\n]{6,}+\\\"|\"(?:[^\"\\\r\n]|\\.){6,}+\"|'(?:[^'\\\r\n]|\\.){6,}+'(?![A-Za-z])"
SECRET = rf"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\\?[\"']?\s?[=:]\s?)(?:{QUOTED}|\\?[\"']?[^\s,;\"']{{6,}})"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[0-9A-Fa-f:]*\d)(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:]|\.\d)"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
SSN = r"(?<![\d\-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])"
ISO_DATE = r"(?<![\d\-])(?:1[89]|2[01])\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d\-])"
DATE = r"(?<![\d/.\-])(?:0?[1-9]|[12]\d|3[01])([/.\-])(?:0?[1-9]|[12]\d|3[01])\1(?:1[89]|2[01])\d\d(?![\d/\-])"
# The months.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?i:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + ")"
NAMED_DATE = rf"(?<![\w.])(?:(?:0?[1-9]|[12]\d|3[01]) {_MONTH},? (?:1[89]|2[01])\d\d|{_MONTH} (?:0?[1-9]|[12]\d|3[01]),? (?:1[89]|2[01])\d\d)(?!\w)"
CARD = r"(?<![A-Za-z0-9.+\-])(?:3[47]\d\d[ \-]\d{6}[ \-]\d{5}|[2-6]\d{3}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7})(?![A-Za-z0-9]|[.\-]\d)"
PHONE = r"(?<![A-Za-z0-9.\-])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|[2-9]\d\d [2-9]\d\d \d{4})(?![A-Za-z0-9]|[.\-]\d)"
ANY = "|".join([EMAIL, SECRET, ACCESS_KEY, IBAN, IPV6, IPV4, SSN, ISO_DATE, DATE, NAMED_DATE, CARD, PHONE])
#: Every pattern needs one of these, so texts without them are passed by cheaply.
NEEDED = r"[0-9@=:]|A[KS]IA"
KINDS = ("email", "secret", "access_key", "iban", "ipv6", "ipv4", "ssn", "date", "card", "phone")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hash(key: Column, tag: str, i: Column, value: Column) -> Column:
    """60 bits of a keyed hash as a non-negative bigint."""
    text = F.concat_ws("|", key, F.lit(tag), i.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: Column, tag: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Keyed permutation of Z_a x Z_b as struct(l, r); a and b are at most 2^60."""

    def step(acc, i):
        turn = F.struct(
            F.pmod(acc["l"] + F.pmod(_hash(key, tag, i, acc["r"]), a), a).alias("l"),
            acc["r"].alias("r"),
        )
        other = F.struct(
            acc["l"].alias("l"),
            F.pmod(acc["r"] + F.pmod(_hash(key, tag, i, acc["l"]), b), b).alias("r"),
        )
        return F.when(i % 2 == 0, turn).otherwise(other)

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(base: int, n: Column) -> Column:
    """base^n as bigint, exactly."""
    return F.aggregate(F.array_repeat(F.lit(base).cast("bigint"), n.cast("int")), F.lit(1).cast("bigint"), lambda x, y: x * y)


def _permute_digits(key: Column, tag: str, digits: Column) -> Column:
    """Permutation of the strings of as many decimal digits (2 to 36)."""

    def halves(x):
        n, h = F.length(x["d"]), F.floor(F.length(x["d"]) / 2)
        got = feistel(key, tag, F.substr(x["d"], F.lit(1), h), F.substr(x["d"], h + 1, n - h), x["a"], x["b"])
        return _bind(got, lambda y: F.concat(F.lpad(y["l"].cast("string"), h.cast("int"), "0"), F.lpad(y["r"].cast("string"), (n - h).cast("int"), "0")))

    h = F.floor(F.length(digits) / 2)
    return _bind(F.struct(digits.alias("d"), _power(10, h).alias("a"), _power(10, F.length(digits) - h).alias("b")), halves)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _chars(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.substr(m, i, F.lit(1)))


def _refill(m: Column, digits: Column, skip: Column) -> Column:
    """``m`` with its digits after the first ``skip`` ones replaced in order."""

    def step(acc, c):
        is_digit = c.rlike(r"^\d$")
        k = acc["k"] + F.when(is_digit, 1).otherwise(0)
        put = is_digit & (k > skip)
        return F.struct(F.concat(acc["out"], F.when(put, F.substr(digits, k - skip, F.lit(1))).otherwise(c)).alias("out"), k.alias("k"))

    return F.aggregate(_chars(m), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counting singly."""
    n = F.length(digits)

    def term(c, i):
        v = c.cast("int") * F.when(F.pmod(n - 1 - i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(_chars(digits), term), F.lit(0), lambda x, y: x + y)


def _card(key: Column, m: Column) -> Column:

    def whole(d):
        def closed(body):
            last = F.pmod(luhn_sum(d) - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
            return F.concat(body, last.cast("string"))

        # the first digit stays so that the pseudonym still looks like a card
        return _bind(F.concat(F.substring(d, 1, 1), _permute_digits(key, "card", F.substr(d, F.lit(2), F.length(d) - 2))), closed)

    return _bind(_bind(_digits(m), whole), lambda new: _refill(m, new, F.lit(0)))


def _phone(key: Column, m: Column) -> Column:
    skip = F.length(F.regexp_extract(m, r"^\+(\d{1,3}?)(?=[ .\-(]|\d{7})", 1))
    rest = F.substr(_digits(m), skip + 1, F.length(_digits(m)) - skip)
    return _bind(F.struct(_permute_digits(key, "phone", rest).alias("new"), skip.alias("skip")), lambda x: _refill(m, x["new"], x["skip"]))


def _ssn(key: Column, m: Column) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas: 001 to 665, 667 to 899
    got = feistel(key, "ssn", index * 99 + group - 1, serial - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"))

    def written(x):
        new = F.floor(x["l"] / 99)
        return F.concat_ws("-", F.lpad(F.when(new > 664, new + 2).otherwise(new + 1).cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

    return _bind(got, written)


def _ipv4(key: Column, m: Column) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    size = F.lit(65536).cast("bigint")
    got = feistel(key, "ipv4", p[0] * 256 + p[1], p[2] * 256 + p[3], size, size)
    return _bind(got, lambda x: F.concat_ws(".", F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))


def _permute_hex(key: Column, tag: str, digits: Column) -> Column:
    """Permutation of the strings of as many base-16 digits (1 to 16), in lower case."""

    def number(x):
        return F.coalesce(F.conv(x, 16, 10).cast("bigint"), F.lit(0).cast("bigint"))

    def halves(x):
        n, h = F.length(x["d"]), F.floor(F.length(x["d"]) / 2)
        got = feistel(key, tag, number(F.substr(x["d"], F.lit(1), h)), number(F.substr(x["d"], h + 1, n - h)), x["a"], x["b"])
        text = F.when(h > 0, F.lpad(F.conv(got["l"].cast("string"), 10, 16), h.cast("int"), "0")).otherwise("")
        return F.lower(F.concat(text, F.lpad(F.conv(got["r"].cast("string"), 10, 16), (n - h).cast("int"), "0")))

    h = F.floor(F.length(digits) / 2)
    return _bind(F.struct(digits.alias("d"), _power(16, h).alias("a"), _power(16, F.length(digits) - h).alias("b")), halves)


def _ipv6(key: Column, m: Column) -> Column:
    hexes = F.regexp_replace(m, ":", "")

    def refilled(d):
        h = F.floor((F.length(d) + 1) / 2)
        rest = F.substr(d, h + 1, F.length(d) - h)
        new = F.concat(_permute_hex(key, "ipv6", F.substr(d, F.lit(1), h)), F.when(F.length(rest) > 0, _permute_hex(key, "ipv6", rest)).otherwise(""))

        def spread(whole):
            def step(acc, c):
                k = acc["k"] + F.when(c == ":", 0).otherwise(1)
                return F.struct(F.concat(acc["out"], F.when(c == ":", c).otherwise(F.substr(whole, k, F.lit(1)))).alias("out"), k.alias("k"))

            return F.aggregate(_chars(m), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]

        return _bind(new, spread)

    return _bind(F.lower(hexes), refilled)


def _mod97(text: Column) -> Column:
    """ISO 7064 remainder of letters and digits."""

    def step(acc, c):
        v = F.when(c.rlike(r"^\d$"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(_chars(text), F.lit(0), step)


def iban_valid(m: Column) -> Column:
    t = F.upper(F.regexp_replace(m, " ", ""))
    n = F.length(t)
    return (n >= 15) & (n <= 34) & (_mod97(F.concat(F.substr(t, F.lit(5), n - 4), F.substring(t, 1, 4))) == 1)


def _iban(key: Column, m: Column) -> Column:
    def renewed(t):
        bban = F.substr(t, F.lit(5), F.length(t) - 4)
        enough = F.length(_digits(bban)) >= 2
        new = F.when(enough, _refill(bban, _permute_digits(key, "iban", _digits(bban)), F.lit(0))).otherwise(bban)
        return _bind(new, lambda x: F.concat(F.substring(t, 1, 2), F.lpad((98 - _mod97(F.upper(F.concat(x, F.substring(t, 1, 2), F.lit("00"))))).cast("string"), 2, "0"), x))

    def spaced(whole):
        def step(acc, c):
            k = acc["k"] + F.when(c == " ", 0).otherwise(1)
            return F.struct(F.concat(acc["out"], F.when(c == " ", c).otherwise(F.substr(whole, k, F.lit(1)))).alias("out"), k.alias("k"))

        return F.aggregate(_chars(m), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]

    return _bind(_bind(F.regexp_replace(m, " ", ""), renewed), spaced)


def permute_date(key: Column, day: Column) -> Column:
    """Permutation of the days of 1800-01-01 to 2199-12-31 (146,097 = 189 * 773)."""
    zero = F.lit("1800-01-01").cast("date")
    n = F.datediff(day, zero).cast("bigint")
    got = feistel(key, "date", F.floor(n / 773), n % 773, F.lit(189).cast("bigint"), F.lit(773).cast("bigint"))
    return _bind(got, lambda x: F.date_add(zero, (x["l"] * 773 + x["r"]).cast("int")))


def _date(key: Column, m: Column) -> Column:
    sep = F.regexp_extract(m, r"\d([/.\-])", 1)
    p = F.split(m, r"[/.\-]")

    def day(y, mo, d):
        return F.try_to_timestamp(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    def padded(x, like):
        return F.when(F.length(like) == 2, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))

    iso, dmy, mdy = day(p[0], p[1], p[2]), day(p[2], p[1], p[0]), day(p[2], p[0], p[1])
    is_iso = F.length(p[0]) == 4
    order = F.when(is_iso, "ymd").when(dmy.isNotNull(), "dmy").otherwise("mdy")

    def written(x):
        d, mo, y = F.dayofmonth(x["day"]), F.month(x["day"]), F.year(x["day"]).cast("string")
        return (
            F.when(x["order"] == "ymd", F.date_format(x["day"], "yyyy-MM-dd"))
            .when(x["order"] == "dmy", F.concat(padded(d, p[0]), sep, padded(mo, p[1]), sep, y))
            .otherwise(F.concat(padded(mo, p[0]), sep, padded(d, p[1]), sep, y))
        )

    day_in = F.when(is_iso, iso).otherwise(F.coalesce(dmy, mdy))
    return F.coalesce(_bind(F.struct(permute_date(key, day_in).alias("day"), order.alias("order")), written), m)


def _named_date(key: Column, m: Column) -> Column:
    day_first = m.rlike(r"^\d")
    word = F.regexp_extract(m, "([A-Za-z]+)", 1)
    month = F.array_position(F.array(*(F.lit(x[:3].lower()) for x in MONTHS)), F.lower(F.substring(word, 1, 3)))
    number, year = F.regexp_extract(m, r"(?<!\d)(\d{1,2})(?!\d)", 1), F.regexp_extract(m, r"(\d{4})$", 1)
    day = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(number, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

    def written(x):
        full = F.get(F.array(*map(F.lit, MONTHS)), F.month(x) - 1)
        name = F.when(F.length(word) == 3, F.substring(full, 1, 3)).otherwise(full)
        name = F.when(word == F.upper(word), F.upper(name)).when(word == F.lower(word), F.lower(name)).otherwise(name)
        d = F.when(F.length(number) == 2, F.lpad(F.dayofmonth(x).cast("string"), 2, "0")).otherwise(F.dayofmonth(x).cast("string"))
        comma = F.when(m.contains(","), ",").otherwise("")
        return F.when(day_first, F.concat(d, F.lit(" "), name, comma, F.lit(" "), F.year(x).cast("string"))).otherwise(F.concat(name, F.lit(" "), d, comma, F.lit(" "), F.year(x).cast("string")))

    return F.coalesce(_bind(permute_date(key, day), written), m)


def _access_key(key: Column, m: Column) -> Column:
    def number(x):
        return F.conv(x, 36, 10).cast("bigint")

    size = F.lit(36**8).cast("bigint")
    got = feistel(key, "access", number(F.substring(m, 5, 8)), number(F.substring(m, 13, 8)), size, size)
    return _bind(got, lambda y: F.concat(F.substring(m, 1, 4), *(F.lpad(F.conv(y[x].cast("string"), 10, 36), 8, "0") for x in "lr")))


def _shifted(key: Column, tag: str, value: Column, whole: Column) -> Column:
    """Letters and digits moved within their class by a keyed stream of ``whole``."""

    def one(c, i):
        by = F.pmod(_hash(key, tag, i, whole), F.lit(1 << 30)).cast("int")
        o = F.ascii(c)

        def turn(low, size):
            return F.char((low + F.pmod(o - low + 1 + F.pmod(by, F.lit(size - 1)), F.lit(size))).cast("long"))

        return F.when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).when(c.rlike("^[0-9]$"), turn(48, 10)).otherwise(c)

    return F.array_join(F.transform(_chars(value), one), "")


def _email(key: Column, m: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(_shifted(key, "email", F.substr(m, F.lit(1), at - 1), F.lower(m)), F.substr(m, at))


def _secret(key: Column, m: Column) -> Column:
    # quotes aren't part of the value, so it gets the same pseudonym with and without them
    head, tail = F.regexp_extract(m, r"^[^=:]*[=:]\s?(?:\\?[\"'])?", 0), F.regexp_extract(m, r"(?:\\?[\"'])?$", 0)
    value = F.substr(m, F.length(head) + 1, F.length(m) - F.length(head) - F.length(tail))
    return F.concat(head, _shifted(key, "secret", value, value), tail)


def kind_of(m: Column) -> Column:
    """Which of KINDS a match of ANY is; null for numbers that fail validation."""

    def whole(pattern):
        return m.rlike(f"^(?:{pattern})$")

    return (
        F.when(whole(EMAIL), "email")
        .when(whole(SECRET), "secret")
        .when(whole(ACCESS_KEY), "access_key")
        .when(whole(IBAN), F.when(iban_valid(m), F.lit("iban")))
        .when(whole(IPV6), "ipv6")
        .when(whole(IPV4), "ipv4")
        .when(whole(SSN), "ssn")
        .when(whole(ISO_DATE) | whole(DATE) | whole(NAMED_DATE), "date")
        .when(whole(CARD), "card")
        .when(whole(PHONE), "phone")
    )


def pseudonym(key: Column, m: Column) -> Column:
    def by_kind(kind):
        out = F.when(kind == "email", _email(key, m))
        for name, fn in (("secret", _secret), ("access_key", _access_key), ("iban", _iban), ("ipv6", _ipv6), ("ipv4", _ipv4), ("ssn", _ssn), ("date", lambda k, x: F.when(x.rlike("[A-Za-z]"), _named_date(k, x)).otherwise(_date(k, x))), ("card", _card), ("phone", _phone)):
            out = out.when(kind == name, fn(key, m))
        return out.otherwise(m)

    return _bind(kind_of(m), by_kind)


def replaced(text: Column, key: Column) -> Column:
    """``text`` with every match replaced by its pseudonym."""
    parts = F.split(text, ANY, -1)
    new = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(key, m))
    joined = F.array_join(F.flatten(F.zip_with(parts, new, lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    return F.when(text.rlike(NEEDED) & text.rlike(ANY), joined).otherwise(text)


def key_of(spark) -> str:
    """The session's secret key, or the example's."""
    return spark.conf.get(KEY_SETTING, KEY)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its text pseudonymised and all other columns as they are."""
    return docs.withColumn("text", replaced(F.col("text"), F.lit(key)))


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the pseudonymised text, and how many matches of each kind there were."""
    t = F.col("text")
    found = F.when(t.rlike(NEEDED), F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), kind_of))
    d = docs.select("doc_id", "text", found.alias("found"))

    def many(kind):
        return F.coalesce(F.size(F.filter("found", lambda k: k == kind)), F.lit(0)).alias(f"n_{kind}")

    return d.select("doc_id", replaced(t, F.lit(key)).alias("text"), *(many(k) for k in KINDS))
