"""BM25 in exact Q32.32 integers.

Tokens are runs of ASCII letters and digits and all non-ASCII characters,
ASCII letters in lower case, cut at 64 bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 1.2, 0.75 and ln 2 in Q32.32, and the terms of the atanh series.
ONE = 1 << 32
K1 = 5153960755
B = 3221225472
LN2 = 2977044472
TERMS = 12
TOKEN_BYTES = 64
SEPARATORS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def tokenise(text: str) -> list[str]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [t.encode()[:TOKEN_BYTES].decode("utf-8", "surrogateescape") for t in re.split(SEPARATORS, folded) if t]


#: One character of a token, as a class of the pattern language.
_CHAR = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{_CHAR}+"))


def _whole(term: bytes) -> str:
    """A pattern of a term as a whole token; one of TOKEN_BYTES stands for all that begin with it."""
    body = term.decode("utf-8", "ignore")
    rest = "" if len(term) < TOKEN_BYTES else f"{_CHAR}*"
    cut = term[len(body.encode()) :]
    if cut:  # the cut fell inside a character: any that starts with these bytes
        first, last = (cut.ljust(n, fill) for n, fill in ((_length(cut[0]), b"\x80"), (_length(cut[0]), b"\xbf")))
        low, high = (min(max(ord(x.decode("utf-8", "replace")[0]), 0x80), 0x10FFFF) for x in (first, last))
        rest = rf"[\x{{{low:x}}}-\x{{{high:x}}}]{_CHAR}*"
    return f"(?i)(?<!{_CHAR})\\Q{body}\\E{rest}(?!{_CHAR})" if body else f"(?<!{_CHAR}){rest}"


def _length(lead: int) -> int:
    return 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def multiply(a: int, b: int) -> int:
    """Rounded Q32 product of non-negative numbers."""
    return (a * b + (ONE >> 1)) >> 32


def divide(a: int, b: int) -> int:
    """Rounded Q32 quotient of non-negative numbers."""
    return ((a << 32) + b // 2) // b


def idf(n_docs: int, df: int) -> int:
    """ln(2 (N + 1) / (2 df + 1)), at least 1 unit, by a series for atanh on [1, 2)."""
    p, q, doublings = 2 * (n_docs + 1), 2 * df + 1, 0
    while 2 * q <= p:
        q, doublings = 2 * q, doublings + 1
    z = divide(p - q, p + q)
    power, total = z, 0
    for i in range(TERMS):
        total += power // (2 * i + 1)
        power = multiply(power, multiply(z, z))
    return max(1, doublings * LN2 + 2 * total)


def term_score(weight: int, tf: int, length: int, n_docs: int, total: int) -> int:
    """Score of one term in one text, an integer in Q32."""
    if not tf:
        return 0
    ratio = ((length * n_docs) << 32) // total
    saturation = ((tf << 32) * (K1 + ONE)) // ((tf << 32) + multiply(K1, ONE - B + multiply(B, ratio)))
    return multiply(weight, saturation)


def _big(x) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("decimal(38,0)")


def _quotient(a: Column, b) -> Column:
    """Whole part of a quotient of non-negative integers."""
    return F.call_function("div", a, _big(b)).cast("decimal(38,0)")


def _product(*factors) -> Column:
    out = _big(factors[0])
    for x in factors[1:]:
        out = (out * _big(x)).cast("decimal(38,0)")
    return out


def _multiply(a, b) -> Column:
    return _quotient((_product(a, b) + _big(ONE >> 1)).cast("decimal(38,0)"), ONE)


def scored(weight: int, tf: Column, length: Column, n_docs: int, total: int) -> Column:
    """``term_score`` as a column, in the same integers."""
    ratio = _quotient(_product(length, n_docs, ONE), max(1, total))
    norm = (_big(ONE - B) + _multiply(B, ratio)).cast("decimal(38,0)")
    below = (_product(tf, ONE) + _multiply(K1, norm)).cast("decimal(38,0)")
    return F.when(tf > 0, _multiply(weight, _quotient(_product(tf, ONE, K1 + ONE), below))).otherwise(_big(0))


def search(df: DataFrame, text: str, query: str, score: str) -> DataFrame:
    """Rows of ``df`` that match the query, with their integer scores.

    Statistics cover all rows whose text is not null; they are a handful of
    numbers, whatever the size of the table. Counting is by patterns, so texts
    are never taken apart, and scores are exact decimals.
    """
    terms = list(dict.fromkeys(t.encode("utf-8", "surrogateescape") for t in tokenise(query)))
    if not terms:
        return df.where(F.lit(False)).withColumn(score, F.lit(None).cast("decimal(38,0)"))
    t = F.col(f"`{text}`")
    counts = [F.regexp_count(t, F.lit(_whole(x))).cast("long") for x in terms]
    stats = df.where(t.isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(token_count(t)), F.lit(0)).alias("total"), *(F.count_if(t.rlike(_whole(x))).alias(f"df{i}") for i, x in enumerate(terms))).first()
    any_term = F.lit(False)
    for x in terms:
        any_term = any_term | t.rlike(_whole(x))
    hit = df.where(t.isNotNull() & any_term)
    hit = hit.withColumns({"__len": token_count(t).cast("long"), **{f"__tf{i}": c for i, c in enumerate(counts)}})
    points = _big(0)
    for i in range(len(terms)):
        points = (points + scored(idf(stats["n"], stats[f"df{i}"]), F.col(f"__tf{i}"), F.col("__len"), stats["n"], int(stats["total"]))).cast("decimal(38,0)")
    return hit.withColumn(score, points).drop("__len", *(f"__tf{i}" for i in range(len(terms))))
