"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

A value that passes its kind's validation is ranked among all values of its
format, the rank is permuted by a Feistel network keyed by a secret, and the
permuted rank is written in the same format.  A permutation maps equal values
to equal pseudonyms and different values to different ones, so documents stay
linked, while the key alone undoes it.  Layout (separators, case, lengths) is
kept, and a pseudonym is valid wherever its original was.

Kinds: card numbers (13 to 19 digits, Luhn), telephone numbers, IPv4
addresses, dates (year-month-day, day/month/year, day.month.year), social
security numbers, IBANs (check digits), e-mail addresses and labelled secrets.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Names the secret in the session's configuration.
KEY_SETTING = "spark.voxmill.pii.key"
ROUNDS = 10
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def feistel(x: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network with cycle walking."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, order = (1 << half) - 1, range(ROUNDS)
    bytes_, wide = (half + 7) // 8, max(8, (half + 7) // 8)
    while True:
        left, right = x >> half, x & mask
        for r in reversed(order) if inverse else order:
            if inverse:
                left, right = right, left
            data = bytes([r]) + tweak + b"|" + right.to_bytes(bytes_, "big")
            f = int.from_bytes(hashlib.blake2b(data, key=key, digest_size=min(64, wide)).digest(), "big")
            left ^= f & mask
            if not inverse:
                left, right = right, left
        x = left << half | right
        if x < size:
            return x


def permute(text: str, key: bytes, tweak: bytes, inverse: bool = False, hexadecimal: bool = False) -> str:
    """Permutes letters and digits of an ASCII text, keeping the class at each place.

    Long texts go in pieces of 40 places, tweaked by their place and what was there before.
    """
    out, places = list(text), [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    past = b""
    for k in range(0, len(places), 40):
        piece = places[k : k + 40]
        if hexadecimal:
            low = any(text[i].islower() for i in places)
            digits = _DIGITS + (_LOWER if low else _UPPER)[:6]
            sets = [digits] * len(piece)
        else:
            sets = [_DIGITS if text[i].isdigit() else _LOWER if text[i].islower() else _UPPER for i in piece]
        x, size = 0, 1
        for i, s in zip(piece, sets):
            x, size = x * len(s) + s.index(text[i]), size * len(s)
        shape = "".join("h" if hexadecimal else s[0] for s in sets).encode()
        y = feistel(x, size, key, tweak + b"/%d/" % k + shape + past, inverse)
        plain = "".join(text[i] for i in piece)
        for i, s in zip(reversed(piece), reversed(sets)):
            y, d = divmod(y, len(s))
            out[i] = s[d]
        made = "".join(out[i] for i in piece)
        past = hashlib.blake2b((made if inverse else plain).encode(), digest_size=8).digest()
    return "".join(out)


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def luhn_digit(payload: str) -> str:
    odd = sum(int(c) for c in payload[-2::-2])
    even = sum(sum(divmod(2 * int(c), 10)) for c in payload[-1::-2])
    return str(-(odd + even) % 10)


def _fill(layout: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def _card(v: str, key: bytes, inverse: bool) -> str | None:
    """All but the check digit are permuted, and the check digit made anew."""
    d = re.sub(r"\D", "", v)
    if not 13 <= len(d) <= 19 or not luhn(d):
        return None
    p = permute(d[:-1], key, b"card", inverse)
    return _fill(v, p + luhn_digit(p))


#: Leading digits of country codes: the world's zones by ITU-T E.164, as (first digits, length of the code).
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NO_CODES = frozenset("210 214 215 217 219 259 28 292 293 294 295 296 384 388 422 424 425 426 427 428 429 693 694 695 696 697 698 699 801 802 803 804 805 806 807 809 83 851 854 857 858 859 871 872 873 874 875 876 877 879 884 885 887 889 89 969 978 990 997 999".split())


def country_code(head: str) -> bool:
    """Whether ``head``, + and digits, is a country code of E.164; no head is none needed."""
    d = head.lstrip("+")
    if not d or d in ("1", "7") or d in _TWO:
        return True
    return len(d) == 3 and d[:2] not in _TWO and d[0] not in "17" and d not in _NO_CODES and d[:2] not in _NO_CODES


def _phone(v: str, key: bytes, inverse: bool) -> str | None:
    """Keeps a leading + and country code, which must be one; the national digits, 7 or more and 15 with the code at most, are permuted."""
    m = re.match(r"\+\d{1,3}(?=[ .\-(])", v)
    head = m.group() if m else ""
    d = re.sub(r"\D", "", v[len(head) :])
    if not 7 <= len(d) <= 15 - len(head.lstrip("+")) or not country_code(head):
        return None
    return head + _fill(v[len(head) :], permute(d, key, b"phone" + head.encode(), inverse))


def _ip(v: str, key: bytes, inverse: bool) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = 0
    for p in parts:
        x = x << 8 | int(p)
    y = feistel(x, 1 << 32, key, b"ip", inverse)
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(v: str, key: bytes, inverse: bool) -> str | None:
    """Days of 1900 to 2099 are permuted, whatever the layout."""
    a, b, c = (int(x) for x in re.split(r"[-/.]", v))
    year, month, day = (a, b, c) if a > 31 or re.match(r"\d{4}", v) else (c, b, a)
    try:
        x = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not _FIRST <= x <= _LAST:
        return None
    y = datetime.date.fromordinal(_FIRST + feistel(x - _FIRST, _LAST - _FIRST + 1, key, b"date", inverse))
    s = re.search(r"[-/.]", v).group()
    return f"{y.year:04}{s}{y.month:02}{s}{y.day:02}" if year == a else f"{y.day:02}{s}{y.month:02}{s}{y.year:04}"


def _ssn(v: str, key: bytes, inverse: bool) -> str | None:
    """Area 001 to 899 but 666, group and serial not zero, permuted among themselves."""
    a, g, n = (int(x) for x in v.split("-"))
    if not 0 < a < 900 or a == 666 or not g or not n:
        return None
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1
    y = feistel(x, 898 * 99 * 9999, key, b"ssn", inverse)
    y, n = divmod(y, 9999)
    a, g = divmod(y, 99)
    return f"{a + 1 + (a >= 665):03}-{g + 1:02}-{n + 1:04}"


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02}"


def _iban(v: str, key: bytes, inverse: bool) -> str | None:
    flat = v.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    rest = permute(flat[4:], key, b"iban" + flat[:2].encode(), inverse)
    it = iter(flat[:2] + _iban_check(flat[:2], rest) + rest)
    return "".join(c if c == " " else next(it) for c in v)


def _email(v: str, key: bytes, inverse: bool) -> str | None:
    """The local part is permuted; domains stay, and tweak it."""
    local, _, domain = v.rpartition("@")
    return permute(local, key, b"mail@" + domain.lower().encode(), inverse) + "@" + domain


def _secret(v: str, key: bytes, inverse: bool) -> str | None:
    return permute(v, key, b"secret", inverse, re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v) is not None)


KINDS: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone,
}
_ALTERNATIVES = (
    r"""(?P<email>(?<![\w.+%-])[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})
    |\b(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']?[ ]?[:=][ ]?["']?(?P<secret>[A-Za-z0-9_\-+/]{16,}={0,2})
    |\b(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?)\b
    |(?<![\w.,/-])(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./-]\d{2}[./-]\d{4})(?![\w/-]|[.,]\d)
    |(?<![\w.])(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\w|\.\d)
    |(?<![\w-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
    |(?<![\w.])(?P<card>\d(?:[ -]?\d){12,18})(?!\w|[.,]\d)
    |(?<![\w.])(?P<phone>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}[ .\-]\d{4}|\d{3}[ .\-]\d{3}[ .\-]\d{4})(?!\w|[.,-]\d)"""
)
_PATTERN = re.compile(_ALTERNATIVES, re.X | re.A)
_EACH = {kind: re.compile(part, re.X | re.A) for kind, part in zip(KINDS, _ALTERNATIVES.split("\n    |"), strict=True)}
#: What parts the groups of a value that may be shorter than its pattern takes it.
_GROUPS = {"iban": re.compile("[ ]"), "card": re.compile("[ -]"), "phone": re.compile("[ ]")}
_FIRST_GROUP = re.compile(r"\W*\w+", re.A)
_MAY = re.compile(r"[0-9@]|[=:][ ]?[\"']?[A-Za-z_\-+/]{16}")


def _valid(text: str, m: re.Match, key: bytes, inverse: bool) -> tuple[str, int, int, str] | None:
    """Kind, start, end and pseudonym of the longest run of groups that is valid, by the first kind that has one where m starts."""
    kinds = list(KINDS)
    for kind in kinds[kinds.index(m.lastgroup) :]:
        own = m if kind == m.lastgroup else _EACH[kind].match(text, m.start())
        if own is None:
            continue
        a, b = own.span(kind)
        shorter = [g.start() for g in _GROUPS[kind].finditer(text, a, b)] if kind in _GROUPS else []
        for end in [b, *reversed(shorter)]:
            if end < b and not _EACH[kind].fullmatch(text, m.start(), end):
                continue
            made = KINDS[kind](text[a:end], key, inverse)
            if made is not None:
                return kind, a, end, made
    return None


def pseudonymise(text: str | None, key: bytes, inverse: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in the new text.

    Of a match that isn't valid the shorter runs of its groups are tried, then
    the search goes on behind its first group.  The inverse finds the values
    anew, and a pseudonym may be valid together with a number beside it where
    the original wasn't; ``restore`` undoes by the places and is exact.
    """
    if not text or not _MAY.search(text):
        return text, []
    out, at, done, spans = [], 0, 0, []
    m = _PATTERN.search(text)
    while m:
        found = _valid(text, m, key, inverse)
        if found is None:
            m = _PATTERN.search(text, _FIRST_GROUP.match(text, m.start()).end())
            continue
        kind, a, b, made = found
        out += [text[at:a], made]
        done += a - at
        spans.append((kind, done, done + len(made)))
        done, at = done + len(made), b
        m = _PATTERN.search(text, b)
    return ("".join([*out, text[at:]]), spans) if spans else (text, [])


def restore(text: str, spans: list[tuple[str, int, int]], key: bytes) -> str:
    """The original of a text with pseudonyms at the given places."""
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], KINDS[kind](text[a:b], key, True)]
        at = b
    return "".join([*out, text[at:]])


_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The secret of the session's configuration; without one, a key drawn for this application alone.

    With a drawn key values stay linked within the application, and nobody can
    undo the pseudonyms once it has ended.  The key goes to tasks with their
    code, so a task that runs again writes the same.
    """
    set_to = spark.conf.get(KEY_SETTING, None)
    if set_to:
        return hashlib.blake2b(set_to.encode(), digest_size=32).digest()
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with text replaced, and pii_kinds, pii_starts and pii_ends added, by code points of the new text.

    Raises without a key.  Null texts stay null with empty lists.  Rows depend on their text and the key alone.
    """

    if not key:
        raise ValueError("pseudonyms need a key")

    @F.pandas_udf("text string, kinds array<string>, starts array<int>, ends array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [pseudonymise(t, key) for t in texts]
            yield pd.DataFrame({
                "text": [t for t, _ in rows],
                **{n: [[s[i] for s in spans] for _, spans in rows] for i, n in enumerate(("kinds", "starts", "ends"))},
            })

    out = docs.withColumn("__p", run(F.col(text_col))).withColumns({
        text_col: F.col("__p.text"), "pii_kinds": F.col("__p.kinds"), "pii_starts": F.col("__p.starts"), "pii_ends": F.col("__p.ends"),
    })
    return out.drop("__p")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms, and where they are."""
    out = pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return out.select("doc_id", "text", F.size("pii_kinds").alias("n_replaced"), "pii_kinds", "pii_starts", "pii_ends")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts with pseudonyms; n_chars follows the new text where it told the old."""
    columns = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    d = docs.toDF(*at.values()).withColumn("__old", F.length(at["text"]))
    out = pseudonyms(d, session_key(spark), at["text"])
    if "n_chars" in at:
        n = F.col(at["n_chars"])
        new = F.length(at["text"]).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(at["n_chars"], F.when(n == F.col("__old"), new).otherwise(n))
    return out.select(*[F.col(at[c]).alias(c) for c in columns])
