"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, octets, calendar), then permuted within their format by a keyed
Feistel network: a card number stays a valid card number of its length, a date stays a date, and equal values get equal
pseudonyms in every document, whatever their separators.
"""

from __future__ import annotations

import bisect
import datetime as dt
import functools
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.llm.common import table

#: Stands in where the caller gives no key; real runs pass their own secret.
KEY = b"documented default key, not a secret"
ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: Characters that are permuted as one number; a longer text is permuted in blocks of so many.
BLOCK = 64


def permute(x: int, n: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..n-1: a Feistel network over a * b >= n, walked until it comes back below n."""
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    size = (a.bit_length() + 7) // 8 + 8  # so many bytes that the remainder is as good as uniform
    head = key + b"|%d|%d|%b|" % (len(key), n, tweak)

    def f(i: int, v: int) -> int:
        return int.from_bytes(hashlib.shake_256(head + b"%d|%x" % (i, v)).digest(size), "big")

    while True:
        left, right = divmod(x, b)  # left < a, right < b
        if back:
            for i in reversed(range(0, ROUNDS, 2)):
                right = (right - f(i + 1, left)) % b
                left = (left - f(i, right)) % a
        else:
            for i in range(0, ROUNDS, 2):
                left = (left + f(i, right)) % a
                right = (right + f(i + 1, left)) % b
        x = left * b + right
        if x < n:
            return x


#: Letters and digits are permuted within these ranges of characters; all others stay.
CLASSES = (("0", 10), ("a", 26), ("A", 26), ("à", 23), ("À", 23))


#: The same for hexadecimal digits.
HEX = (("0", 10), ("a", 6), ("A", 6))


def permute_text(s: str, key: bytes, tweak: bytes, back: bool = False, classes: tuple[tuple[str, int], ...] = CLASSES) -> str:
    """Each letter stays a letter of its range and each digit a digit; BLOCK characters are one number of mixed radix.

    A block's permutation depends on the plain blocks before it, so that a long text costs time in proportion to it.
    """
    out: list[str] = []
    before = hashlib.blake2b(tweak + b"|%d" % len(s), digest_size=16)
    for i in range(0, len(s), BLOCK):
        block = s[i : i + BLOCK]
        new = _permute_block(block, key, tweak if len(s) <= BLOCK else before.digest(), back, classes)
        before.update((new if back else block).encode())
        out.append(new)
    return "".join(out)


def _permute_block(s: str, key: bytes, tweak: bytes, back: bool, classes: tuple[tuple[str, int], ...]) -> str:
    at = [next(((ord(first), n) for first, n in classes if ord(first) <= ord(c) < ord(first) + n), None) for c in s]
    value, size = 0, 1
    for c, x in zip(s, at, strict=True):
        if x:
            value, size = value * x[1] + ord(c) - x[0], size * x[1]
    value, out = permute(value, size, key, tweak, back), []
    for c, x in zip(reversed(s), reversed(at), strict=True):
        if x:
            value, k = divmod(value, x[1])
            c = chr(x[0] + k)
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The check digit that belongs behind `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _number(kind: str, digits: str, key: bytes, back: bool) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, kind.encode(), back)).zfill(len(digits))


def _card(s: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = _number("card", digits[:-1], key, back)
    return _refill(s, body + luhn_digit(body))


#: The country codes of two digits (E.164). 1 and 7 stand alone, all others have three.
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def _phone(s: str, key: bytes, back: bool) -> str | None:
    """The ten digits of a national number, or all behind the country code; the code stays."""
    digits = re.sub(r"\D", "", s)
    if s[0] == "+":
        if not 8 <= len(digits) <= 15:
            return None
        head = 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3
    else:
        head = len(digits) - 10
    return _refill(s, digits[:head] + _number("phone", digits[head:], key, back))


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    """Area, group and serial number as one number over the valid ones."""

    def areas(x: int) -> int:  # rank of an area among 001-665, 667-899
        return x - 1 - (x > 666)

    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = permute((areas(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, b"ssn", back)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ipv4(s: str, key: bytes, back: bool) -> str | None:
    octets = s.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in octets):
        return None
    x = permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, b"ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ipv6(s: str, key: bytes, back: bool) -> str | None:
    """The address as one number, written out in full if it was, else in its shortest form (RFC 5952).

    Addresses that are written alike in both forms, having no group below 0x1000, are permuted among themselves. Short
    ones such as `::1` and `a::b` are taken for something else and stay.
    """
    try:
        x = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    if len(s) < 6 or s.count(":") < 3 and not re.search("[0-9]", s):
        return None
    whole = lambda v: all(v >> 16 * i & 0xF000 for i in range(8))
    alike = whole(x)
    while True:
        x = permute(x, 1 << 128, key, b"ipv6", back)
        if whole(x) == alike:
            break
    new = ipaddress.IPv6Address(x)
    out = new.exploded if len(s) == 39 else new.compressed
    return out.upper() if s.upper() == s and s.lower() != s else out


def _date_class(day: int) -> tuple[bool, bool, bool]:
    """What a pseudonym keeps of a date, so that every way of writing it stays as it is: day and month below 10, and a day that is no month."""
    d = dt.date.fromordinal(day)
    return d.day < 10, d.day > 12, d.month < 10


@functools.cache
def _dates() -> dict[tuple[bool, bool, bool], list[int]]:
    """The days of FIRST_DAY to LAST_DAY by class."""
    out: dict[tuple[bool, bool, bool], list[int]] = {}
    for day in range(FIRST_DAY, LAST_DAY + 1):
        out.setdefault(_date_class(day), []).append(day)
    return out


def _date(s: str, key: bytes, back: bool) -> str | None:
    """Year first, or day first, or month first where the day can't be: all in 1900 to 2099.

    A date is permuted among the days of its class (see _date_class), so its pseudonym is read in the same order and
    every written form of a date gets the same day.
    """
    sep = re.search(r"[-/.]", s)[0]
    parts = s.split(sep)
    for order in ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        y, m, d = (int(parts[i]) for i in order)
        try:
            day = dt.date(y, m, d).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            kind = _date_class(day)
            held = _dates()[kind]
            new = dt.date.fromordinal(held[permute(bisect.bisect_left(held, day), len(held), key, b"date%d%d%d" % kind, back)])
            out = [""] * 3
            for i, v in zip(order, (new.year, new.month, new.day), strict=True):
                out[i] = str(v).zfill(len(parts[i]))
            return sep.join(out)
    return None


def _iban(s: str, key: bytes, back: bool) -> str | None:
    flat = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = permute_text(flat[4:], key, b"iban" + flat[:2].encode(), back)
    check = 98 - number(body + flat[:2] + "00") % 97
    new = iter(flat[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def _email(s: str, key: bytes, back: bool) -> str | None:
    local, _, domain = s.partition("@")
    return permute_text(local, key, b"email@" + domain.lower().encode(), back) + "@" + domain


def _secret(s: str, key: bytes, back: bool) -> str | None:
    """Behind a known prefix, letters stay letters and digits digits; hexadecimal stays hexadecimal."""
    head = _PREFIX.match(s).end()
    body = s[head:]
    new = permute_text(body, key, b"secret" + s[:head].encode(), back, HEX if _HEXADECIMAL.fullmatch(body) else CLASSES)
    return s[:head] + new if new != body or back else None


_HEXADECIMAL = re.compile("[0-9a-f]+|[0-9A-F]+")
#: Prefixes of widely used access keys.
_PREFIX = re.compile(r"(?:AKIA|ASIA|AIza|sk-|pk-|gh[pousr]_|glpat-|xox[abprs]-|eyJ)?")
_NAMES = r"(?<![A-Za-z])(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth|credential)s?"
_OCTETS = r"\d{1,3}(?:\.\d{1,3}){3}"


def _has(*parts: str) -> Callable[[str], bool]:
    return lambda text: any(p in text for p in parts)


#: What must stand in a text that a pattern matches: parts that the pattern itself asks for.
_DIGIT, _AT, _COLON, _SET = re.compile(r"\d").search, _has("@"), _has(":"), _has("=", ":")
_KEYS = _has("AKIA", "ASIA", "AIza", "sk-", "pk-", *(f"gh{c}_" for c in "pousr"), "glpat-", *(f"xox{c}-" for c in "abprs"))
#: An unquoted named value shows a digit among its first 200 characters, so that repeated names take time in proportion.
#: Kind, pattern, pseudonym and what the pattern needs of each kind of value, in order of precedence. The value is the group `v`, or all that matches.
KINDS: tuple[tuple[str, str, Callable[[str, bytes, bool], str | None], Callable[[str], object]], ...] = (
    ("secret", r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|[sp]k-[A-Za-z0-9_-]{20,}+|gh[pousr]_[A-Za-z0-9]{30,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9_-])", _secret, _KEYS),
    ("secret", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+(?:\.[A-Za-z0-9_-]++)?(?![A-Za-z0-9_-])", _secret, _has("eyJ")),
    ("secret", r"[=:][ \t]{0,4}[\"']?(?P<v>[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])", _secret, _SET),
    ("secret", _NAMES + r"[\"']?[ \t]{0,4}(?:[=:]|=>)[ \t]{0,4}(?:\"(?P<v>[^\"\s]{6,}+)\"|'(?P<w>[^'\s]{6,}+)'|(?P<x>(?=[A-Za-z_+/.=-]{0,200}\d)[A-Za-z0-9_+/.=-]{8,}+)(?![\w@]))", _secret, _SET),
    ("email", r"(?<![\w.%+-])[._%+-]*(?P<v>[^\W_][\w.%+-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![\w-])", _email, _AT),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban, _DIGIT),
    ("ipv6", r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,34}:)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)", _ipv6, _COLON),
    ("ipv4", rf"(?<![\w.]){_OCTETS}(?!\.?\w)", _ipv4, _DIGIT),
    ("date", r"(?<![\w/.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\w/-]|\.\d)", _date, _DIGIT),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn, _DIGIT),
    ("phone", r"(?<![\w.-])\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}(?![\w-]|\.\d)", _phone, _DIGIT),
    ("phone", r"(?<![\w.+-])(?:\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]|\.\d)", _phone, _DIGIT),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)", _card, _DIGIT),
)
_PATTERNS = [(kind, re.compile(pattern), make, need) for kind, pattern, make, need in KINDS]
_NEEDS = {need for *_, need in KINDS}


def findings(text: str | None, key: bytes = KEY, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each value in a text, in order; a kind earlier in KINDS wins over an overlap, then the first in the text."""
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    held = {need: need(text) for need in _NEEDS}
    for kind, pattern, make, need in _PATTERNS:
        if not held[need]:
            continue
        own: list[tuple[int, int, str, str]] = []
        k = 0  # of the values found so far, which do not overlap, the first that ends behind the match's start
        for m in pattern.finditer(text):
            a, z = next((m.span(g) for g in m.groupdict() if m[g] is not None), m.span())
            while k < len(out) and out[k][1] <= a:
                k += 1
            if k < len(out) and out[k][0] < z:
                continue
            new = make(text[a:z], key, back)
            if new is not None:
                own.append((a, z, kind, new))
        if own:
            out = sorted(out + own)
    return out


def _put(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for a, z, _, new in found:
        parts += [text[at:a], new]
        at = z
    return "".join([*parts, text[at:]])


def replace(text: str | None, key: bytes = KEY, back: bool = False) -> str | None:
    return None if text is None else _put(text, findings(text, key, back))


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Replaces every value in `text` by its pseudonym; null and empty texts stay, so does every other column.

    A row is worked on by itself, so repeated rows get equal texts. Time grows with the text and the values in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([replace(x, key) for x in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def find(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, seq, kind, start, end, pseudonym): a row for each value found in docs (doc_id, text), in characters."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("pseudonym", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, kind, a, z, new) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (a, z, kind, new) in enumerate(findings(text, key))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def report(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, n_values, kinds, text): a row for each row of docs (doc_id, text) in which values are found, with the pseudonyms in their place."""
    schema = "doc_id long, n_values long, kinds array<string>, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = findings(text, key)
                if found:
                    rows.append((i, len(found), sorted({x[2] for x in found}), _put(text, found)))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["doc_id", "n_values", "kinds", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with personal data or secrets, and its text with pseudonyms in their place."""
    return report(table(spark, sf_dir, "documents"))
