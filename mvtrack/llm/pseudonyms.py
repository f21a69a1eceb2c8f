"""Format-preserving pseudonyms for personal numbers and dates.

A value that passes its format's validation is replaced by another valid value
of the same format: a keyed Feistel permutation of the format's whole domain,
walked along its cycle where the domain isn't a product of two sides.  Equal
values stay equal in all documents, different ones stay different, and the
holder of the key can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ROUNDS = 8
#: Characters of a mail name that are permuted as one.
LONG_LOCAL = 64
DAYS_FROM, DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # to 2099-12-31


def _step(key: bytes, kind: str, size: int, r: int, half: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{kind}|{size}|{r}|{half}".encode(), "sha256")[:16], "big")


def _sides(size: int) -> tuple[int, int]:
    a = isqrt(size - 1) + 1
    return a, -(-size // a)


@lru_cache(1 << 16)
def permute(key: bytes, kind: str, size: int, x: int, back: bool = False) -> int:
    """A permutation of range(size) that depends on key, kind and size; ``back`` undoes it."""
    if size < 2:
        return x
    a, b = _sides(size)
    while True:
        if back:
            for r in reversed(range(ROUNDS)):
                right, w = divmod(x, a)
                x = b * ((w - _step(key, kind, size, r, right)) % a) + right
        else:
            for r in range(ROUNDS):
                left, right = divmod(x, b)
                x = a * right + (left + _step(key, kind, size, r, right)) % a
        if x < size:  # else the value left the domain: walk on
            return x


def derange(key: bytes, kind: str, size: int, x: int, back: bool = False) -> int:
    """Like ``permute``, but no value stays as it is: a step along the one cycle that the permutation makes of the range."""
    at = permute(key, kind, size, x)
    return permute(key, kind, size, (at + (-1 if back else 1)) % size, back=True)


def walk(p: Callable[[str, int, int], int], kind: str, size: int, x: int, fits: Callable[[int], bool]) -> int:
    """The next value along the cycle that fits, as the given one does."""
    while True:
        x = p(kind, size, x)
        if fits(x):
            return x


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced one by one."""
    rest = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(rest), shape)


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for valid numbers."""
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))


def _card(value: str, p: Callable[[str, int, int], int]) -> str | None:
    digits = _digits(value)
    if luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = f"{p('card', 10**n, int(digits[:-1])):0{n}d}"
    return _refill(value, body + str(-luhn(body + "0") % 10))


def _ip(value: str, p: Callable[[str, int, int], int]) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    return ".".join(map(str, p("ip", 2**32, int.from_bytes(bytes(parts), "big")).to_bytes(4, "big")))


def _ssn(value: str, p: Callable[[str, int, int], int]) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    x = p("ssn", 898 * 99 * 9999, ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


# The country codes of one and of two digits; all others have three.
_ONE, _TWO = ("1", "7"), ("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98").split()


def _phone(value: str, p: Callable[[str, int, int], int]) -> str | None:
    """Country codes stay, and so does whether the area and exchange of a number of ten digits can be dialled (no first 0 or 1)."""
    digits = _digits(value)
    if not 7 <= len(digits) <= 15 or len(set(digits)) == 1:
        return None
    keep = (1 if digits[0] in _ONE else 2 if digits[:2] in _TWO else 3) if value[0] == "+" else 1 if len(digits) == 11 and digits[0] == "1" else 0
    rest = digits[keep:]
    n = len(rest)
    dialled = lambda x: n == 10 and f"{x:010d}"[0] >= "2" and f"{x:010d}"[3] >= "2"
    want = dialled(int(rest))
    x = walk(p, "phone", 10**n, int(rest), lambda x: dialled(x) == want)
    return _refill(value, f"{digits[:keep]}{x:0{n}d}")


def _iban(value: str, p: Callable[[str, int, int], int]) -> str | None:
    plain = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    kinds = [26 if c.isalpha() else 10 for c in plain[4:]]
    x, size = 0, 1
    for c, k in zip(plain[4:], kinds, strict=True):
        x, size = x * k + (ord(c) - 65 if k == 26 else int(c)), size * k
    x, body = p("iban", size, x), ""
    for k in reversed(kinds):
        x, d = divmod(x, k)
        body = (chr(65 + d) if k == 26 else str(d)) + body
    check = 98 - number(body + plain[:2] + "00") % 97
    rest = iter(plain[:2] + f"{check:02d}" + body)
    return re.sub(r"[A-Z0-9]", lambda _: next(rest), value)


def _date(value: str, p: Callable[[str, int, int], int]) -> str | None:
    parts = re.split(r"[-./]", value)
    mark = value[len(parts[0])]
    first = len(parts[0]) == 4
    y, m, d = map(int, parts if first else reversed(parts))
    swap = not first and m > 12  # month first, where the other order is no date
    if swap:
        m, d = d, m
    try:
        day = datetime.date(y, m, d).toordinal() - DAYS_FROM
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    order = (lambda t: [t.year, t.month, t.day]) if first else (lambda t: [t.month, t.day, t.year]) if swap else (lambda t: [t.day, t.month, t.year])
    widths = list(map(len, parts))

    def fits(day: int) -> bool:
        """It is written with as many digits; and a date that can be read either way must not come out of one that can't."""
        t = datetime.date.fromordinal(day + DAYS_FROM)
        return all(len(str(x)) <= n for x, n in zip(order(t), widths, strict=True)) and not (swap and t.day <= 12)

    t = datetime.date.fromordinal(walk(p, "date" + "m" * swap, DAYS, day, fits) + DAYS_FROM)
    return mark.join(f"{x:0{n}d}" for x, n in zip(order(t), widths, strict=True))


@lru_cache(1 << 12)
def _alphabet(c: str) -> str:
    """The characters among which one is replaced: ASCII digits, a-z or A-Z; elsewhere those of its kind and block of 256."""
    if c.isascii():
        return next((own for own in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in own), c)
    if not c.isalnum():
        return c
    first, kind = ord(c) & ~0xFF, unicodedata.category(c)
    return "".join(chr(x) for x in range(max(first, 128), first + 256) if unicodedata.category(chr(x)) == kind and chr(x).isalnum())


def _shaped(text: str, kind: str, p: Callable[[str, int, int], int]) -> str:
    """``text`` through one permutation of all texts of its shape."""
    own = [_alphabet(c) for c in text]
    x, size = 0, 1
    for c, letters in zip(text, own, strict=True):
        x, size = x * len(letters) + letters.index(c), size * len(letters)
    if size == 1:
        return text
    x, new = p(kind, size, x), []
    for letters in reversed(own):
        x, d = divmod(x, len(letters))
        new.append(letters[d])
    return "".join(reversed(new))


def _email(value: str, p: Callable[[str, int, int], int]) -> str | None:
    """The local part, of any script, through one permutation of all local parts of its shape.

    Beyond ``LONG_LOCAL`` characters it goes piece by piece, each through a
    permutation that the length and all pieces before it choose: still one to
    one, in time that grows with the length; parts that begin alike stay alike as
    far as whole pieces do.
    """
    local, at, host = value.rpartition("@")
    if len(local) <= LONG_LOCAL:
        new = _shaped(local, "email", p)
    else:
        made, chain = [], hashlib.sha256(str(len(local)).encode())
        for i in range(0, len(local), LONG_LOCAL // 2):
            piece = local[i : i + LONG_LOCAL // 2]
            made.append(_shaped(piece, f"email|{chain.hexdigest()}", p))
            chain.update("\0".join(sorted((piece, made[-1]))).encode("utf-8", "surrogatepass"))  # the same on the way back
        new = "".join(made)
    return None if new == local else new + at + host


#: Kind, pattern, and the function that validates and replaces; earlier kinds win where matches overlap.
FORMATS: list[tuple[str, re.Pattern[str], Callable]] = [
    ("email", re.compile(r"(?<![\w.+%-])\w[\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("card", re.compile(r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-])"), _card),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\w)"), _ip),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _ssn),
    ("date", re.compile(r"(?<![\w./-])(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?![\w/-])"), _date),
    ("phone", re.compile(r"(?<![\w.+-])(?:(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){1,4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|\+[0-9]{8,15})(?![\w-])"), _phone),
]
KINDS = [k for k, _, _ in FORMATS]


def replace(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, in the text given."""
    if not text:
        return text, []
    if "@" not in text:
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw.translate(None, b"0123456789")) > len(raw) - 2:  # an account number may have its two check digits only, a date six
            return text, []
    p = lambda kind, size, x: derange(key, kind, size, x, back)
    taken: list[tuple[int, int, str, str]] = []  # in order, apart from each other
    for kind, pattern, new in FORMATS:
        starts, ends = [t[0] for t in taken], [t[1] for t in taken]
        found = []
        for m in pattern.finditer(text):
            if bisect_right(ends, m.start()) == bisect_left(starts, m.end()):  # none that ends after its start begins before its end
                if (value := new(m[0], p)) is not None:
                    found.append((m.start(), m.end(), kind, value))
        taken = sorted(taken + found)
    out, at = [], 0
    for a, b, _, value in taken:
        out += [text[at:a], value]
        at = b
    return "".join([*out, text[at:]]), [(k, a, b) for a, b, k, _ in taken]


def pseudonyms(key: bytes, text: str = "text", back: bool = False) -> Column:
    """A struct (text, spans) of a text column; spans is kind:start:end, comma-joined."""

    @F.pandas_udf("struct<text:string,spans:string>")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            made = [replace(t, key, back) for t in texts]
            yield pd.DataFrame({"text": [t for t, _ in made], "spans": [",".join(f"{k}:{a}:{b}" for k, a, b in s) for _, s in made]})

    return mask.asNondeterministic()(F.col(text))


def mask_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, n_replaced, spans, text) for every row.

    A null text stays null and an empty one empty, with no spans.  Each row is
    its own work, whatever its doc_id, so nulls, ties and repeated rows need no
    care, no row moves, and equal values get equal pseudonyms everywhere.  An
    empty table gives no rows; other columns are not read.
    """
    done = small_batches(docs).select("doc_id", pseudonyms(key).alias("__made"))
    count = F.expr("cast(size(filter(split(__made.spans, ','), s -> s <> '')) as long)")
    return done.select("doc_id", count.alias("n_replaced"), F.col("__made.spans").alias("spans"), F.col("__made.text").alias("text"))
