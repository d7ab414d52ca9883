"""Format-preserving Feistel pseudonyms for personal data.

A value that passes the check of its kind is replaced by another valid value of the same format:
a keyed permutation of the format's values, so equal values get equal pseudonyms in every
document and different values different ones. Nothing is looked up and nothing is shuffled.

Results for odd input: a null text stays null, an empty one empty, null ids and repeated rows
pass through; texts are scanned whole, whatever their length; a value that fails its check (a
card number with a wrong check digit, 31 February) is left as it is; of overlapping values the
kind listed first wins, then the earlier one; an empty table gives no rows. Other columns of the input
are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import slices

ROUNDS = 10
# Characters of an email address that are permuted together: half of so many are mixed by one digest.
EMAIL = 96
KINDS = ("email", "iban", "card", "date", "ip", "ssn", "phone")
# First and last day of the permuted calendar.
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1

# Country codes of one and of two digits; all others have three.
ONE_DIGIT_CODES = ("1", "7")
TWO_DIGIT_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 "
    "60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()

_DIGITS = re.compile(r"\d")
# Local parts are read backwards from the @, whatever their length.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}")
_PATTERNS = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "date": re.compile(r"(?<![\w.+/-])(?:\d{4}-\d\d-\d\d|\d\d([/.])\d\d\1\d{4})(?![\w/-])"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
    "ssn": re.compile(r"(?<![\w.+-])\d{3}-\d\d-\d{4}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w.+-])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
        r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}"
        r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\1\d{4})(?![\w-])"
    ),
}


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """Image of ``value`` under a keyed permutation of range(size).

    A Feistel network over the pairs (value // b, value % b); pairs beyond the range are permuted
    again until they fall into it, which keeps the map one to one.
    """
    if size < 2:
        return value
    b = isqrt(size - 1) + 1
    a = -(-size // b)
    while True:
        left, right = divmod(value, b)
        for turn in range(ROUNDS):
            word = left if turn % 2 else right
            seed = f"{tweak}:{size}:{turn}:{word}".encode()
            add = int.from_bytes(hashlib.blake2b(seed, key=key, digest_size=32).digest(), "big")
            if turn % 2:
                right = (right + add) % b
            else:
                left = (left + add) % a
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """Check digit that follows these digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    source = iter(digits)
    return _DIGITS.sub(lambda _: next(source), pattern)


def _email(value: str, key: bytes) -> str | None:
    """Letters and digits, but those of the top-level domain, are permuted together, in a name of over
    ``EMAIL`` characters in pieces of so many."""
    name, _, top = value.rpartition(".")
    pieces = [name[i : i + EMAIL] for i in range(0, len(name), EMAIL)]
    made = [_email_piece(piece, key, f"email{i or ''}") for i, piece in enumerate(pieces)]
    return "".join(made) + "." + top


def _email_piece(name: str, key: bytes, tweak: str) -> str:
    kinds = [10 if c.isdigit() else 26 if c.isalpha() else 0 for c in name]
    number, size = 0, 1
    for c, n in zip(name.lower(), kinds, strict=True):
        if n:
            number, size = number * n + (ord(c) - (48 if n == 10 else 97)), size * n
    number, out = permute(number, size, key, tweak), []
    for c, n in zip(reversed(name), reversed(kinds), strict=True):
        if n:
            number, d = divmod(number, n)
            made = chr(d + (48 if n == 10 else 97))
            c = made.upper() if c.isupper() else made
        out.append(c)
    return "".join(reversed(out))


def _card(value: str, key: bytes) -> str | None:
    digits = "".join(_DIGITS.findall(value))
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body, size = int(digits[:-1]), 10**n
    while True:
        body = permute(body, size, key, "card")
        made = f"{body:0{n}d}"
        made += str(luhn(made))
        if len(set(made)) > 1:  # cycle-walk past the values that the check refuses
            return _refill(value, made)


def _iban_check(body: str, country: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(value: str, key: bytes) -> str | None:
    flat = value.replace(" ", "")
    country, check, body = flat[:2], flat[2:4], flat[4:]
    if not 11 <= len(body) <= 30 or _iban_check(body, country) != int(check):
        return None
    number, size = 0, 1
    for c in body:
        n = 10 if c.isdigit() else 26
        number, size = number * n + (int(c) if n == 10 else ord(c) - 65), size * n
    number, out = permute(number, size, key, "iban" + country), []
    for c in reversed(body):
        number, d = divmod(number, 10 if c.isdigit() else 26)
        out.append(str(d) if c.isdigit() else chr(65 + d))
    made = "".join(reversed(out))
    source = iter(f"{country}{_iban_check(made, country):02d}{made}")
    return "".join(c if c == " " else next(source) for c in value)


def _date(value: str, key: bytes) -> str | None:
    """Year first with hyphens; else month first if that is a date, else day first (days 13 on).

    Days up to 12 and those above are permuted apart, whatever the format: the image can then be read
    in the order of the original.
    """
    a, b, c = re.split(r"[-/.]", value)
    separator = value[len(a)]
    if separator == "-":
        orders = [((int(a), int(b), int(c)), "{0:04d}-{1:02d}-{2:02d}")]
    elif separator == ".":
        orders = [((int(c), int(b), int(a)), "{2:02d}.{1:02d}.{0:04d}")]
    else:
        orders = [
            ((int(c), int(a), int(b)), "{1:02d}/{2:02d}/{0:04d}"),
            ((int(c), int(b), int(a)), "{2:02d}/{1:02d}/{0:04d}"),
        ]
    for parts, form in orders:
        try:
            date = datetime.date(*parts)
        except ValueError:
            continue
        day = date.toordinal() - FIRST_DAY
        if not 0 <= day < DAYS:
            return None
        while True:  # in all formats alike, so that equal dates stay equal
            day = permute(day, DAYS, key, "date")
            made = datetime.date.fromordinal(day + FIRST_DAY)
            if (made.day > 12) == (date.day > 12):
                return form.format(made.year, made.month, made.day)
    return None


def _ip(value: str, key: bytes) -> str | None:
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255:
        return None
    number = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, number.to_bytes(4, "big")))


def _ssn_valid(digits: str) -> bool:
    area, group, serial = digits[:3], digits[3:5], digits[5:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ssn(value: str, key: bytes) -> str | None:
    digits = value.replace("-", "")
    if not _ssn_valid(digits):
        return None
    while True:
        digits = f"{permute(int(digits), 10**9, key, 'ssn'):09d}"
        if _ssn_valid(digits):
            return f"{digits[:3]}-{digits[3:5]}-{digits[5:]}"


def _phone(value: str, key: bytes) -> str | None:
    """The country code stays; all other digits are permuted together.

    Where the code ends is told by its digits, not by what stands between them, so that a number has
    one pseudonym however it is spaced.
    """
    kept = ""
    if value[0] == "+":
        code = "".join(_DIGITS.findall(value))
        length = 1 if code[0] in ONE_DIGIT_CODES else 2 if code[:2] in TWO_DIGIT_CODES else 3
        places = [m.end() for m in _DIGITS.finditer(value)]
        kept = value[: places[length - 1]]
    rest = value[len(kept) :]
    digits = "".join(_DIGITS.findall(rest))
    if not 7 <= len(digits) <= 15:
        return None
    number = permute(int(digits), 10 ** len(digits), key, "phone")
    return kept + _refill(rest, f"{number:0{len(digits)}d}")


_MAKERS: dict[str, Callable[[str, bytes], str | None]] = {
    "email": _email,
    "iban": _iban,
    "card": _card,
    "date": _date,
    "ip": _ip,
    "ssn": _ssn,
    "phone": _phone,
}


@lru_cache(maxsize=20_000)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """Replacement of a value, or None if it fails the check of its kind."""
    return _MAKERS[kind](value, key)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = _local_start(text, at) if domain else at
        if start < at:
            yield start, domain.end()
        at = text.find("@", at + 1)


def _local_start(text: str, at: int) -> int:
    """Where the local part that ends at ``at`` starts: with a letter or digit, as far back as it goes."""
    size = 64
    while True:
        low = max(0, at - size)
        start = at - _LOCAL.match(text[low:at][::-1]).end()
        if start > low or not low:
            break
        size *= 2
    while start < at and text[start] in "._%+-":
        start += 1
    return start


def _spans(kind: str, pattern: re.Pattern, text: str, key: bytes) -> Iterator[tuple[int, int]]:
    """Matches, cut back to the longest valid start where more groups were taken for a part."""
    for match in pattern.finditer(text):
        value = match.group()
        ends = [len(value)]
        if kind in ("card", "iban"):
            ends += [i for i in range(len(value) - 1, 0, -1) if value[i] in " -"]
        for end in ends:
            if pattern.fullmatch(value[:end]) and pseudonym(kind, value[:end], key) is not None:
                yield match.start(), match.start() + end
                break


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and replacement of each value, in order of position."""
    taken: list[tuple[int, int, str, str]] = []

    def add(kind: str, spans: Iterator[tuple[int, int]]) -> None:
        got = []
        for start, end in spans:
            made = pseudonym(kind, text[start:end], key)
            if made is not None:
                got.append((start, end, kind, made))
        merged: list[tuple[int, int, str, str]] = []
        older = iter(taken)
        next_old = next(older, None)
        for span in got:
            while next_old and next_old[1] <= span[0]:
                merged.append(next_old)
                next_old = next(older, None)
            clear_left = not merged or merged[-1][1] <= span[0]
            if clear_left and not (next_old and next_old[0] < span[1]):
                merged.append(span)
        if next_old:
            merged.append(next_old)
        merged.extend(older)
        taken[:] = sorted(merged)

    if "@" in text:
        add("email", _emails(text))
    if _DIGITS.search(text):
        for kind, pattern in _PATTERNS.items():
            add(kind, _spans(kind, pattern, text, key))
    return taken


def pseudonymize_text(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    counts = dict.fromkeys(KINDS, 0)
    out, at = [], 0
    for start, end, kind, made in find(text, key):
        out += [text[at:start], made]
        at = end
        counts[kind] += 1
    return "".join([*out, text[at:]]), counts


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id``, the ``text`` with its pseudonyms and a count ``n_<kind>`` for each kind.

    One row for each row of ``docs``, of which only ``doc_id`` and ``text`` are read.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, "
    schema += ", ".join(f"n_{kind} long" for kind in KINDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts = [], {kind: [] for kind in KINDS}
            for text in batch.column("text").to_pylist():
                made, found = pseudonymize_text(text or "", key)
                texts.append(None if text is None else made)
                for kind in KINDS:
                    counts[kind].append(found[kind])
            columns = [batch.column("doc_id"), pa.array(texts, pa.string())]
            columns += [pa.array(counts[kind], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "text", *(f"n_{kind}" for kind in KINDS)]
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def pseudonymize_rows(docs: DataFrame, key: bytes) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` replaced and, if there, ``n_chars`` anew."""
    plain = docs.withColumn("text", F.col("text").cast("string"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [
                None if t is None else pseudonymize_text(t, key)[0]
                for t in batch.column("text").to_pylist()
            ]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = plain.mapInArrow(work, plain.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(kind))
    return out
