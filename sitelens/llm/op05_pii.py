"""Format-preserving pseudonyms: values that validate are permuted within their format by a keyed Feistel network.

Equal values have equal pseudonyms in every document, so records stay linked; other values never share one, for each
network is a permutation of the format's valid values (where the network's domain is larger, it is walked until it is
inside). Check digits are computed anew. Without the key a pseudonym tells nothing but its format.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY = datetime.date(1900, 1, 1)
DAYS = (datetime.date(2100, 1, 1) - FIRST_DAY).days
#: Lengths of account numbers by country, for the commoner countries. Fixed values.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26}


class Feistel:
    """Keyed permutations of range(n), each with a tweak of its own."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tweak: str, i: int, half: int, size: int) -> int:
        said = f"{tweak}|{i}|{half}".encode()
        # sixteen bytes more than the range has, so that the remainder is even
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=min(64, (size.bit_length() + 7) // 8 + 16)).digest(), "big") % size

    def permute(self, value: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return value
        a_size = 1 << ((n - 1).bit_length() // 2)
        b_size = -(-n // a_size)
        while True:  # walked until it is inside; the way is a part of a cycle, so this ends
            a, b = value % a_size, value // a_size
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    b = (b + sign * self._f(tweak, i, a, b_size)) % b_size
                else:
                    a = (a + sign * self._f(tweak, i, b, a_size)) % a_size
            value = b * a_size + a
            if value < n:
                return value

    def mixed(self, digits: list[int], sizes: list[int], tweak: str, back: bool = False) -> list[int]:
        """A permutation of tuples of digits, each below its size."""
        value = n = 0
        n = 1
        for d, s in zip(digits, sizes, strict=True):
            value, n = value * s + d, n * s
        value = self.permute(value, n, f"{tweak}:{n}", back)
        out = []
        for s in reversed(sizes):
            value, d = divmod(value, s)
            out.append(d)
        return out[::-1]


def luhn(digits: list[int]) -> int:
    """The check digit of a payload."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def _put(shape: str, digits: list[int]) -> str:
    """``shape`` with its digits replaced in order."""
    to = iter(digits)
    return "".join(str(next(to)) if c.isdigit() else c for c in shape)


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c.isdigit()]


def card(text: str, net: Feistel, back: bool = False) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != d[-1] or d[0] not in (2, 3, 4, 5, 6):
        return None
    payload = [d[0], *net.mixed(d[1:-1], [10] * (len(d) - 2), f"card{d[0]}", back)]
    return _put(text, [*payload, luhn(payload)])


def phone(text: str, net: Feistel, back: bool = False) -> str | None:
    d = _digits(text)
    head = []
    if text.startswith("+"):
        if d[0] != 1:  # another country: its first two digits stay
            if not 8 <= len(d) <= 15:
                return None
            return _put(text, [*d[:2], *net.mixed(d[2:], [10] * (len(d) - 2), f"phone{d[:2]}", back)])
        head, d = d[:1], d[1:]
    elif len(d) == 11 and d[0] == 1:
        head, d = d[:1], d[1:]
    if len(d) != 10:
        return None
    if d[0] < 2 or d[3] < 2:  # no such area or exchange: a number all the same where +1 or parentheses mark it, in a class of its own
        if not head and "(" not in text:
            return None
        while True:
            d = net.mixed(d, [10] * 10, "phone1 odd", back)
            if d[0] < 2 or d[3] < 2:
                return _put(text, [*head, *d])
    sizes = [8, 10, 10, 8, *[10] * 6]
    out = net.mixed([d[0] - 2, *d[1:3], d[3] - 2, *d[4:]], sizes, "phone1", back)
    return _put(text, [*head, out[0] + 2, *out[1:3], out[3] + 2, *out[4:]])


def ssn(text: str, net: Feistel, back: bool = False) -> str | None:
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if not area or area == 666 or area >= 900 or not group or not serial:
        return None
    out = net.mixed([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn", back)
    area = out[0] + 1
    return f"{area + (area >= 666):03d}{text[3]}{out[1] + 1:02d}{text[6]}{out[2] + 1:04d}"


def ipv4(text: str, net: Feistel, back: bool = False) -> str | None:
    d = [int(x) for x in text.split(".")]
    if any(x > 255 for x in d) or not 1 <= d[0] <= 223 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    out = net.mixed([d[0] - 1, *d[1:]], [223, 256, 256, 256], "ipv4", back)
    return ".".join(map(str, [out[0] + 1, *out[1:]]))


def iban(text: str, net: Feistel, back: bool = False) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if len(plain) != IBAN_LENGTHS.get(plain[:2], 0) or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = plain[4:]
    sizes = [10 if c.isdigit() else 26 for c in body]
    out = net.mixed([int(c) if c.isdigit() else ord(c) - 65 for c in body], sizes, f"iban{plain[:2]}{sizes}", back)
    body = "".join(str(x) if s == 10 else chr(65 + x) for x, s in zip(out, sizes, strict=True))
    check = 98 - number(f"{body}{plain[:2]}00") % 97
    to = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(to) for c in text)


def date(text: str, net: Feistel, back: bool = False) -> str | None:
    parts = re.split(r"([-/.])", text)
    numbers = [int(x) for x in parts[::2]]
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    elif parts[1] == "." or numbers[0] > 12:
        order = (2, 1, 0)
    else:
        order = (2, 0, 1)
    try:
        day = (datetime.date(*(numbers[i] for i in order)) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= day < DAYS or parts[1] != parts[3]:
        return None
    # a date with slashes whose day may be read as a month keeps to such days, for it is read back so
    monthly = parts[1] == "/" and order != (0, 1, 2)
    while True:
        day = net.permute(day, DAYS, "date", back)
        new = FIRST_DAY + datetime.timedelta(day)
        if not monthly or order == (2, 0, 1) or new.day > 12:
            break
    pad = 1 if any(len(x) == 1 for x in parts[::2]) else 2
    for i, x in zip(order, (new.year, new.month, new.day), strict=True):
        parts[2 * i] = str(x).zfill(4 if i == order[0] else pad)
    return "".join(parts)


def _letters(text: str, net: Feistel, tweak: str, back: bool) -> str:
    """Letters and digits permuted within their classes; other characters stay."""
    classes = [(48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else None for c in text]
    own = [(ord(c) - k[0], k[1]) for c, k in zip(text, classes, strict=True) if k]
    out = iter(net.mixed([d for d, _ in own], [s for _, s in own], f"{tweak}{[s for _, s in own]}", back))
    return "".join(chr(k[0] + next(out)) if k else c for c, k in zip(text, classes, strict=True))


def email(text: str, net: Feistel, back: bool = False) -> str | None:
    name, _, host = text.rpartition("@")
    return f"{_letters(name, net, f'email@{host.lower()}', back)}@{host}"


def secret(text: str, net: Feistel, back: bool = False) -> str | None:
    """A key or password behind its label: hexadecimal digits within their own, others within their classes."""
    at = re.search(r"[A-Za-z0-9+/_\-]+\"?$", text).start() if not text.startswith("AKIA") else 4
    head, value = text[:at], text[at:]
    core = value.rstrip('"')
    if re.fullmatch(r"[0-9a-f]+", core):
        core = "".join(f"{x:x}" for x in net.mixed([int(c, 16) for c in core], [16] * len(core), "hex", back))
    elif head == "AKIA":
        signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        core = "".join(signs[x] for x in net.mixed([signs.index(c) for c in core], [36] * len(core), "akia", back))
    else:
        core = _letters(core, net, "secret", back)
    return head + core + value[len(value.rstrip('"')) :]


KINDS: dict[str, tuple[str, Callable[..., str | None]]] = {
    "email": (r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w])", email),
    "secret": (r"\bAKIA[A-Z0-9]{16}\b|(?i:\b(?:password|passwd|pwd|token|secret|api_?key)\b[ \t]*[=:][ \t]*\"?)[A-Za-z0-9+/_\-]{8,}\"?", secret),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    "date": (r"(?<![\w/.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\w/-]|\.\d)", date),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    "ipv4": (r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", ipv4),
    "phone": (r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![\w-])|(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])|(?:1[ .-]?)?\(\d{3}\)[ .-]?)\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?![\w])", phone),
    "card": (r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)", card),
}
ANY = re.compile("|".join(f"(?P<{name}>{re.sub(r'(?<![?(])\\([12])', r'\\\1', pattern)})" for name, (pattern, _) in KINDS.items()).replace(r"([-/.])\d{1,2}\1", r"(?P<sep1>[-/.])\d{1,2}(?P=sep1)").replace(r"([-/.])\d{1,2}\2", r"(?P<sep2>[-/.])\d{1,2}(?P=sep2)"))


def replace(text: str, net: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in the new text."""
    out, found, at, size = [], [], 0, 0
    pos = 0
    while m := ANY.search(text, pos):
        kind = next(k for k in KINDS if m[k] is not None)
        new = KINDS[kind][1](m[0], net, back)
        if new is None:  # not valid: it stays, and what begins inside of it is looked at
            pos = m.start() + 1
            while pos < len(text) and text[pos].isalnum() and text[pos - 1].isalnum():
                pos += 1
            continue
        out.append(text[at : m.start()])
        size += m.start() - at
        found.append((kind, size, len(new)))
        out.append(new)
        size += len(new)
        at = pos = m.end()
    return "".join([*out, text[at:]]), found


def _replace_rows(key: bytes, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Feistel(key)
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            texts, spans = [], []
            for x in batch.column(1):
                text, found = replace(x.as_py(), net, back)
                texts.append(text)
                spans.append([{"kind": k, "start": s, "length": n} for k, s, n in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))], ["doc_id", "text", "found"])

    return run


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """Documents that hold values to replace: ``doc_id``, ``text`` with pseudonyms, ``found`` (kind, start, length in it).

    Cards (with a right check digit), phone numbers, social security numbers, IPv4 addresses, account numbers (IBAN with
    right check digits), calendar dates from 1900 to 2099, e-mail names and labelled secrets. Numbers that don't validate
    stay, among them ten digits whose area code or exchange begins with 0 or 1, unless +1 or parentheses mark a telephone number. ``back`` undoes it with the same key. Null and empty texts, and texts without such a value, give no row;
    repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    held = docs.select("doc_id", text.alias("text")).where(F.col("text").rlike("[0-9@]|(?i)password|passwd|pwd|token|secret|api_?key"))
    return held.mapInArrow(_replace_rows(key, back), f"doc_id {kind}, text string, found array<struct<kind:string,start:long,length:long>>").where(F.size("found") > 0)
