"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers (cards, phones, social security numbers, IP addresses, IBANs), dates, e-mail addresses and secrets are found
by pattern and validated; their digits, letters or days are permuted by a Feistel network under a key, inside their
own format: separators, case, lengths and leading zeros stay, card and account numbers keep whether their checksum holds,
octets stay octets, days stay days of their part of the calendar (before 1900, 1900 to 2099, later). Equal values get
equal pseudonyms in every document, and different ones different. Letters outside A-Z and Latin-1 stay.

Defined results: a null text stays null, an empty one empty. Texts are scanned whole. What fails validation as one
kind may still be another (a date-like group of digits in a long number is part of the number). Repeated rows give
repeated results; an empty table gives none. Extra columns are carried through by pseudonymise().
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

ROUNDS = 10
DEFAULT_KEY = b"replace this key in production"
#: Days stay in their part of the calendar: (first, after the last) as ordinals.
_ERAS = [tuple(datetime.date(y, 1, 1).toordinal() for y in span) for span in ((1000, 1900), (1900, 2100), (2100, 9999))]

_NUMBERS = re.compile(
    r"""(?<![\w])(?:
      (?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})
    | (?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?!\.\d)
    | (?P<ip6>(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})(?!:)
    | (?P<ssn>\d{3}-\d{2}-\d{4})
    | (?P<phone>\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ -]?\(?\d{1,4}\)?(?:[ -]?\d{2,4}){2,4}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})
    | (?P<secret>[0-9a-fA-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,})
    | (?P<iban>[A-Z]{2}\d{2}[ ]?(?:[0-9A-Z]{4}[ ]?){2,7}[0-9A-Z]{1,4})
    | (?P<card>\d(?:[ -]?\d){12,18})
    )(?!\w)""",
    re.X,
)
#: Holds in every text that has an address or a match of _NUMBERS; \d takes all decimal digits, as there.
_QUICK = re.compile(r"\d[\d.]|:[0-9a-fA-F]{1,4}:|@|[0-9a-fA-F]{32}|sk-|gh[pousr]_|AKIA|ASIA|\+\d|\d[ -]\d")
_LOCAL = re.compile(r"[\w.+%-]+\Z")
_HOST = re.compile(r"(?:[\w-]+\.)+[A-Za-z]{2,}")


class Feistel:
    """Permutations of numbers and of strings under one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.digits = lru_cache(50_000)(self._digits)

    def _f(self, kind: str, n: int, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{kind}|{n}|{i}|{x}".encode(), key=self.key, digest_size=32).digest(), "big")

    def _digits(self, kind: str, radix: int, value: int, length: int) -> int:
        """A permutation of the numbers of length digits in radix."""
        if length == 1:
            return (value + self._f(kind, 1, 0, 0) % (radix - 1) + 1) % radix
        u = length // 2
        v = length - u
        a, b = divmod(value, radix**v)
        for i in range(ROUNDS):
            m = radix ** (u if i % 2 == 0 else v)
            a, b = b, (a + self._f(kind, length, i, b)) % m
        return a * radix ** (v if ROUNDS % 2 == 0 else u) + b

    def below(self, kind: str, value: int, n: int) -> int:
        """A permutation of the numbers below n: walks the cycle until it is back inside."""
        length = len(str(n - 1))
        while True:
            value = self.digits(kind, 10, value, length)
            if value < n:
                return value

    def string(self, kind: str, text: str, alphabet: str) -> str:
        """A permutation of the strings of one length over an alphabet."""
        radix, value = len(alphabet), 0
        for c in text:
            value = value * radix + alphabet.index(c)
        value = self.digits(kind, radix, value, len(text))
        out = []
        for _ in text:
            value, r = divmod(value, radix)
            out.append(alphabet[r])
        return "".join(reversed(out))


_ACCENTS = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
_LOWER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _fill(pattern: str, chosen, new: str) -> str:
    """pattern with the characters that chosen holds replaced by those of new, in order; case stays."""
    it = iter(new)
    out = []
    for c in pattern:
        if chosen(c):
            n = next(it)
            out.append(n.upper() if c.isupper() else n)
        else:
            out.append(c)
    return "".join(out)


def _is_digit(c: str) -> bool:
    return c in _DIGITS


def _mixed(f: Feistel, kind: str, text: str) -> str:
    """Digits, letters of A-Z and accented ones of Latin-1 each permuted among their own kind; other characters stay."""
    for part, alphabet in (("", _LOWER), ("accents", _ACCENTS), ("digits", _DIGITS)):
        chosen = lambda c: len(c.lower()) == 1 and c.lower() in alphabet and c.lower().upper() in (c, c.upper())  # noqa: B023, E731
        own = "".join(c.lower() for c in text if chosen(c))
        if own:
            text = _fill(text, chosen, f.string(kind + part, own, alphabet))
    return text


def _card(f: Feistel, text: str) -> str:
    digits = "".join(filter(_is_digit, text))
    valid, lead = luhn(digits), digits[0] == "0"
    new = digits
    while True:
        new = f.string("card", new, _DIGITS)
        if luhn(new) == valid and (new[0] == "0") == lead:
            return _fill(text, _is_digit, new)


def _date(f: Feistel, text: str) -> str | None:
    parts = re.split(r"[./-]", text)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else ([(2, 0, 1), (2, 1, 0)] if "/" in text else [(2, 1, 0), (2, 0, 1)])
    for y, m, d in orders:
        try:
            day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal()
        except ValueError:
            continue
        start, stop = next((era for era in _ERAS if era[0] <= day < era[1]), (0, 0))
        # One digit stays one digit, and beside one a second number of two digits has no leading zero.
        short = {k for k in (m, d) if len(parts[k]) == 1}
        while start:
            day = start + f.below("date", day - start, stop - start)
            new = datetime.date.fromordinal(day)
            values = {y: new.year, m: new.month, d: new.day}
            if not short or all((values[k] < 10) == (k in short) for k in (m, d)):
                seps = re.findall(r"[./-]", text)
                shown = [f"{values[k]:0{len(parts[k])}d}" for k in range(3)]
                return f"{shown[0]}{seps[0]}{shown[1]}{seps[1]}{shown[2]}"
    return None


def _iban_rest(bare: str) -> int:
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


def iban_valid(bare: str) -> bool:
    return 2 <= int(bare[2:4]) <= 98 and _iban_rest(bare) == 1


def _iban(f: Feistel, text: str) -> str:
    """Country and form stay; a valid number stays valid, by new check digits, and an invalid one invalid."""
    bare = text.replace(" ", "")
    if iban_valid(bare):
        account = _mixed(f, "iban", bare[4:])
        new = f"{98 - _iban_rest(bare[:2] + '00' + account):02d}{account}"
    else:
        new = _mixed(f, "iban", bare[2:])
        while iban_valid(bare[:2] + new):
            new = _mixed(f, "iban", new)
    return text[:2] + _fill(text[2:], lambda c: c != " ", new)


def _ip6(f: Feistel, text: str) -> str:
    return _fill(text, lambda c: c != ":", f.string("ip6", text.lower().replace(":", ""), _HEX))


def _ip(f: Feistel, text: str) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = f.digits("ip", 256, int.from_bytes(bytes(octets), "big"), 4)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _phone(f: Feistel, text: str) -> str | None:
    digits = "".join(filter(_is_digit, text))
    if not 7 <= len(digits) <= 15:
        return None
    keep = len(re.match(r"\+?(\d{1,3})", text)[1]) if text[0] == "+" else 0
    keep = min(keep, len(digits) - 7)
    return _fill(text, _is_digit, digits[:keep] + f.string("phone", digits[keep:], _DIGITS))


def _secret(f: Feistel, text: str) -> str:
    low = text.lower()
    if all(c in _HEX for c in low):
        new = f.string("hex", low, _HEX)
        return new.upper() if text.upper() == text and any(c in "ABCDEF" for c in text) else new
    head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", text)[0]
    return head + _mixed(f, "key", text[len(head) :])


_KINDS = {
    "date": _date,
    "ip": _ip,
    "ssn": lambda f, t: _fill(t, _is_digit, f.string("ssn", "".join(filter(_is_digit, t)), _DIGITS)),
    "phone": _phone,
    "secret": _secret,
    "iban": _iban,
    "ip6": _ip6,
    "card": _card,
}


def replace(text: str, f: Feistel) -> tuple[str, int]:
    """The text with pseudonyms, and how many."""
    if not _QUICK.search(text):
        return text, 0
    spans: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text, max(0, at - 128), at), _HOST.match(text, at + 1)
        if left and right:
            host = right[0]
            name, _, top = host.rpartition(".")
            spans.append((left.start(), right.end(), f"{_mixed(f, 'local', left[0])}@{_mixed(f, 'host', name)}.{top}"))
        at = text.find("@", at + 1)
    taken = [(s, e) for s, e, _ in spans]
    k = 0
    m = _NUMBERS.search(text)
    while m:
        found, m = m, _NUMBERS.search(text, m.end())
        while k < len(taken) and taken[k][1] <= found.start():
            k += 1
        if k < len(taken) and taken[k][0] < found.end():
            continue
        new = _KINDS[found.lastgroup](f, found[0])
        if new is None:  # not valid as this kind: what begins inside it may be valid
            m = _NUMBERS.search(text, found.start() + 1)
        else:
            spans.append((found.start(), found.end(), new))
    spans.sort()
    out, last, n = [], 0, 0
    for s, e, new in spans:
        if s >= last:
            out += [text[last:s], new]
            last, n = e, n + 1
    return "".join([*out, text[last:]]), n


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, text: str = "text") -> tuple[DataFrame, str]:
    """docs with pseudonyms in its text column, and the name of an added column that counts them."""
    n = fresh(docs, "_replaced")
    place, names = docs.columns.index(text), [*docs.columns, n]

    def run(batches):
        f = Feistel(key)
        for batch in batches:
            done = [(None, 0) if t.as_py() is None else replace(t.as_py(), f) for t in batch.column(place)]
            columns = list(batch.columns)
            columns[place] = pa.array([d[0] for d in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.int64())], names)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes) + f", `{n}` long"
    return docs.mapInArrow(run, schema), n


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, n = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col(n).alias("n_replaced"))
