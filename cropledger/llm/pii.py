"""Format-preserving pseudonyms for personal numbers and dates.

Values are found by their format and validated (check digits, social security number rules, calendar; phones by their format
alone). Their digits are permuted by a keyed
Feistel network over all values of the format, so a pseudonym has the format of its value, passes the same validation (a phone number of the number plan stays in it), and
equal values, however they are punctuated, have equal pseudonyms in all documents. Whoever has the key can invert it.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropledger.llm.common import schema_of, text_of

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
DAYS = (LAST_DAY - FIRST_DAY).days + 1
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
KINDS = ("card", "iban", "ssn", "phone", "ip", "email", "date")


class Feistel:
    """A keyed permutation of 0..size-1: halves of base `b` digits, rounds of HMAC-SHA256, and cycle walking."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, x: int, size: int) -> int:
        mac = hmac.digest(self.key, f"{tweak}/{i}/{size}/{x}".encode(), hashlib.sha256)
        return int.from_bytes(mac[:16], "big") % size

    def permute(self, x: int, size: int, tweak: str, fits: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """Walks on until the result is below size and fits; so it permutes the fitting values, if x fits."""
        if size < 2:
            return x
        low = 1
        while low * low < size:
            low += low if low < 1 << 20 else low >> 2
        # The left half counts 0..high-1, the right one 0..low-1.
        high = -(-size // low)
        while True:
            left, right = divmod(x, low)
            for i in (range(ROUNDS) if not back else reversed(range(ROUNDS))):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._round(tweak, i, left, low)) % low
                else:
                    left = (left + sign * self._round(tweak, i, right, high)) % high
            x = left * low + right
            if x < size and fits(x):
                return x


def luhn_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_digits(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country)
    return f"{98 - int(number + '00') % 97:02d}"


def _phone_ok(d: str) -> bool:
    return d[0] in "23456789" and d[3] in "23456789" and not d[1:3] == "11" and not d[4:6] == "11"


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


# Formats of personal values.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-]|\.[0-9]))"
    r"|(?P<ip>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-]))"
    r"|(?P<phone>(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]))"
    r"|(?P<card>(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))"
)


def _refill(value: str, digits: str) -> str:
    """The value with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def digits(self, d: str, tweak: str, ok: Callable[[str], bool] = lambda _: True) -> str:
        n = len(d)
        return f"{self.feistel.permute(int(d), 10**n, f'{tweak}{n}', lambda x: ok(f'{x:0{n}d}')):0{n}d}"

    def _card(self, value: str) -> str | None:
        d = re.sub(r"\D", "", value)
        if luhn_digit(d[:-1]) != int(d[-1]) or not int(d):
            return None
        body = self.digits(d[:-1], "card", lambda x: int(x) > 0)
        return _refill(value, body + str(luhn_digit(body)))

    def _iban(self, value: str) -> str | None:
        v = value.replace(" ", "")
        country, check, body = v[:2], v[2:4], v[4:]
        if not 11 <= len(body) <= 30 or _iban_digits(country, body) != check:
            return None
        # Letters stay, digits are permuted.
        old = re.sub(r"\D", "", body)
        body = _refill(body, self.digits(old, "iban" + country)) if old else body
        it = iter(country + _iban_digits(country, body) + body)
        return "".join(" " if c == " " else next(it) for c in value)

    def _ssn(self, value: str) -> str | None:
        d = value.replace("-", "")
        return _refill(value, self.digits(d, "ssn", _ssn_ok)) if _ssn_ok(d) else None

    def _phone(self, value: str) -> str:
        d = re.sub(r"\D", "", value)
        own = d[-10:]
        # Numbers of the plan stay in it, and the others outside: whatever has the format is somebody's number.
        planned = _phone_ok(own)
        return _refill(value, d[:-10] + self.digits(own, "phone", lambda x: _phone_ok(x) == planned))

    def _ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self.feistel.permute(x, 2**32, "ip").to_bytes(4, "big")))

    def _email(self, value: str) -> str | None:
        """Letters and digits before the @ are permuted as one word, upper and lower case alike; the domain stays."""
        name, domain = value.lower().split("@")
        word = [c for c in name if c in LETTERS]
        x = 0
        for c in word:
            x = x * 36 + LETTERS.index(c)
        x = self.feistel.permute(x, 36 ** len(word), f"email{len(word)}@{domain}")
        out = []
        for _ in word:
            x, r = divmod(x, 36)
            out.append(LETTERS[r])
        it = iter(reversed(out))
        return "".join(next(it) if c in LETTERS else c for c in name) + value[len(name):]

    def _date(self, value: str) -> str | None:
        mark = re.search(r"\D", value)[0]
        a, b, c = value.split(mark)
        order = "ymd" if len(a) == 4 else "dmy" if mark == "." or int(a) > 12 else "mdy"
        at = dict(zip(order, map(int, (a, b, c))))
        try:
            day = datetime.date(at["y"], at["m"], at["d"])
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # Within dates that read the same way: where day and month can be told apart only by the order, the order stays.
        ok = (lambda x: (FIRST_DAY + datetime.timedelta(x)).day <= 12) if order == "mdy" and int(b) <= 12 else (
            (lambda x: (FIRST_DAY + datetime.timedelta(x)).day > 12) if mark == "/" and order != "ymd" else lambda x: True)
        new = FIRST_DAY + datetime.timedelta(self.feistel.permute((day - FIRST_DAY).days, DAYS, "date", ok))
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return mark.join(parts[k] for k in order)

    def of(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None for a value that is not valid."""
        key = (kind, value)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = getattr(self, f"_{kind}")(value)
        return self.known[key]

    def replace(self, text: str) -> tuple[str, list[int], list[int]]:
        """The text with pseudonyms, how many of each kind, and [first, end) characters of the replaced values."""
        counts, spans, out, at = [0] * len(KINDS), [], [], 0
        m = PATTERN.search(text)
        while m:
            kind, value = m.lastgroup, m[0]
            new = self.of(kind, value)
            if new is None:
                # Not valid: another format may still begin inside it.
                m = PATTERN.search(text, m.start() + 1)
                continue
            counts[KINDS.index(kind)] += 1
            spans += [m.start(), m.end()]
            out += [text[at:m.start()], new]
            at = m.end()
            m = PATTERN.search(text, at)
        return "".join([*out, text[at:]]), counts, spans


def pseudonymise(docs: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, text with pseudonyms, n_<kind> for each kind, and spans of the replaced values in the old text.

    Null and empty texts come out empty. Documents stay where they are; equal values meet through the key alone.
    """
    keep = keep or ["doc_id"]
    source = docs.select(*keep, text_of().alias("_text"))
    more = "text string, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", spans array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Pseudonyms(key.encode())
        for b in batches:
            done = [p.replace(t) for t in b["_text"]]
            yield b[keep].assign(text=[d[0] for d in done], **{f"n_{k}": [d[1][i] for d in done] for i, k in enumerate(KINDS)}, spans=[d[2] for d in done])

    return source.mapInPandas(run, schema_of(source, keep, more))


def op6_pseudonyms(docs: DataFrame, key: str = "example key: a deployment passes its own") -> DataFrame:
    """doc_id, text and the number of values replaced of each kind. Null and empty texts give empty ones, long texts count whole,
    repeated rows and null ids get their result like others; an empty table gives an empty result."""
    return pseudonymise(docs, key).drop("spans")
