"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Found and validated: payment cards (Luhn), IBANs (mod 97), US social security
numbers (issued ranges), phone numbers, IPv4 and IPv6 addresses, calendar dates,
e-mail addresses and credentials. Each value's place among all values of its format
is permuted by a Feistel network under the key, so the pseudonym is another valid
value of that format and of the same length, equal values stay equal in all
documents, and whoever holds the key can go back. No value maps to itself.

Dates are days of the calendar from year 1 to 9999 with a year of four digits, in
any usual order, or month, day and a year of two digits between slashes; days of
1900 to 2099 stay among themselves. Ten digits alone are a phone number if area
and exchange may be North American ones. An IPv6 address has three groups at least.

Map only: one scan, no shuffle. Texts without a digit, ``@`` or ``=`` pass
through untouched, as whole Arrow buffers.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foliant.llm.text import slices

_ROUNDS = 8
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Years of which dates are permuted among themselves; two digits are years from 1950.
_YEARS = {"near": [(1900, 2099)], "far": [(1, 1899), (2100, 9999)], "short": [(1950, 2049)]}


class Feistel:
    """A keyed permutation of range(n) for any n, without fixed points."""

    def __init__(self, key: bytes, kind: str, n: int) -> None:
        self.n = n
        self.a = math.isqrt(max(n - 1, 0)) + 1
        self.b = -(-n // self.a)
        self._key = hashlib.blake2b(key, digest_size=32, person=kind.encode()[:16]).digest()
        self._salt = n.to_bytes((n.bit_length() + 7) // 8 or 1, "big")
        self.shift = 1 + self._f(255, n) % (n - 1) if n > 1 else 0

    def _f(self, i: int, x: int) -> int:
        data = bytes([i]) + len(self._salt).to_bytes(2, "big") + self._salt + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self._key, digest_size=32).digest(), "big")

    def _walk(self, x: int, back: bool) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
                if i % 2:
                    right = (right + (-1 if back else 1) * self._f(i, left)) % self.b
                else:
                    left = (left + (-1 if back else 1) * self._f(i, right)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def permute(self, x: int, back: bool = False) -> int:
        """The inverse of E, a shift, then E: every x moves, and back undoes it."""
        if self.n < 2:
            return x
        y = (self._walk(x, False) + (-self.shift if back else self.shift)) % self.n
        return self._walk(y, True)


@lru_cache(maxsize=4096)
def _feistel(key: bytes, kind: str, n: int) -> Feistel:
    return Feistel(key, kind, n)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if "0" <= c <= "9" else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


Move = Callable[[str, int, int], int]


def _card(text: str, move: Move) -> str | None:
    d = _digits(text)
    if not luhn(d) or len(set(d)) == 1:
        return None
    body = len(d) - 1
    # all numbers of that length are ranked, but for those of a single digit
    new = f"{move(f'card{len(d)}', 10**body, int(d[:-1])):0{body}d}"
    return _refill(text, new + next(c for c in "0123456789" if luhn(new + c)))


def _ssn(text: str, move: Move) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(move("ssn", 898 * 99 * 9999, place), 9999)
    area, group = divmod(rest, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, move: Move) -> str | None:
    d = _digits(text)
    if not 10 <= len(d) <= 15:
        return None
    code = 0
    if text.startswith("+"):
        code = len(_digits(re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", text).group()))
    n = len(d) - code
    return _refill(text, d[:code] + f"{move(f'phone{n}', 10**n, int(d[code:])):0{n}d}")


def _ip(text: str, move: Move) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    low, count = zip(*(((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts))
    place = 0
    for p, a, n in zip(parts, low, count):
        place = place * n + int(p) - a
    place = move("ip" + "".join(str(len(p)) for p in parts), math.prod(count), place)
    out: list[str] = []
    for a, n in zip(reversed(low), reversed(count)):
        place, r = divmod(place, n)
        out.insert(0, str(r + a))
    return ".".join(out)


class _Calendar:
    """The days of some years of which month and day pass a test, by number."""

    def __init__(self, years: str, fits: Callable[[int, int], bool]) -> None:
        every = [datetime.date(y, 1, 1) + datetime.timedelta(k) for y, n in ((2001, 365), (2004, 366)) for k in range(n)]
        self.days = [[(d.month, d.day) for d in every if d.year == y and fits(d.month, d.day)] for y in (2001, 2004)]
        self.place = [{d: k for k, d in enumerate(days)} for days in self.days]
        self.years = [y for low, high in _YEARS[years] for y in range(low, high + 1)]
        self.at = {y: k for k, y in enumerate(self.years)}
        self.before = [0]
        for y in self.years:
            self.before.append(self.before[-1] + len(self.days[self._leap(y)]))

    @staticmethod
    def _leap(year: int) -> bool:
        return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)

    def moved(self, kind: str, year: int, month: int, day: int, move: Move) -> tuple[int, int, int] | None:
        """Another day; none if this isn't one of them."""
        own = self.place[self._leap(year)].get((month, day)) if year in self.at else None
        if own is None:
            return None
        new = move(f"date {kind}", self.before[-1], self.before[self.at[year]] + own)
        k = bisect.bisect_right(self.before, new) - 1
        return self.years[k], *self.days[self._leap(self.years[k])][new - self.before[k]]


@lru_cache(maxsize=256)
def _calendar(years: str, month: int, day: int, first: int) -> _Calendar:
    """Days with a month of so many digits at most, a day likewise and from ``first`` on."""
    return _Calendar(years, lambda m, d: m < 10**month and first <= d < 10**day)


@lru_cache(maxsize=256)
def _calendar_of_names(years: str, name: int, day: int) -> _Calendar:
    return _Calendar(years, lambda m, d: len(_MONTHS[m - 1]) == name and len(str(d)) == day)


def _date(text: str, move: Move) -> str | None:
    a, b, c = parts = re.split(r"[-/.]", text)
    first = 1
    if len(a) == 4:
        order = (0, 1, 2)
    elif "/" in text and int(a) <= 12:  # month first where that is a date
        order = (2, 0, 1)
    else:
        order, first = (2, 1, 0), 13 if "/" in text else 1
    year, month, day = (parts[k] for k in order)
    number = int(year)
    years = "near" if 1900 <= number <= 2099 else "far"
    if len(year) == 2:
        years, number = "short", number + (1900 if number >= 50 else 2000)
    kind = f"{years}-{len(month)}-{len(day)}-{first}"
    new = _calendar(years, len(month), len(day), first).moved(kind, number, int(month), int(day), move)
    if new is None:
        return None
    out = dict(zip(order, (f"{new[0] % 10 ** len(year):0{len(year)}d}", f"{new[1]:0{len(month)}d}", f"{new[2]:0{len(day)}d}")))
    return f"{out[0]}{text[len(a)]}{out[1]}{text[len(a)]}{out[2]}"


def _named(text: str, move: Move) -> str | None:
    name = re.search(r"[A-Za-z]+", text).group()
    numbers = re.findall(r"\d+", text)
    month = [x.lower() for x in _MONTHS].index(name.lower()) + 1
    day, year = numbers[0], int(numbers[1])
    years, length = "near" if 1900 <= year <= 2099 else "far", len(day.lstrip("0") or "0")
    new = _calendar_of_names(years, len(name), length).moved(f"{years}-month-{len(name)}-{length}", year, month, int(day), move)
    if new is None:
        return None
    title = _MONTHS[new[1] - 1]
    title = title.upper() if name.isupper() else title.lower() if name.islower() else title
    out = iter([f"{new[2]:0{len(day)}d}", f"{new[0]:04d}"])
    return re.sub(r"[A-Za-z]+|\d+", lambda m: title if m.group()[0].isalpha() else next(out), text)


def _classes(text: str, kind: str, move: Move, letters: int = 26) -> str:
    """Digits and the first letters permuted together, each within its class; case stays."""
    sizes = [10 if "0" <= c <= "9" else letters if "a" <= c.lower() < chr(97 + letters) else 1 for c in text]
    place = 0
    for c, n in zip(text, sizes):
        place = place * n + (0 if n == 1 else int(c) if n == 10 else ord(c.lower()) - 97)
    shape = "".join("9" if n == 10 else "a" if n == letters else c for c, n in zip(text, sizes))
    place = move(f"{kind}{hashlib.blake2b(shape.encode(), digest_size=5).hexdigest()}", math.prod(sizes), place)
    out = []
    for c, n in zip(reversed(text), reversed(sizes)):
        place, r = divmod(place, n)
        out.append(c if n == 1 else str(r) if n == 10 else chr(97 + r).upper() if c.isupper() else chr(97 + r))
    return "".join(reversed(out))


def _email(text: str, move: Move) -> str:
    local, _, domain = text.rpartition("@")
    if re.search("[A-Za-z0-9]", local):
        return f"{_classes(local, 'mail', move)}@{domain}"
    host, _, top = domain.rpartition(".")
    return f"{local}@{_classes(host, 'host', move)}.{top}"


def _iban(text: str, move: Move) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return None

    def number(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s))

    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _classes(plain[4:], "iban", move)
    new = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body
    rest = iter(new)
    return "".join(c if c == " " else next(rest) for c in text)


def _credential(text: str, move: Move) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return _classes(text, "hex", move, 6)
    return _classes(text, "secret", move)


def _ip6(text: str, move: Move) -> str | None:
    groups = [g for g in text.split(":") if g]
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return _classes(text, "ip6", move, 6) if len(groups) > 2 and re.search("[0-9]", text) else None


def _north(text: str, move: Move) -> str | None:
    """Ten digits of which the first and the fourth are 2 at least."""
    area, exchange, line = int(text[:3]) - 200, int(text[3:6]) - 200, int(text[6:])
    if area < 0 or exchange < 0:
        return None
    rest, line = divmod(move("north", 800 * 800 * 10_000, (area * 800 + exchange) * 10_000 + line), 10_000)
    area, exchange = divmod(rest, 800)
    return f"{area + 200}{exchange + 200}{line:04d}"


_KINDS: list[tuple[str, str, Callable[[str, Move], str | None]]] = [
    ("email", r"(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _email),
    ("secret", r"(?i:(?<![^\W_])(?:token|password|passwd|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{12,})", _credential),
    ("access", r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)", lambda text, move: text[:4] + _classes(text[4:], "access", move)),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)", _iban),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2})(?![0-9]|[./-][0-9])", _date),
    ("named", r"(?<!\w)(?:(?i:{m}) [0-9]{1,2}, [0-9]{4}|[0-9]{1,2} (?i:{m}) [0-9]{4})(?!\w)".replace("{m}", "|".join(_MONTHS)), _named),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    ("ip6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])", _ip6),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])", _card),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?!\w)", _phone),
    ("compact", r"(?<![\w+])\+[0-9]{10,15}(?![0-9])", _phone),
    ("north", r"(?<![\w.,+/-])[2-9][0-9]{2}[2-9][0-9]{6}(?![\w/-]|[.,][0-9])", _north),
]
_FIND = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in _KINDS))
_DO = {name: do for name, _, do in _KINDS}


def pseudonymise_text(text: str, key: bytes, back: bool = False) -> str:
    def move(kind: str, n: int, x: int) -> int:
        return _feistel(key, kind, n).permute(x, back)

    def new(m: re.Match[str]) -> str:
        kind, whole = next(k for k in _DO if m.group(k) is not None), m.group()
        if kind == "secret":
            value = m.group("value")
            return whole[: -len(value)] + _credential(value, move)
        out = _DO[kind](whole, move)
        return whole if out is None else out

    return _FIND.sub(new, text)


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False) -> DataFrame:
    """docs with the personal data in whole texts replaced; lengths stay.

    All columns and rows stay as they are but for the text, whatever their names. A
    null or empty text stays; repeated rows give equal results; long texts are read
    whole; null ids stay; an empty table stays empty. Numbers that fail their check
    (Luhn, mod 97, unissued or impossible) are no personal data and stay. ``back``
    undoes it under the same key, which is to be kept secret.
    """
    k = [c.lower() for c in docs.columns].index(text_col.lower())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, k):
                texts = batch.column(k)
                may = pc.fill_null(pc.match_substring_regex(texts, "[0-9@=:]"), False)
                if pc.any(may).as_py():
                    mask = may.to_numpy(zero_copy_only=False)
                    new = [pseudonymise_text(t, key, back) for t in texts.filter(may).to_pylist()]
                    changed = pc.replace_with_mask(texts, pa.array(np.asarray(mask)), pa.array(new, type=texts.type))
                    batch = batch.set_column(k, batch.schema.field(k), changed)
                yield batch

    return docs.mapInArrow(rows, docs.schema)
