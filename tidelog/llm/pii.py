"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Found values are validated (check digits, ranges, the calendar) and replaced by a keyed permutation of their own
format: a card number becomes another with a right check digit, a date another date, an address another address.
The permutation is a Feistel network over the format's values, numbered from 0 (HMAC-SHA256 rounds, cycle-walking
to the format's size), so equal values have equal pseudonyms in all documents, different values different ones, and
who has the key can turn them back.  What fails validation stays.

Dates are found with two-digit days and months only, phones in groups of 3-3-4 digits with separators only (a country
code may go before); other forms of either stay in clear.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import mapped, quoted, small_rows

#: The key is passed in, or set in the session under this name; without either, a public key, which anyone can turn
#: back, stands in (tests, examples).
KEY_SETTING, KEY, ROUNDS = "spark.tidelog.pseudonymKey", b"not a secret", 10
_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())
#: Where year, month and day stand.
_DAY_FIRST, _MONTH_FIRST = (2, 1, 0), (2, 0, 1)


class Feistel:
    """A keyed permutation of range(size), different for each kind."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size, self.half = size, max(1, ((size - 1).bit_length() + 1) // 2)
        self.key = hmac.new(key, f"{kind}:{size}".encode(), hashlib.sha256)

    def _round(self, i: int, x: int) -> int:
        h = self.key.copy()
        h.update(i.to_bytes(1) + x.to_bytes((self.half + 7) // 8))
        return int.from_bytes(hashlib.shake_256(h.digest()).digest((self.half + 7) // 8)) & ((1 << self.half) - 1)

    def _once(self, x: int, back: bool) -> int:
        mask = (1 << self.half) - 1
        left, right = x >> self.half, x & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(i, left), left
            else:
                left, right = right, left ^ self._round(i, right)
        return left << self.half | right

    def apply(self, x: int, back: bool = False) -> int:
        """Walks on until the value is in range, at most a few steps on average."""
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x


def _radix(c: str) -> tuple[str, int] | None:
    for letters in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        if c in letters:
            return letters, letters.index(c)
    return None


class Pseudonyms:
    """Functions of a found value, one for each kind; None means that the value is not valid."""

    def __init__(self, key: bytes = KEY, back: bool = False):
        self.key, self.back = key, back
        self.permuted = lru_cache(200_000)(self._permuted)
        self.network = lru_cache(1000)(lambda kind, size: Feistel(key, kind, size))

    def _permuted(self, kind: str, x: int, size: int) -> int:
        return self.network(kind, size).apply(x, self.back)

    def characters(self, kind: str, s: str) -> str:
        """Digits to digits, small letters to small letters, capitals to capitals; all else stays."""
        places = [(i, *r) for i, c in enumerate(s) if (r := _radix(c))]
        x, size = 0, 1
        for _, letters, at in places:
            x, size = x * len(letters) + at, size * len(letters)
        if size == 1:
            return s
        x, out = self.permuted(kind, x, size), list(s)
        for i, letters, _ in reversed(places):
            x, at = divmod(x, len(letters))
            out[i] = letters[at]
        return "".join(out)

    def digits(self, kind: str, s: str, skip: int = 0, tail: Callable[[str], str] | None = None) -> str:
        """Permutes the digits of s after the first skip, and before the last if tail makes that from the others."""
        d = "".join(re.findall("[0-9]", s))
        body = d[skip : len(d) - (tail is not None)]
        new = d[:skip] + str(self.permuted(f"{kind}{len(body)}", int(body), 10 ** len(body))).zfill(len(body))
        it = iter(new + (tail(new) if tail else ""))
        return re.sub("[0-9]", lambda _: next(it), s)

    def card(self, s: str) -> str | None:
        d = re.sub("[^0-9]", "", s)
        return self.digits("card", s, tail=luhn_digit) if len(set(d)) > 1 and d[-1] == luhn_digit(d[:-1]) else None

    def iban(self, s: str) -> str | None:
        bare = s.replace(" ", "")
        if not 15 <= len(bare) <= 34 or iban_rest(bare) != 1 or not 2 <= int(bare[2:4]) <= 98:
            return None
        bban = self.characters(f"iban{bare[:2]}", bare[4:])
        new = f"{bare[:2]}{98 - iban_rest(bare[:2] + '00' + bban):02d}{bban}"
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in s)

    def email(self, s: str) -> str:
        local, _, domain = s.rpartition("@")
        return f"{self.characters('email', local)}@{domain}"

    def phone(self, s: str) -> str:
        return self.digits("phone", s, skip=len(re.sub("[^0-9]", "", s)) - 10)

    def address(self, s: str) -> str | None:
        try:
            x = int(ipaddress.IPv4Address(s))
        except ValueError:
            return None
        return str(ipaddress.IPv4Address(self.permuted("ipv4", x, 1 << 32)))

    def ssn(self, s: str) -> str | None:
        def number(d: str) -> int | None:
            area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
            ok = 0 < area < 900 and area != 666 and group and serial
            return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1 if ok else None

        if (x := number(s.replace("-", ""))) is None:
            return None
        x, serial = divmod(self.permuted("ssn", x, 898 * 99 * 9999), 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def date(self, s: str) -> str | None:
        """Years 1900 to 2099, year first or last (then the day before the month, if both are possible).

        A month before the day can only be told if the day is above 12, so such dates walk on to another such date:
        the pseudonym is read in the same order, and no date of the other order has it.
        """
        cut = re.search("[^0-9]", s)[0]
        parts = s.split(cut)
        if len(parts[0]) == 4:
            orders = ((0, 1, 2),)
        else:
            orders = (_DAY_FIRST, _MONTH_FIRST)
        for order in orders:
            try:
                day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
            except ValueError:
                continue
            if _DAYS[0] <= day <= _DAYS[1]:
                new = None
                while new is None or order == _MONTH_FIRST and new.day <= 12:
                    day = _DAYS[0] + self.permuted("date", day - _DAYS[0], _DAYS[1] - _DAYS[0] + 1)
                    new = datetime.date.fromordinal(day)
                out = [""] * 3
                for i, v in zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")):
                    out[i] = v
                return cut.join(out)
        return None


def luhn_digit(d: str) -> str:
    """The check digit that follows these digits."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
    return str(-total % 10)


def iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


#: Patterns in order of precedence; none starts or ends inside a longer number.
KINDS = {
    "email": r"[A-Za-z0-9À-ÖØ-öø-ÿ._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}\b",
    "address": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}(?P<c1>[-/.])[0-9]{2}(?P=c1)[0-9]{2}|[0-9]{2}(?P<c2>[-/.])[0-9]{2}(?P=c2)[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Lengths of IBANs by country (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "KW": 30, "KZ": 20,
    "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: A card in its usual groups (or none), beside groups of other sizes.
_CARD = re.compile(r"(?<![0-9])(?<![0-9]{4}[ -])[0-9]{4}([ -]?)(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{5})(?![0-9])(?![ -][0-9]{4}(?![0-9]))")
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
_HINT = re.compile(r"[0-9@]")


def _parts(kind: str, s: str) -> Iterator[tuple[int, int]]:
    """Which parts of a found run of groups may be the value, the likeliest first; (0, len(s)) is all of it."""
    if kind == "card":
        yield from (m.span() for m in _CARD.finditer(s))
    elif kind == "iban":
        ends = [i + 1 for i, c in enumerate(s) if c != " "]
        n = IBAN_LENGTHS.get(s[:2], 0)
        if 0 < n < len(ends) and s[ends[n - 1]] == " ":
            yield 0, ends[n - 1]
    yield 0, len(s)


def pseudonymize(text: str, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in it.

    Groups of an IBAN or a card may run on into a word or number that follows or goes before; then the part that is
    valid is taken.  In a run that has none, the search goes on at the next group.
    """
    if not _HINT.search(text):
        return text, []
    out, spans, at, size, pos, tried = [], [], 0, 0, 0, 0
    while m := _ANY.search(text, pos):
        kind = next(k for k in KINDS if m[k] is not None)
        for start, end in _parts(kind, m[0]):
            # A run that failed as a whole is not tried again from each of its groups: some part would pass by chance.
            if kind == "card" and end - start == len(m[0]) and m.start() < tried:
                continue
            if (new := getattr(names, kind)(m[0][start:end])) is not None:
                break
        else:
            new = None
        if new is None:
            pos = m.end()
            if kind in ("iban", "card"):
                tried, pos = max(tried, pos), m.start() + len(re.match("[^ -]+", m[0])[0])
            continue
        start, pos = m.start() + start, m.start() + end
        out += (text[at:start], new)
        size += start - at
        spans.append((kind, size, size + len(new)))
        size, at = size + len(new), pos
    return "".join(out) + text[at:], spans


def pseudonymized(docs: DataFrame, key: bytes | None = None, back: bool = False) -> DataFrame:
    """docs with text replaced, and n_found, kinds (comma-separated, in order), spans (start and end of each).

    One pass over whole texts without a shuffle.  Null text stays null and has none; null doc_ids and repeated rows are
    rows like others, an empty docs gives no rows.  Other columns are carried along, and those that bear a result's name
    are replaced.  key: by default, the session's KEY_SETTING.  back: turns pseudonyms into the values again.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY.decode()).encode()
    own = [c for c in docs.columns if c not in RESULTS]
    at, kinds = own.index("text"), ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for b in small_rows(batches):
            found = [(None, []) if t is None else pseudonymize(t, names) for t in b.column(at).to_pylist()]
            cols = [pa.array([t for t, _ in found], b.column(at).type) if i == at else c for i, c in enumerate(b.columns)]
            cols += [pa.array([len(s) for _, s in found], pa.int64()), pa.array([",".join(x[0] for x in s) for _, s in found], pa.string()), pa.array([[y for x in s for y in x[1:]] for _, s in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *RESULTS])

    rows = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(own)))
    return mapped(rows, run, f"{kinds}, n_found long, kinds string, spans array<int>").toDF(*own, *RESULTS)


RESULTS = ("n_found", "kinds", "spans")
