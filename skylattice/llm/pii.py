"""Personal data replaced by format-preserving Feistel pseudonyms.

Values are found by pattern, then validated (Luhn, mod 97, calendar, octets, number plans). A valid
value is numbered within its format, and the number goes through a keyed permutation of exactly
that range: a Feistel network with cycle walking, conjugating a fixed shift, so that no value
stays itself. Equal values have equal pseudonyms in all documents, different ones different
pseudonyms; check digits are made anew, texts keep their length, and the key reverses it all.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

#: For tests and demonstration; a deployment passes a secret of its own.
DEMO_KEY = b"demonstration key, not a secret"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of range(n), one for each n and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, tweak: bytes, k: int, v: int, size: int) -> int:
        width = (size.bit_length() + 71) // 8
        data = self.key + tweak + b"|%d|%d|%d" % (size, k, v)
        return int.from_bytes(hashlib.shake_256(data).digest(width), "big") % size

    def _once(self, x: int, side: int, tweak: bytes, back: bool) -> int:
        a, b = divmod(x, side)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = (b - self._round(tweak, k, a, side)) % side, a
            else:
                a, b = b, (a + self._round(tweak, k, b, side)) % side
        return a * side + b

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        side = math.isqrt(n - 1) + 1
        x = self._once(x, side, tweak, back)
        while x >= n:
            x = self._once(x, side, tweak, back)
        return x

    def permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """A permutation of range(n) without a fixed point (n of at least 2)."""
        if n < 2:
            return x
        t = tweak.encode()
        shift = 1 + self._round(t, ROUNDS, n, n - 1)
        return self._walk((self._walk(x, n, t, False) + (-shift if back else shift)) % n, n, t, True)


def _mixed(f: Feistel, digits: list[int], bases: list[int], tweak: str, back: bool) -> list[int]:
    """Permute a number given by digits of several bases."""
    x = 0
    for d, b in zip(digits, bases):
        x = x * b + d
    x = f.permute(x, math.prod(bases), tweak, back)
    out = []
    for b in reversed(bases):
        x, d = divmod(x, b)
        out.append(d)
    return out[::-1]


def _fill(template: str, chars: str, where: Callable[[str], bool]) -> str:
    it = iter(chars)
    return "".join(next(it) if where(c) else c for c in template)


def _ascii_digit(c: str) -> bool:
    return "0" <= c <= "9"


def luhn_sum(digits: str) -> int:
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits)))


def _alnum(f: Feistel, s: str, tweak: str, back: bool) -> str:
    """Letters to letters and digits to digits, ASCII; case and all else stay where they are."""
    at = [i for i, c in enumerate(s) if c.isascii() and c.isalnum()]
    low = s.lower() if s.isascii() else "".join(c.lower() if c.isascii() else c for c in s)
    kind = "".join("9" if _ascii_digit(s[i]) else "a" for i in at)
    got = _mixed(f, [ord(low[i]) - (48 if k == "9" else 97) for i, k in zip(at, kind)], [10 if k == "9" else 26 for k in kind], f"{tweak}:{kind}", back)
    out = list(s)
    for i, k, v in zip(at, kind, got):
        c = chr(v + (48 if k == "9" else 97))
        out[i] = c.upper() if s[i].isupper() else c
    return "".join(out)


def email(f: Feistel, s: str, back: bool) -> str | None:
    local, _, domain = s.rpartition("@")
    name, dot, top = domain.rpartition(".")
    if not name or ".." in s or len(s) > 254:
        return None
    return _alnum(f, local, "email", back) + "@" + _alnum(f, name, "domain", back) + dot + top


def card(f: Feistel, s: str, back: bool) -> str | None:
    d = "".join(filter(_ascii_digit, s))
    if not 13 <= len(d) <= 19 or luhn_sum(d) % 10 or len(set(d)) == 1:
        return None
    mid = f.permute(int(d[1:-1]), 10 ** (len(d) - 2), f"card{len(d)}{d[0]}", back)
    body = d[0] + str(mid).zfill(len(d) - 2)
    return _fill(s, body + str(-luhn_sum(body + "0") % 10), _ascii_digit)


def iban(f: Feistel, s: str, back: bool) -> str | None:
    flat = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    account = _alnum(f, flat[4:], "iban" + flat[:2], back)
    check = 98 - number(account + flat[:2] + "00") % 97
    return _fill(s, f"{flat[:2]}{check:02d}{account}", lambda c: c != " ")


def ssn(f: Feistel, s: str, back: bool) -> str | None:
    a, b, c = map(int, s.split("-"))
    if not 0 < a < 900 or a == 666 or not b or not c:
        return None
    a, b, c = _mixed(f, [a - 1 - (a > 666), b - 1, c - 1], [898, 99, 9999], "ssn", back)
    return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"


def ipv4(f: Feistel, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    low, size = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    got = _mixed(f, [int(p) - low[len(p)] for p in parts], [size[len(p)] for p in parts], "ipv4" + "".join(str(len(p)) for p in parts), back)
    return ".".join(str(v + low[len(p)]) for p, v in zip(parts, got))


def north_american(f: Feistel, s: str, back: bool) -> str | None:
    d = "".join(filter(_ascii_digit, s))
    code, d = d[:-10], d[-10:]
    if len(d) < 10 or code not in ("", "1"):
        return None
    low, n = (2, 8) if d[0] >= "2" else (0, 2)  # area codes below 200 are not in use: they stay such
    got = _mixed(f, [int(d[0]) - low, *map(int, d[1:])], [n] + [10] * 9, f"nanp{n}", back)
    return _fill(s, code + str(got[0] + low) + "".join(map(str, got[1:])), _ascii_digit)


def international(f: Feistel, s: str, back: bool) -> str | None:
    """The first two digits after the plus stay: the country, or its zone."""
    d = "".join(filter(_ascii_digit, s))
    if d.startswith("1"):
        return north_american(f, s, back)
    if not 8 <= len(d) <= 15 or d[0] == "0":
        return None
    rest = f.permute(int(d[2:]), 10 ** (len(d) - 2), f"phone{len(d)}{d[:2]}", back)
    return _fill(s, d[:2] + str(rest).zfill(len(d) - 2), _ascii_digit)


@functools.cache
def _days(late: bool) -> list[int]:
    """Days, counted from FIRST_DAY, up to the twelfth of their month or after it."""
    return [k for k in range(LAST_DAY - FIRST_DAY + 1) if (datetime.date.fromordinal(k + FIRST_DAY).day > 12) == late]


def date(f: Feistel, s: str, back: bool) -> str | None:
    """yyyy-mm-dd, or day, month and year with . or / or -; month first only where the second number cannot be a month.
    Days up to the twelfth and later ones are permuted among themselves, so that a date has one pseudonym
    in all orders and each order still reads one way."""
    a, sep, b, c = re.fullmatch(r"(\d+)([-./])(\d+)[-./](\d+)", s).groups()
    order = "ymd" if len(a) == 4 else "mdy" if int(b) > 12 else "dmy"
    v = dict(zip(order, map(int, (a, b, c))))
    try:
        day = datetime.date(v["y"], v["m"], v["d"]).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day <= LAST_DAY - FIRST_DAY:
        return None
    late = v["d"] > 12
    days = _days(late)
    t = datetime.date.fromordinal(days[f.permute(bisect.bisect_left(days, day), len(days), f"date{late:d}", back)] + FIRST_DAY)
    parts = {"y": f"{t.year:04d}", "m": f"{t.month:02d}", "d": f"{t.day:02d}"}
    return sep.join(parts[k] for k in order)


#: A longer secret is permuted in parts of this length, each by its place.
SECRET_PART = 128


def secret(f: Feistel, s: str, back: bool) -> str | None:
    """hex to hex, capitals and 2-7 to such, else letters to letters and digits to digits."""
    if len(s) > SECRET_PART:
        parts = [s[k : k + SECRET_PART] for k in range(0, len(s), SECRET_PART)]
        return "".join(_alnum(f, x, f"secret part {k}", back) for k, x in enumerate(parts))
    for name, alphabet in (("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")):
        if set(s) <= set(alphabet):
            n = len(alphabet)
            return "".join(alphabet[v] for v in _mixed(f, [alphabet.index(c) for c in s], [n] * len(s), f"{name}{len(s)}", back))
    return _alnum(f, s, "secret", back)


#: In order of precedence at one place: (kind, pattern, group that is replaced, rule).
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@])", email),
    ("secret", r"(?<=AKIA)[A-Z2-7]{16}(?![A-Za-z0-9])", secret),
    ("secret", r"(?:(?<=password=)|(?<=secret=)|(?<=PASSWORD=)|(?<=SECRET=)|(?<=token = \")|(?<=TOKEN = \")|(?<=token=)|(?<=TOKEN=))[A-Za-z0-9]{8,}+", secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("date", r"(?<![\d./-])(?:\d{4}-\d\d-\d\d|\d\d([./-])\d\d\1\d{4})(?![\d/-]|\.\d)", date),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", ipv4),
    ("ssn", r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])", ssn),
    ("card", r"(?<![\d+-])\d(?:[ -]?\d){12,18}(?![\d-])", card),
    ("phone", r"(?<![\w+])\+\d[\d ().-]{6,18}\d(?!\d)", international),
    ("phone", r"(?<![\w+)])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?!\d)", north_american),
]
_RULES = [(kind, re.compile(p, re.ASCII), rule) for kind, p, rule in KINDS]
#: What may follow a value that is read shorter than its pattern goes.
_ENDS = {"iban": re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])"), "card": re.compile(r"(?<=[0-9])(?![0-9-])"), "phone": re.compile(r"(?<=[0-9])(?![0-9])")}
_IBAN_LENGTHS = dict(re.findall(r"([A-Z]{2})(\d\d)", "AD24AE23AL28AT20AZ28BA20BE16BG22BH22BR29BY28CH21CR22CY28CZ24DE22DK18DO28EE20ES24FI18FO18FR27GB22GE22GI23GL18GR27GT28HR21HU28IE22IL23IS26IT27JO30KW30KZ20LB28LI21LT20LU20LV21MC27MD24ME22MK19MR27MT31MU30NL18NO15PK24PL28PS29PT25QA29RO24RS22SA24SE24SI19SK24SM27TN24TR26VG24XK20"))
_MAY = re.compile("[0-9@]|AKIA|(?i:password=|token|secret=)")


def _readings(kind: str, pattern: re.Pattern, text: str, a: int, z: int) -> list[int]:
    """Where a value that starts at a may end: the longest first, and of an account the country's length before that."""
    if kind not in _ENDS:
        return [z]
    ends = [z, *(e.start() for e in reversed(list(_ENDS[kind].finditer(text, a + 1, z))) if e.start() < z and pattern.fullmatch(text, a, e.start()))]
    if kind == "iban":
        ends.sort(key=lambda e: len(text[a:e].replace(" ", "")) != int(_IBAN_LENGTHS.get(text[a : a + 2], 0)))
    return ends


def replace(text: str, f: Feistel, back: bool = False) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds of what was replaced, in page order. Of two values that
    overlap, the one of the kind listed first is taken. Where the longest reading of a value does not
    validate, shorter ones from its start are tried, then later starts; what does not validate stays."""
    if not _MAY.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []  # sorted, none overlaps another

    def free(a: int, z: int) -> bool:
        i = bisect.bisect_left(taken, (z,))
        return not i or taken[i - 1][1] <= a

    for kind, pattern, rule in _RULES:
        m = pattern.search(text)
        while m:
            a, at = m.start(), m.end() if kind not in _ENDS else m.start() + 1
            for z in _readings(kind, pattern, text, a, m.end()):
                if not free(a, z):
                    continue
                got = rule(f, text[a:z], back)
                if got is not None:
                    bisect.insort(taken, (a, z, kind, got))
                    at = z
                    break
            m = pattern.search(text, at)
    out, at = [], 0
    for a, z, _, got in taken:
        out += [text[at:a], got]
        at = z
    return "".join([*out, text[at:]]), [t[2] for t in taken]


def pseudonymize(docs: DataFrame, key: bytes = DEMO_KEY, back: bool = False) -> DataFrame:
    """doc_id, text, n_values, kinds (sorted, distinct) for each row of docs(doc_id, text).

    A null text stays null; empty texts, repeated rows and rows without doc_id each have a row.
    Other columns are ignored.
    """

    def run(batches):
        f = Feistel(key)
        for batch in batches:
            texts, n, kinds = [], [], []
            for t in batch.column(1):
                text = t.as_py()
                new, found = (None, []) if text is None else replace(text, f, back)
                texts.append(new)
                n.append(len(found))
                kinds.append(sorted(set(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "text", "n_values", "kinds"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string, n_values long, kinds array<string>")


def replace_in(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """docs with pseudonyms in its text, all other columns as they are. A null text stays null, an empty one empty; rows
    that repeat are each replaced alike."""

    @F.arrow_udf("string")
    def new(texts):
        f = Feistel(key)
        return pa.array([None if t is None else replace(t, f)[0] for t in map(pa.StringScalar.as_py, texts)], pa.string())

    return bounded(docs).withColumn("text", new(F.col("text").cast("string")))
