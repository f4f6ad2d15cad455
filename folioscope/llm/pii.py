"""PII: format-preserving Feistel pseudonyms.

Validated numbers, dates and addresses are replaced by keyed permutations of the values of
their own format, so that a pseudonym is again valid, has the same length and layout, and
equal values get equal pseudonyms in every document.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, slices

ROUNDS = 8
FINDINGS = T.ArrayType(
    T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("pseudonym", "string")
)
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER = re.compile(
    r"(?<![\w.+-])(?:"
    r"(?P<iban>[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})"
    r"|(?P<iso>\d{4}-\d\d-\d\d)"
    r"|(?P<dotted>\d\d\.\d\d\.\d{4})"
    r"|(?P<slashed>\d\d/\d\d/\d{4})"
    r"|(?P<ssn>\d{3}-\d\d-\d{4})"
    r"|(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})"
    r"|(?P<intl>\+[2-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4}+)){2,14})"
    r"|(?P<card>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5}|\d{13,19})"
    r")(?![\w-]|\.\d)"
)
END = re.compile(r"(?![\w-]|\.\d)")
#: A trunk prefix as in "+44 (0)20", or an area code of one digit; it stays as it is.
TRUNK = re.compile(r"\(\d\)")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: int(n)
    for n, cs in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV"
        " 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST"
        " 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE"
        " 31:MT,SC 32:LC 33:RU"
    ).split())
    for c in cs.split(",")
}


class Permutation:
    """Keyed permutations of 0 .. size - 1 by a balanced Feistel network and cycle walking."""

    def __init__(self, key: bytes):
        self.key = key

    @lru_cache(maxsize=100_000)  # noqa: B019  one object a task
    def _round(self, tweak: str, size: int, k: int, half: int, bits: int) -> int:
        text = f"{tweak}|{size}|{k}|{half}".encode()
        return int.from_bytes(hmac.digest(self.key, text, "sha256"), "big") & ((1 << bits) - 1)

    def __call__(self, value: int, size: int, tweak: str, ok: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The image of ``value``; walks on until it is below ``size`` and ``ok``. Values that
        are ``ok`` map one to one onto themselves. ``back``: the inverse."""
        if size < 2:
            return value
        bits = ((size - 1).bit_length() + 1) // 2
        mask = (1 << bits) - 1
        while True:
            left, right = value >> bits, value & mask
            for k in range(ROUNDS):
                if back:
                    left, right = right ^ self._round(tweak, size, ROUNDS - 1 - k, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, size, k, right, bits)
            value = left << bits | right
            if value < size and ok(value):
                return value


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _refill(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in layout)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card(text: str, p: Permutation, back: bool) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    # The first digit stays, the last follows from the others. One repeated digit isn't a card.
    span = len(d) - 2
    close = lambda v: next(x for c in "0123456789" if luhn(x := d[0] + str(v).zfill(span) + c))
    v = p(int(d[1:-1]), 10**span, f"card{d[0]}", lambda v: len(set(close(v))) > 1, back)
    return _refill(text, close(v))


def _ip(text: str, p: Permutation, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    v = p(sum(int(x) << (24 - 8 * k) for k, x in enumerate(parts)), 1 << 32, "ip", back=back)
    return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(y: int, m: int, d: int) -> int | None:
    try:
        n = (date(y, m, d) - _FIRST).days
    except ValueError:
        return None
    return n if 0 <= n < _DAYS else None


def _day(form: str):
    def change(text: str, p: Permutation, back: bool) -> str | None:
        if form == "%Y-%m-%d":
            n, shape = _date(int(text[:4]), int(text[5:7]), int(text[8:])), form
        else:
            a, b, y = int(text[:2]), int(text[3:5]), int(text[6:])
            n, shape = _date(y, b, a), form
            if n is None and form == "%d/%m/%Y":
                # Month first only where day first is no date, that is for days over 12.
                n, shape = _date(y, a, b), "%m/%d/%Y"
        if n is None:
            return None
        # One permutation for all forms, so that a day keeps its pseudonym in each of them. Days
        # over 12 map to such days, by which the two slashed forms stay apart.
        late = lambda v: (_FIRST + timedelta(v)).day > 12
        own = late(n)
        return (_FIRST + timedelta(p(n, _DAYS, "date", lambda v: late(v) == own, back))).strftime(shape)

    return change


def _ssn(text: str, p: Permutation, back: bool) -> str | None:
    ok = lambda v: not (s := str(v).zfill(9)).startswith(("000", "666", "9")) and s[3:5] != "00" and s[5:] != "0000"
    v = int(_digits(text))
    return _refill(text, str(p(v, 10**9, "ssn", ok, back)).zfill(9)) if ok(v) else None


def _phone(text: str, p: Permutation, back: bool) -> str | None:
    d = _digits(text)
    head, own = d[:-10], d[-10:]
    # Numbers that the plan allows (area and office begin with 2 to 9) map to such numbers.
    valid = lambda v: min((s := str(v).zfill(10))[0], s[3]) > "1"
    kind = valid(int(own))
    return _refill(text, head + str(p(int(own), 10**10, "phone", lambda v: valid(v) == kind, back)).zfill(10))


def _intl(text: str, p: Permutation, back: bool) -> str | None:
    d = _digits(TRUNK.sub("", text))
    if not 8 <= len(d) <= 15:
        return None
    new = iter(d[:2] + str(p(int(d[2:]), 10 ** (len(d) - 2), f"intl{d[:2]}", back=back)).zfill(len(d) - 2))
    parts = re.split(f"({TRUNK.pattern})", text)
    return "".join(x if k % 2 else "".join(next(new) if "0" <= c <= "9" else c for c in x) for k, x in enumerate(parts))


def _iban_check(country: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _is_iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and any("0" <= c <= "9" for c in flat[4:]) and 98 - _iban_check(flat[:2], flat[4:]) == int(flat[2:4])


def _own_length(text: str) -> str | None:
    """The start of ``text`` that is as long as its country's IBANs, where a blank follows."""
    at, left = 0, IBAN_LENGTHS.get(text[:2], 99)
    while left and at < len(text):
        left -= text[at] != " "
        at += 1
    return text[:at] if not left and text[at : at + 1] == " " else None


def _iban(text: str, p: Permutation, back: bool) -> str | None:
    if not _is_iban(text):
        return None
    flat, short = text.replace(" ", ""), _own_length(text)
    country, rest = flat[:2], flat[4:]
    d = _digits(rest)

    def made(v: int) -> str:
        new = _refill(rest, str(v).zfill(len(d)))
        out = iter(country + str(98 - _iban_check(country, new)).zfill(2) + new)
        return "".join(c if c == " " else next(out) for c in text)

    # One that holds no shorter IBAN maps to its like, so that the way back cuts it alike.
    ok = (lambda v: not _is_iban(made(v)[: len(short)])) if short else (lambda _: True)
    return made(p(int(d), 10 ** len(d), f"iban{country}{re.sub('[0-9]', '0', rest)}", ok, back))


def _cut(kind: str, found: str) -> str:
    """What of a match is the value: of an IBAN with a word behind it the IBAN, of an
    international number with more numbers behind it as many groups as have 15 digits."""
    if kind == "iban":
        short = _own_length(found)
        return short if short and _is_iban(short) else found
    if kind == "intl":
        at = len(found)
        while at > 0 and len(_digits(TRUNK.sub("", found[:at]))) > 15:
            at = next((k for k in range(at - 1, 0, -1) if found[k] in " .-" and END.match(found, k)), 0)
        return found[:at] or found
    return found


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _email(text: str, p: Permutation, back: bool) -> str | None:
    """Letters and digits of the local part change within their kind; the domain stays."""
    local, _, domain = text.rpartition("@")
    kinds = [next((s for s in _SETS if c in s), None) for c in local]
    value, size = 0, 1
    for c, s in zip(local, kinds, strict=True):
        if s:
            value, size = value * len(s) + s.index(c), size * len(s)
    shape = "".join("xaA0"[(1 + (2, 0, 1)[_SETS.index(s)]) if s else 0] if s else c for c, s in zip(local, kinds, strict=True))
    value, out = p(value, size, f"email{shape}@{domain.lower()}", back=back), []
    for c, s in zip(reversed(local), reversed(kinds), strict=True):
        if s:
            value, k = divmod(value, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out)) + "@" + domain


CHANGES = {
    "iban": _iban, "ip": _ip, "iso": _day("%Y-%m-%d"), "dotted": _day("%d.%m.%Y"), "slashed": _day("%d/%m/%Y"),
    "ssn": _ssn, "phone": _phone, "intl": _intl, "card": _card,
}
KINDS = {"iso": "date", "dotted": "date", "slashed": "date", "intl": "phone"}


def pseudonymise(text: str | None, p: Permutation, back: bool = False) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) in characters of the text
    given. ``back`` undoes it with the same key."""
    if not text:
        return text, []
    found: list[tuple[str, int, int, str]] = []
    if "@" in text:
        found += [("email", m.start(), m.end(), _email(m.group(), p, back)) for m in EMAIL.finditer(text)]
    taken, past = [(a, b) for _, a, b, _ in found], 0  # ascending, apart
    m = NUMBER.search(text)
    while m:
        own = _cut(m.lastgroup, m.group())
        start, end = m.start(), m.start() + len(own)
        new = CHANGES[m.lastgroup](own, p, back)
        while past < len(taken) and taken[past][1] <= start:
            past += 1
        if new is not None and not (past < len(taken) and taken[past][0] < end):
            found.append((KINDS.get(m.lastgroup, m.lastgroup), start, end, new))
        m = NUMBER.search(text, end)
    found.sort(key=lambda f: f[1])
    out, at = [], 0
    for _, a, b, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]) if found else text, found


def apply(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and ``pii``: array of (kind, start, end,
    pseudonym), offsets in the original text. Kinds: email, card (Luhn), iban (mod 97),
    ssn, phone, ip, date.

    IP addresses may change in length, all else keeps it. Numbers that fail their check stay
    as they are. Null stays null with an empty array. All rows and columns are kept; a column
    named pii in ``docs`` makes the new one ``pii_``.
    """
    out = free_name(docs, "pii")
    schema = T.StructType(list(docs.schema.fields)).add(out, FINDINGS)
    names, kind = [f.name for f in schema], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for a, b in slices(texts):
                new, found = zip(*(pseudonymise(t, p) for t in texts[a:b]), strict=True)
                part = batch.slice(a, b - a)
                columns = [pa.array(new, pa.string()) if c == text_col else part.column(c) for c in docs_columns]
                rows = [[dict(zip(("kind", "start", "end", "pseudonym"), x, strict=True)) for x in f] for f in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=names)

    docs_columns = docs.columns
    return docs.mapInArrow(run, schema)
