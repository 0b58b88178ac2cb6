"""PII: format-preserving Feistel pseudonyms for validated numbers, dates and keys.

A found value is read as a number below the count of values of its format, permuted by a keyed Feistel network
(walking on while the result lies outside), and written back in the same format. The permutation depends on key
and format alone, so equal values stay equal across documents and different ones stay different.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

ROUNDS = 10
#: The key of tests and checks; a production run passes its own.
DEFAULT_KEY = b"a key for tests"


def permute(key: bytes, kind: str, value: int, size: int) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on the next even number of bits, cycle-walked into range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    label = f"{kind}:{size}".encode()
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            word = blake2b(label + bytes([r]) + right.to_bytes((half + 7) // 8, "big"), key=key, digest_size=min(64, (half + 15) // 8)).digest()
            left, right = right, left ^ (int.from_bytes(word, "big") & mask)
        value = left << half | right
        if value < size:
            return value


# ---------------------------------------------------------------- formats: each gives the pseudonym, or None if the value isn't valid

_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def by_class(key: bytes, kind: str, text: str, alphabets: tuple[str, ...] = _CLASSES) -> str:
    """Letters and digits permuted among their kind, all else in place."""
    size, value, at = 1, 0, []
    for i, c in enumerate(text):
        for a in alphabets:
            if c in a:
                value, size = value * len(a) + a.index(c), size * len(a)
                at.append((i, a))
                break
    out = list(text)
    value = permute(key, kind + "".join(a[0] for _, a in at), value, size) if size > 1 else value
    for i, a in reversed(at):
        value, d = divmod(value, len(a))
        out[i] = a[d]
    return "".join(out)


def fill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """Luhn sum with the last digit counted once; valid if it ends in 0."""
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + 2 * int(c) % 10 for i, c in enumerate(reversed(digits)))


def card(key: bytes, text: str) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or luhn(d) % 10 or d[0] == "0":
        return None
    low = 10 ** (len(d) - 2)
    body = str(permute(key, "card", int(d[:-1]) - low, 9 * low) + low)
    return fill(text, body + str(-luhn(body + "0") % 10))


#: Country calling codes of one and two digits; all others have three.
ONE_DIGIT_CODES = ("1", "7")
TWO_DIGIT_CODES = tuple(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def country_code(digits: str) -> str:
    return digits[:1] if digits.startswith(ONE_DIGIT_CODES) else digits[:2] if digits.startswith(TWO_DIGIT_CODES) else digits[:3]


def phone(key: bytes, text: str) -> str | None:
    """The country code stays, all digits after it are permuted; North American numbers keep to their own rules."""
    d = re.sub(r"\D", "", text)
    if text.startswith("+") and not (d.startswith("1") and len(d) == 11):
        if not 8 <= len(d) <= 15 or d[0] == "0":
            return None
        code = country_code(d)
        n = len(d) - len(code)
        return fill(text, code + str(permute(key, "phone" + code, int(d[len(code) :]), 10**n)).zfill(n))
    own = d[-10:]
    if own[0] in "01" or own[3] in "01":
        return None
    value = ((int(own[0]) - 2) * 100 + int(own[1:3])) * 800 + (int(own[3]) - 2) * 100 + int(own[4:6])
    value = permute(key, "phone", value * 10_000 + int(own[6:]), 800 * 800 * 10_000)
    area, rest = divmod(value, 800 * 10_000)
    office, line = divmod(rest, 10_000)
    return fill(text, d[:-10] + f"{area + 200:03d}{office + 200:03d}{line:04d}")


def social(key: bytes, text: str) -> str | None:
    a, b, c = map(int, text.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    v = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    v, c = divmod(permute(key, "social", v, 898 * 99 * 9999), 9999)
    a, b = divmod(v, 99)
    return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"


def ip4(key: bytes, text: str) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = permute(key, "ip4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, v.to_bytes(4, "big")))


def ip6(key: bytes, text: str) -> str | None:
    """Written out in full if it was, else shortened, in its own case. Of two groups alone, the first must be of three or four characters with a digit (a name of a program's scope looks like the rest)."""
    groups = [g for g in text.split(":") if g]
    if len(groups) < 3 and not (len(groups[0]) > 2 and re.search("[0-9]", groups[0])):
        return None
    try:
        old = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    new = ipaddress.IPv6Address(permute(key, "ip6", int(old), 1 << 128))
    shown = new.exploded if text.lower() == old.exploded else new.compressed
    return shown.upper() if text != text.lower() else shown


def iban(key: bytes, text: str) -> str | None:
    flat = text.replace(" ", "")
    rest = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
    if rest(flat) != 1:
        return None
    body = by_class(key, "iban" + flat[:2], flat[4:])
    new = flat[:2] + f"{98 - rest(flat[:2] + '00' + body):02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
#: The orders of year, month and day that a separator stands for; the later ones where the first gives no day of the calendar.
ORDERS = {"-": ("ymd", "dmy", "mdy"), "/": ("mdy", "dmy"), ".": ("dmy", "mdy")}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Months of the other languages of the corpora.
OTHER_MONTHS = {
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
}
#: name: (names of all months in its language and form, place, kind). A name that languages share counts for the first of them; short forms are three letters of English, German and Spanish names but May's.
MONTH_NAMES: dict[str, tuple[tuple[str, ...], int, str]] = {}
for _language, _months in (("en", MONTHS), *OTHER_MONTHS.items()):
    for _place, _month in enumerate(_months):
        MONTH_NAMES.setdefault(_month.lower(), (_months, _place, "date"))
for _language, _months in (("en", MONTHS), *OTHER_MONTHS.items()):
    for _place, _month in enumerate(_months):
        if _language != "fr" and _place != 4:
            MONTH_NAMES.setdefault(_month[:3].lower(), (tuple(m[:3] for m in _months), _place, "short"))


def _days(keep: Callable[[date], bool]) -> tuple[list[date], dict[date, int]]:
    every = (FIRST_DAY + timedelta(days=k) for k in range((LAST_DAY - FIRST_DAY).days + 1))
    kept = [d for d in every if keep(d)]
    return kept, {d: k for k, d in enumerate(kept)}


#: Days that a date may become: all; those above the 12th, which no other order of day and month can mean; those outside May, whose name has no short form.
DAYS = {"date": _days(lambda d: True), "late": _days(lambda d: d.day > 12), "short": _days(lambda d: d.month != 5)}


def _moved(key: bytes, kind: str, y: int, m: int, d: int) -> date | None:
    """The pseudonym of a day within its kind; None if it isn't one of them."""
    days, at = DAYS[kind]
    try:
        place = at.get(date(y, m, d))
    except ValueError:
        return None
    return None if place is None else days[permute(key, kind, place, len(days))]


def day(key: bytes, text: str) -> str | None:
    sep = next(c for c in text if not c.isdigit())
    parts = text.split(sep)
    orders = [o for o in ORDERS[sep] if len(parts[o.index("y")]) == 4]
    for k, order in enumerate(orders):
        named = dict(zip(order, map(int, parts)))
        new = _moved(key, "late" if k else "date", named["y"], named["m"], named["d"])
        if new:
            padded = all(len(x) >= 2 for x in parts)
            show = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded else str(new.month), "d": f"{new.day:02d}" if padded else str(new.day)}
            return sep.join(show[x] for x in order)
    return None


def named_day(key: bytes, text: str) -> str | None:
    """Dates with a month's name, before or after the day, which may be an ordinal: the new month is of the name's language, form and case, and an ordinal ends as its new number does."""
    name = next(w for w in re.findall(r"[^\W\d_]+", text) if w.lower() in MONTH_NAMES)
    names, place, kind = MONTH_NAMES[name.lower()]
    first, second = re.findall("[0-9]+", text)
    new = _moved(key, kind, int(second), place + 1, int(first))
    if new is None:
        return None
    shown = names[new.month - 1]
    shown = shown.upper() if name.isupper() else shown.lower() if name.islower() else shown[0].upper() + shown[1:]
    parts = {m[0]: m for m in re.finditer(r"[0-9]+(?:st|nd|rd|th|er)?|[^\W\d_]+", text, re.IGNORECASE)}
    day_text = next(t for t in parts if t[0].isdigit())
    suffix = re.sub("[0-9]", "", day_text)
    number = f"{new.day:02d}" if len(first) == 2 and not suffix else str(new.day)
    if suffix.lower() == "er":  # said of the first alone
        number += suffix if new.day == 1 else ""
    elif suffix:
        end = "th" if 11 <= new.day <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
        number += end.upper() if suffix.isupper() else end
    told = iter((number, f"{new.year:04d}"))
    month = re.compile(rf"(?<![^\W\d_]){name}(?![^\W\d_])")
    return re.sub("[0-9]+(?:st|nd|rd|th|er)?", lambda m: next(told), month.sub(shown, text, count=1), flags=re.IGNORECASE)


def email(key: bytes, text: str) -> str:
    local, _, host = text.rpartition("@")
    return by_class(key, "email", local) + "@" + host


def access_key(key: bytes, text: str) -> str:
    return text[:4] + by_class(key, "access", text[4:], (_CLASSES[2] + _CLASSES[0],))


#: Characters of a secret that are permuted together.
SECRET_BLOCK = 128


def secret(key: bytes, text: str) -> str:
    """Longer ones block by block, forwards and then backwards, each block keyed by those before it in that order: all of the text decides on all of the pseudonym."""
    alphabets = ("0123456789abcdef",) if re.fullmatch("[0-9a-f]+", text) else _CLASSES
    if len(text) <= SECRET_BLOCK:
        return by_class(key, "secret", text, alphabets)
    blocks = [text[i : i + SECRET_BLOCK] for i in range(0, len(text), SECRET_BLOCK)]
    for way in (1, -1):
        told = f"{way}:{len(text)}"
        for i in range(len(blocks))[::way]:
            blocks[i] = by_class(key, f"secret{told}:", blocks[i], alphabets)
            told = blake2b((told + blocks[i]).encode(), key=key, digest_size=16).hexdigest()
    return "".join(blocks)


_LEFT, _RIGHT = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_NAMES = "|".join(sorted(MONTH_NAMES, key=lambda m: (-len(m), m)))
#: kind: (pattern, format). Earlier ones win where two begin at the same place.
KINDS: dict[str, tuple[str, Callable]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}", email),
    "iban": (_LEFT + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _RIGHT, iban),
    "access_key": (_LEFT + r"AKIA[A-Z0-9]{16}" + _RIGHT, access_key),
    "secret": (r"(?i:(?:password|passwd|secret|token|api[_-]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?)(?![A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}\.)(?=[_./+=-]*[A-Za-z0-9])(?P<own>[A-Za-z0-9_./+=-]{7,}[A-Za-z0-9_/+=-])", secret),
    "date": (_LEFT + r"(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?:(?=T[0-9]{2}:?[0-9]{2})|(?!\.?[0-9A-Za-z]))", day),
    "named_date": (_LEFT + rf"(?i:[0-9]{{1,2}}(?:st|nd|rd|th|er|\.)? (?:of |de )?(?:{_NAMES})\.?,? (?:de |del )?[0-9]{{4}}|(?<!\w)(?:{_NAMES})\.? [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}})" + _RIGHT, named_day),
    "ip4": (r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])", ip4),
    "ip6": (r"(?<![A-Za-z0-9:.])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){1,7}(?![A-Za-z0-9:])", ip6),
    "social": (_LEFT + r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-)" + _RIGHT, social),
    "card": (_LEFT + r"[0-9]{4}(?:[ -]?[0-9]{4}){2}(?:[ -]?[0-9]{1,4}){1,2}" + _RIGHT, card),
    "phone": (r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]){4,12}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})" + _RIGHT, phone),
}
_ANY = re.compile("|".join(f"(?P<{k}>{p.replace('?P<own>', '?P<' + k + '_own>')})" for k, (p, _) in KINDS.items()))
_MAYBE = re.compile(r"[0-9@=:]|AKIA")


@lru_cache(1 << 16)
def pseudonym(key: bytes, kind: str, value: str) -> str | None:
    return KINDS[kind][1](key, value)


def replace(text: str | None, key: bytes) -> tuple[str | None, list[dict]]:
    """The text with its values replaced, and the places found in the old text."""
    if not text or not _MAYBE.search(text):
        return text, []
    out, found, done, at = [], [], 0, 0
    while m := _ANY.search(text, at):
        kind = m.lastgroup.removesuffix("_own")
        own = f"{kind}_own" if f"{kind}_own" in _ANY.groupindex else kind
        new = pseudonym(key, kind, m[own])
        if new is None:  # not valid: other formats may still begin inside
            at = m.start() + 1
            continue
        out += [text[done : m.start(own)], new]
        found.append({"kind": kind, "start": m.start(own), "end": m.end(own)})
        done = at = m.end(own)
    return "".join(out) + text[done:] if found else text, found


def pseudonymise(docs: DataFrame, *, text_col: str = "text", key: bytes = DEFAULT_KEY) -> DataFrame:
    """docs with pseudonyms in text_col, and one more column: places, an array of (kind, start, end) in the old text.

    Null stays null, empty stays empty, both without places. Values that fail their format's validation (Luhn,
    mod 97, calendar, number ranges) stay as they are, and so do an e-mail's host, a number's country code and the
    time of day after a date. Rows
    are changed each for itself, so ids may repeat or be null, and copies stay copies; an empty table stays empty.
    `key` decides on the permutations: DEFAULT_KEY is public, and is for tests and checks alone.
    """
    place = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("places", T.ArrayType(place))])

    @F.pandas_udf(kind)
    def done(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([replace(t, key) for t in texts], columns=["text", "places"])

    own, places = fresh(docs, "replaced"), fresh(docs, "places")
    out = docs.withColumn(own, done(F.col(text_col).cast("string")))
    names = [F.col(own)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names, F.col(own)["places"].alias(places))


def digest(docs: DataFrame) -> DataFrame:
    out = pseudonymise(docs.select("doc_id", "text"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["kind"]))), ",")
    return out.select("doc_id", F.size("places").cast("long").alias("n_found"), kinds.alias("kinds"), "text")
