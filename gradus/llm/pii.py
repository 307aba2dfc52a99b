"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, ranges, calendar), turned into a number of
their format's domain, and permuted there by a keyed Feistel network with cycle walking; the result
is written in the same format: same length, separators, capitals, valid check digits. The
permutation depends on the key and the format's domain only, so equal values get equal pseudonyms
in every document, different ones different pseudonyms, and who has the key can invert it.

Card numbers keep the first digit, IBANs country and letters, phone numbers the country code,
e-mail addresses the domain. Dates of 1900 to 2099 are permuted by day, so a date keeps its
pseudonym across formats.

Numbers beside a value (expiry, CVV, year, BIC) look like a part of it, so at every place the kinds
are tried in turn, each with every group-aligned end: IBANs at their country's length first, cards
in a usual layout first, in any other last. If nothing is valid there, the scan goes on at the next
character. Pseudonyms for which a shorter reading would win are passed over, so the text reads the
same again. What stays ambiguous is a number whose digits make a valid card together with foreign
digits beside it, by their check digit's chance; such a text may not be restored.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.common import rename_clashes, ship_package

ROUNDS = 10
KINDS = ("email", "iban", "card", "ssn", "date", "phone", "ip")


def feistel(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1 (its inverse with ``back``)."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)

    def f(r: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{r}|{half}".encode(), key=key, digest_size=32).digest(), "big")

    while True:
        left, right = divmod(x, b)
        for r in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * f(r, left)) % b
            else:
                left = (left + sign * f(r, right)) % a
        x = left * b + right
        if x < size:
            return x


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def luhn(digits: str) -> int:
    """The sum that is 0 modulo 10 for a valid number."""
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def day(y: str, m: str, d: str) -> int | None:
    """Days since 1900-01-01 up to 2099-12-31."""
    try:
        n = datetime.date(int(y), int(m), int(d)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return n if 0 <= n < DAYS else None


FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY

Permute = Callable[[int, int, str], int]


def _email(s: str, p: Permute) -> str | None:
    local, at, domain = s.rpartition("@")
    radix = [10 if c.isdigit() else 26 for c in local if c.isascii() and c.isalnum()]
    if not radix:
        return None
    size, x = math.prod(radix), 0
    for c in (c for c in local if c.isascii() and c.isalnum()):
        x = x * 10 + int(c) if c.isdigit() else x * 26 + ord(c.lower()) - 97
    x = p(x, size, "email")
    out = []
    for c in reversed(local):
        if c.isascii() and c.isalnum():
            x, v = divmod(x, 10 if c.isdigit() else 26)
            out.append(str(v) if c.isdigit() else chr(v + (65 if c.isupper() else 97)))
        else:
            out.append(c)
    return "".join(reversed(out)) + at + domain


def _card(s: str, p: Permute) -> str | None:
    d = digits_of(s)
    if not 13 <= len(d) <= 19 or luhn(d):
        return None
    if d[0] == "2":
        if len(d) != 16 or not 2221 <= int(d[:4]) <= 2720:
            return None
        x = p((int(d[:4]) - 2221) * 10 ** 11 + int(d[4:-1]), 500 * 10 ** 11, "card2")
        body = str(x + 2221 * 10 ** 11)
        return refill(s, body + str(-luhn(body + "0") % 10))
    if d[0] not in "3456":
        return None
    n, new = len(d) - 2, d
    while True:
        body = d[0] + f"{p(int(new[1:-1]), 10 ** n, 'card'):0{n}d}"
        new = body + str(-luhn(body + "0") % 10)
        if n < 15 or (luhn(new[:16]) == 0) == (luhn(d[:16]) == 0):  # in groups, the first 16 digits would be read as a card
            return refill(s, new)


def _iban(s: str, p: Permute) -> str | None:
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
        return None
    d = digits_of(plain[4:])
    if not d:
        return None
    rest = refill(plain[4:], f"{p(int(d), 10 ** len(d), 'iban' + plain[:2]):0{len(d)}d}")
    out = iter(plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + rest):02d}" + rest)
    return "".join(c if c == " " else next(out) for c in s)


def _ssn(s: str, p: Permute) -> str | None:
    area, group, serial = (int(x) for x in re.split("[- ]", s))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(p(x, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(x, 99)
    return refill(s, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")


def _date(s: str, p: Permute) -> str | None:
    a, b, c = re.split("[-/.]", s)
    if len(a) == 4:
        orders = ["ymd"]
    elif "." in s:
        orders = ["dmy"]
    else:
        orders = ["mdy", "dmy"]
    for order in orders:
        part = dict(zip(order, (a, b, c)))
        n = day(part["y"], part["m"], part["d"])
        if n is not None:
            t = datetime.date.fromordinal(p(n, DAYS, "date") + FIRST_DAY)
            new = {"y": f"{t.year:04d}", "m": f"{t.month:02d}", "d": f"{t.day:02d}"}
            seps = re.sub(r"\d", "", s)
            x = [new[k] for k in order]
            return x[0] + seps[0] + x[1] + seps[1] + x[2]
    return None


def _phone(s: str, p: Permute) -> str | None:
    d = digits_of(s)
    ten = d[1:] if len(d) == 11 and d[0] == "1" else d if len(d) == 10 and not s.startswith("+") else ""
    if ten and ten[0] >= "2" and ten[3] >= "2":
        x = ((int(ten[:3]) - 200) * 800 + int(ten[3:6]) - 200) * 10000 + int(ten[6:])
        x, line = divmod(p(x, 800 * 800 * 10000, "phone"), 10000)
        area, office = divmod(x, 800)
        return refill(s, d[:len(d) - 10] + f"{area + 200}{office + 200}{line:04d}")
    if s.startswith("+") and 8 <= len(d) <= 15:
        code = digits_of(re.match(r"\+\d{1,3}", s)[0])
        n = len(d) - len(code)
        return refill(s, code + f"{p(int(d[len(code):]), 10 ** n, 'phone+'):0{n}d}") if n >= 5 else None
    return None


def _ip(s: str, p: Permute) -> str | None:
    x = 0
    for octet in s.split("."):
        if int(octet) > 255 or len(octet) > 1 and octet[0] == "0":
            return None
        x = x * 256 + int(octet)
    x = p(x, 1 << 32, "ip")
    return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))


CHANGE = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "phone": _phone, "ip": _ip}
#: How each kind may begin; a number must not go on at either side (card: see ``_card_ends``).
PART = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.+-])[2-6](?:[ -]?[0-9]){12}",
    "ssn": r"(?<![A-Za-z0-9.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])",
    "date": r"(?<![A-Za-z0-9.+/-])(?:(?:19|20)[0-9]{2}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)(?:19|20)[0-9]{2})(?![A-Za-z0-9]|[./-][0-9])",
    "phone": r"(?<![A-Za-z0-9.+-])(?:\+1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![A-Za-z0-9]|[.-][0-9])"
             r"|(?<![A-Za-z0-9.+-])\+[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,5}(?![A-Za-z0-9]|[.-][0-9])",
    "ip": r"(?<![A-Za-z0-9.+-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
}
ONE = {k: re.compile(p) for k, p in PART.items()}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PART.items()))
MAYBE = re.compile("[0-9@]")
DIGITS = re.compile("[0-9]{1,20}")
GOES_ON = re.compile(r"[A-Za-z0-9]|\.[0-9]")
NEXT_GROUP = re.compile("[ -](?=[0-9])")
#: Digits by group as cards are written; a single group is usual too.
CARD_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 3, 3, 3), (6, 13)}
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 "
    "MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 "
    "XK20 YE30").split()}


def _card_ends(text: str, start: int) -> tuple[list[int], list[int]]:
    """Where a card that begins at ``start`` may end: in a usual layout, shortest first, and in another, longest first."""
    usual, other, groups, n, at = [], [], (), 0, start
    while True:
        end = DIGITS.match(text, at).end()
        n += end - at
        if n > 19 or groups and end - at >= 13:  # a long group behind others is a number of its own
            break
        groups += (end - at,)
        if n >= 13 and not GOES_ON.match(text, end):
            (usual if len(groups) == 1 or groups in CARD_GROUPS else other).append(end)
        if not NEXT_GROUP.match(text, end):
            break
        at = end + 1
    return usual, other[::-1]


def _ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where an IBAN or a phone number may end: behind a group of the longest match."""
    ends = [end, *[i for i in range(end - 1, start, -1) if text[i] == " "]]
    want = IBAN_LENGTH.get(text[start:start + 2]) if kind == "iban" else None
    if want is None:
        return ends
    return [*[i for i in ends if i - start - text.count(" ", start, i) == want], end]


def _readings(text: str, start: int, first: str) -> Iterator[tuple[str, int]]:
    """(kind, end) of all that may begin at a place, in the order of trying; no kind before ``first`` fits there."""
    other: list[int] = []
    for kind in KINDS[KINDS.index(first):]:
        m = ONE[kind].match(text, start)
        if m is None:
            continue
        if kind == "card":
            ends, other = _card_ends(text, start)
        else:
            ends = _ends(kind, text, start, m.end()) if kind in ("iban", "phone") else [m.end()]
        yield from ((kind, e) for e in ends)
    for end in other:  # unless the digits after a space are a value of their own
        if not any(_value_begins(text, i + 1) for i in range(start, end) if text[i] == " "):
            yield "card", end


def _value_begins(text: str, at: int) -> bool:
    """Whether a valid value begins here; cards in a usual layout only."""
    for kind in KINDS:
        if (m := ONE[kind].match(text, at)) is not None:
            ends = _card_ends(text, at)[0] if kind == "card" else _ends(kind, text, at, m.end()) if kind in ("iban", "phone") else [m.end()]
            if any(CHANGE[kind](text[at:e], lambda x, size, tweak: x) is not None for e in ends):
                return True
    return False


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its values permuted (``back``: restored), and the number of values by kind."""
    count: dict[str, int] = {}
    if not MAYBE.search(text):
        return text, count

    def permute(x: int, size: int, tweak: str) -> int:
        return feistel(x, size, key, tweak, back)

    out, done, at = [], 0, 0
    while (m := PATTERN.search(text, at)) is not None:
        start = at = m.start()
        tried: list[tuple[str, int]] = []
        for kind, end in _readings(text, start, next(k for k in KINDS if m[k] is not None)):
            new = CHANGE[kind](text[start:end], permute)
            if new is not None:
                shorter = [(k, e - start) for k, e in tried if e < end]
                while any(CHANGE[k](new[:e], permute) is not None for k, e in shorter):
                    new = CHANGE[kind](new, permute)
                count[kind] = count.get(kind, 0) + 1
                out += [text[done:start], new]
                done = at = end
                break
            tried.append((kind, end))
        else:
            at = start + 1
    return "".join([*out, text[done:]]), count


def _changer(key: bytes, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1):
                t = t.as_py()
                new, n = (None, {}) if t is None else pseudonymise(t, key, back)
                texts.append(new)
                counts.append([n.get(k, 0) for k in KINDS])
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), *[pa.array([c[i] for c in counts], pa.int32()) for i in range(len(KINDS))]],
                                  names=["row", "text", *[f"n_{k}" for k in KINDS]])

    return run


def pseudonymise_documents(docs: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None, back: bool = False) -> DataFrame:
    """The columns ``keep`` (all others than the text, if None), the text with pseudonyms, and n_email,
    n_iban, n_card, n_ssn, n_date, n_phone, n_ip; input columns of these names are dropped.

    A null text stays null with counts 0, an empty one empty; repeated rows are changed alike. A text
    without a digit or @ is returned as it is. Texts are changed whole, one at a time, in any order."""
    ship_package(docs.sparkSession)
    docs = rename_clashes(docs, [f"n_{k}" for k in KINDS])
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.struct(F.lit(1).alias("_none")).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("text", T.StringType()), *[T.StructField(f"n_{k}", T.IntegerType()) for k in KINDS]])
    out = packed.mapInArrow(_changer(key, back), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("text").alias(text), *[f"n_{k}" for k in KINDS])
