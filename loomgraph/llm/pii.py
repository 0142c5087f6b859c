"""Format-preserving pseudonyms for personal data.

What looks like personal data is validated first (check digits, ranges, calendar dates). A valid value
is taken as a number in the mixed radix of its format and permuted by a keyed Feistel network over
that very set, so its pseudonym has the same format and is valid too, and equal values have equal
pseudonyms in every document, whatever separators they are written with. With the key the
pseudonyms can be turned back.

Kinds: payment cards (Luhn), IBANs (modulo 97), US phone and social security numbers, IPv4 addresses,
ISO dates from 1900 to 2099, e-mail addresses (their local part), access keys and secret tokens.

Defined cases: a null text stays null and an empty one empty; a very long text is gone through whole; what
fails validation stays as it is; where two kinds begin at one place, the first of KINDS counts; repeated
rows and null ids are treated like others; an empty table gives no rows; further columns, whatever their
names, are kept.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common

ROUNDS = 10
MADE = pa.struct({"text": pa.string(), "pii": pa.list_(pa.struct({"kind": pa.string(), "start": pa.int32(), "end": pa.int32()}))})


def _product(radices) -> int:
    return functools.reduce(lambda a, b: a * b, radices, 1)


def permuted(kind: str, digits: list[int], radices: list[int], key: bytes, back: bool = False) -> list[int]:
    """The digits' image under a keyed permutation of all digits in these radices: a Feistel network
    whose halves are numbers modulo the product of their radices."""
    half = len(digits) // 2
    sides = [radices[:half], radices[half:]]
    sizes = [_product(s) for s in sides]
    values = []
    for part, own in ((digits[:half], sides[0]), (digits[half:], sides[1])):
        n = 0
        for d, r in zip(part, own):
            n = n * r + d
        values.append(n)
    width = (max(sizes).bit_length() + 7) // 8
    tweak = f"{kind}/{','.join(map(str, radices))}/".encode()
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        to = i % 2
        f = int.from_bytes(hashlib.blake2b(tweak + bytes([i]) + values[1 - to].to_bytes(width, "big"), key=key, digest_size=min(64, width + 8)).digest(), "big")
        values[to] = (values[to] + (-f if back else f)) % sizes[to]
    out = []
    for n, own in zip(values, sides):
        part = []
        for r in reversed(own):
            n, d = divmod(n, r)
            part.append(d)
        out += part[::-1]
    return out


def _walk(kind: str, digits: list[int], radices: list[int], key: bytes, valid) -> list[int]:
    """Permutes until the image is valid: a permutation of the valid values."""
    while True:
        digits = permuted(kind, digits, radices, key)
        if valid(digits):
            return digits


def luhn(digits: list[int]) -> int:
    """The sum that is a multiple of 10 for valid numbers."""
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))


def _filled(text: str, digits: list[int]) -> str:
    """text with its digits replaced in order."""
    left = iter(digits)
    return "".join(str(next(left)) if "0" <= c <= "9" else c for c in text)


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if "0" <= c <= "9"]


def _series(d: list[int]) -> bool:
    """Whether numbers of cards begin so: with 3 to 6, or with 2221 to 2720."""
    return d[0] in (3, 4, 5, 6) or 2221 <= d[0] * 1000 + d[1] * 100 + d[2] * 10 + d[3] <= 2720


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not _series(d) or luhn(d) % 10 or len(set(d)) == 1:
        return None
    body = [d[0], *_walk("card", d[1:-1], [10] * (len(d) - 2), key, lambda x: _series([d[0], *x]))]
    return _filled(text, [*body, -luhn([*body, 0]) % 10])


def _phone_valid(d: list[int]) -> bool:
    """Area and exchange begin with 2 to 9 and do not end in 11."""
    return all(part[0] > 1 and part[1:] != [1, 1] for part in (d[:3], d[3:6]))


def _phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    country, own = d[:-10], d[-10:]
    if country not in ([], [1]) or not _phone_valid(own):
        return None
    return _filled(text, country + _walk("phone", own, [10] * 10, key, _phone_valid))


def _ssn_valid(d: list[int]) -> bool:
    area = d[0] * 100 + d[1] * 10 + d[2]
    return area not in (0, 666) and d[0] != 9 and d[3:5] != [0, 0] and d[5:] != [0] * 4


def _ssn(text: str, key: bytes) -> str | None:
    d = _digits(text)
    return _filled(text, _walk("ssn", d, [10] * 9, key, _ssn_valid)) if _ssn_valid(d) else None


def _address(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    octets = [int(p) for p in parts]
    if any(o > 255 or str(o) != p for o, p in zip(octets, parts)):
        return None
    return ".".join(map(str, permuted("ipv4", octets, [256] * 4, key)))


FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2099, 12, 31).toordinal() - FIRST_DAY + 1


def _date(text: str, key: bytes) -> str | None:
    try:
        day = datetime.date.fromisoformat(text).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    a, b = _walk("date", list(divmod(day, 512)), [256, 512], key, lambda x: x[0] * 512 + x[1] < DAYS)
    return datetime.date.fromordinal(FIRST_DAY + a * 512 + b).isoformat()


ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _by_class(kind: str, text: str, key: bytes, alphabets=ALPHABETS) -> str:
    """Letters become letters of their case and digits digits; other signs stay."""
    at = [(i, next(a for a in alphabets if c in a)) for i, c in enumerate(text) if any(c in a for a in alphabets)]
    image = permuted(kind, [a.index(text[i]) for i, a in at], [len(a) for _, a in at], key) if at else []
    out = list(text)
    for (i, a), d in zip(at, image):
        out[i] = a[d]
    return "".join(out)


def _mail(text: str, key: bytes) -> str:
    local, _, domain = text.partition("@")
    return f"{_by_class('mail', local, key)}@{domain}"


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    value = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or value(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _by_class("iban", plain[4:], key)
    whole = iter(f"{plain[:2]}{98 - value(body + plain[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(whole) for c in text)


def _access_key(text: str, key: bytes) -> str:
    return text[:4] + _by_class("access", text[4:], key, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",))


def _token(text: str, key: bytes) -> str:
    return _by_class("token", text, key, ("0123456789abcdef",) if text == text.lower() else ("0123456789ABCDEF",) if text == text.upper() else ALPHABETS)


KINDS = {
    "mail": (r"(?<![\w.+-])[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _mail),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "access": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", _access_key),
    "token": (r"(?i:\b(?:token|secret|api[_-]?key|passw(?:or)?d)\b[\"']?\s*[=:]\s*[\"']?)(?P<token>[0-9a-f]{16,}|[0-9A-F]{16,})(?![A-Za-z0-9])", _token),
    "phone": (r"(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", _phone),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    "date": (r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])", _date),
    "ipv4": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _address),
    "card": (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<sep>[ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])", _card),
}
PATTERN = re.compile("|".join(f"(?P<k_{name}>{pattern})" for name, (pattern, _) in KINDS.items()))
#: Every kind but the tokens and mail addresses without digits has one of these.
SIGNS = re.compile(r"[0-9@]")


def findings(text: str, key: bytes) -> list[tuple[str, int, int, str]]:
    """kind, start, end and pseudonym of each valid value, from left to right."""
    out, at = [], 0
    if not SIGNS.search(text) and not re.search(r"(?i)token|secret|key|passw", text):
        return out
    while m := PATTERN.search(text, at):
        kind = next(k[2:] for k, v in m.groupdict().items() if v is not None and k.startswith("k_"))
        start, end = m.span("token") if kind == "token" else m.span()
        image = KINDS[kind][1](text[start:end], key)
        if image is not None:
            out.append((kind, start, end, image))
            at = end
        else:
            # another kind may begin here or within
            again = next((x for name, (p, f) in KINDS.items() if name != kind and (y := re.compile(p).match(text, m.start())) and name != "token" and (image := f(y[0], key)) is not None for x in [(name, *y.span(), image)]), None)
            if again:
                out.append(again)
                at = again[2]
            else:
                at = m.start() + 1
                while at < m.end() and text[at - 1].isalnum() and text[at].isalnum():
                    at += 1
    return out


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    found = findings(text, key)
    if not found:
        return text, found
    parts, at = [], 0
    for _, start, end, image in found:
        parts += [text[at:start], image]
        at = end
    return "".join([*parts, text[at:]]), found


def key_of(spark: SparkSession) -> bytes:
    """The key that the session names in spark.loomgraph.pii.key; one that is known to all, fit for trials
    only, where it names none."""
    return (spark.conf.get("spark.loomgraph.pii.key", None) or "loomgraph").encode()


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with pseudonyms in the text, and the column pii (replaced if there): an array of kind,
    start and end (code points of the old text) of what was replaced."""

    @F.arrow_udf("struct<text: string, pii: array<struct<kind: string, start: int, end: int>>>")
    def run(text: pa.Array) -> pa.Array:
        rows = []
        for t in text:  # one text at a time as a Python object
            made, found = (None, []) if not t.is_valid else replaced(t.as_py(), key)
            rows.append({"text": made, "pii": [{"kind": k, "start": s, "end": e} for k, s, e, _ in found]})
        return pa.array(rows, MADE)

    made = docs.select(common.whole(docs).alias("row"), run(F.col("text").cast("string")).alias("made"))
    return common.unpacked(made, docs.columns, {"text": F.col("made.text"), "pii": F.col("made.pii")})
