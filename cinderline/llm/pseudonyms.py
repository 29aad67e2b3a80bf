"""Personal data (operator 8): values found and validated are replaced by keyed pseudonyms of the same format.

A value's free characters (digits, letters, day numbers) are read as one number below the size of its
format and permuted by a Feistel network, walking on while the result lies outside the format. A step
on the circle of the network's images leaves no fixed point, so no value is its own pseudonym.
Checksums are recomputed, so a card number stays a card number. The permutation depends on the key
and the kind alone: equal values have equal pseudonyms in all documents, different ones different
pseudonyms, and lengths and all other text stay as they were. Capitals do not tell values apart, nor
do the separators of cards, phones and IBANs, nor the script of decimal digits, which stays.

Found are: email addresses (mailboxes of letters, digits and ._%+-' and hosts of any number of names;
letters are Latin, Greek or Cyrillic, and other signs end a mailbox); card numbers of 13 to 19 digits
with their check digit; IBANs (with small letters only of their country's length); phone numbers with
a plus or in the forms (ddd) ddd-dddd and ddd-ddd-dddd; social security numbers; IPv4 addresses; days
from 1900 to 2099 in the forms of day(). Other forms (IPv6, ten bare digits, days without leading
zeros) are not looked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import documents, id_and_text, map_batches

#: For tests and demonstrations; give a secret one in production.
DEMO_KEY = b"cinderline demonstration key"
ROUNDS = 8
KINDS = ("email", "iban", "card", "phone", "ssn", "ip", "date")


def feistel(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on enough bits, repeated until the result is in range; or its inverse."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, n = (1 << half) - 1, (half + 7) // 8 + 1
    mixed = lambda part, r: int.from_bytes(blake2b(part.to_bytes(n, "big") + bytes([r]), key=key[:64], person=tweak[:16].ljust(16, b"\0"), digest_size=min(64, n + 8)).digest(), "big") & mask
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ mixed(left, r), left) if back else (right, left ^ mixed(right, r))
        x = left << half | right
        if x < size:
            return x


def permute(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size) that changes every number: through the network, one step on, and back through it."""
    return x if size < 2 else feistel((feistel(x, size, key, tweak) + 1) % size, size, key, tweak, True)


@lru_cache(None)
def alphabet(block: int, capitals: bool) -> str:
    """The small letters among 64 neighbouring code points that have a capital of one character, or those that do not; of ASCII a to z."""
    if not block >> 1:
        return "abcdefghijklmnopqrstuvwxyz"
    return "".join(c for c in map(chr, range(block << 6, block + 1 << 6)) if c.isalpha() and c.lower() == c and has_capital(c) == capitals)


def has_capital(c: str) -> bool:
    return len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c


def small(c: str) -> str:
    return c.lower() if len(c.lower()) == 1 else c


def letters_like(c: str) -> str:
    """The alphabet that a small letter is permuted in."""
    return alphabet(ord(c) >> 6, has_capital(c))


def in_format(text: str, key: bytes, tweak: str, free: Callable[[int], bool] = lambda i: True) -> str:
    """Permutes the letters and digits at free places, each within its class; everything else stays, and capitals are put back where they were. Long texts are permuted in pieces of 32 places, each under a tweak of those before."""
    out, low = list(text), [small(c) for c in text]
    places = [i for i, c in enumerate(low) if free(i) and ((c.isascii() and c.isalnum()) or (c.isalpha() and c in letters_like(c)))]
    for at in range(0, len(places), 32):
        part, number, size = places[at : at + 32], 0, 1
        classes = ["0123456789" if low[i].isdigit() else letters_like(low[i]) for i in part]
        for i, letters in zip(part, classes, strict=True):
            number, size = number * len(letters) + letters.index(low[i]), size * len(letters)
        # Which classes stand where is part of the format, and the characters before are part of the tweak.
        shape = "".join(letters[0] for letters in classes) + "".join([low[i] for i in places[:at]])
        number = permute(number, size, key, blake2b(f"{tweak}:{shape}".encode(), digest_size=16).digest())
        for i, letters in zip(reversed(part), reversed(classes), strict=True):
            number, digit = divmod(number, len(letters))
            out[i] = letters[digit].upper() if text[i] != low[i] else letters[digit]
    return "".join(out)


def luhn_digit(digits: str) -> int:
    """The check digit that follows."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def put_digits(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


#: The country codes of two digits; 1 and 7 are whole codes, all others have three.
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def email(found: str, key: bytes) -> str | None:
    """The mailbox and the host's names below the last two are permuted; without such names only the mailbox."""
    at = found.index("@")
    keep = found.rfind(".", 0, found.rfind("."))
    return in_format(found, key, "email", lambda i: i < max(at, keep))


def card(found: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    new = in_format(digits[:-1], key, "card")
    return put_digits(found, new + str(luhn_digit(new)))


def phone(found: str, key: bytes) -> str | None:
    """The digits behind the country's code are permuted, whatever stands between them."""
    digits = re.sub(r"\D", "", found)
    if not 8 <= len(digits) <= 15:
        return None
    code = (1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3) if found[0] == "+" else 0
    kept = 0
    while code > 0:
        code -= found[kept].isdigit()
        kept += 1
    return in_format(found, key, "phone", lambda i: i >= kept)


def ssn(found: str, key: bytes) -> str | None:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999: the valid numbers are permuted among themselves."""
    area, group, serial = int(found[:3]), int(found[4:6]), int(found[7:])
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    x = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, b"ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def ip(found: str, key: bytes) -> str | None:
    """An address of valid octets; octets are permuted within their number of digits, which keeps the length."""
    octets = found.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    sizes, firsts = {1: 10, 2: 90, 3: 156}, {1: 0, 2: 10, 3: 100}
    number = total = 0
    total = 1
    for o in octets:
        number, total = number * sizes[len(o)] + int(o) - firsts[len(o)], total * sizes[len(o)]
    number = permute(number, total, key, ("ip" + "".join(str(len(o)) for o in octets)).encode())
    out = []
    for o in reversed(octets):
        number, d = divmod(number, sizes[len(o)])
        out.append(str(d + firsts[len(o)]))
    return ".".join(reversed(out))


FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def day(found: str, key: bytes) -> str | None:
    """A real day from 1900 to 2099 in year-month-day, day.month.year or month/day/year."""
    a, b, c = (int(x) for x in re.findall(r"\d+", found))
    kind = "-" if "-" in found else "." if "." in found else "/"
    try:
        then = date(a, b, c) if kind == "-" else date(c, b, a) if kind == "." else date(c, a, b)
    except ValueError:
        return None
    x = (then - FIRST_DAY).days
    if not 0 <= x < DAYS:
        return None
    d = FIRST_DAY + timedelta(permute(x, DAYS, key, b"date"))
    return f"{d:%Y-%m-%d}" if kind == "-" else f"{d:%d.%m.%Y}" if kind == "." else f"{d:%m/%d/%Y}"


#: The lengths of IBANs by country.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20".split()}


def iban(found: str, key: bytes) -> str | None:
    raw = found.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    country = raw[:2].upper()
    if not 15 <= len(raw) <= 34 or number(raw[4:] + raw[:4]) % 97 != 1 or (raw != raw.upper() and IBAN_LENGTHS.get(country) != len(raw)):
        return None
    body = in_format(raw[4:], key, f"iban{country}")
    new = iter(f"{raw[:2]}{98 - number(body + raw[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(new) for c in found)


#: Letters of mailboxes and hosts: Latin, Greek, Cyrillic.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏͰ-ԯ"
#: In order of precedence; a later kind does not look inside what an earlier one has taken.
FINDERS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "email": (rf"@(?:[0-9{LETTERS}-]{{1,63}}\.)+[{LETTERS}]{{2,24}}", email),  # the mailbox is read backwards
    "iban": (r"\b[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,4})?\b", iban),
    "card": (r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])", card),
    "phone": (r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])", phone),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    "ip": (r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)", ip),
    "date": (r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-]|\.\d)", day),
}
PATTERNS = [(k, re.compile(p), f) for k, (p, f) in FINDERS.items()]
#: Groups of digits joined by single blanks or hyphens, of which some may be a card number.
RUN = re.compile(r"(?<!\d)\d++(?:[ -]\d++)++")
GROUP = re.compile(r"\d+")
MAILBOX = frozenset(c for c in map(chr, range(0x530)) if re.match(f"[0-9._%+'-]|[{LETTERS}]", c))
ANY = re.compile(r"\d|@")
OTHER_DIGITS = re.compile(r"[^\D0-9]")


def inner_cards(text: str) -> Iterator[tuple[int, int]]:
    """Card candidates beside other numbers: whole groups inside longer runs of digits, of two digits each at least. Those of 16 and 15 digits come first, then earlier and longer ones."""
    for run in RUN.finditer(text):
        groups = [m.span() for m in GROUP.finditer(text, *run.span())]
        while groups and re.match(r"[\w-]", text[groups[-1][1] : groups[-1][1] + 1]) and groups[-1][1] == run.end():
            groups.pop()
        found = []
        for i, (start, _) in enumerate(groups):
            if i == 0 and start and re.match(r"[\w.+-]", text[start - 1]):
                continue
            n = 0
            for a, b in groups[i : i + 10]:
                n += b - a
                if n > 19 or b - a < 2:
                    break
                if n >= 13:
                    found.append((n not in (15, 16), start, -n, b))
        for _, start, _, end in sorted(found):
            yield start, end


def mailbox_start(text: str, at: int) -> int:
    """Where the mailbox before an @ begins, of any length; it does not begin with a dot or a quotation mark."""
    start = at
    while start and text[start - 1] in MAILBOX:
        start -= 1
    while start < at and text[start] in ".'":
        start += 1
    return start


def candidates(kind: str, pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Spans to validate, in order of preference; they may overlap. Of a card or IBAN, whose run may take in a neighbour, also the shorter ends and later starts inside it."""
    if kind == "email":
        for m in pattern.finditer(text):
            if (start := mailbox_start(text, m.start())) < m.start():
                yield start, m.end()
        return
    if kind == "iban":
        at = 0
        while m := pattern.search(text, at):
            yield m.span()
            for i in range(m.end() - 1, m.start(), -1):
                if text[i] == " " and pattern.fullmatch(text, m.start(), i):
                    yield m.start(), i
            at = m.start() + 1
        return
    for m in pattern.finditer(text):
        yield m.span()
    if kind == "card":
        yield from inner_cards(text)


def pseudonymise(text: str, key: bytes = DEMO_KEY) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of each, in order. Lengths do not change; the time is in proportion to the text's length."""
    if not ANY.search(text):
        return text, []
    # Finds and permutations see ASCII digits; the digits of other scripts are put back as such.
    plain = text if text.isascii() else OTHER_DIGITS.sub(lambda m: str(unicodedata.decimal(m[0])), text)
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind, pattern, new in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        for a, b in candidates(kind, pattern, plain):
            if taken.find(1, a, b) < 0 and (value := new(plain[a:b], key)) is not None:
                found.append((a, b, kind, value if text is plain else in_scripts(value, text[a:b])))
                taken[a:b] = b"\1" * (b - a)
    found.sort()
    out, at = [], 0
    for a, b, _, value in found:
        out += [text[at:a], value]
        at = b
    return "".join([*out, text[at:]]), [(a, b, k) for a, b, k, _ in found]


def in_scripts(value: str, like: str) -> str:
    """The value with its digits in the scripts of the digits that stood in their places."""
    return "".join(chr(ord(old) - unicodedata.decimal(old) + int(new)) if OTHER_DIGITS.match(old) else new for new, old in zip(value, like, strict=True))


def pseudonyms(docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, spans (kind:start:end in code points, comma-joined, in order), and the number of each kind.

    A null or empty text has none. Repeated rows stay, each with the same pseudonyms; an empty table
    gives an empty one; other columns go. Texts are read whole, however long; where finds overlap, the
    order of the kinds and then of the candidates decides.
    """

    def replaced(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans, counts = [], [], {k: [] for k in KINDS}
        for t in b.column("text").to_pylist():
            new, found = pseudonymise(t, key)
            texts.append(new)
            spans.append(",".join([f"{k}:{a}:{e}" for a, e, k in found]))
            for k, n in counts.items():
                n.append(sum(f[2] == k for f in found))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(spans, pa.string()), *(pa.array(n, pa.int64()) for n in counts.values())], ["doc_id", "text", "spans", *(f"n_{k}" for k in counts)])

    return map_batches(id_and_text(docs, id_col, text_col), replaced, "doc_id long, text string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with its pseudonyms, their spans and the number of each kind, under the demonstration key."""
    return pseudonyms(documents(spark, sf_dir))


def without_private(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """All documents and columns, with pseudonyms in the text; null texts stay null, and so do empty tables and repeated rows what they are."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pseudonymise(t, key)[0])

    return docs.withColumn("text", replaced("text"))
