"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses.

What is found in a text is first validated (Luhn digit of card numbers, mod-97 of bank accounts, calendar of
dates, octets of IPv4 addresses, area rules of social security numbers, digit counts of telephone numbers) and
then permuted by a keyed Feistel network within its own format: a card number becomes a card number with a
valid check digit, a date a date, separators stay where they are. The permutation depends on key, kind and
value only, so equal values stay equal across documents, whatever their separators, and different ones differ.
A telephone number keeps its country code, a mail address its top-level domain; name and host are permuted
apart, so addresses of one host stay together. Nothing is stored and no table is shared between tasks.

Only texts with two digits in a row, a digit, a dot and a digit, or an @ go to Python, and there only their
words with digits or an @, with the words next to them that a number in groups may go on in.

Null texts stay null and have no findings; empty texts stay empty. Texts are read whole. Repeated rows get equal
results. Other columns aren't touched; one named like the result is replaced.
"""

from __future__ import annotations

import datetime
import re
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

PATTERN = re.compile(
    r"(?P<mail>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<iso>(?<![0-9-])(?:19|20)[0-9][0-9]([-/.])[0-9][0-9]\4[0-9][0-9](?![0-9-]))"
    r"|(?P<day>(?<![0-9./-])[0-9]{1,2}([-/.])[0-9]{1,2}\6(?:19|20)[0-9][0-9](?![0-9-]))"
    r"|(?P<ip>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\w+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]))"
    r"|(?P<card>(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\11[0-9]{4}\11[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\12[0-9]{5})(?![0-9-]))"
)

#: Words that hold an @ or a digit, and what may follow in the same number: more of them, or groups of capitals.
WINDOW = re.compile(r"(?<!\S)[^\s@0-9]*+[@0-9]\S*+(?: (?:[^\s@0-9]*+[@0-9]\S*+|[A-Z]{1,4}(?!\S)))*+")
#: The same for the JVM, wider: texts without such a place can't hold a find.
WORTH = r"@|\d\d|\d\.\d"
#: The two-digit country codes of the telephone numbering plan; 1 and 7 are single, all others have three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


class Feistel:
    """Keyed permutations of [0, n): eight balanced rounds over the next even number of bits, walking cycles."""

    def __init__(self, key: bytes):
        self.key = key

    def permute(self, value: int, n: int, kind: str) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for i in range(8):
                message = f"{kind}|{n}|{i}|{right}".encode()
                left, right = right, left ^ (int.from_bytes(blake2b(message, key=self.key, digest_size=16).digest(), "big") & mask)
            value = (left << half) | right
            if value < n:
                return value


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _into(template: str, signs: str, taken) -> str:
    """template with its characters that ``taken`` accepts replaced by signs in order."""
    rest = iter(signs)
    return "".join(next(rest) if taken(c) else c for c in template)


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


class Pseudonymizer:
    def __init__(self, key: bytes):
        self.net = Feistel(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def digits(self, kind: str, s: str) -> str:
        return str(self.net.permute(int(s), 10 ** len(s), f"{kind}{len(s)}")).zfill(len(s)) if s else s

    def of(self, kind: str, found: str) -> str | None:
        """The pseudonym of a found string, None if it isn't valid."""
        at = (kind, found)
        if at not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[at] = getattr(self, f"_{kind}")(found)
        return self.known[at]

    def _card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        body = self.digits("card", d[:-1])
        return _into(s, body + luhn_digit(body), str.isdigit)

    def _phone(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        code = 0 if s[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in TWO_DIGITS else 3
        if not 7 <= len(d) - code <= 14:
            return None
        return _into(s, d[:code] + self.digits("phone", d[code:]), str.isdigit)

    def _ssn(self, s: str) -> str | None:
        area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        place, serial = divmod(self.net.permute(place, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(place, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _ip(self, s: str) -> str | None:
        octets = s.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        n = self.net.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip")
        return ".".join(map(str, n.to_bytes(4, "big")))

    def _iban(self, s: str) -> str | None:
        d = s.replace(" ", "")
        if int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 != 1:
            return None
        body = _into(d[4:], self.digits("iban", re.sub(r"\D", "", d[4:])), str.isdigit)
        return _into(s, d[:2] + f"{_iban_check(d[:2], body):02d}" + body, lambda c: c != " ")

    def _date(self, year: int, month: int, day: int) -> datetime.date | None:
        try:
            n = datetime.date(year, month, day).toordinal() - FIRST_DAY
        except ValueError:
            return None
        return datetime.date.fromordinal(FIRST_DAY + self.net.permute(n, LAST_DAY - FIRST_DAY + 1, "date"))

    def _iso(self, s: str) -> str | None:
        d = self._date(int(s[:4]), int(s[5:7]), int(s[8:]))
        return d and f"{d.year:04d}{s[4]}{d.month:02d}{s[7]}{d.day:02d}"

    def _day(self, s: str) -> str | None:
        """Day first; month first where only that is a date. Always two digits each, so that dates stay dates."""
        a, sign, b, year = re.match(r"(\d+)(\D)(\d+)\D(\d+)", s).groups()
        if int(b) <= 12:
            d = self._date(int(year), int(b), int(a))
            return d and f"{d.day:02d}{sign}{d.month:02d}{sign}{d.year:04d}"
        d = self._date(int(year), int(a), int(b))
        return d and f"{d.month:02d}{sign}{d.day:02d}{sign}{d.year:04d}"

    def word(self, kind: str, s: str) -> str:
        """Letters and digits permuted, each among themselves; other signs stay."""
        letters = [c for c in s if c.isalpha()]
        n = 0
        for c in letters:
            n = n * 26 + ord(c.lower()) - 97
        word = []
        n = self.net.permute(n, 26 ** len(letters), f"{kind}{len(letters)}") if letters else 0
        for _ in letters:
            n, c = divmod(n, 26)
            word.append(chr(97 + c))
        out = _into(s, "".join(reversed(word)), str.isalpha)
        return _into(out, self.digits(kind, re.sub(r"\D", "", s)), str.isdigit)

    def _mail(self, s: str) -> str | None:
        local, domain = s.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        return f"{self.word('mail', local)}@{self.word('host', host)}.{top}"

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of what was replaced, in the original's characters."""
        out, spans, done = [], [], 0
        for window in WINDOW.finditer(text):
            end = window.end()
            m = PATTERN.search(text, window.start(), end)
            while m:
                kind = m.lastgroup
                new = self.of(kind, m[0])
                if new is not None:
                    out += [text[done : m.start()], new]
                    spans.append(({"iso": "date", "day": "date"}.get(kind, kind), m.start(), m.end()))
                    done = m.end()
                # what begins inside an invalid find may still be valid
                m = PATTERN.search(text, m.end() if new is not None else m.start() + 1, end)
        return "".join([*out, text[done:]]), spans


def pseudonymize(docs: DataFrame, key: bytes, *, text_col: str = "text", out_col: str = "pseudonymized") -> DataFrame:
    """docs with out_col: struct(text, spans array<struct(kind, start, end)>)."""
    schema = "text string, spans array<struct<kind: string, start: int, end: int>>"

    @F.pandas_udf(schema)
    def of(text):
        import pandas as pd

        names = Pseudonymizer(key)
        rows = [names.text(t) if t is not None else (None, []) for t in text]
        return pd.DataFrame({"text": [r[0] for r in rows], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in r[1]] for r in rows]})

    text = F.col(f"`{text_col}`").cast("string")
    worth = text.rlike(WORTH)
    found = of(F.when(worth, text))
    as_is = F.struct(text.alias("text"), F.array().cast("array<struct<kind: string, start: int, end: int>>").alias("spans"))
    return docs.withColumn(out_col, F.when(worth, found).otherwise(as_is))
