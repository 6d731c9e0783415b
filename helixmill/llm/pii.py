"""Personal data and secrets in texts: patterns propose, checks confirm, context words adjust the score.

Each kind has a pattern, a check (Luhn for payment cards, mod-97 and the country's length for IBANs, octets for IPv4
addresses, area rules for social security numbers, digit counts for telephone numbers) and words that speak for or
against it within ``NEAR`` characters. A span whose check fails is dropped whatever stands near it; of card numbers
and IBANs, which run on over blanks and hyphens, what ends at one of these before, or begins after one, is tried first.
The score is the
kind's base, plus ``BOOST`` if a word speaks for it, less ``BOOST`` if one speaks against it; spans of ``LEAST`` or more
count. Of spans that overlap the one of the highest score stays, then the longest, then the first.

Defined results. Null and empty texts have no spans; a row of null doc_id has its spans under null. Rows that repeat are
searched each for itself. Texts are searched whole: the quick test for a digit or "@", without which no kind can match,
looks at all of them. ``start_char`` and ``end_char`` count code points. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from helixmill.llm._text import chunks

NEAR = 40
BOOST = 0.3
LEAST = 0.5


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and sum(digits[0::2]) % 10 == -sum(d * 2 - 9 * (d > 4) for d in digits[1::2]) % 10


_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}


def iban(text: str) -> bool:
    s = re.sub(r"[ -]", "", text).upper()
    if len(s) != _IBAN_LENGTH.get(s[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ipv4(text: str) -> bool:
    parts = text.split(".")
    return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in parts) and parts[0] != "0"


def ssn(text: str) -> bool:
    area, group, serial = text.split(text[3])
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def phone(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return 8 <= len(digits) <= 15 and len(set(digits)) > 2 and not re.fullmatch(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4}", text) and not re.fullmatch(r"\d+(?:\.\d+){3}", text)


def email(text: str) -> bool:
    user, _, host = text.rpartition("@")
    return len(user) <= 64 and ".." not in text and not host.startswith("-")


def secret(text: str) -> bool:
    return len(set(text.lower())) >= 8 and bool(re.search(r"\d", text)) and bool(re.search(r"[A-Za-z]", text))


class Kind(NamedTuple):
    name: str
    pattern: re.Pattern
    check: Callable[[str], bool]
    base: float
    pro: re.Pattern
    contra: re.Pattern
    groups: bool = False


def _words(*words: str) -> re.Pattern:
    return re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(words) + r")(?![^\W_])") if words else re.compile(r"(?!)")


KINDS = (
    Kind("EMAIL", re.compile(r"(?<![\w.+%-])[\w.+%-]+@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,24}(?![\w-])"), email, 0.9, _words("mail", "e-?mail", "contact", "write"), _words()),
    Kind("CREDIT_CARD", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"), luhn, 0.7, _words("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "carte", "karte", "tarjeta"), _words("isbn", "order", "tracking", "serial", "invoice", "imei"), True),
    Kind("IBAN", re.compile(r"(?<![\w-])[A-Za-z]{2}\d{2}(?:[ -]?[A-Za-z0-9]{4}){2,7}(?:[ -]?[A-Za-z0-9]{1,3})?(?![\w-])"), iban, 0.9, _words("iban", "account", "bank", "konto", "compte", "cuenta"), _words(), True),
    Kind("IPV4", re.compile(r"(?<![\w.+-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)"), ipv4, 0.6, _words("ip", "host", "server", "address", "client", "from"), _words("version", "release", "section", "chapter")),
    Kind("US_SSN", re.compile(r"(?<![\w.+-])\d{3}([ -])\d{2}\1\d{4}(?![\w-]|\.\d)"), ssn, 0.6, _words("ssn", "social", "security", "tax"), _words("order", "part", "isbn", "invoice")),
    Kind("PHONE", re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-]|\.\d)|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{1,4}){2,6}(?![\w-]|\.\d)"), phone, 0.7, _words("tel", "phone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"), _words("isbn", "invoice")),
    Kind("PHONE", re.compile(r"(?<![\w.+-])\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-]|\.\d)"), phone, 0.3, _words("tel", "phone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"), _words("isbn", "invoice", "version", "order")),
    Kind("SECRET", re.compile(r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{36,}|sk-[\w-]{20,}|xox[abprs]-[\w-]{10,})(?![\w-])"), secret, 0.8, _words("key", "token", "secret"), _words("example")),
    Kind("SECRET", re.compile(r"(?<![\w-])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\w-])"), secret, 0.3, _words("key", "api", "apikey", "api_key", "token", "secret", "password", "passwd", "auth", "bearer"), _words("commit", "sha1", "sha256", "md5", "checksum", "digest")),
)


def _confirmed(kind: Kind, text: str) -> Iterator[tuple[int, int]]:
    """Spans of a kind that pass its check; of groups the most that do, the search going on behind them."""
    at = 0
    while m := kind.pattern.search(text, at):
        a, at = m.span()
        if kind.check(m[0]):
            yield a, at
        elif kind.groups:
            end = next((e for e in range(at - 1, a, -1) if text[e] in " -" and kind.check(text[a:e])), 0)
            at = end or a + 1
            if end:
                yield a, end


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the spans of a text, in order."""
    found = []
    for kind in KINDS:
        for a, b in _confirmed(kind, text):
            before, after = text[max(0, a - NEAR) : a], text[b : b + NEAR]
            score = kind.base
            if kind.pro.search(before) or kind.pro.search(after):
                score += BOOST
            if kind.contra.search(before) or kind.contra.search(after):
                score -= BOOST
            if round(score, 6) >= LEAST:
                found.append((-min(1.0, round(score, 6)), a - b, a, b, kind.name))
    taken: list[tuple[int, int, str, float]] = []
    if len(found) > 1:
        found.sort()
        used: list[tuple[int, int]] = []
        for score, _, a, b, name in found:
            at = bisect(used, (a, b))
            if (at and used[at - 1][1] > a) or (at < len(used) and used[at][0] < b):
                continue
            used.insert(at, (a, b))
            taken.append((a, b, name, -score))
        return sorted(taken)
    return [(a, b, name, -score) for score, _, a, b, name in found]


_SCHEMA = "doc_id long, kind string, start_char int, end_char int, score double"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            likely = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(part.column("text"), r"[0-9@]|\p{Nd}"), False)))
            if not len(likely):
                continue
            part = part.take(pa.array(likely))
            rows = [(d, kind, a, b, score) for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for a, b, kind, score in find(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "kind", "start_char", "end_char", "score"])


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start_char, end_char, score) of every span in every row."""
    return docs.select("doc_id", "text").mapInArrow(_find, _SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of text replaced by its kind in brackets; nulls stay."""
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if text:
                    for a, b, kind, _ in reversed(find(text)):
                        text = f"{text[:a]}[{kind}]{text[b:]}"
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    return docs.mapInArrow(run, schema)
