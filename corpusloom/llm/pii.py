"""PII: patterns propose spans, checksums confirm them, context words nearby adjust the score.

Every kind starts from a score of its own. One of its context words within WINDOW characters on either side raises it by
GAIN, one of its counter-words (an order or a part number looks like much else) lowers it by LOSS. Findings are kept
from KEEP on. The agreed base kinds are e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone
numbers: they are listed whatever their score, which only says how sure they are. The method adds IBANs (mod 97), which
counter-words can take back, and numbers in social-security form, which need a context word. Matches are leftmost and do
not overlap within a kind; one that fails its check is dropped without another try. Spans count code points, end
exclusive; equal starts are listed by kind. Words of the context are runs of A-Z, case aside.

A null text is empty. Repeated rows give repeated results. An empty table has no result rows. Texts of any length are
scanned whole. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.functions.generate import bounded_batches

WINDOW, KEEP, GAIN, LOSS = 48, 0.6, 0.3, 0.3


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _card(text: str) -> bool:
    digits = _digits(text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))


def _phone(text: str) -> bool:
    return 10 <= len(_digits(text)) <= 15


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and mod97(plain)


def _ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    name: str
    #: Characters without which the pattern can't match.
    needs: str
    pattern: re.Pattern
    check: object
    score: float
    words: frozenset[str]
    against: frozenset[str]


#: What other long numbers are called near them
_NUMBERS = frozenset({"order", "invoice", "tracking", "serial", "part", "isbn", "version", "ticket"})
KINDS = (
    Kind("email", "@", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), None, 0.7, frozenset({"mail", "email", "contact", "write", "reach"}), frozenset({"example", "noreply"})),
    Kind("ip", ".", re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), _ip, 0.5, frozenset({"ip", "address", "host", "server", "login"}), frozenset({"version", "release", "section"})),
    Kind("card", "", re.compile(r"[0-9]([\x20-]?[0-9])+"), _card, 0.5, frozenset({"card", "credit", "visa", "mastercard", "karte", "carte", "tarjeta"}), _NUMBERS),
    Kind("phone", "+", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), _phone, 0.5, frozenset({"phone", "call", "tel", "mobile", "telefon"}), _NUMBERS),
    Kind("iban", "", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII), _iban, 0.6, frozenset({"iban", "account", "konto", "compte", "cuenta", "bank"}), _NUMBERS),
    Kind("ssn", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _ssn, 0.4, frozenset({"ssn", "social", "security", "insurance"}), _NUMBERS),
)
BASE = ("email", "ip", "card", "phone")
_WORD = re.compile(r"[A-Za-z]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the e-mail pattern, each found from its @ backwards: linear where the pattern itself would not be."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at)
        if found and start < at:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def score(kind: Kind, text: str, start: int, end: int) -> float:
    """The kind's score, raised by context words and lowered by counter-words on either side."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW])}
    return round(kind.score + GAIN * bool(kind.words & near) - LOSS * bool(kind.against & near), 2)


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all findings, by start and then kind as listed."""
    found = []
    has_digit = any(map(text.__contains__, "0123456789"))
    for order, kind in enumerate(KINDS):
        if kind.needs not in text or (kind.name != "email" and not has_digit):
            continue
        matches = _emails(text) if kind.name == "email" else (m.span() for m in kind.pattern.finditer(text))
        for start, end in matches:
            if kind.check and not kind.check(text[start:end]):
                continue
            value = score(kind, text, start, end)
            if kind.name in BASE or value >= KEEP:
                found.append((start, order, end, kind.name, value))
    return [(start, end, name, value) for start, _, end, name, value in sorted(found)]


_OUT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            found = spans(text.as_py() or "")
            base = ",".join(f"{k}:{a}:{b}" for a, b, k, _ in found if k in BASE)
            counts = [sum(k == name for *_, k, _ in found) for name in BASE]
            rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for a, b, k, _ in found), ",".join(f"{v:.2f}" for *_, v in found)))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 3
        names = [c.split()[0] for c in _OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores of every row of documents (doc_id, text)."""
    bounded_batches(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_scan, _OUT)
