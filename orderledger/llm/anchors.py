"""Personal data by anchor expansion.

An Aho-Corasick automaton reports the characters and cue words that personal data hang on:
at-signs, plus signs, digits, schemes and words such as "account". From each anchor a
local parser expands to both sides, finds the borders and validates what lies between.
Nothing else of a text is looked at by Python.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Order in which kinds that begin at the same place are listed. The first four are the base
#: kinds; the others are what the method adds.
KINDS = ("email", "ip", "card", "phone", "address", "account")

# Words before an account or identity number, in the languages of the tables.
CUES = (
    "account", "acct", "iban", "ssn", "passport", "konto", "kontonummer", "compte", "cuenta",
    "routing", "customer id", "user id", "tax id",
)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no|nr|num|id))?\.?\x20?[:=#]?\x20?([A-Z]{2}[0-9]{2}[\x20]?(?:[A-Z0-9]{4}[\x20]?){2,7}[A-Z0-9]{0,4}|[0-9](?:[\x20-]?[0-9]){5,17}|(?<![A-Za-z0-9])(?=(?:[A-Z]*[0-9]){4})[A-Z][A-Z0-9]{5,17})(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s/@]+@[A-Za-z0-9.-]+")
_DIGITS = frozenset("0123456789")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def build_automaton() -> ahocorasick.Automaton:
    """Anchors: single characters, the scheme mark, and the cues, for texts with A-Z in lower case."""
    automaton = ahocorasick.Automaton()
    for char in _DIGITS:
        automaton.add_word(char, "digit")
    automaton.add_word("@", "at")
    automaton.add_word("+", "plus")
    automaton.add_word("://", "scheme")
    for cue in CUES:
        automaton.add_word(cue, cue)
    automaton.make_automaton()
    return automaton


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _lowered(text: str) -> str:
    """A-Z in lower case and nothing else changed, so that all offsets hold."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")


class AnchorScanner:
    """Finds spans in one text; `base` are those of the fixed patterns, `added` the others."""

    def __init__(self) -> None:
        self.automaton = build_automaton()

    def scan(self, text: str) -> tuple[list[Span], list[Span]]:
        base: list[Span] = []
        added: list[Span] = []
        ends = {"email": 0, "ip": 0, "card": 0, "phone": 0}
        ip_run = card_run = iban_run = 0
        for last, anchor in self.automaton.iter(_lowered(text)):
            if anchor == "digit":
                # Only the first digit of a run can begin a match: the rest of the run would
                # have to end at the same place.
                if last >= ends["ip"] and last >= ip_run:
                    ip_run = self._ip(text, last, base, ends)
                if last >= card_run:
                    card_run = self._card(text, last, base)
                if last >= iban_run and last >= 2:
                    iban_run = self._iban(text, last, added)
            elif anchor == "at":
                self._email(text, last, base, ends)
            elif anchor == "plus":
                if last >= ends["phone"]:
                    self._phone(text, last, base, ends)
            elif anchor == "scheme":
                self._scheme(text, last + 1, added)
            else:
                self._account(text, last - len(anchor) + 1, last, added)
        return base, added

    @staticmethod
    def _ip(text: str, at: int, found: list[Span], ends: dict[str, int]) -> int:
        match = _IP.match(text, at)
        if match is None:
            end = at + 1
            while end < len(text) and text[end] in _DIGITS:
                end += 1
            return end
        ends["ip"] = match.end()
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match.groups()):
            found.append(Span("ip", at, match.end()))
        return match.end()

    @staticmethod
    def _card(text: str, at: int, found: list[Span]) -> int:
        match = _CARD.match(text, at)
        if match is None:
            return at + 1
        digits = _digits(match.group()) if match.end() - at <= 64 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append(Span("card", at, match.end()))
        return match.end()

    @staticmethod
    def _phone(text: str, at: int, found: list[Span], ends: dict[str, int]) -> None:
        match = _PHONE.match(text, at)
        if match is None:
            return
        ends["phone"] = match.end()
        if 10 <= sum(c in _DIGITS for c in match.group()) <= 15:
            found.append(Span("phone", at, match.end()))

    @staticmethod
    def _email(text: str, at: int, found: list[Span], ends: dict[str, int]) -> None:
        start = at
        while start > ends["email"] and _LOCAL.match(text[start - 1]):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match is not None:
            ends["email"] = match.end()
            found.append(Span("email", start, match.end()))

    @staticmethod
    def _scheme(text: str, at: int, added: list[Span]) -> None:
        """The login in an address such as ftp://user:word@host."""
        match = _USERINFO.match(text, at)
        if match is not None:
            added.append(Span("address", at, match.end()))

    @staticmethod
    def _iban(text: str, at: int, added: list[Span]) -> int:
        """An account number that carries its own check digits, cue or not."""
        start = at - 2
        if start and (text[start - 1].isalnum()):
            return at + 1
        match = _IBAN.match(text, start)
        if match is None:
            return at + 1
        plain = match.group().replace(" ", "")
        if 15 <= len(plain) <= 34 and _mod97(plain):
            added.append(Span("account", start, match.end()))
            return match.end()
        return at + 1

    @staticmethod
    def _account(text: str, start: int, last: int, added: list[Span]) -> None:
        """A number that follows a cue word; the cue may not be part of a longer word."""
        if start and text[start - 1].isalnum():
            return
        match = _ACCOUNT.match(text, last + 1)
        if match is not None and not any(a.start < match.end(1) and match.start(1) < a.end for a in added[-4:]):
            added.append(Span("account", *match.span(1)))


def listed(spans: list[Span]) -> str:
    """kind:start:end by start, then by the order of the kinds, joined by commas."""
    ordered = sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in ordered)


FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)


def personal_data(docs: DataFrame) -> DataFrame:
    """Count and list the personal data of every whole text, in one pass without a shuffle.

    Offsets count code points, ends are exclusive. A null or empty text has no spans.
    Repeated rows are scanned as they are; only doc_id and text are read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = AnchorScanner()
        for batch in batches:
            out = []
            for text in batch.column(1):
                base, added = scanner.scan(text.as_py() or "")
                spans = sorted({*base, *added})
                counts = [sum(s.kind == kind for s in spans) for kind in KINDS]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                out.append((*counts, digest, listed(spans)))
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], FOUND.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(scan, FOUND)
