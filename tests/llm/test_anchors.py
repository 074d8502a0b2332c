import hashlib
import random
import re

from docs import frame, rows
from orderledger.llm.anchors import AnchorScanner, Span, listed, personal_data

# The base patterns as the contract states them.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    found = [Span("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [Span("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append(Span("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(Span("phone", *m.span()))
    return found


def test_base_spans_as_the_patterns():
    pick, scanner = random.Random(5), AnchorScanner()
    cards = ["4532015112830366", "4532 0151 1283 0366", "6011-0009-9013-9424", "45320151128303667"]
    parts = [*cards, "a.b@c.de", "@", "@@", "x@y", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "256.0.0.1",
             "0000001.2.3.4", "+1 (212) 555-0100", "+1", "+12+3456789012345", "+(1)", " ", "-", ".", "é", "٣", "account 123456", "12"]
    for _ in range(30_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 7)))
        assert listed(scanner.scan(text)[0]) == listed(brute(text)), text


def test_base_spans_over_the_tables(spark, sf_documents):
    got = {r["doc_id"]: r for r in rows(personal_data(sf_documents))}
    for doc_id, text in sf_documents.select("doc_id", "text").collect():
        spans = brute(text or "")
        assert got[doc_id]["base_sha256"] == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert {s for s in got[doc_id]["spans"].split(",") if s} >= {f"{s.kind}:{s.start}:{s.end}" for s in spans}
        for kind in ("email", "ip", "card", "phone"):
            assert got[doc_id][f"n_{kind}"] == sum(s.kind == kind for s in spans)


def test_added_spans():
    scanner = AnchorScanner()
    iban = "GB82 WEST 1234 5698 7654 32"
    base, added = scanner.scan(f"x {iban} and Account no: 12345678 at ftp://me:pw@host.org/")
    assert Span("account", 2, 2 + len(iban)) in added
    assert {s.kind for s in added} == {"account", "address"} and len(added) == 3
    assert not scanner.scan("GB83 WEST 1234 5698 7654 32 accountant of plain words")[1]


def test_awkward_rows(spark):
    docs = [(1, None), (1, ""), (None, "a@b.co"), (3, "1" * 20_000), (3, "1" * 20_000), (4, "+1" * 9_000 + "@" * 9_000)]
    got = rows(personal_data(frame(spark, docs, extra=True)))
    assert [r["spans"] for r in got] == ["", "", "email:0:6", "", "", ""]
    assert personal_data(frame(spark, [])).count() == 0


def test_added_spans_after_cues_in_any_spelling_and_with_borders():
    scanner = AnchorScanner()

    def added(text):
        return [(s.kind, text[s.start : s.end]) for s in scanner.scan(text)[1]]

    for text in ("Customer ID 12345678", "Tax ID: 12345678", "USER id 12345678", "é Konto: 12345678", "passport 12345678"):
        assert added(text) == [("account", "12345678")], text
    assert added("passport C01X00T47") == [("account", "C01X00T47")]
    for text in ("Falkonto 12345678", "misaccount: 12345678", "1konto 12345678", "account HOLDERS", "accounting 12345678"):
        assert added(text) == [], text
    login = "ftp://" + "u" * 5000 + ":" + "p" * 5000 + "@host.example.org"
    assert added(f"see {login} now") == [("address", login[6:])]
    assert added("İİ account 12345678") == [("account", "12345678")]


def test_added_spans_by_brute_force_over_made_texts():
    pick, scanner = random.Random(8), AnchorScanner()
    cue = re.compile(r"(?<![^\W_])(?:account|konto|ssn|tax id)(?:\x20?(?:number|no|nr|num|id))?\.?\x20?[:=#]?\x20?([0-9](?:[\x20-]?[0-9]){5,17}|(?-i:(?<![A-Za-z0-9])(?=(?:[A-Z]*[0-9]){4})[A-Z][A-Z0-9]{5,17}))(?![A-Za-z0-9])", re.I)
    parts = ["account", "Konto", "SSN", "Tax ID", " ", ": ", "#", "123456", "12 34-56", "x", "é", "no", ".", "77", "\n"]
    for _ in range(20_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 7)))
        expected = [m.span(1) for m in cue.finditer(text)]
        assert [(s.start, s.end) for s in scanner.scan(text)[1]] == expected, text
