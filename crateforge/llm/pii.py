"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Base kinds (always kept, whatever their score): email, ip, card (Luhn), phone. Added by the method, where they overlap no
base span and reach ``threshold`` after the context words are counted: iban (mod-97), short_card (13 to 15 digits, Luhn),
bank_code (9 digits, weights 3, 7, 1) and id_number. The last three look like ordinary numbers, so none reaches the
threshold without a context word.

Every pattern reads each run of characters once, so that time grows with the length of a text whatever it holds: very
long texts, also of one run of digits, are scanned whole.

Added spans overlap neither base spans nor each other: of those that would, the likelier stays.

Defined results: null and empty texts have no spans; an empty table gives no rows; offsets are code points; repeated rows
give repeated results; extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.llm import spans
from crateforge.llm.common import wanted

KINDS = ["email", "ip", "card", "phone"]
# The patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # starts at the first digit of a run, as the leftmost match does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ID_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
BANK_CODE = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])")
DIGIT = re.compile(r"[0-9]")
# Words that make a kind likelier when they stand within WINDOW code points.
CONTEXT = {
    "email": ("mail", "contact", "write to", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "master", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "id_number": ("ssn", "social security", "taxpayer", "identity"),
    "short_card": ("card", "visa", "amex", "american express", "diners", "credit", "karte", "tarjeta", "carte"),
    "bank_code": ("routing", "aba", "transit", "sort code", "bank"),
}
#: Score before context, and what each context word adds up to TOP.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.75, "id_number": 0.35, "short_card": 0.5, "bank_code": 0.45}
WINDOW, STEP, TOP = 48, 0.15, 0.99


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def weighted_sum(digits: str) -> bool:
    """The check of nine-digit bank codes: weights 3, 7, 1 in turn, a multiple of 10 and not all zeros."""
    return any(c != "0" for c in digits) and sum(w * int(d) for w, d in zip((3, 7, 1) * 3, digits)) % 10 == 0


def score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
    return min(TOP, PRIOR[kind] + STEP * sum(w in near for w in CONTEXT[kind]))


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of EMAIL, found from their @ signs, so that texts without any cost nothing."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, floor := m.end()))
        at = text.find("@", max(at + 1, floor))
    return out


def cards(text: str, least: int, most: int) -> list[tuple[int, int]]:
    """Runs of digits, single blanks or hyphens between them, of so many digits, that Luhn's check confirms."""
    return [m.span() for m in CARD.finditer(text) if least <= len(digits := m[0].replace(" ", "").replace("-", "")) <= most and luhn(digits)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind, then start."""
    found = [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        found += [("card", *s) for s in cards(text, 16, 19)]
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """Confirmed codes; the search goes on at the end of each, or one place after the start of what none confirmed."""
    out, m = [], IBAN.search(text)
    while m:
        code = m[0]
        while len(code) >= 15 and not mod97(code):  # the pattern may have run into the next word
            code = code[:-1].rstrip(" ")
        if len(code) >= 15:
            out.append((m.start(), m.start() + len(code)))
        m = IBAN.search(text, out[-1][1] if len(code) >= 15 else m.start() + 1)
    return out


def apart(found: list[tuple]) -> list[tuple]:
    """Of spans (kind, start, end, score, ...) that overlap the one of higher score stays, then the longer, the earlier, the one of the lesser kind."""
    starts: list[int] = []
    kept: dict[int, tuple] = {}
    for s in sorted(found, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        at = bisect_left(starts, s[2])  # those before begin before its end
        if not at or kept[starts[at - 1]][2] <= s[1]:
            starts.insert(bisect_left(starts, s[1]), s[1])
            kept[s[1]] = s
    return [kept[a] for a in starts]


def find(text: str, threshold: float = 0.6) -> tuple[list[tuple], list[tuple]]:
    """Base spans and all spans, each (kind, start, end, score, base), by kind, then start."""
    base = [(k, a, b, score(text, k, a, b), True) for k, a, b in base_spans(text)]
    if not DIGIT.search(text):
        return base, base
    proposed = [("iban", *s) for s in ibans(text)] + [("id_number", *m.span()) for m in ID_NUMBER.finditer(text)] + [("short_card", *s) for s in cards(text, 13, 15)]
    proposed += [("bank_code", *m.span()) for m in BANK_CODE.finditer(text) if weighted_sum(m[0])]
    taken = spans.Taken(base)
    more = [(k, a, b, s, False) for k, a, b in proposed if taken.free(a, b) and (s := score(text, k, a, b)) >= threshold]
    kept = set(apart(more))
    return base, base + [s for s in more if s in kept]


def pii(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_email, n_ip, n_card, n_phone, base_sha256, spans (line), found (structs with scores)."""
    docs = wanted(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return docs.mapInArrow(spans.scan(lambda: lambda text: find(text, threshold), KINDS), spans.schema(KINDS))
