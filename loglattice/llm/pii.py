"""Personal data by anchor expansion.

Method. One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, schemes, digits and the cue
words that stand before account numbers. From each anchor a small parser reads outwards and decides where
the item begins and ends and whether it is valid. A parser starts where the last item of its kind ended, so
every character is read a bounded number of times per kind.

Spans are (kind, start, end) in code points, end exclusive. Base kinds: email, ip, card, phone. Further
kinds: url (a scheme and an authority), account (an international bank account number with a right check sum, or
a number behind a cue word) and spoken (an address written with "at" and "dot" in brackets).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account", "spoken")
# The cues and schemes that are searched for.
CUES = ("ssn", "iban", "passport", "account no", "account number", "acct", "routing", "tax id")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
SPOKEN = ("[at]", "(at)")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"[ ().0-9-]+")
URL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?[^\s<>\"']*")
ACCOUNT = re.compile(r"[ #:.=-]{0,4}([A-Za-z0-9][A-Za-z0-9-]{4,33})")
FOUR = re.compile(r"[0-9]{4}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SPOKEN_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\.| dot ) ?[A-Za-z0-9-]+)+", re.IGNORECASE)


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("+", "+"), *((d, "0") for d in "0123456789"), *((s, "scheme") for s in SCHEMES), *((c, "cue") for c in CUES), *((s, "spoken") for s in SPOKEN)]:
        machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def email_at(text: str, at: int, done: int) -> tuple[int, int] | None:
    """The longest run of local characters before the sign, at least one, and two or more labels behind it."""
    start = at
    while start > done and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    found = DOMAIN.match(text, at + 1)
    return (start, found.end()) if found else None


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """From a plus sign and a digit to the last digit of the run behind them."""
    if not "0" <= text[at + 1 : at + 2] <= "9":
        return None
    run = PHONE.match(text, at + 2)
    if not run:
        return None
    end = run.end()
    while end > at + 3 and not "0" <= text[end - 1] <= "9":
        end -= 1
    return (at, end) if end > at + 3 else None


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """A bank account number around its two check digits, the longest with a right check sum."""
    if at < 2 or not (text[at - 2 : at].isascii() and text[at - 2 : at].isalpha() and text[at - 2 : at].isupper()):
        return None
    found = IBAN.match(text, at - 2)
    if not found:
        return None
    end = found.end()
    while end - (at - 2) >= 15:
        plain = text[at - 2 : end].replace(" ", "")
        if 15 <= len(plain) <= 34 and text[end - 1] != " " and not text[end : end + 1].isalnum() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return at - 2, end
        end -= 1
    return None


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of the text, by kind in the order of BASE + ADDED, then by start."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE + ADDED}
    done = dict.fromkeys(BASE + ADDED, 0)
    ip_from = card_from = 0
    for last, (kind, length) in anchors().iter(text if text.isascii() and text.islower() else fold(text)):
        at = last - length + 1
        if kind == "0":
            if at >= ip_from:
                if found := IP.match(text, at):
                    ip_from = found.end()
                    if all(int(p) <= 255 for p in short_parts(found[0])):
                        spans["ip"].append(found.span())
                else:  # a run of digits without what follows starts nowhere else
                    ip_from = DIGITS.match(text, at).end()
            if at >= card_from:
                found = CARD.match(text, at)
                card_from = found.end() if found else at + 1
                if found:
                    digits = found[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append(found.span())
            if at >= done["account"] and (found := iban_at(text, at)):
                spans["account"].append(found)
                done["account"] = found[1]
        elif kind == "@":
            if found := email_at(text, at, done["email"]):
                spans["email"].append(found)
                done["email"] = found[1]
        elif kind == "+":
            if at >= done["phone"] and (found := phone_at(text, at)):
                done["phone"] = found[1]
                if 9 <= sum("0" <= c <= "9" for c in text[found[0] : found[1]]) <= 15:
                    spans["phone"].append(found)
        elif kind == "scheme":
            if at >= done["url"] and (found := URL.match(text, last + 1)):
                spans["url"].append((at, found.end()))
                done["url"] = found.end()
        elif kind == "cue":
            before = text[at - 1 : at]
            if at >= done["account"] and not before.isalnum() and (found := ACCOUNT.match(text, last + 1)) and FOUR.search(found[1]):
                spans["account"].append(found.span(1))
                done["account"] = found.end()
        elif found := SPOKEN_DOMAIN.match(text, last + 1):
            end = at - (text[at - 1 : at] == " ")
            start = end
            while start > done["spoken"] and text[start - 1] in LOCAL:
                start -= 1
            if start < end:
                spans["spoken"].append((start, found.end()))
                done["spoken"] = found.end()
    return [(kind, *span) for kind in BASE + ADDED for span in spans[kind]]


def fold(text: str) -> str:
    """Lower case without a change of length, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def short_parts(address: str) -> list[str]:
    """The parts as numbers of at most three digits or 999: a long run of digits is never parsed whole."""
    return [p if len(p := q.lstrip("0") or "0") <= 3 else "999" for q in address.split(".")]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row; null text counts as empty.

    Each row is read by itself, so repeated rows, ties and extra columns change nothing; an empty table gives
    an empty result. The time for a text grows with its length alone.
    """

    def run(batches):
        for batch in batches:
            found = [find(t) if t else [] for t in (x.as_py() for x in batch.column(1))]
            counts = [pa.array([sum(s[0] == kind for s in f) for f in found], pa.int64()) for kind in BASE]
            digests = pa.array([hashlib.sha256(joined([s for s in f if s[0] in BASE]).encode()).hexdigest() for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(f) for f in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of text replaced by its kind in brackets; spans that overlap become one."""

    def run(batches):
        for batch in batches:
            texts = [masked(t) if t else t for t in (x.as_py() for x in batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], names=["_row", "_text"])

    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("_text"))
    out = rows.mapInArrow(run, f"_row {docs.schema.simpleString()}, _text string")
    return out.select(F.col("_row").withField("text", F.col("_text")).alias("_row")).select("_row.*")


def masked(text: str) -> str:
    out, at = [], 0
    for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
