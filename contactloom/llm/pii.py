"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, dots between digits, plus signs, digits,
scheme strings and identifier cues.  At each anchor a deterministic parser for its kind expands to
the left and right, and validates what it has read.  No parser looks at a text as a whole.

Base kinds, leftmost and non-overlapping within a kind; a match that fails validation is dropped
and reading goes on behind it:

* email: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip: four numbers joined by dots, each at most 255
* card: digits with at most one space or hyphen between two, 14 to 19 of them, passing Luhn
* phone: ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 10 to 15 digits

Kinds that the method adds: url (a scheme or ``www.``), iban (country, check digits, mod 97),
account (a number behind a cue such as ``account no.``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")
Span = tuple[str, int, int]

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'|]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
#: No repeat gives back what it has read, as nothing behind it could use that: one pass, however long.
_BEHIND_CUE = re.compile(r"[\s:#.]*+(?:no\.?|number|nr\.?)?[\s:#=]*+([A-Z]{0,4}[0-9][0-9 -]{4,30}[0-9])", re.IGNORECASE)
#: What starts a web address, and words before an account number.
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
CUES = ("account", "acct", "iban", "konto", "cuenta", "compte")


def automaton():
    """Anchors with their kind.  Cues are listed in lower case, with a capital, and in capitals."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for d in _DIGITS:
        found.add_word(d, ("digit", 1))
    for kind, words in (("url", SCHEMES), ("cue", CUES)):
        for word in words:
            for form in {word, word.capitalize(), word.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _mod97(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def spans(text: str, anchors) -> list[Span]:
    """All spans (kind, start, end) of a text, in code points, the end exclusive, by start and then
    by kind in the order of BASE and ADDED."""
    out: list[Span] = []
    email_end = ip_at = card_at = phone_at = url_end = account_end = 0
    for last, (kind, length) in anchors.iter(text):
        start = last - length + 1
        if kind == "digit":
            if start >= card_at:  # the first digit of a run, as runs are read to their ends
                m = _CARD.match(text, start)
                if m is None:
                    card_at = start + 1
                else:
                    card_at = m.end()
                    own = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(own) <= 19 and luhn(own):
                        out.append(("card", start, m.end()))
            if start >= ip_at:
                m = _QUAD.match(text, start)
                if m is None:
                    # a later start within these digits has the same dots behind it
                    ip_at = start + 1
                    while ip_at < len(text) and text[ip_at] in _DIGITS:
                        ip_at += 1
                else:
                    ip_at = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                        out.append(("ip", start, m.end()))
        elif kind == "email":
            left = start
            while left > email_end and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (m := _LABELS.match(text, start + 1)):
                out.append(("email", left, m.end()))
                email_end = m.end()
        elif kind == "phone":
            if start >= phone_at and (m := _PHONE.match(text, start)):
                phone_at = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append(("phone", start, m.end()))
        elif kind == "url":
            if start >= url_end and (m := _URL.match(text, last + 1)):
                end = m.end()
                while end > last + 1 and text[end - 1] in ".,;:!?)]}":
                    end -= 1
                if end > last + 1:
                    out.append(("url", start, end))
                    url_end = end
        elif start >= account_end:
            at = last + 1
            while at < len(text) and text[at] in " :#.=":
                at += 1
            m = _IBAN.match(text, at)
            if m is not None and len(own := m[0].replace(" ", "")) <= 34 and _mod97(own):
                out.append(("iban", at, m.end()))
                account_end = m.end()
            elif (m := _BEHIND_CUE.match(text, last + 1)) and sum(c in _DIGITS for c in m[1]) >= 6:
                out.append(("account", m.start(1), m.end(1)))
                account_end = m.end(1)
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def find(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, spans (array of kind, start, end), and what
    base spans amount to: n_email, n_ip, n_card, n_phone and base_sha256.

    Null and empty texts have no spans.  Very long texts are read in one pass.  Repeated rows get
    equal results.  An empty table gives an empty result.  Other columns, of any name, are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [spans(t, anchors) if t else [] for t in batch.column(1).to_pylist()]
            base = [[s for s in own if s[0] in BASE] for own in found]
            counts = [pa.array([sum(s[0] == kind for s in own) for own in base], pa.int64()) for kind in BASE]
            digests = [hashlib.sha256(joined(own).encode()).hexdigest() for own in base]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(rows, kind_of)],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<kind:string,start:long,end:long>>")
