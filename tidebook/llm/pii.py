r"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single pass: at
signs, ``://``, plus signs, digits next to a dot, digit groups and cue words.
Around each anchor a local parser reads as far as its kind allows and validates
what it has read. Every parser looks at the run of its own characters once, so
the work is linear in the text, whatever it holds.

Base kinds, leftmost and not overlapping within a kind:

* email: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
* ip: four dotted numbers of at most 255
* card: 12 to 19 digits with single blanks or hyphens between, passing Luhn
* phone: ``\+[0-9][\x20().0-9-]+[0-9]`` with 9 to 15 digits

Added kinds:

* url: ``scheme://user:password@host`` with its credentials
* iban: two letters, two check digits and 11 to 30 more, passing mod 97
* account: the value after a cue such as ``password=`` or ``token = "``
* key: an access key id: its four-letter cue and 16 capitals or digits
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidebook.llm.common import extended, fresh, in_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "key")
#: Cue words before a value (fixed values).
CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "account", "passport", "ssn")
KEY_CUES = ("AKIA", "ASIA")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_VALUE = re.compile(r"""\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9+/_.-]{6,})""")
_KEY = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")
_DIGITS = frozenset("0123456789")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [("@", "email"), ("://", "url"), ("+", "phone"), *((c, "account") for c in CUES), *((c.upper(), "account") for c in CUES), *((c.capitalize(), "account") for c in CUES), *((c, "key") for c in KEY_CUES)]:
        found.add_word(word, (kind, len(word)))
    for a in "0123456789":
        found.add_word(f"{a}.", ("ip", 2))
        for b in "0123456789":
            found.add_word(a + b, ("card", 2))
            for gap in " -":
                found.add_word(a + gap + b, ("card", 3))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _email(text: str, at: int, done: int) -> tuple[int, int] | None:
    """Around an at sign: left over local characters, right over a dotted domain."""
    domain = _DOMAIN.match(text, at + 1)
    if domain is None:
        return None
    start = at
    while start > done and text[start - 1] in _LOCAL:
        start -= 1
    return (start, domain.end()) if start < at else None


def _ips(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Fours of neighbouring numbers in a run of digits and dots, from the left."""
    at, parts = start, []
    for part in text[start:end].split("."):
        if part:
            parts.append((at, part))
        else:
            parts = []
        if len(parts) == 4:
            if all(len(p) <= 3 or not p[:-3].strip("0") for _, p in parts) and all(int(p[-3:]) <= 255 for _, p in parts):
                yield parts[0][0], at + len(part)
            parts = []
        at += len(part) + 1


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """From two letters and two check digits; the longest end at which the check holds."""
    found = _IBAN.match(text, at)
    if found is None or (at and text[at - 1].isalnum()):
        return None
    for end in range(found.end(), at + 14, -1):
        body = text[at:end].replace(" ", "")
        if text[end - 1] != " " and len(body) >= 15 and not text[end : end + 1].isalnum() and _mod97(body):
            return at, end
    return None


class Finder:
    """Spans of one text after the other; the automaton is built once."""

    def __init__(self) -> None:
        self.anchors = _anchors()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, index of the kind, end) in code points, in order."""
        out: list[tuple[int, int, int]] = []
        done = dict.fromkeys(KINDS, 0)  # up to where each kind has read

        def add(kind: str, span: tuple[int, int] | None) -> None:
            if span is not None:
                out.append((span[0], KINDS.index(kind), span[1]))
                done[kind] = max(done[kind], span[1])

        for last, (kind, width) in self.anchors.iter(text):
            at = last - width + 1
            if kind == "email":
                if at >= done["email"]:
                    add("email", _email(text, at, done["email"]))
            elif kind == "phone":
                if at >= done["phone"] and (found := _PHONE.match(text, at)):
                    done["phone"] = found.end()
                    if 9 <= sum(c in _DIGITS for c in found.group()) <= 15:
                        add("phone", found.span())
            elif kind == "ip":
                if at >= done["ip"]:
                    start = at
                    while start > done["ip"] and text[start - 1] in _DIGITS:
                        start -= 1
                    end = _DOTTED.match(text, at).end()
                    for span in _ips(text, start, end):
                        add("ip", span)
                    done["ip"] = end
            elif kind == "card":
                if at >= done["card"]:
                    found = _GROUPED.match(text, at)
                    done["card"] = found.end()
                    digits = found.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        add("card", found.span())
                    if at >= done["iban"] and at > 1:
                        add("iban", _iban(text, at - 2))
            elif kind == "url":
                if at >= done["url"]:
                    start = at
                    while start > done["url"] and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+.-"):
                        start -= 1
                    found = _AUTHORITY.match(text, last + 1)  # read once: the next one starts behind it
                    done["url"] = found.end() if found else last + 1
                    login, sign, host = found.group().rpartition("@") if found else ("", "", "")
                    if start < at and sign and host and ":" in login[1:]:
                        add("url", (start, found.end()))
            elif kind == "account":
                if at >= done["account"] and (found := _VALUE.match(text, last + 1)) and any(c in _DIGITS for c in found.group(1)):
                    add("account", found.span(1))
            elif at >= done["key"] and (found := _KEY.match(text, last + 1)) and not (at and text[at - 1].isalnum()):
                add("key", (at, found.end()))
        return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def find(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_spans and spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and
    then kind, comma-joined. A null text is an empty one and has none. Repeated
    rows are read alike. Other columns stay; one named like a result column is
    replaced by it. One pass, no shuffle.
    """
    counts = [f"n_{k}" for k in BASE]
    docs = fresh(docs, *counts, "base_spans", "spans", needs=(text,))
    schema = extended(docs, ", ".join([*(f"{c} long" for c in counts), "base_spans string", "spans string"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            rows = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                spans = finder.spans(t or "")
                base = [s for s in spans if s[1] < len(BASE)]
                rows.append((*(sum(s[1] == k for s in base) for k in range(len(BASE))), joined(base), joined(spans)))
            columns = zip(*rows) if rows else [[]] * 6
            new = [pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *counts, "base_spans", "spans"])

    return in_arrow(docs, run, schema)


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans by the first. Cases as in ``find``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            i = batch.schema.get_field_index(text)
            out = []
            for t in batch.column(i).to_pylist():
                parts, at = [], 0
                for start, kind, end in finder.spans(t or ""):
                    if start >= at:
                        parts += [t[at:start], f"<{KINDS[kind]}>"]
                        at = end
                out.append("".join([*parts, t[at:]]) if parts else t)
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, pa.string()).cast(batch.schema.field(i).type))

    return in_arrow(docs, run, docs.schema)
