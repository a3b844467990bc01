"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and cue words of identifiers.
A deterministic parser beside each anchor expands it to its whole span and validates it (domain labels, byte ranges,
Luhn and mod-97 sums, digit counts). Each parser looks at characters next to its anchor, so the time is linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: The base kinds in the order of the result, then the kinds that anchors add.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("url", "account", "secret")
#: Cue words before account numbers and credentials.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey")
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "ws", "wss")

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_RUN = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
_HOST = re.compile(r"(?:[^\s/?#@]*@)?((?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]{2,}|localhost|\[[0-9A-Fa-f:]+\])(?::[0-9]{1,5})?(?=[/?#]|$)")
_NUMBER = re.compile(r"(?:[ \t]{0,2}(?:no|nr|num|number|id)\.?)?[ \t]{0,2}[:=#]?[ \t]{0,2}([A-Z]{0,3}[0-9](?:[ -]?[0-9A-Z]){5,33})(?![0-9A-Za-z])")
_IBAN = re.compile(r"[ \t]{0,2}[:=#]?[ \t]{0,2}([A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30})(?![0-9A-Za-z])")
_CREDENTIAL = re.compile(r"[ \t]{0,2}[:=][ \t]{0,2}([\"']?)([A-Za-z0-9_./+-]{8,}+)")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")

_AUTOMATON: list[ahocorasick.Automaton] = []
_FOLD = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        made = ahocorasick.Automaton()
        for word in ("@", "+", "://", "www.", "AKIA"):
            made.add_word(word.lower(), (word, len(word)))
        for digit in "0123456789":
            made.add_word(digit, ("0", 1))
        for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
            for cue in cues:
                made.add_word(cue, (kind, len(cue)))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    bare = value.replace(" ", "")
    if not 15 <= len(bare) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _byte_parts(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def find(text: str | None) -> list[Span]:
    """All spans (kind, start, end exclusive; code points) by kind in the order of KINDS, then start. Spans of one kind
    don't overlap; spans of different kinds may."""
    if not text:
        return []
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended
    run_end = 0

    def add(kind: str, start: int, end: int) -> None:
        found[kind].append((kind, start, end))
        free[kind] = end

    # Anchors are found in any case; in lower case each code point must keep its place.
    folded = text.lower()
    for last, (anchor, size) in _automaton().iter(folded if len(folded) == len(text) else text.translate(_FOLD)):
        at = last - size + 1
        if anchor == "0":
            if at < run_end:
                continue
            run_end = _RUN.match(text, at).end()
            if at >= free["ip"] and (m := _IP.match(text, at)):
                free["ip"] = m.end()
                if _byte_parts(m[0]):
                    add("ip", at, m.end())
            if at >= free["card"] and (m := _CARD.match(text, at)):
                free["card"] = m.end()
                if 16 <= len(number := _digits(m[0])) <= 19 and luhn(number):
                    add("card", at, m.end())
        elif anchor == "@":
            start = at
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
        elif anchor == "+":
            if at >= free["phone"] and (m := _PHONE.match(text, at)):
                free["phone"] = m.end()
                if 8 <= len(_digits(m[0])) <= 15:
                    add("phone", at, m.end())
        elif anchor in ("://", "www."):
            start = at
            if anchor == "://":
                while start > free["url"] and at - start < 8 and text[start - 1].isascii() and text[start - 1].isalnum():
                    start -= 1
                if text[start:at].lower() not in SCHEMES:
                    continue
            elif at < free["url"] or at and (text[at - 1].isalnum() or text[at - 1] in "/.@-_"):
                continue
            body = at + 3 if anchor == "://" else at
            if m := _URL_REST.match(text, body):
                rest = m[0].rstrip(".,;:!?)]")
                if _HOST.match(rest):
                    add("url", start, body + len(rest))
        elif anchor == "AKIA":
            if at >= free["secret"] and not (at and text[at - 1].isalnum()) and (m := _KEY.match(text, at)):
                add("secret", at, m.end())
        elif at and (text[at - 1].isalnum()):
            continue
        elif anchor == "account":
            if at >= free["account"] and (m := _account(text, last + 1)):
                add("account", *m)
        elif at >= free["secret"] and (m := _CREDENTIAL.match(text, last + 1)) and any(c in "0123456789" for c in m[2]):
            add("secret", m.start(2), m.end(2))
    for kind in ("email", "url", "account", "secret"):
        found[kind].sort(key=lambda s: s[1])
    return [span for kind in KINDS for span in found[kind]]


def _account(text: str, after: int) -> tuple[int, int] | None:
    if (m := _IBAN.match(text, after)) and iban_valid(m[1]):
        return m.span(1)
    if (m := _NUMBER.match(text, after)) and len(_digits(m[1])) >= 6:
        return m.span(1)
    return None


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """text with every span replaced by its kind in angle brackets; of overlapping spans the first, longest one names
    what replaces all that they cover. Null stays null."""
    if not text or not spans:
        return text
    out, at, covered = [], 0, 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= covered:
            out += [text[at:start], f"<{kind.upper()}>"]
        covered = max(covered, end)
        at = covered
    return "".join(out) + text[at:]


def find_spans(docs: DataFrame) -> DataFrame:
    """docs with spans array<struct<kind,start,end>> and redacted_text string added.

    Null text has no spans and stays null. Rows are read one by one: repeated rows get equal spans; an empty table
    gives an empty table. Other columns pass through; those named like the added ones are replaced.
    """
    rows = docs.drop("spans", "redacted_text")
    names = rows.columns
    span = "array<struct<kind:string,start:long,end:long>>"
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + [f"spans {span}", "redacted_text string"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [find(t) for t in texts]
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, spans, pa.array([redacted(t, f) for t, f in zip(texts, found)], pa.string())],
                [*names, "spans", "redacted_text"])

    return rows.mapInArrow(scan, schema)
