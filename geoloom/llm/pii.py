"""Personal data by anchor expansion.

An Aho-Corasick automaton passes once over a text, ASCII letters lower-cased,
and reports anchors: at signs, plus signs, digits, ``scheme://`` marks, and cue
words for identifiers.  From each anchor a deterministic local parser expands to the
left and right and validates the boundary, so no pattern is tried at every
position of the text.

Kinds found, in the order of the result:

* ``email``: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``: four dotted groups of digits, each at most 255
* ``card``: 16 to 19 digits, single blanks or hyphens between, passing Luhn
* ``phone``: a plus sign and 8 to 15 digits among ``[\\x20().0-9-]``
* ``address``: the user part of a url (``scheme://user:password@``)
* ``account``: after a cue word, an IBAN passing mod 97 or 6 to 17 digits of a
  bank account
* ``routing``: after a cue word, nine digits passing the bank routing checksum
* ``ssn``: after a cue word, nine digits as 3-2-4 of a social security number,
  without the areas, groups and serials that are never given out
* ``passport``: after a cue word, one or two letters and six to eight digits,
  or nine digits
* ``tax``: after a cue word, an employer's number as 2-7 digits or a country
  code with 8 to 12 digits

Cue words stand alone (no letter or digit on either side), in letters of any
case; a few fill words and separators may follow before the number, which ends
where no letter or digit follows.  The first four are leftmost and non-overlapping within their kind; a match
that fails its check is dropped and its text is not tried again.

Ties: spans of different kinds may overlap and are all reported.

Defined results: null and empty texts have no spans; a null id stays null;
repeated rows give repeated results; an empty table gives an empty one;
further columns are ignored.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "address", "account", "routing", "ssn", "passport", "tax")
BASE_KINDS = KINDS[:4]

#: Fixed values.
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CUES = {
    "iban": "account",
    "account": "account",
    "acct": "account",
    "konto": "account",
    "kontonummer": "account",
    "compte": "account",
    "cuenta": "account",
    "routing": "routing",
    "aba": "routing",
    "ssn": "ssn",
    "social security": "ssn",
    "passport": "passport",
    "passeport": "passport",
    "pasaporte": "passport",
    "reisepass": "passport",
    "ein": "tax",
    "tin": "tax",
    "tax id": "tax",
    "vat": "tax",
    "ust-id": "tax",
    "tva": "tax",
    "nif": "tax",
}
FILL = ("number", "nummer", "nr", "no", "num", "id", "is")
PHONE_INNER = " ().-"
#: Characters after a cue within which its number has a digit: separators, fill words, letters before the digits.
CUE_REACH = 64

_digit = frozenset(DIGITS)
_label = frozenset(LETTERS + DIGITS + "-")
_local = frozenset(LETTERS + DIGITS + "._%+-")
_phone = frozenset(DIGITS + PHONE_INNER)
_alnum = frozenset(LETTERS + DIGITS)
_near = re.compile("[0-9]")
_user = frozenset(LETTERS + DIGITS + "._%+-:~!$&'*,;=")


def lower(text: str) -> str:
    """ASCII letters lower-cased, all places kept."""
    return text.encode().lower().decode()


def automaton() -> ahocorasick.Automaton:
    anchors = ahocorasick.Automaton()
    for sign in "@+" + DIGITS:
        anchors.add_word(sign, (sign if sign in "@+" else "0", 1))
    anchors.add_word("://", ("://", 3))
    for cue, kind in CUES.items():
        anchors.add_word(cue, (kind, len(cue)))
    anchors.make_automaton()
    return anchors


def parse_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around the at-sign at ``at``; nothing left of ``floor`` is free."""
    start = at
    while start > floor and text[start - 1] in _local:
        start -= 1
    if start == at:
        return None
    i, n, labels, end = at + 1, len(text), 0, 0
    while True:
        j = i
        while j < n and text[j] in _label:
            j += 1
        if j == i:
            break
        labels, end = labels + 1, j
        if j >= n or text[j] != ".":
            break
        i = j + 1
    return (start, end) if labels >= 2 else None


def parse_ip(text: str, start: int) -> tuple[int, list[int]]:
    """From a group's first digit: where the dotted chain that was read ends, and its group ends."""
    i, n, ends = start, len(text), []
    while len(ends) < 4:
        j = i
        while j < n and text[j] in _digit:
            j += 1
        if j == i:
            break
        ends.append(j)
        if j >= n or text[j] != ".":
            break
        i = j + 1
    return ends[-1], ends


def parse_card(text: str, start: int) -> int:
    i, n = start + 1, len(text)
    while i < n:
        if text[i] in _digit:
            i += 1
        elif text[i] in " -" and i + 1 < n and text[i + 1] in _digit:
            i += 2
        else:
            break
    return i


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def parse_phone(text: str, plus: int) -> int | None:
    n = len(text)
    if plus + 1 >= n or text[plus + 1] not in _digit:
        return None
    i, end = plus + 2, None
    while i < n and text[i] in _phone:
        if text[i] in _digit and i >= plus + 3:
            end = i + 1
        i += 1
    return end


def parse_user(text: str, after: int) -> tuple[int, int] | None:
    i = after
    while i < len(text) and text[i] in _user:
        i += 1
    return (after, i) if i > after and i < len(text) and text[i] == "@" else None


def parse_iban(text: str, start: int) -> int | None:
    """Two letters, two digits, 11 to 30 more, single blanks between, passing mod 97; where it ends."""
    i, kept = start, ""
    while i < len(text) and len(kept) < 34:
        if text[i] in _alnum:
            kept += text[i].upper()
        elif text[i] != " " or i + 1 >= len(text) or text[i + 1] not in _alnum:
            break
        ends = text[i] in _alnum and (i + 1 >= len(text) or text[i + 1] not in _alnum)
        if ends and len(kept) >= 15 and kept[:2].isalpha() and kept[2:4].isdigit():
            turned = kept[4:] + kept[:4]
            if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                return i + 1
        i += 1
    return None


def number_start(text: str, after: int) -> int:
    """Past separators and at most two fill words after a cue."""
    i = after
    for _ in range(3):
        while i < len(text) and i < after + 16 and text[i] in " .:#=\t":
            i += 1
        word = next((w for w in FILL if lower(text[i : i + len(w)]) == w), "")
        end = i + len(word)
        if not word or (end < len(text) and text[end] in _alnum):
            return i
        i = end
    return i


def run_of(text: str, start: int, most: int) -> tuple[str, int]:
    """The letters and digits from ``start``, with single hyphens or blanks before a digit, and where they end; empty beyond ``most``."""
    i = start
    while i < len(text) and i - start <= most:
        if text[i] in _alnum or (text[i] in " -" and i > start and text[i - 1] in _alnum and i + 1 < len(text) and text[i + 1] in _digit):
            i += 1
        else:
            return text[start:i], i
    return (text[start:i], i) if i - start <= most else ("", start)


def _routing(digits: str) -> bool:
    return len(digits) == 9 and sum(int(d) * w for d, w in zip(digits, (3, 7, 1) * 3, strict=True)) % 10 == 0 and digits != "0" * 9


def _ssn(shown: str, digits: str) -> bool:
    parts = [p for p in shown.replace(" ", "-").split("-") if p]
    if len(digits) != 9 or (len(parts) > 1 and [len(p) for p in parts] != [3, 2, 4]):
        return False
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def parse_identifier(text: str, kind: str, after: int) -> tuple[int, int] | None:
    """The identifier that a cue of ``kind`` announces."""
    start = number_start(text, after)
    if kind == "account" and (end := parse_iban(text, start)):
        return start, end
    shown, end = run_of(text, start, 24)
    letters = len(shown) - len(shown.lstrip(LETTERS))
    digits = "".join(c for c in shown[letters:] if c in _digit)
    plain = shown.isascii() and all(c in _digit or c in " -" for c in shown[letters:])
    if not plain:
        return None
    fits = {
        "account": letters == 0 and 6 <= len(digits) <= 17,
        "routing": letters == 0 and _routing(digits),
        "ssn": letters == 0 and _ssn(shown, digits),
        "passport": (1 <= letters <= 2 and 6 <= len(digits) <= 8) or (letters == 0 and len(digits) == 9),
        "tax": (letters == 0 and len(digits) == 9 and shown[2:3] in "-0123456789") or (letters == 2 and 8 <= len(digits) <= 12),
    }
    return (start, end) if fits[kind] else None


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans by kind and then start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    free = dict.fromkeys(KINDS, 0)

    def take(kind: str, span: tuple[int, int]) -> None:
        found[kind].append(span)
        free[kind] = span[1]

    for last, (anchor, length) in anchors.iter(lower(text)):
        at = last - length + 1
        if anchor == "0":
            if at >= free["ip"] and (at == 0 or text[at - 1] not in _digit or at == free["ip"]):
                end, ends = parse_ip(text, at)
                free["ip"] = end
                if len(ends) == 4:
                    parts = text[at:end].split(".")
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in parts)):
                        take("ip", (at, end))
            if at >= free["card"]:
                end = parse_card(text, at)
                free["card"] = end
                digits = text[at:end].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    take("card", (at, end))
        elif anchor == "@":
            if at >= free["email"] and (span := parse_email(text, at, free["email"])):
                take("email", span)
        elif anchor == "+":
            if at >= free["phone"] and (end := parse_phone(text, at)):
                free["phone"] = end
                if 8 <= sum(c in _digit for c in text[at:end]) <= 15:
                    take("phone", (at, end))
        elif anchor == "://":
            if span := parse_user(text, last + 1):
                take("address", span)
        elif at >= free[anchor] and (at == 0 or text[at - 1] not in _alnum) and text[last + 1 : last + 2] not in _alnum:
            # Most cues are common words, so a number must be near before anything is parsed.
            if _near.search(text, last + 1, last + CUE_REACH) and (span := parse_identifier(text, anchor, last + 1)):
                take(anchor, span)
    return [(kind, start, end) for kind in KINDS for start, end in found[kind]]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (kind, start, end)), by kind as in ``KINDS`` and then start; one map over the rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        kind_of = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(text.as_py() or "", anchors)]
                for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind_of))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span replaced by ``<KIND>``; of overlapping spans the union is replaced under the first one's kind."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        end = -end
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with its columns, personal data in ``text_col`` replaced; null texts stay null."""
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            texts = [
                None if text is None else redact(text, find_spans(text, anchors))
                for text in (x.as_py() for x in batch.column(at))
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts and the joined spans of ``find_personal_data``'s rows, with DataFrame functions."""

    def joined(kinds) -> F.Column:
        kept = F.filter("spans", lambda s: s["kind"].isin(*kinds)) if kinds != KINDS else F.col("spans")
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
    )


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
