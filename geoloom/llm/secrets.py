"""Secret scan: keyed assignments, access keys, hex runs and high-entropy strings.

Candidates are the maximal runs of ``[A-Za-z0-9+/_.=-]`` of 20 characters or
more.  A window of 20 characters slides over each; the counts of its
characters and the sum of c * log2(c) are updated by the one character that
enters and the one that leaves, so each step costs the same however long the
window is.  A window counts when its Shannon entropy reaches the threshold of
its character class (hex digits, letters and digits, all signs) and it mixes
letters with digits.  The span is the union of touching windows, widened to
the whole candidate when most of it counts.

Allow-lists suppress candidates that are known not to be secrets: uuids,
dotted or slashed names of plain words, placeholders of repeated characters,
and version numbers.

Base kinds (``assign``, ``access``, ``hex``) always stay; spans of the method
are of kind ``entropy`` and are left out where a base span covers them.

Documents are first tested as a whole, by linear-time patterns over the Arrow
column, for what every span needs; only documents that pass are read further.

Ties: a window of exactly the threshold counts; spans of one start follow the
order of the kinds.

Defined results: null and empty texts have no spans; a null id stays null;
repeated rows give repeated results; an empty table gives an empty one;
further columns are ignored.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
BASE_KINDS = KINDS[:3]

WINDOW = 20
#: Bits a character that a window must reach, by the class of its candidate.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "all": 3.8}

#: Fixed values.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_.=-]{20,}"
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[A-Za-z]+([._/=+-]+[A-Za-z]+)*[._/=+-]*",
    r"v?[0-9]+([._-][0-9]+)*",
    r"(.)\1*",
)
#: What a text with a span has, for a linear-time test of whole columns.
NEEDED = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|[A-Za-z+/_.=-][0-9]|[0-9][A-Za-z+/_.=-]"


def compiled() -> dict[str, re.Pattern]:
    named = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}
    return {name: re.compile(p) for name, p in named.items()} | {f"allowed{i}": re.compile(p) for i, p in enumerate(ALLOWED)}


def entropy_spans(run: str) -> list[tuple[int, int]]:
    """Unions of the windows of ``run`` that reach their threshold; counts are updated, not rebuilt."""
    size = WINDOW
    if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
        return []
    plain = run.isalnum()
    kind = "hex" if plain and all(c in "0123456789abcdefABCDEF" for c in run) else "alnum" if plain else "all"
    least = THRESHOLDS[kind]
    xlog = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    counts: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0
    out: list[list[int]] = []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += xlog[n + 1] - xlog[n]
        counts[c] = n + 1
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= size:
            old = run[i - size]
            n = counts[old]
            total += xlog[n - 1] - xlog[n]
            counts[old] = n - 1
            digits -= old.isdigit()
            letters -= old.isalpha()
        if i >= size - 1 and digits >= 2 and letters >= 2 and math.log2(size) - total / size >= least:
            start = i - size + 1
            if out and start <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([start, i + 1])
    if sum(e - s for s, e in out) * 2 > len(run):
        return [(0, len(run))]
    return [(s, e) for s, e in out]


def find_secrets_in(text: str, patterns: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    """All spans by start and then kind as in ``KINDS``."""
    spans = []
    for m in patterns["assign"].finditer(text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    for kind, name in ((1, "access"), (2, "hex")):
        spans += [(m.start(), kind, m.end()) for m in patterns[name].finditer(text)]
    base = list(spans)
    allowed = [p for name, p in patterns.items() if name.startswith("allowed")]
    for m in patterns["candidate"].finditer(text):
        if any(p.fullmatch(m[0]) for p in allowed):
            continue
        for s, e in entropy_spans(m[0]):
            s, e = s + m.start(), e + m.start()
            if not any(x <= s and e <= y for x, _, y in base):
                spans.append((s, 3, e))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(spans)]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (kind, start, end)), by start and then kind; one map over the rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = compiled()
        kind_of = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            texts = batch.column(1)
            worth = pc.fill_null(pc.match_substring_regex(texts, NEEDED), False)
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets_in(text.as_py(), patterns)] if go else []
                for text, go in zip(texts, worth.to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind_of))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and the joined spans of ``find_secrets``'s rows, with DataFrame functions."""

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
