"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased, so case and punctuation do
not hide a copy.  Every n-gram of a test item that some document has is a
seed; those that no document has, most of a benchmark, are not sent.  A
document that has a seed is aligned with the item around it: match +2,
mismatch -1, gap -1, best local score, divided by the score of a full copy.
Pairs from ``least`` on are reported.  The window around a seed holds every
alignment through it that can reach ``least``, and a window is only left out
where too few of the item's words are in it for that.  So all pairs are found
but those whose alignment has no ``n`` words in a row (with every third word
replaced an item still scores 0.5, and is not seen).

The test items are a stated query set: they are taken in blocks of at most
``block_chars`` characters, each block against all documents, so what is sent
to the executors has that bound whatever the size of the benchmark.  Document
frequencies cover all documents and are added up in partial sums.  Both passes
are maps over the documents, without a shuffle of texts and without any cap:
an item that a third of all documents copy is simply aligned in each of them,
where the document is.

Ties: a score of exactly ``least`` is reported; an item that a document holds
several times is one pair, with the best score; equal items are pairs each.

Defined results: null and empty texts match nothing; items with fewer than
``n`` words have no n-gram and match nothing; null item ids and null documents'
ids stay null in the result; repeated rows give repeated results; an empty
table on either side gives an empty result, or keeps every document; further
columns are ignored, and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks

N, LEAST = 3, 0.45
BLOCK_CHARS = 8 << 20
#: Cells of the alignments that are computed together.
CELLS = 1 << 20
#: Words of the windows, and hits of seeds, that are looked at together.
HITS = 1 << 19
_SIEVE_BITS = 20


@dataclass
class Items:
    """One block of test items: their words' hashes, and their seeds sorted by hash."""

    words: np.ndarray
    bounds: np.ndarray
    seeds: np.ndarray
    #: For each entry of ``seeds``: the item and the position in it.
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray


def _word_hashes(block: textblocks.Block) -> tuple[np.ndarray, np.ndarray]:
    data = textblocks.plain_table()[block.data]
    words = textblocks.find_words(data, block.offsets)
    return textblocks.span_hashes(data, words.starts, words.ends), words.bounds


def _sieve(seeds: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _SIEVE_BITS, bool)
    out[(seeds >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
    return out


def _grams(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.flatnonzero(textblocks.gram_mask(bounds, n))
    return textblocks.gram_hashes(words, n)[place] if len(place) else np.zeros(0, np.uint64), place


def _found(grams: np.ndarray, seeds: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Indices of the grams that are seeds."""
    maybe = np.flatnonzero(sieve[(grams >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)])
    if not len(maybe) or not len(seeds):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(seeds, grams[maybe]), len(seeds) - 1)
    return maybe[seeds[at] == grams[maybe]]


def _frequencies(docs: DataFrame, grams: np.ndarray, n: int) -> np.ndarray:
    """In how many documents each of the sorted grams occurs."""
    shared = docs.sparkSession.sparkContext.broadcast((grams, _sieve(grams)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, sieve = shared.value
        total = np.zeros(len(seeds), np.int64)
        for batch in batches:
            for block in textblocks.blocks(batch.column(0)):
                words, bounds = _word_hashes(block)
                hashes, place = _grams(words, bounds, n)
                hit = _found(hashes, seeds, sieve)
                doc = np.searchsorted(bounds, place[hit], "right") - 1
                pairs = np.unique(doc * len(seeds) + np.searchsorted(seeds, hashes[hit]))
                total += np.bincount(pairs % max(1, len(seeds)), minlength=len(seeds))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["seed", "n"])

    rows = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(grams), np.int64)
    out[rows["seed"].to_numpy()] = rows["n"].to_numpy()
    return out


def _seeded(docs: DataFrame, texts: pa.Array, n: int) -> Items | None:
    parts, bounds = [], [0]
    for block in textblocks.blocks(texts):
        words, own = _word_hashes(block)
        parts.append(words)
        bounds += (own[1:] + bounds[-1]).tolist()
    words, bounds = np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(bounds, np.int64)
    grams, place = _grams(words, bounds, n)
    if not len(grams):
        return None
    distinct = np.unique(grams)
    frequency = _frequencies(docs, distinct, n)[np.searchsorted(distinct, grams)]
    item = np.searchsorted(bounds, place, "right") - 1
    chosen = np.flatnonzero(frequency)
    chosen = chosen[np.argsort(grams[chosen], kind="stable")]
    return Items(
        words, bounds, grams[chosen], item[chosen], (place - bounds[item])[chosen], _sieve(grams[chosen])
    )


def smith_waterman(items: np.ndarray, lengths: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local score of each row of ``items`` (padded with 0) with the same row of ``windows`` (padded with 1).

    Along a row the gap is a running maximum: the best of the cells to the
    left, each less the gap in between.
    """
    slope = np.arange(windows.shape[1] + 1, dtype=np.int32)
    above = np.zeros((len(items), windows.shape[1] + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    for i in range(int(lengths.max(initial=0))):
        row = np.zeros_like(above)
        score = np.where(windows == items[:, i : i + 1], 2, -1)
        np.maximum(above[:, :-1] + score, above[:, 1:] - 1, out=row[:, 1:])
        row = np.maximum(row, 0)
        above = np.maximum.accumulate(row + slope, axis=1) - slope
        np.maximum(best, np.where(i < lengths, above.max(1), 0), out=best)
    return best


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _may_reach(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, items: Items, item: np.ndarray, least: float) -> np.ndarray:
    """Which windows hold so many of their item's words that the score can reach ``least``: a score is no more than their share."""
    length = np.diff(items.bounds)[item]
    out = np.zeros(len(lo), bool)
    total = np.cumsum(hi - lo + length)
    begin = 0
    while begin < len(lo):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HITS, "right")))
        some = slice(begin, end)
        number = np.arange(end - begin)
        of_item, of_window = np.repeat(number, length[some]), np.repeat(number, (hi - lo)[some])
        spread = textblocks.mix(number.astype(np.uint64))
        own = items.words[_ranges(items.bounds[item[some]], length[some])] ^ spread[of_item]
        there = words[_ranges(lo[some], (hi - lo)[some])] ^ spread[of_window]
        out[some] = np.bincount(of_item, np.isin(own, there), end - begin) / length[some] >= least
        begin = end
    return out


def align(block: textblocks.Block, items: Items, n: int, least: float):
    """(document, item, score) of the block's pairs that reach ``least``; the best of a pair's places counts."""
    words, bounds = _word_hashes(block)
    grams, place = _grams(words, bounds, n)
    hit = _found(grams, items.seeds, items.sieve)
    lo = np.searchsorted(items.seeds, grams[hit], "left")
    count = np.searchsorted(items.seeds, grams[hit], "right") - lo
    doc = np.searchsorted(bounds, place[hit], "right") - 1
    # Documents are taken together as long as their hits fit.
    borders = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
    total = np.concatenate([[0], np.cumsum(count)])[borders]
    out, begin = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    while begin < len(borders) - 1:
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + HITS, "right")) - 1)
        some = slice(borders[begin], borders[end])
        entry, at = _ranges(lo[some], count[some]), np.repeat(place[hit][some], count[some])
        out.append(_aligned(words, bounds, items, items.item[entry], np.repeat(doc[some], count[some]), at - items.place[entry], least))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _aligned(words: np.ndarray, bounds: np.ndarray, items: Items, item: np.ndarray, doc: np.ndarray, start: np.ndarray, least: float):
    """``align`` for hits of seeds; ``start`` is where the item would begin."""
    order = np.lexsort((start, item, doc))
    item, doc, start = item[order], doc[order], start[order]
    length = np.diff(items.bounds)[item]
    # A score of ``least`` leaves room for so many gaps.
    slack = np.ceil(2 * (1 - least) * length).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] - start[:-1] > slack[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    item, doc, length, slack = item[first], doc[first], length[first], slack[first]
    lo = np.maximum(bounds[doc], start[first] - slack)
    hi = np.minimum(bounds[doc + 1], start[last] + length + slack)
    may = _may_reach(words, lo, hi, items, item, least)
    item, doc, length, lo, hi = item[may], doc[may], length[may], lo[may], hi[may]
    score = np.zeros(len(item))
    order = np.argsort(hi - lo, kind="stable")
    begin = 0
    while begin < len(order):
        # Windows of like length are aligned together, as many as fit.
        width = int((hi - lo)[order[begin]])
        end = begin + max(1, CELLS // max(1, 2 * width))
        some = order[begin:end]
        some = some[(hi - lo)[some] <= max(2 * width, 64)]
        begin += len(some)
        wide, tall = int((hi - lo)[some].max()), int(length[some].max())
        column, row = np.arange(wide), np.arange(tall)
        windows = np.where(lo[some, None] + column < hi[some, None], words[np.minimum(lo[some, None] + column, len(words) - 1)], 1)
        own = items.bounds[item[some], None] + row
        rows = np.where(row < length[some, None], items.words[np.minimum(own, len(items.words) - 1)], 0)
        score[some] = smith_waterman(rows, length[some], windows) / (2 * length[some])
    keep = score >= least
    doc, item, score = doc[keep], item[keep], score[keep]
    order = np.lexsort((-score, item, doc))
    doc, item, score = doc[order], item[order], score[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[new], item[new], score[new]


def _blocks(docs: DataFrame, benchmark: DataFrame, n: int, block_chars: int) -> Iterator[tuple[pa.Array, Items]]:
    """The benchmark's items in blocks, with their seeds."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = total // block_chars + 1
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
        if len(rows):
            seeded = _seeded(docs, rows["text"].combine_chunks(), n)
            if seeded is not None:
                yield rows["item_id"].combine_chunks(), seeded


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = N, least: float = LEAST, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, score): the documents that hold a test item or an edited copy of it; a full copy scores 1."""
    id_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    shape = f"doc_id {id_kind}, item_id {item_kind}, score double"
    out = docs.sparkSession.createDataFrame([], shape)
    for names, items in _blocks(docs, benchmark, n, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast((names, vars(items)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, items = shared.value
            items = Items(**items)
            for batch in batches:
                for block in textblocks.blocks(batch.column(1)):
                    doc, item, score = align(block, items, n, least)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(doc + block.first)), names.take(pa.array(item)), pa.array(score)],
                            ["doc_id", "item_id", "score"],
                        )

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(scan, shape))
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = N, least: float = LEAST, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    at = docs.columns.index("text")
    kept = docs
    for _, items in _blocks(docs, benchmark, n, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(vars(items))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(**shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for block in textblocks.blocks(batch.column(at)):
                    keep[block.first + align(block, items, n, least)[0]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
