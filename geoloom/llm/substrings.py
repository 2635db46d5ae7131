"""Exact removal of repeated passages, by super-k-mers.

A window is ``size`` consecutive words of one document.  A word is removed
when a window over it has a word sequence that also starts in a document with
a smaller id; windows are judged on the input.

The minimiser of a window is the smallest hash among its runs of ``core``
words.  Equal windows have equal minimisers, and neighbouring windows mostly
share one: a *super-k-mer* is the longest stretch of windows with the same
minimiser at the same place.  It travels as one packed string of words, not
one string a window, to its minimiser's bucket.  There windows are sorted by
their hash, equal hashes are compared word by word on the packed bytes, and
all windows but those of the smallest document are reported, as word ranges.

Bounded work for any table:

* first only minimisers and document ids are counted, with partial sums: a
  minimiser of a single document cannot repeat elsewhere, so its super-k-mers
  stay where they are;
* a bucket is a hash of the minimiser, and buckets grow in number with the
  super-k-mers, so a sorting task holds some megabytes;
* a minimiser of more than ``hot_docs`` documents (a license text, a large
  group of copies) would fill its bucket: its windows go as 128-bit digests,
  whose smallest document is found by a partial aggregation.

Defined results: null, empty and short texts lose nothing; several rows of one
id are one document for the comparison, and each row is returned; a row with a
null id is not compared and loses nothing;
an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks
from .session import cut, join_one, small_batches

SIZE = 50
CORE = 12
#: Lists of up to so many KB are sent to every executor, longer ones are joined by a shuffle.
MARKS_KILOBYTES = 64 << 10
SUPER_KMERS_IN_BUCKET = 20_000


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, step = values, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - step :]) if step < width else out


def super_kmers(block: textblocks.Block, size: int, core: int):
    """(document, first word, words, minimiser) of each super-k-mer of a block, and the block's words.

    The word index runs over the block; equal minimisers at neighbouring
    windows are one stretch.
    """
    words = textblocks.find_words(block.data, block.offsets)
    hashes = textblocks.span_hashes(block.data, words.starts, words.ends)
    nothing = np.zeros(0, np.int64)
    if len(hashes) < size:
        return words, (nothing, nothing, nothing, np.zeros(0, np.uint64))
    least = _sliding_min(textblocks.gram_hashes(hashes, core), size - core + 1)
    inside = textblocks.gram_mask(words.bounds, size)
    changes = np.ones(len(least), bool)
    changes[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    starts = words.bounds[:-1]
    changes[starts[starts < len(least)]] = True
    first = np.flatnonzero(changes)
    last = np.append(first[1:], len(least))
    keep = inside[first]
    first, last = first[keep], last[keep]
    doc = np.searchsorted(words.bounds, first, "right") - 1
    return words, (doc, first, last - first + size - 1, least[first])


def _ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _minimisers(docs: DataFrame, size: int, core: int) -> DataFrame:
    """(m, doc_id, key): the minimisers of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _ids(batch, "doc_id"), _ids(batch, "key")
            for block in textblocks.blocks(batch.column("text")):
                _, (doc, _, _, least) = super_kmers(block, size, core)
                if len(doc):
                    order = np.lexsort((least, doc))
                    doc, least = doc[order], least[order]
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
                    doc, least = doc[new] + block.first, least[new]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(least.view(np.int64)), pa.array(ids[doc]), pa.array(keys[doc])], ["m", "doc_id", "key"]
                    )

    return docs.mapInArrow(scan, "m long, doc_id long, key long")


def _marked(batch: pa.RecordBatch, column: str, size: int, core: int):
    """Blocks of a batch with the super-k-mers whose minimiser is in the row's list in ``column``."""
    lists = batch.column(column)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for block in textblocks.blocks(batch.column("text")):
        words, (doc, first, n, least) = super_kmers(block, size, core)
        if not len(doc):
            continue
        lo, hi = bounds[block.first], bounds[block.last]
        owner = np.repeat(np.arange(block.last - block.first), counts[block.first : block.last])
        # Only the pair decides: (document, minimiser), so both are sorted and searched together.
        asked = textblocks.mix(least + doc.astype(np.uint64))
        known = np.sort(textblocks.mix(values[lo:hi] + owner.astype(np.uint64)))
        at = np.searchsorted(known, asked)
        keep = (at < len(known)) & (known[np.minimum(at, max(0, len(known) - 1))] == asked) if len(known) else np.zeros(len(doc), bool)
        yield block, words, doc[keep], first[keep], n[keep], least[keep]


def _packed(marked: DataFrame, size: int, core: int, buckets: int) -> DataFrame:
    """(bucket, doc_id, key, at, packed): super-k-mers as their words joined by single blanks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _ids(batch, "doc_id"), _ids(batch, "key")
            for block, words, doc, first, n, least in _marked(batch, "cold", size, core):
                raw = block.data.tobytes()
                lo, hi = words.starts[first].tolist(), words.ends[first + n - 1].tolist()
                texts = [b" ".join(raw[a:b].split()) for a, b in zip(lo, hi, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((textblocks.mix(least) % np.uint64(buckets)).astype(np.int32)),
                        pa.array(ids[block.first + doc]),
                        pa.array(keys[block.first + doc]),
                        pa.array((first - words.bounds[doc]).astype(np.int32)),
                        pa.array(texts, pa.binary()),
                    ],
                    ["bucket", "doc_id", "key", "at", "packed"],
                )

    return marked.mapInArrow(scan, "bucket int, doc_id long, key long, at int, packed binary")


def _stretches(ids, keys, starts, size: int) -> pa.RecordBatch:
    """Removed windows, sorted by document and place, as joined word ranges."""
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts = ids[order], keys[order], starts[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + size)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids))[: len(first)] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[first]), pa.array(keys[first]), pa.array(starts[first].astype(np.int32)), pa.array((starts[last] + size).astype(np.int32))],
        ["doc_id", "key", "start", "end"],
    )


_RANGES = "doc_id long, key long, start int, end int"


def _sort_buckets(packed: DataFrame, size: int) -> DataFrame:
    """Removed word ranges of one bucket each: windows sorted by hash and document, equal hashes compared as bytes."""

    def sort(group: pa.Table) -> pa.Table:
        data = group["packed"].combine_chunks()
        if isinstance(data, pa.ChunkedArray):
            data = data.chunk(0)
        ids, keys, at = (group[c].to_numpy().astype(np.int64) for c in ("doc_id", "key", "at"))
        lengths = pa.compute.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        raw = b"".join(data.to_pylist())
        bytes_ = np.frombuffer(raw, np.uint8)
        words = textblocks.find_words(bytes_, offsets)
        grams = textblocks.gram_hashes(textblocks.span_hashes(bytes_, words.starts, words.ends), size)
        place = np.flatnonzero(textblocks.gram_mask(words.bounds, size))
        string = np.searchsorted(words.bounds, place, "right") - 1
        hashes = grams[place]
        order = np.lexsort((ids[string], hashes))
        place, string, hashes = place[order], string[order], hashes[order]
        owner = ids[string]
        head = np.ones(len(place), bool)
        head[1:] = hashes[1:] != hashes[:-1]
        leader = np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
        later = np.flatnonzero(owner > owner[leader])
        lo, hi = words.starts[place], words.ends[place + size - 1]
        ok = np.fromiter(
            (raw[lo[i] : hi[i]] == raw[lo[j] : hi[j]] for i, j in zip(later.tolist(), leader[later].tolist(), strict=True)), bool, len(later)
        )
        later = later[ok]
        starts = at[string[later]] + place[later] - words.bounds[string[later]]
        return pa.Table.from_batches([_stretches(ids[string[later]], keys[string[later]], starts, size)])

    return packed.groupBy("bucket").applyInArrow(sort, _RANGES)


def _hot_windows(marked: DataFrame, size: int, core: int) -> DataFrame:
    """(w1, w2, doc_id, key, start): digests of the windows whose minimiser many documents have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _ids(batch, "doc_id"), _ids(batch, "key")
            for block, words, doc, first, n, _ in _marked(batch, "hot", size, core):
                hashes = textblocks.span_hashes(block.data, words.starts, words.ends)
                count = n - size + 1
                place = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                owner = np.repeat(doc, count)
                one = textblocks.gram_hashes(hashes, size)[place]
                two = textblocks.gram_hashes(textblocks.mix(hashes + np.uint64(0x9E3779B97F4A7C15)), size)[place]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array(ids[block.first + owner]),
                        pa.array(keys[block.first + owner]),
                        pa.array((place - words.bounds[owner]).astype(np.int32)),
                    ],
                    ["w1", "w2", "doc_id", "key", "start"],
                )

    return marked.mapInArrow(scan, "w1 long, w2 long, doc_id long, key long, start int")


def repeated_ranges(docs: DataFrame, size: int = SIZE, core: int = CORE, hot_docs: int = 1000) -> DataFrame:
    """(doc_id, key, ranges): the words to remove, ``key`` being xxhash64 of the text; documents without any are left out."""
    small_batches(docs.sparkSession)
    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"
    )
    minimisers = _minimisers(texts, size, core)
    shared = minimisers.groupBy("m").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.count("*") > hot_docs).alias("is_hot")
    )
    marks = cut(
        join_one(minimisers, cut(shared.where("a <> b").select("m", "is_hot")), ["m"])
        .groupBy("doc_id", "key")
        .agg(
            F.collect_list(F.when(~F.col("is_hot"), F.col("m"))).alias("cold"),
            F.collect_list(F.when(F.col("is_hot"), F.col("m"))).alias("hot"),
        )
    )
    total = marks.agg(F.sum(F.size("cold")).alias("cold"), F.sum(F.size("hot")).alias("hot"), F.count("*").alias("n")).first()
    kilobytes = ((total["cold"] or 0) + (total["hot"] or 0) + 8 * total["n"]) // 128
    marked = texts.join(F.broadcast(marks) if kilobytes <= MARKS_KILOBYTES else marks, ["doc_id", "key"]).select(
        "doc_id", "key", "text", "cold", "hot"
    )
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions * 2, (total["cold"] or 0) // SUPER_KMERS_IN_BUCKET)
    ranges = _sort_buckets(_packed(marked, size, core, buckets), size)
    if total["hot"]:
        windows = _hot_windows(marked.where(F.size("hot") > 0), size, core)
        least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"))
        ranges = ranges.unionByName(
            join_one(windows, cut(least.where("least <> last").drop("last")), ["w1", "w2"])
            .where("doc_id > least")
            .select("doc_id", "key", "start", (F.col("start") + size).alias("end"))
        )
    return ranges.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def remove_repeats(docs: DataFrame, size: int = SIZE, core: int = CORE, hot_docs: int = 1000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` is the words that stay, joined by single blanks."""
    ranges = cut(repeated_ranges(docs, size, core, hot_docs))
    total = ranges.agg(F.sum(F.size("ranges")).alias("r"), F.count("*").alias("n")).first()
    fits = ((total["r"] or 0) + 8 * total["n"]) // 128 <= MARKS_KILOBYTES
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    joined = rows.join(F.broadcast(ranges) if fits else ranges, ["doc_id", "key"], "left").select("doc_id", "text", "ranges")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if ranges.is_valid:
                    gone = np.zeros(len(words), bool)
                    for r in ranges.as_py():
                        gone[r["start"] : r["end"]] = True
                    n_removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(apply, f"doc_id {kind}, n_words long, n_removed long, kept string")
