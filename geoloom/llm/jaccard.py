"""Similarity join of documents on word shingles, by token-combination prefixes.

A document is its set of distinct ``k``-word shingles (lower-cased A-Z).  Two
documents link when their Jaccard similarity is at least ``percent`` / 100.
Two sets that link differ in few tokens, so in any order of all tokens their
prefixes must meet.  Here the order is: tokens of one document only, then rare
tokens, then frequent ones.

* A document whose tokens of its own are more than may differ links with none.
* Rare tokens of the prefix are indexed one by one.
* Frequent tokens are indexed in pairs: the prefix is extended until every
  group of frequent tokens (a hash of the token, groups growing in number with
  the size of the set) holds so many that a link must share two of one group.
  Every pair of one group is a key.

Documents that share a key are candidates and are verified on the whole sets.

How it scales:

* equal sets are collapsed first, by 128-bit sums of their hashes;
* token counts: each map task packs its tokens, sorted and differenced, into
  one blob for each bucket; a token that several documents of the task have is
  sent once with its count, so a token of a third of all documents is one
  entry a task.  Buckets grow in number with the text.  What comes back to the
  task's documents are the tokens that others have too;
* candidates are first verified against the smallest document of the key that
  they share most keys with, which joins up a group of copies with one
  comparison a document;
* keys that then still hold several components are searched further.  With at
  most ``LIGHT`` documents, their pairs are taken.  With more, the combinations
  grow from two tokens to many: a document's tokens are dealt by hash to groups
  of six cells, so many groups that a link leaves one with two cells touched at
  most, and every four cells of a group are a key, made of all their tokens.
  How many tokens two documents may differ in follows from their sizes and
  their tokens of no one else, so each key is for two ranges of that budget;
* of two documents with a common key a row is made only if their sizes, their
  budgets and the parity bits of their tokens (which differ in no more places
  than the sets do) allow a link.  There is no cap on keys, candidates or
  partners.  Documents in great number that differ from each other by hardly
  more than a link allows still cost a look at each pair of them.

Defined results: ties (a similarity of exactly ``percent``) link; documents without words, without text or with a null id have
an empty set or stand alone; with fewer than ``k`` words the whole sequence is
the one shingle; several rows of one id belong to one component; an empty
table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks
from .session import cut, is_small, join_one, small, small_batches

K, PERCENT = 5, 80
#: Documents that have a frequent token.
FREQUENT = 24
#: Documents of a key whose pairs are looked at without a longer combination.
LIGHT = 100
#: Cells of a group, and those of them that make a key; a group may have the others touched.
CELLS, AGREE = 6, 4
#: Upper bounds of the ranges of budgets: the first, and from each to the next.
FIRST_RANGE, RANGE_RATIO = 4, 1.6
#: Words of 64 parity bits.
BITS = 4
#: Rows of documents that are broadcast: the driver builds the hash table, at about a kilobyte a row, and such
#: tables grow with the corpus.
DOCUMENTS = 50_000
#: Bytes of text to a bucket of token counts.
BUCKET_BYTES = 8 << 20
#: Bytes of text, and documents, packed together.
CHUNK_BYTES, CHUNK_DOCS = 4 << 20, 60_000
_LOW = np.uint64(0xFFFF)


def shingle_sets(block: textblocks.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingle hashes, sorted within each document, and the documents' bounds."""
    data = textblocks.lower_table()[block.data]
    words = textblocks.find_words(data, block.offsets)
    hashes = textblocks.span_hashes(data, words.starts, words.ends)
    grams = textblocks.gram_hashes(hashes, k)
    lo = words.bounds[:-1]
    n = np.diff(words.bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(bounds[-1], np.uint64)
    edges = bounds.tolist()
    for i, (a, m) in enumerate(zip(lo.tolist(), n.tolist(), strict=True)):
        if m >= k:
            out[edges[i] : edges[i + 1]] = np.sort(grams[a : a + m - k + 1])
        elif m:
            out[edges[i]] = textblocks.gram_hashes(hashes[a : a + m], m)[0] ^ np.uint64(m)
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    starts = bounds[:-1]
    new[starts[starts < len(out)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[bounds]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each document's values, modulo 2 ** 64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _summaries(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, s1, s2): the size and the 128-bit digest of each set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textblocks.blocks(batch.column(1)):
                tokens, bounds = shingle_sets(block, k)
                one = _sums(textblocks.mix(tokens), bounds)
                two = _sums(textblocks.mix(tokens ^ np.uint64(0xA5A5A5A5DEADBEEF)), bounds)
                ids = batch.column(0).slice(block.first, block.last - block.first)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(bounds)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["doc_id", "n", "s1", "s2"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n long, s1 long, s2 long")


#: Numbers below which packing is not worth it.
_PLAIN = 16


def pack(keys: np.ndarray) -> bytes:
    """A sorted array of 64-bit numbers as differences, by planes of bytes, compressed; a few numbers as they are."""
    if len(keys) < _PLAIN:
        return b"p" + keys.astype("<u8").tobytes()
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return b"z" + len(keys).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"p":
        return np.frombuffer(blob[1:], "<u8").astype(np.uint64)
    n = int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(pa.decompress(blob[9:], n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


_BLOBS = "bucket int, chunk long, kind int, one binary, two binary, three binary"
_SINGLE, _CHUNK = 0, 1


def _blobs(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """For each chunk of documents: its tokens by bucket, and one row about itself.

    A key is the upper 48 bits of a token over the document's number within
    the chunk; the tokens of several documents of the chunk stay in its own
    row, and their buckets get them once, with the count in the lower bits.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        keys, ids, sizes = [], [], []
        held = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            chunk = (task << 32) | number
            number += 1
            key = np.sort(np.concatenate(keys))
            token = key >> np.uint64(16)
            first = np.ones(len(key), bool)
            first[1:] = token[1:] != token[:-1]
            at = np.flatnonzero(first)
            count = np.diff(np.append(at, len(key)))
            alone = np.repeat(count == 1, count)
            singles, members = key[alone], key[~alone]
            several = count > 1
            multis = (key[at[several]] & ~_LOW) | np.minimum(count[several], 65535).astype(np.uint64)
            rows = {name: [] for name in ("bucket", "chunk", "kind", "one", "two", "three")}
            # Only buckets that have a key are visited, so a chunk makes no more blobs than it has tokens.
            of_one, of_two = (((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) for x in (singles, multis))
            for b in np.union1d(of_one, of_two).tolist():
                one, two = (x[np.searchsorted(of, b) : np.searchsorted(of, b, "right")] for x, of in ((singles, of_one), (multis, of_two)))
                rows["bucket"].append(b)
                rows["kind"].append(_SINGLE)
                rows["one"].append(pack(one))
                rows["two"].append(pack(two))
                rows["three"].append(b"")
            rows["bucket"].append(chunk % buckets)
            rows["kind"].append(_CHUNK)
            rows["one"].append(pack(members))
            rows["two"].append(np.concatenate(ids).astype("<i8").tobytes())
            rows["three"].append(np.concatenate(sizes).astype("<i8").tobytes())
            rows["chunk"] = [chunk] * len(rows["bucket"])
            keys.clear(), ids.clear(), sizes.clear()
            return _table(rows)

        for batch in batches:
            number_of = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for block in textblocks.blocks(batch.column(1)):
                if held and (held + block.last - block.first > CHUNK_DOCS or size + len(block.data) > CHUNK_BYTES):
                    yield flush()
                    held = size = 0
                tokens, bounds = shingle_sets(block, k)
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)) + held, n).astype(np.uint64)
                keys.append((tokens & ~_LOW) | doc)
                ids.append(number_of[block.first : block.last])
                sizes.append(n)
                held += len(n)
                size += len(block.data)
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(scan, _BLOBS)


def _table(rows: dict) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(rows[c], kinds.get(c, pa.binary())) for c in rows], list(rows))


def _shared_tokens(blobs: DataFrame, frequent: int) -> DataFrame:
    """By bucket: of each chunk's tokens those that other documents have too, with their class in the lowest bit of ``two``.

    ``one`` has the keys of tokens that are single in the chunk, ``two`` those
    that are not; ``three`` the classes of the former (1: frequent).
    """

    def count(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        out = {name: [] for name in ("bucket", "chunk", "kind", "one", "two", "three")}
        parts, weights = [], []
        for r in rows:
            if r["kind"] == _SINGLE:
                r["one"], r["two"] = unpack(r["one"]), unpack(r["two"])
                parts += [r["one"] >> np.uint64(16), r["two"] >> np.uint64(16)]
                weights += [np.ones(len(r["one"]), np.int64), (r["two"] & _LOW).astype(np.int64)]
        if parts:
            token, weight = np.concatenate(parts), np.concatenate(weights)
            order = np.argsort(token)
            token, weight = token[order], weight[order]
            at = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
            total = np.add.reduceat(weight, at) if len(at) else weight
            shared = total > 1
            known, often = token[at[shared]], total[shared] >= frequent
        for r in rows:
            out["bucket"].append(r["bucket"])
            out["chunk"].append(r["chunk"])
            out["kind"].append(r["kind"])
            if r["kind"] == _CHUNK:
                for name in ("one", "two", "three"):
                    out[name].append(r[name])
                continue
            one, two = r["one"], r["two"]
            place = np.searchsorted(known, one >> np.uint64(16))
            is_known = np.zeros(len(one), bool)
            if len(known):
                is_known = known[np.minimum(place, len(known) - 1)] == one >> np.uint64(16)
            out["one"].append(pack(one[is_known]))
            out["three"].append(np.packbits(often[place[is_known]]).tobytes() if len(known) else b"")
            mark = often[np.searchsorted(known, two >> np.uint64(16))] if len(two) else np.zeros(0, bool)
            out["two"].append(pack((two & ~_LOW) | mark.astype(np.uint64)))
        return pa.Table.from_batches([_table(out)])

    return blobs.groupBy("bucket").applyInArrow(count, _BLOBS)


def _pair_groups(size_class: int) -> int:
    return max(1, (1 << size_class) // 16)


def signatures(unique: int, rare: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray | None:
    """Keys of a set from its number of tokens of its own and its sorted shared ones; None if it can link with nothing."""
    n = unique + len(rare) + len(often)
    overlap = (percent * n + 99) // 100
    need = n - overlap + 1 - unique
    if need <= 0 or n < 2:
        return None
    out = [textblocks.mix(rare[:need])]
    need -= len(rare[:need])
    if need > 0:
        low, high = (percent * n + 99) // 100, 100 * n // percent
        mixed = textblocks.mix(often ^ np.uint64(0x5BF03635))
        for size_class in range(low.bit_length() - 1, high.bit_length()):
            groups = _pair_groups(size_class)
            group = (mixed % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            rank = np.empty(len(often), np.int64)
            sorted_group = group[order]
            starts = np.searchsorted(sorted_group, np.arange(groups))
            rank[order] = np.arange(len(often)) - starts[sorted_group]
            gained = np.cumsum(rank > 0)
            stop = int(np.searchsorted(gained, need)) + 1
            for members in np.split(order[rank[order] >= 0], starts[1:]):
                members = members[members < stop]
                if len(members) > 1:
                    i, j = np.triu_indices(len(members), 1)
                    x, y = mixed[members[i]], mixed[members[j]]
                    out.append(textblocks.mix(x * np.uint64(3) + y * np.uint64(5) + np.uint64(size_class)))
    return np.unique(np.concatenate(out))


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """For each of 64 * ``BITS`` classes of tokens whether their number is odd."""
    odd = np.bincount((textblocks.mix(tokens) >> np.uint64(40)).astype(np.int64) % (64 * BITS), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _ranges(highest: float) -> list[int]:
    """Upper bounds of the ranges of budgets up to ``highest``."""
    out = [FIRST_RANGE]
    while out[-1] < highest:
        out.append(int(out[-1] * RANGE_RATIO))
    return out


_FOURS = np.array(list(combinations(range(CELLS), AGREE)))


def long_combinations(n: int, tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which two linked documents share one, from a set's size and its shared tokens.

    Two sets that link differ in at most the sum of their budgets' shared
    tokens: (100 - p) / (100 + p) of the size, less the tokens of no one else.
    """
    budget = (n * (100 - percent) - (n - len(tokens)) * (100 + percent)) / (100 + percent)
    most = n * (100 - percent) / (100 + percent) * 100 / percent
    bounds = _ranges(max(most, budget))
    own = int(np.searchsorted(bounds, budget))
    out = []
    for other in range(int(np.searchsorted(bounds, -budget)) if budget < 0 else 0, int(np.searchsorted(bounds, most)) + 1):
        groups = (bounds[own] + bounds[other]) // (CELLS - AGREE + 1) + 1
        kind = textblocks.mix(np.array([min(own, other) * 64 + max(own, other) + 1], np.uint64))
        mixed = textblocks.mix(tokens + kind)
        cell = (mixed >> np.uint64(20)).astype(np.int64) % (groups * CELLS)
        sums = np.zeros(groups * CELLS, np.uint64)
        np.add.at(sums, cell, mixed)
        sums = textblocks.mix(sums + np.arange(len(sums), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(groups, CELLS)
        out.append(textblocks.mix(sums[:, _FOURS].sum(axis=2, dtype=np.uint64).ravel() + kind))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _with_long_keys(candidates: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, s, bits, keys): the documents with longer combinations for keys."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [
                long_combinations(n, unpack(blob), percent).view(np.int64)
                for n, blob in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)
            ]
            keys = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), keys], ["doc_id", "n", "s", "bits", "keys"])

    shape = "doc_id long, n long, s long, bits array<long>, keys array<long>"
    return candidates.select("doc_id", "n", "s", "bits", "tokens").mapInArrow(extend, shape)


def _candidates(shared: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, s, keys, bits, tokens): documents that may link; s of their n tokens are shared, and packed in ``tokens``."""

    def gather(group: pa.Table) -> pa.Table:
        parts, flags, multi, multi_flag, own = [], [], [], [], None
        for r in group.to_pylist():
            if r["kind"] == _CHUNK:
                own = r
                continue
            one, two = unpack(r["one"]), unpack(r["two"])
            parts.append(one)
            flags.append(np.unpackbits(np.frombuffer(r["three"], np.uint8), count=len(one)).astype(bool) if len(one) else np.zeros(0, bool))
            multi.append(two >> np.uint64(16))
            multi_flag.append((two & _LOW).astype(bool))
        ids, sizes = np.frombuffer(own["two"], "<i8"), np.frombuffer(own["three"], "<i8")
        members = unpack(own["one"])
        if multi:
            token, flag = np.concatenate(multi), np.concatenate(multi_flag)
            order = np.argsort(token)
            flags.append(flag[order][np.searchsorted(token[order], members >> np.uint64(16))] if len(members) else np.zeros(0, bool))
            parts.append(members)
        out = {name: [] for name in ("doc_id", "n", "s", "keys", "bits", "tokens")}
        if parts:
            key, flag = np.concatenate(parts), np.concatenate(flags)
            doc = (key & _LOW).astype(np.int64)
            # Rare before frequent, then by token, within each document.
            order = np.lexsort((key, flag, doc))
            doc, token, flag = doc[order], key[order] >> np.uint64(16), flag[order]
            bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
            count = np.diff(bounds)
            for i in np.flatnonzero((count * 100 >= sizes * percent) & (sizes > 1)).tolist():
                tokens, often = token[bounds[i] : bounds[i + 1]], flag[bounds[i] : bounds[i + 1]]
                split = len(tokens) - int(often.sum())
                keys = signatures(int(sizes[i]) - len(tokens), tokens[:split], tokens[split:], percent)
                if keys is not None:
                    out["doc_id"].append(int(ids[i]))
                    out["n"].append(int(sizes[i]))
                    out["s"].append(len(tokens))
                    out["keys"].append(keys.view(np.int64))
                    out["bits"].append(parity_bits(tokens))
                    out["tokens"].append(pack(np.sort(tokens)))
        kinds = {"keys": pa.list_(pa.int64()), "bits": pa.list_(pa.int64()), "tokens": pa.binary()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return shared.groupBy("chunk").applyInArrow(gather, "doc_id long, n long, s long, keys array<long>, bits array<long>, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, on their whole sets: tokens that a document has for itself cannot be common."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, None
        for batch in batches:
            keep = []
            for na, ta, nb, tb in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if ta is not last and ta != last:
                    last, tokens = ta, unpack(ta)
                other = unpack(tb)
                both = np.concatenate([tokens, other])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (na + nb - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return (
        join_one(pairs.join(right, "b"), left, ["a"], rows_bound=DOCUMENTS)
        .select("a", "b", "na", "ta", "nb", "tb")
        .mapInArrow(compare, "a long, b long")
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, label): the smallest id reachable from each of ``nodes`` over ``edges`` (a, b).

    In each round every node takes the first of its neighbours and itself and
    then that one's own choice; the edges are contracted to the nodes chosen,
    and those within one node go.  First is the smallest id in even rounds,
    which ends a star around it at once, and the smallest hash in odd ones,
    which halves a chain in whatever order its ids are; so rounds are
    logarithmic in number, and each only reads what the last one left.
    """
    labels = nodes.select("doc_id", F.col("doc_id").alias("label"))
    rest = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    number = 0
    while rest.limit(1).count():
        rank = lambda c: F.struct((F.xxhash64(c) if number % 2 else F.col(c)).alias("r"), F.col(c).alias("id"))  # noqa: B023, E731
        ends = rest.select("a", "b").union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = cut(ends.groupBy("a").agg(F.min(rank("b")).alias("near")).select("a", F.least(rank("a"), "near")["id"].alias("to")))
        # One row a node here and in ``step``, so one measure serves all joins of the round.
        fits = is_small(first, DOCUMENTS)
        onward = first.select(F.col("a").alias("to"), F.col("to").alias("next"))
        step = cut(join_one(first, onward, ["to"], "left", fits=fits).select("a", F.coalesce("next", "to").alias("to")))
        labels = cut(
            join_one(labels, step.select(F.col("a").alias("label"), "to"), ["label"], "left", fits=fits).select(
                "doc_id", F.coalesce("to", "label").alias("label")
            )
        )
        moved = join_one(rest, step, ["a"], fits=fits).select(F.col("to").alias("x"), "b")
        moved = join_one(moved, step.select(F.col("a").alias("b"), F.col("to").alias("y")), ["b"], fits=fits).where("x <> y")
        rest = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        number += 1
    smallest = labels.groupBy("label").agg(F.min("doc_id").alias("smallest"))
    return cut(join_one(labels, smallest, ["label"], rows_bound=DOCUMENTS).select("doc_id", F.col("smallest").alias("label"))) if number else labels


def _open_keys(near: DataFrame) -> DataFrame:
    """(key, members) of the keys that documents of different components share."""
    keys = near.select("label", F.explode("keys").alias("key"))
    found = keys.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("members"))
    return found.where("x <> y").select("key", "members")


def _pairs(near: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents of different components that share one of ``keys`` and may link."""
    rows = join_one(near.select("doc_id", "n", "s", "bits", "label", F.explode("keys").alias("key")), keys.select("key"), ["key"])
    rows = rows.select("key", "doc_id", "n", "s", "label", *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITS)])
    others = rows.select("key", *[F.col(c).alias(f"{c}_") for c in rows.columns if c != "key"])
    common = F.least("s", "s_")
    differ = sum((F.bit_count(F.col(f"bits{i}").bitwiseXOR(F.col(f"bits{i}_"))) for i in range(BITS)), F.lit(0))
    alone = F.col("n") - F.col("s") + F.col("n_") - F.col("s_")
    return (
        rows.join(others, "key")
        .where("doc_id < doc_id_ and label <> label_")
        .where(F.least("n", "n_") * 100 >= F.greatest("n", "n_") * percent)
        .where(common * 100 >= (F.col("n") + F.col("n_") - common) * percent)
        .where((differ + alone) * (100 + percent) <= (F.col("n") + F.col("n_")) * (100 - percent))
        .select(F.col("doc_id").alias("a"), F.col("doc_id_").alias("b"))
    )


def _linked(candidates: DataFrame, percent: int, light: int) -> DataFrame:
    """(doc_id, label) of the candidates: their components under all links."""
    sets = candidates.select("doc_id", "n", "tokens")
    keys = candidates.select("doc_id", F.explode("keys").alias("key"))
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("members")).where("members > 1")
    votes = (
        join_one(keys, heads.select("key", "head"), ["key"])
        .where("head <> doc_id")
        .groupBy("doc_id", "head")
        .agg(F.count("*").alias("votes"))
    )
    best = votes.groupBy("doc_id").agg(F.max(F.struct("votes", -F.col("head"))).alias("best"))
    stars = best.select(F.col("doc_id").alias("b"), (-F.col("best.col2")).alias("a"))
    edges = cut(_verified(stars, sets, percent))
    labels = components(candidates.select("doc_id").distinct(), edges)

    near = join_one(candidates.select("doc_id", "n", "s", "bits", "keys"), labels, ["doc_id"], rows_bound=DOCUMENTS)
    left = cut(_open_keys(near))
    heavy = cut(
        join_one(near.select("doc_id", F.explode("keys").alias("key")), left.where(F.col("members") > light).select("key"), ["key"])
        .select("doc_id")
        .distinct()
    )
    pairs = _pairs(near, left.where(F.col("members") <= light), percent)
    if heavy.limit(1).count():
        longer = cut(join_one(_with_long_keys(candidates.join(small(heavy, DOCUMENTS), "doc_id"), percent), labels, ["doc_id"], rows_bound=DOCUMENTS))
        pairs = pairs.union(_pairs(longer, _open_keys(longer), percent))
    pairs = pairs.distinct()
    more = cut(_verified(cut(pairs), sets, percent))
    if not more.limit(1).count():
        return labels
    return components(candidates.select("doc_id").distinct(), edges.union(more))


def similar_groups(docs: DataFrame, k: int = K, percent: int = PERCENT, frequent: int = FREQUENT, light: int = LIGHT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    summaries = cut(_summaries(rows, k))
    full = summaries.where("n > 0 and doc_id is not null")
    equal = ["s1", "s2", "n"]
    heads = full.groupBy(*equal).agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head <> last").drop("last")
    copies = cut(join_one(full, cut(heads), equal, rows_bound=DOCUMENTS).where("doc_id <> head").distinct())
    # Copies leave the search, but for ids that have another text too.
    ids = copies.select("doc_id").distinct()
    others = full.join(small(ids, DOCUMENTS), "doc_id", "left_semi").join(copies, ["doc_id", *equal], "left_anti").select("doc_id").distinct()
    gone = cut(ids.join(others, "doc_id", "left_anti"))
    texts = rows.where("doc_id is not null and text is not null").join(small(gone, DOCUMENTS), "doc_id", "left_anti")
    length = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), length // BUCKET_BYTES + 1)
    candidates = cut(_candidates(_shared_tokens(_blobs(texts, k, buckets), frequent), percent))
    labels = _linked(candidates, percent, light)
    edges = copies.select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    # A copy takes its head's label; ids with several texts can tie groups together, so ties go through components.
    tied = gone.count() < copies.count()
    if tied:
        links = edges.union(labels.select(F.col("label").alias("a"), F.col("doc_id").alias("b")))
        found = components(links.select(F.col("a").alias("doc_id")).union(links.select("b")).distinct(), links)
    else:
        of_copies = edges.join(labels.withColumnRenamed("doc_id", "a"), "a", "left").select(
            F.col("b").alias("doc_id"), F.coalesce("label", "a").alias("label")
        )
        found = labels.union(of_copies)
    return summaries.join(found, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id")
    )
