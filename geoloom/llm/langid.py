"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte n-grams (n = 2, 3; letters lower-cased,
everything else a blank): tf = log(1 + count), times idf, normalised.  Each
language has a few centroids, found by spherical k-means; the language of the
centroid with the highest cosine wins.  A text whose best cosine is lower than
its language's limit is *rejected*: it is far from everything learned.  A text of
few n-grams has a low cosine with anything, so its limit is lower in
proportion to the square root of their number.

The document frequencies behind idf cover all training rows.  The centroids
are fitted on a sample of about ``sample_per_lang`` labelled rows for each
language (a documented bound: rows whose hash of the id falls under a
threshold), which also gives each language's distance limit.  The model is
``dims`` idf values and ``dims`` x ``clusters`` numbers for each language,
whatever the size of the table.

Defined results: a null text or one without a letter is ``und`` with score 0
and is rejected; with no training rows every text is ``und``; an empty table
gives an empty result; repeated rows are judged alike; further columns are
ignored.  Of equal cosines the language first in the alphabet wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks

UNKNOWN = "und"
DIMS = 4096
#: Distinct n-grams from which on a text's limit is its language's.
FULL_GRAMS = 100
#: Documents whose dense vectors are held at once.
ROWS_AT_ONCE = 128


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray


def _alphabet() -> np.ndarray:
    """Letters lower-cased, bytes of other scripts kept, the rest 0."""
    table = np.zeros(256, np.uint32)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def counts_of(block: textblocks.Block, lo: int, hi: int, dims: int) -> np.ndarray:
    """n-gram counts of documents lo to hi of a block, one row for each."""
    start, end = block.offsets[lo], block.offsets[hi]
    out = np.zeros((hi - lo) * dims, np.int64)
    codes = _alphabet()[block.data[start:end]]
    if len(codes) < 2:
        return out.reshape(hi - lo, dims)
    doc = np.repeat(np.arange(hi - lo), np.diff(block.offsets[lo : hi + 1]))
    pair = codes[:-1] * np.uint32(256) + codes[1:]
    for gram, last in ((pair, 1), (pair[:-1] * np.uint32(256) + codes[2:], 2)):
        keep = (doc[:-last] == doc[last:]) & (gram != 0)
        slot = ((gram[keep] * np.uint32(2654435761)) >> np.uint32(32 - int(dims).bit_length() + 1)).astype(np.int64)
        out += np.bincount(doc[:-last][keep] * dims + slot, minlength=len(out))
    return out.reshape(hi - lo, dims)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts, dtype=np.float32) * idf
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def _frequencies(docs: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """In how many of the rows each n-gram slot occurs, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(dims, np.int64), 0
        for batch in batches:
            for block in textblocks.blocks(batch.column(0)):
                n = len(block.offsets) - 1
                rows += n
                for lo in range(0, n, ROWS_AT_ONCE):
                    total += (counts_of(block, lo, min(n, lo + ROWS_AT_ONCE), dims) > 0).sum(0)
        slots = np.append(np.flatnonzero(total), dims)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.append(total, rows)[slots])], ["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(dims + 1, np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out[:dims], int(out[dims])


def _sample(training: DataFrame, per_lang: int, dims: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Counts and languages of about ``per_lang`` rows of each language, chosen by a hash of the id."""
    sizes = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 20))
    limit: Column = F.lit(0)
    for lang in langs:
        limit = F.when(F.col("lang") == lang, int((1 << 20) * min(1.0, per_lang / sizes[lang])) + 1).otherwise(limit)
    chosen = training.where(place < limit).select("lang", "text")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for block in textblocks.blocks(batch.column(1)):
                n = len(block.offsets) - 1
                for lo in range(0, n, ROWS_AT_ONCE):
                    hi = min(n, lo + ROWS_AT_ONCE)
                    rows = [x.tobytes() for x in np.minimum(counts_of(block, lo, hi, dims), 65535).astype(np.uint16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[block.first + lo : block.first + hi]), pa.array(rows, pa.binary())], ["lang", "v"]
                    )

    rows = chosen.mapInArrow(featurise, "lang string, v binary").toArrow()
    place_of = {lang: i for i, lang in enumerate(langs)}
    owner = np.array([place_of[x] for x in rows["lang"].to_pylist()], np.int64)
    vectors = np.frombuffer(b"".join(rows["v"].to_pylist()), np.uint16).reshape(-1, dims)
    order = np.lexsort((*vectors[:, :8].T, vectors.sum(1), owner))
    return langs, vectors[order], owner[order]


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the farthest points on, so the outcome does not depend on chance."""
    seeds = [vectors.mean(0)]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(vectors[(vectors @ np.stack(seeds).T).max(1).argmin()])
    centres = np.stack(seeds)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        nearest = (vectors @ centres.T).argmax(1)
        for j in range(len(centres)):
            if (nearest == j).any():
                centres[j] = vectors[nearest == j].mean(0)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def fit(
    training: DataFrame, clusters: int = 4, sample_per_lang: int = 400, dims: int = DIMS, slack: float = 0.7
) -> Model | None:
    """From rows (doc_id, text, lang); rows without a language or without text are left out.

    A language's limit is ``slack`` times the lowest cosine that its own
    sampled rows have with their nearest centroid, raised for rows of few n-grams.
    """
    training = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequency, n = _frequencies(training, dims)
    if not n:
        return None
    langs, counts, owner = _sample(training, sample_per_lang, dims)
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + np.float32(1)
    vectors = _vectors(counts, idf)
    centroids, owners, limits = [], [], []
    for i in range(len(langs)):
        own = vectors[owner == i]
        grams = (own > 0).sum(1)
        own, grams = own[grams > 0], grams[grams > 0]
        if not len(own):
            limits.append(0.0)
            continue
        found = _cluster(own, clusters)
        centroids.append(found)
        owners += [i] * len(found)
        cosine = (own @ found.T).max(1) / np.sqrt(np.minimum(1, grams / FULL_GRAMS))
        limits.append(float(slack * cosine.min()))
    if not centroids:
        return None
    return Model(langs, idf, np.concatenate(centroids), np.array(owners), np.array(limits, np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected): one map over the rows."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(**shared.value) if shared.value else None
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *judge(batch.column(1), known)], ["doc_id", "lang_pred", "score", "rejected"]
            )

    return rows.mapInArrow(classify, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def judge(texts: pa.Array, model: Model | None) -> list[pa.Array]:
    """Language, score and rejection of each text."""
    n = len(texts)
    lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best, score, grams = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    if model is None:
        lettered = np.zeros(n, bool)
        names, limits = [UNKNOWN], np.zeros(1)
    else:
        names, limits = [*model.langs, UNKNOWN], model.limits
        dims = len(model.idf)
        for block in textblocks.blocks(texts):
            size = len(block.offsets) - 1
            for lo in range(0, size, ROWS_AT_ONCE):
                hi = min(size, lo + ROWS_AT_ONCE)
                counts = counts_of(block, lo, hi, dims)
                cosine = _vectors(counts, model.idf) @ model.centroids.T
                top = cosine.argmax(1)
                best[block.first + lo : block.first + hi] = model.owner[top]
                score[block.first + lo : block.first + hi] = cosine[np.arange(hi - lo), top]
                grams[block.first + lo : block.first + hi] = (counts > 0).sum(1)
    rejected = ~lettered | (score < limits[best] * np.sqrt(np.minimum(1, grams / FULL_GRAMS)))
    best = np.where(lettered, best, len(names) - 1)
    score = np.where(lettered, np.clip(score, 0, 1), 0.0)
    return [pa.array(names).take(pa.array(best)), pa.array(score), pa.array(rejected)]


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The table's rows that are not rejected, all columns as they are."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(**shared.value) if shared.value else None
        for batch in batches:
            yield batch.filter(pc.invert(judge(batch.column(at), known)[2]))

    return docs.mapInArrow(clean, docs.schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
