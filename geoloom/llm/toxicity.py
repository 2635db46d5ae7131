"""Toxicity by two class-conditional Kneser-Ney models.

Two models, of the toxic and of the ordinary labelled documents, are compared
on a text: the mean over its distinct pairs of adjacent words of
log p(toxic) - log p(ordinary).  A logistic curve, fitted on labelled
documents whose counts were left out of the models, turns the mean into a
probability.

Words are runs of letters and digits, lower-cased; a word's stem is its first
``STEM`` characters.  In each class c(h, w) counts the documents with w after h,
and N(.w) is Kneser-Ney's continuation count, the number of distinct words
before w; N(.s) is its sum over the words with the stem s.  Counts without a
class are of both.

* p(w | h) = (max(c(h, w) - D, 0) + D * N(h.) * p(w)) / c(h)
* p(w) = max(N_class(.w) - D', 0) / N_class(..) + l * p(s) * N(.w) / N(.s)
* p(s) = max(N_class(.s) - D'', 0) / N_class(..) + m * N(.s) / N(..)

Each D is n1 / (n1 + 2 n2) of its counts in its class, and l and m are what
the discounts leave; so all levels back off to the counts that both classes
share.  A pair that neither class has takes its word's ratio.

A word says something only where its N(.w) in a class exceeds by ``SIGMAS``
standard deviations what the shared counts lead one to expect: E + SIGMAS *
sqrt(E + 1), with E the sum over the words h before w of 1 - (1 - q)^c(h, w), q
being the class's share of all counts.  Other words take their stem's ratio, by
the same test, or none: of the two classes one is ten times the other, and what
the smaller one has not seen is not told apart from what it lacks.  On the
held-out labels of sf0.1 a trial of these formulas in NumPy ranks 0.95 of the
toxic documents above all but 0.003 of the others; without that test it is 0.02
with pairs and 0.03 with words alone.

The counts cover every labelled training row and grow with it.  Words are told
apart by 64 bits of hash, of which 32 are their stem's.  The model is a number
for each stem and word that says something, and for each known pair that ends
in such a word.  It is taken in parts of about
``MODEL_WORDS`` numbers, each sent to the executors and held against all
documents, so what is sent has that bound at every size of the table.

Defined results: a null or empty text, and one without words, gets the share
of toxic labels as its score, as does every text while one of the classes has
no label (0 without any label); repeated rows are scored alike; labels of
unknown documents, null labels and null ids do not count; of several labels of
one document the largest counts; a score equal to the threshold is predicted
toxic; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks
from .session import cut, small, stored

#: Characters of a stem.
STEM = 4
#: Words and stems of the model that are sent at once.
MODEL_WORDS = 2_000_000
#: Standard deviations that a class's count must exceed what the shared counts explain.
SIGMAS = 4.0
#: From this score on a text is predicted to be toxic.
THRESHOLD = 0.3
#: One training row in so many is for the logistic curve and not for the counts.
CALIBRATION = 5
#: Pairs that a task sums before it hands them on.
PAIRS = 1_000_000
#: Bound on the rows for the logistic curve.
CALIBRATION_ROWS = 20_000


def _pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return textblocks.mix(words * np.uint64(0xD6E8FEB86659FD93) + before)


_STEM_BITS = np.uint64(0xFFFFFFFF00000000)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word its stem's hash in the upper 32 bits and its own, odd, in the lower ones; a stem's key has none there."""
    characters = np.flatnonzero((data & 0xC0) != 0x80)
    after = np.searchsorted(characters, starts) + STEM
    longer = np.append(characters, len(data))[np.minimum(after, len(characters))]
    whole = textblocks.span_hashes(data, starts, ends)
    stems = np.where(longer < ends, textblocks.span_hashes(data, starts, np.minimum(longer, ends)), textblocks.mix(whole))
    return (stems & _STEM_BITS) | (whole >> np.uint64(32)) | np.uint64(1)


def distinct_pairs(block: textblocks.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key of the word before, key of the word), each pair once a document; 0 stands before the first word."""
    data = textblocks.plain_table()[block.data]
    spans = textblocks.find_words(data, block.offsets)
    words = word_keys(data, spans.starts, spans.ends)
    before = np.zeros(len(words), np.uint64)
    before[1:] = words[:-1]
    starts = spans.bounds[:-1]
    before[starts[starts < len(words)]] = 0
    doc = spans.docs()
    _, first = np.unique(_pair_keys(before, words) ^ textblocks.mix(doc.astype(np.uint64)), return_index=True)
    return doc[first], before[first], words[first]


def count_pairs(labelled: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(word, before, toxic, ordinary), the words as keys: in how many documents each pair of words occurs, from rows (text, toxic).

    With ``words``, rows (word), of pairs that end in one of them.

    Pairs are summed and sorted by their words before they are dealt out by
    the word and three bits of the word before: neighbours in a shuffle's block
    then share a word, which compresses, and a frequent word's pairs go to
    eight tasks.
    """

    def summed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        before, words, toxic = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((before, words))
        before, words = before[order], words[order]
        first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (before[1:] != before[:-1])))
        n_toxic = np.add.reduceat(toxic[order], first)
        n = np.diff(np.append(first, len(words)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(words[first].view(np.int64)),
                pa.array(before[first].view(np.int64)),
                pa.array(n_toxic.astype(np.int32)),
                pa.array((n - n_toxic).astype(np.int32)),
            ],
            ["word", "before", "toxic", "ordinary"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            label = np.asarray(batch.column(1).to_pylist(), np.int64)
            for block in textblocks.blocks(batch.column(0)):
                doc, before, words = distinct_pairs(block)
                if len(words):
                    parts.append((before, words, label[block.first + doc]))
                    waiting += len(words)
                if waiting >= PAIRS:
                    yield summed(parts)
                    parts, waiting = [], 0
        if parts:
            yield summed(parts)

    found = labelled.select("text", "toxic").mapInArrow(count, "word long, before long, toxic int, ordinary int")
    if words is not None:
        found = found.join(small(words), "word", "left_semi")
    deal = F.shiftrightunsigned("before", 61)
    return (
        found.repartition("word", deal)
        .groupBy("word", deal.alias("_deal"), "before")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
        .drop("_deal")
    )


_CLASSES = ("toxic", "ordinary")


def _statistics(pairs: DataFrame, share: float) -> DataFrame:
    """By word and class: all counts, contexts, expected contexts and their change with the share; contexts in either class.

    ``share`` is about the toxic class's share of all counts; the slopes carry
    the expected contexts over to the exact share, known when all is summed.
    """
    both = F.col("toxic") + F.col("ordinary")
    sums = []
    for c, q in zip(_CLASSES, (share, 1 - share), strict=True):
        sums += [
            F.sum(c).alias(f"count_{c}"),
            F.count_if(F.col(c) > 0).alias(f"types_{c}"),
            F.sum(1 - F.pow(F.lit(1 - q), both)).alias(f"expected_{c}"),
            F.sum(both * F.pow(F.lit(1 - q), both - 1)).alias(f"slope_{c}"),
            F.count_if(F.col(c) == 1).alias(f"ones_{c}"),
            F.count_if(F.col(c) == 2).alias(f"twos_{c}"),
        ]
    return pairs.groupBy("word").agg(*sums, F.count("*").alias("types"))


@dataclass
class Model:
    #: (key, beyond): how far log p(toxic) - log p(ordinary) of a stem is from ``rest``, of a word from its stem, of a pair from its word.
    table: DataFrame | None = None
    #: The parts of the table, each with about ``MODEL_WORDS`` rows at most.
    parts: int = 1
    #: The ratio of every other word.
    rest: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0
    #: Means beyond it say no more than it.
    bound: float = np.inf

    def means(self, rows: DataFrame, kept: str) -> DataFrame:
        """(kept, x): from rows (kept, text), the mean log ratio of each text's distinct pairs; null where there are none."""
        kind = rows.schema[kept].dataType.simpleString()
        rows = rows.select(kept, "text")
        if self.parts == 1:
            found = self._totals(rows, 0, f"{kept} {kind}, n long, total double")
        else:
            numbered = stored(rows.select(F.monotonically_increasing_id().alias("_row"), kept, "text"))
            found = reduce(
                DataFrame.union, (self._totals(numbered, i, f"_row long, {kept} {kind}, n long, total double") for i in range(self.parts))
            )
            found = found.groupBy("_row").agg(F.first(kept).alias(kept), F.first("n").alias("n"), F.sum("total").alias("total"))
        return found.select(kept, F.when(F.col("n") > 0, self.rest + F.col("total") / F.col("n")).alias("x"))

    def _totals(self, rows: DataFrame, part: int, shape: str) -> DataFrame:
        """Of each text: its pairs, and what this part's words say beyond ``rest``."""
        names, at = rows.columns, rows.columns.index("text")
        got = self.table.where(F.pmod(F.xxhash64("key"), F.lit(self.parts)) == part).toArrow()
        keys = got["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        shared = rows.sparkSession.sparkContext.broadcast((keys[order], got["beyond"].to_numpy()[order].astype(np.float32)))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, beyond = shared.value
            for batch in batches:
                n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                for block in textblocks.blocks(batch.column(at)):
                    doc, before, words = distinct_pairs(block)
                    size = block.last - block.first
                    n[block.first : block.last] = np.bincount(doc, minlength=size)
                    if len(known):
                        for keys in (words, words & _STEM_BITS, _pair_keys(before, words)):
                            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                            total[block.first : block.last] += np.bincount(doc, np.where(known[place] == keys, beyond[place], 0), size)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(n), pa.array(total)],
                    [*(c for c in names if c != "text"), "n", "total"],
                )

        return rows.mapInArrow(add_up, shape)


def _model(stats: DataFrame, share: float, sigmas: float, model_words: int) -> Model | None:
    """Continuation counts alone, the discount being what chance explains; ``fit`` takes ``bigram_model``."""
    names = [f"{name}_{c}" for name in ("count", "types") for c in _CLASSES] + ["types"]
    sums = stats.agg(*[F.sum(c).alias(c) for c in names]).first()
    if not sums["types_toxic"] or not sums["types_ordinary"]:
        return None
    exact = sums["count_toxic"] / (sums["count_toxic"] + sums["count_ordinary"])

    def kept(rows: DataFrame) -> tuple[DataFrame, dict[str, float]]:
        """The rows whose counts exceed the discount in a class, with what is left of them, and what the discounts leave."""
        shares = []
        for c, change in zip(_CLASSES, (exact - share, share - exact), strict=True):
            expected = F.greatest(F.col(f"expected_{c}") + change * F.col(f"slope_{c}"), F.lit(0.0))
            shares.append((F.greatest(F.col(f"types_{c}") - expected - sigmas * F.sqrt(expected + 1), F.lit(0.0)) / sums[f"types_{c}"]).alias(c))
        some = cut(rows.select("word", "types", *shares).where("toxic > 0 or ordinary > 0"))
        left = some.agg(*[(1 - F.coalesce(F.sum(c), F.lit(0.0))).alias(c) for c in _CLASSES], F.count("*").alias("n")).first()
        return some, left.asDict()

    stem = F.shiftleft(F.shiftrightunsigned("word", 32), 32)
    columns = [c for c in stats.columns if c != "word"]
    by_stem = cut(stats.groupBy(stem.alias("word")).agg(*[F.sum(c).alias(c) for c in columns]))
    words, left = kept(stats)
    stems, left_stems = kept(by_stem)
    in_both = F.col("types") / sums["types"]
    p_stem = {c: F.col(c) + left_stems[c] * in_both for c in _CLASSES}
    stems = cut(by_stem.select(F.col("word").alias("stem"), F.col("types").alias("of_stem")).join(
        stems.select(F.col("word").alias("stem"), *[p_stem[c].alias(f"p_{c}") for c in _CLASSES]), "stem", "left"
    ))
    ratio = lambda of: F.log(of("toxic")) - F.log(of("ordinary"))
    rest_of_stems = float(np.log(left_stems["toxic"] / left_stems["ordinary"]))
    of_words = words.withColumn("stem", stem).join(stems, "stem")
    spelled = lambda c: F.coalesce(F.col(f"p_{c}"), left_stems[c] * F.col("of_stem") / sums["types"])
    above = float(np.log(left["toxic"] / left["ordinary"]))
    table = of_words.select(
        F.col("word").alias("key"),
        (ratio(lambda c: F.col(c) + left[c] * spelled(c) * F.col("types") / F.col("of_stem")) - ratio(spelled) - above).alias("beyond"),
    ).union(
        stems.where("p_toxic is not null").select(F.col("stem").alias("key"), (ratio(lambda c: F.col(f"p_{c}")) - rest_of_stems).alias("beyond"))
    )
    return Model(cut(table), (left["n"] + left_stems["n"]) // model_words + 1, rest_of_stems + above)


def discount(ones: int, twos: int) -> float:
    """Kneser-Ney's n1 / (n1 + 2 n2); a half where nothing was counted once, as a discount of none leaves nothing to back off with."""
    return ones / (ones + 2 * twos) if ones else 0.5


def bigram_model(labelled: DataFrame, share: float, sigmas: float = SIGMAS, model_words: int = MODEL_WORDS) -> Model | None:
    """From rows (text, toxic); ``share`` is about the toxic class's share of all counts.  None while a class has no word."""
    c = F.col
    pairs = count_pairs(labelled)
    words = _statistics(pairs, share)
    seen = [x for k in _CLASSES for x in (F.sum(k).alias(f"count_{k}"), F.count_if(c(k) > 0).alias(f"types_{k}"))]
    histories = pairs.groupBy(c("before").alias("word")).agg(*seen)
    summed = [x for x in words.columns if x != "word"]
    # One job, so that both read one shuffle of the pairs; of the words before only what the back-off weights need is shuffled.
    stats = cut(words.withColumn("role", F.lit(0)).unionByName(histories.withColumn("role", F.lit(1)), allowMissingColumns=True))
    words, histories = (stats.where(c("role") == role).drop("role") for role in (0, 1))
    sums = words.agg(*[F.sum(x).alias(x) for x in summed]).first()
    if not sums["types_toxic"] or not sums["types_ordinary"]:
        return None
    exact = sums["count_toxic"] / (sums["count_toxic"] + sums["count_ordinary"])
    stem = F.shiftleft(F.shiftrightunsigned("word", 32), 32)
    by_stem = cut(words.groupBy(stem.alias("word")).agg(*[F.sum(x).alias(x) for x in summed]))

    def level(rows: DataFrame):
        """(what a class has beyond its discount, what its discounts leave), each by class; whether a class has more than chance explains."""
        found = rows.agg(*[F.count_if(test(c(f"types_{k}"))).alias(f"{name}_{k}") for k in _CLASSES for name, test in (("ones", lambda x: x == 1), ("twos", lambda x: x == 2), ("some", lambda x: x > 0))]).first()
        off = {k: discount(found[f"ones_{k}"], found[f"twos_{k}"]) for k in _CLASSES}
        own = {k: F.greatest(c(f"types_{k}") - off[k], F.lit(0.0)) / sums[f"types_{k}"] for k in _CLASSES}
        left = {k: off[k] * found[f"some_{k}"] / sums[f"types_{k}"] for k in _CLASSES}
        telling = F.lit(False)
        for k, change in zip(_CLASSES, (exact - share, share - exact), strict=True):
            expected = F.greatest(c(f"expected_{k}") + change * c(f"slope_{k}"), F.lit(0.0))
            telling |= c(f"types_{k}") - expected > sigmas * F.sqrt(expected + 1)
        return own, left, telling

    own, left, telling = level(by_stem)
    stems = by_stem.select(
        c("word").alias("stem"), c("types").alias("of_stem"), telling.alias("telling"),
        *[(own[k] + left[k] * c("types") / sums["types"]).alias(f"stem_{k}") for k in _CLASSES],
    )
    ratio = lambda name: F.log(f"{name}_toxic") - F.log(f"{name}_ordinary")
    of_stem = F.when(c("telling"), ratio("stem")).otherwise(0.0)
    own, left, telling = level(words)
    told = small(cut(words.where(telling).select(stem.alias("stem"), "word", "types", *[own[k].alias(f"own_{k}") for k in _CLASSES])))
    told = cut(stems.join(told, "stem").select(
        "word", of_stem.alias("of_stem"), *[(c(f"own_{k}") + left[k] * c(f"stem_{k}") * c("types") / c("of_stem")).alias(f"p_{k}") for k in _CLASSES]
    ))
    # Pairs that end in such a word, with what is known of the word before.
    pairs = count_pairs(labelled, told.select("word")).join(small(told), "word")
    histories = histories.select(c("word").alias("before"), *[f"{name}_{k}" for name in ("count", "types") for k in _CLASSES])
    above = {}
    for k in _CLASSES:
        off, seen = discount(sums[f"ones_{k}"], sums[f"twos_{k}"]), c(f"count_{k}")
        high = (F.greatest(c(k) - off, F.lit(0.0)) + off * c(f"types_{k}") * c(f"p_{k}")) / seen
        above[k] = F.when(seen > 0, high).otherwise(c(f"p_{k}"))
    pairs = pairs.join(histories, "before").select("before", "word", (F.log(above["toxic"]) - F.log(above["ordinary"]) - ratio("p")).alias("beyond"))

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, word = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_pair_keys(before, word).view(np.int64)), batch.column(2)], ["key", "beyond"])

    table = cut(
        stems.where("telling").select(c("stem").alias("key"), of_stem.alias("beyond"))
        .union(told.select(c("word").alias("key"), (ratio("p") - c("of_stem")).alias("beyond")))
        .union(pairs.mapInArrow(with_keys, "key long, beyond double"))
    )
    return Model(table, table.count() // model_words + 1)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sigmas: float = SIGMAS,
    calibration_rows: int = CALIBRATION_ROWS,
    model_words: int = MODEL_WORDS,
) -> Model:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    ``calibration_rows`` bounds the rows that
    fit the logistic curve, and nothing else; ``model_words`` the words that
    are sent at once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    labelled = docs.select("doc_id", "text").where("doc_id is not null").join(small(known), "doc_id")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(CALIBRATION))
    length = F.coalesce(F.sum(F.when(place != 0, F.length("text"))), F.lit(0))
    sizes = {r["toxic"]: r for r in labelled.groupBy("toxic").agg(F.count("*").alias("n"), length.alias("length")).collect()}
    constant = Model(prior=sizes[1]["n"] / sum(r["n"] for r in sizes.values()) if 1 in sizes else 0.0)
    if len(sizes) < 2 or not sizes[0]["length"] or not sizes[1]["length"]:
        return constant
    labelled = labelled.where("text is not null")
    share = sizes[1]["length"] / (sizes[0]["length"] + sizes[1]["length"])
    model = bigram_model(labelled.where(place != 0), share, sigmas, model_words)
    if model is None:
        return constant
    model.prior = constant.prior
    _calibrate(model, labelled.where(place == 0), sum(r["n"] for r in sizes.values()), calibration_rows)
    return model


def _calibrate(model: Model, rows: DataFrame, labels: int, bound: int) -> None:
    """The curve, from rows that the model has not counted."""
    share = min(1.0, bound * CALIBRATION / labels)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 20))
    chosen = rows.where(place < int(share * (1 << 20)) + 1)
    got = model.means(chosen, "toxic").where("x is not null").toArrow()
    x, y = got["x"].to_numpy(), got["toxic"].to_numpy().astype(float)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    if len(x):
        model.bound = float(max(1e-6, np.quantile(np.abs(x), 0.98)))
        x = np.clip(x, -model.bound, model.bound)
    model.slope, model.shift = logistic(x, y, model.prior)


def logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift by Newton's method on the standardised x; without both classes, a constant."""
    base = float(np.log(prior / (1 - prior)))
    if len(x) < 2 or y.min() == y.max() or x.std() == 0:
        return 0.0, base
    mean, spread = x.mean(), x.std()
    design = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    beta = np.array([0.0, base])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(
            (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (y - p) - ridge * (beta - [0, base])
        )
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * mean / spread)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): one map over the rows for each part of the model."""
    rows = docs.select("doc_id", "text")
    if model.table is None:
        return rows.select("doc_id", F.lit(float(model.prior)).alias("score"))
    mean = F.greatest(F.least(F.col("x"), F.lit(model.bound)), F.lit(-model.bound))
    power = F.greatest(F.least(model.slope * mean + model.shift, F.lit(30.0)), F.lit(-30.0))
    p = F.when(F.col("x").isNull(), F.lit(model.prior)).otherwise(1 / (1 + F.exp(-power)))
    return model.means(rows, "doc_id").select("doc_id", p.alias("score"))
