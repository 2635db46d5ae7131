"""Mixing sources to target weights by temperature.

Source i with a share p_i of all tokens gets the weight p_i ** alpha, divided
by their sum.  alpha = 1 leaves the shares, alpha = 0 makes the sources equal.
The exponent is bisected to the largest one whose weights reach the target
entropy; if some source would then be repeated more often than allowed, it is
raised to the smallest one that keeps the limit.  Sources are never brought to
the driver: a step of the bisection is one aggregate over their small table,
which tries a grid of exponents at once.

The weights are realised under a token budget.  A source's tokens are passed
over in full as often as they fit; the rest is a part of one more pass.  The
order of a pass is a permutation of blocks: a document's 36-bit hash with the
pass's number is its place, and the first, second and third 12 bits of it are
its block, the block within and the last one.  To find where the budget of the
last pass ends, token sums are taken by block, then inside the block where it
ends, then inside that one's; so no step holds more than 4096 rows a source,
and a source with a third of all rows is added up in partial sums like any
other.  Documents follow each other in the order of their place, and are taken
as long as their tokens fit.

Defined results: null and empty sources are one source; texts without words
have no tokens and take part in full passes only; repeated rows have the same
place and are taken or left together; a table without tokens gives an empty
result; further columns are kept, whatever their names, but columns of the
table named as the result's own (``epoch``, ``place``, ``n_tokens``) are
replaced by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .session import cut, small

WORD = r"[^\x20\x09-\x0D]+"
RESULT = ("epoch", "place", "n_tokens")
_GRID = 32
_ROUNDS = 7


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _search(sources: DataFrame, worth: list, enough) -> float:
    """The largest exponent in [0, 1] that is ``enough`` (0 if none is); ``worth`` are aggregates of an exponent."""
    lo, hi = 0.0, 1.0
    for _ in range(_ROUNDS):
        grid = [lo + (hi - lo) * i / _GRID for i in range(_GRID + 1)]
        row = sources.agg(*[w(a).alias(f"x{i}_{j}") for i, a in enumerate(grid) for j, w in enumerate(worth)]).first()
        good = [i for i, a in enumerate(grid) if enough(a, [row[f"x{i}_{j}"] for j in range(len(worth))])]
        if not good:
            return 0.0
        best = max(good)
        if best == _GRID:
            return hi
        lo, hi = grid[best], grid[best + 1]
    return lo


def exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_share: float) -> float:
    """From rows (p), the shares; ``target_entropy`` in bits, ``budget_share`` the budget in passes over all tokens."""
    p = F.col("p")
    alpha = 1.0
    if target_entropy is not None:
        total = lambda a: F.sum(F.pow(p, F.lit(a)))
        logs = lambda a: F.sum(F.pow(p, F.lit(a)) * F.log2(p))

        def reaches(a: float, got: list[float]) -> bool:
            return math.log2(got[0]) - a * got[1] / got[0] >= target_entropy - 1e-12

        alpha = _search(sources, [total, logs], reaches)
    if max_repeats is not None:
        total = lambda a: F.sum(F.pow(p, F.lit(1 - a)))
        most = lambda a: F.max(F.pow(p, F.lit(-a)))
        # In 1 - alpha the repeats grow, so the largest distance from alpha = 1 is looked for.
        reach = _search(sources, [total, most], lambda a, got: budget_share * got[1] / got[0] <= max_repeats * (1 + 1e-12))
        alpha = max(alpha, 1 - reach)
    return alpha


def _place(seed: int, epoch: Column, doc_id: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 9), 16, 10).cast("long")


def _cuts(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, full, cut): full passes of a source, and the place where its last pass ends."""
    # open: the places still in question are those with the prefix ``base``; ``left``: tokens that still fit.
    state = weights.select("key", "full", F.col("rest").alias("left"), F.lit(0).cast("long").alias("base"))
    for level in (24, 12, 0):
        width = 1 << level
        inside = tokens.join(small(state), "key").where(
            F.shiftright(F.col("place"), level + 12) == F.shiftright(F.col("base"), level + 12)
        )
        block = F.shiftleft(F.shiftright(F.col("place"), level), level)
        sums = inside.groupBy("key", "full", "left", block.alias("block")).agg(F.sum("n_tokens").alias("n"))
        upto = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        ends = sums.withColumn("upto", F.sum("n").over(upto)).where("upto > left")
        found = ends.groupBy("key").agg(F.min(F.struct("block", "upto", "n")).alias("end"))
        state = cut(
            state.join(found, "key", "left").select(
                "key",
                "full",
                F.coalesce(F.col("left") - (F.col("end.upto") - F.col("end.n")), F.col("left")).alias("left"),
                # Without an end all places inside fit: what follows is past them.
                F.coalesce(F.col("end.block"), F.col("base") + (width << 12)).alias("base"),
            )
        )
    return state.select("key", "full", F.col("base").alias("cut"))


def mix(
    docs: DataFrame,
    target_entropy_share: float | None = 0.98,
    max_repeats: float | None = 4.0,
    budget_passes: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """The rows of ``docs``, one for each pass that takes them, with ``epoch`` (from 0), ``place`` and ``n_tokens``.

    ``target_entropy_share`` is the share of the highest entropy, log2 of the
    number of sources; ``budget_passes`` the budget in passes over all tokens.
    Ordered by (epoch, place) the result is the mixture's order.
    """
    key = F.coalesce(F.col("source").cast("string"), F.lit(""))
    tokens = cut(docs.select(key.alias("key"), "doc_id", token_count(F.col("text")).alias("n_tokens")))
    sources = cut(tokens.groupBy("key").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    facts = sources.agg(F.sum("tokens").alias("total"), F.count("*").alias("n")).first()
    total, n = facts["total"] or 1, facts["n"]
    shares = cut(sources.withColumn("p", F.col("tokens") / F.lit(float(total))))
    target = None if target_entropy_share is None or n < 2 else target_entropy_share * math.log2(n)
    alpha = exponent(shares, target, max_repeats, budget_passes) if n else 1.0
    scale = shares.agg(F.sum(F.pow("p", F.lit(alpha)))).first()[0] or 1.0
    granted = F.floor(F.round(F.lit(budget_passes * total) * F.pow("p", F.lit(alpha)) / F.lit(scale), 6)).cast("long")
    weights = cut(
        shares.withColumn("granted", granted).select(
            "key", F.expr("granted div tokens").alias("full"), (F.col("granted") % F.col("tokens")).alias("rest")
        )
    )
    last = tokens.where("n_tokens > 0").join(small(weights), "key")
    placed = cut(last.select("key", "n_tokens", _place(seed, F.col("full"), F.col("doc_id")).alias("place")))
    cuts = cut(_cuts(placed, weights))
    # Names of its own for what is joined, so that no column of the table can clash with it.
    own = [c for c in docs.columns if c.lower() not in RESULT]
    counted = docs.select(
        *[F.col(f"`{c}`") for c in own], key.alias("_mix_key"), F.col("doc_id").alias("_mix_id"), token_count(F.col("text")).alias("_mix_tokens")
    )
    ends = cuts.select(F.col("key").alias("_mix_key"), F.col("full").alias("_mix_full"), F.col("cut").alias("_mix_cut"))
    counted = counted.join(small(ends), "_mix_key")
    taken = (F.col("_mix_tokens") > 0) & (_place(seed, F.col("_mix_full"), F.col("_mix_id")) < F.col("_mix_cut"))
    passes = F.col("_mix_full") + taken.cast("int")
    out = counted.where(passes > 0).select(
        *[F.col(f"`{c}`") for c in own],
        F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("epoch"),
        F.col("_mix_tokens").alias("n_tokens"),
        "_mix_id",
    )
    return out.withColumn("place", _place(seed, F.col("epoch"), F.col("_mix_id"))).drop("_mix_id")
