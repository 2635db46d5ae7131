"""Quality by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at one property of a text and votes good, bad, or abstains.
No rule decides alone.  The votes of all documents are counted by pattern (at
most 3 ** rules rows), and expectation-maximisation on the pattern counts
estimates for each rule how often it votes each way on good and on bad
documents, and the share of good ones.  A document's posterior probability of
being good follows from its own votes; it is kept from 0.5 on.

Everything on the rows is a DataFrame expression; only the pattern counts
reach the driver, where the estimation runs in a few arithmetic steps.

The base figures: words are ``[^\\x20\\x09-\\x0D]+``; ``n_repeat_words`` counts
the words inside 3-word windows found twice or more, the first included,
windows being compared by a 64-bit hash within their document.

Defined results: null and empty texts have no words and fail the base rules,
as do all texts of fewer than 50 words and those mostly repeated; repeated
rows are judged alike and each counts; an empty table gives an empty result;
if no document passes the base rules, none is kept; further columns are
ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut

#: Fixed values.
SEPARATORS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_capitals", "n_marks", "n_shouts")


class Rule(NamedTuple):
    """Votes bad or good where the condition holds; abstains elsewhere, and where both hold."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 50 or n_words > 100000", "n_words between 50 and 100000"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars between 2.5 * n_words and 10 * n_words"),
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols < 0.05 * n_words"),
    Rule("marks", "n_marks > 0.35 * n_words", "n_marks < 0.3 * n_words"),
    Rule("letters", "n_marks > 0.08 * word_chars", "n_marks < 0.06 * word_chars"),
    Rule("lines", "n_dup_lines > 0.5 * n_lines", "n_dup_lines < 0.3 * n_lines"),
    Rule("repetition", "n_repeat_words > 0.4 * n_words", "n_repeat_words < 0.35 * n_words"),
    Rule("capitals", "n_capitals > 0.5 * word_chars", "n_capitals < 0.15 * word_chars"),
    Rule("shouting", "n_shouts > 0.2 * n_words", "n_shouts < 0.05 * n_words"),
)


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _covered(starts: Column) -> Column:
    """Words inside 3-word windows that start at the sorted places."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the base figures, and the rules' further ones), all long."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        F.length(F.translate(text, SEPARATORS, "")).alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, CAPITALS).alias("n_capitals"),
        _count(text, MARKS).alias("n_marks"),
        _count(text, "!").alias("n_shouts"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"),
    )
    words = F.col("words")
    after = lambda k: F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1)))
    pairs = F.zip_with(words, after(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    windows = F.slice(
        F.zip_with(pairs, after(2), lambda p, c: F.xxhash64(p["a"], p["b"], c)), 1, F.greatest(F.size(words) - 2, F.lit(0))
    )
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_shouts",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(words).alias("n_words"),
        windows.alias("windows"),
    )
    # Windows sorted by hash: those with an equal neighbour are repeated.
    rows = rows.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
        ),
    ).drop("windows")
    rows = rows.withColumn(
        "equal",
        F.zip_with("sorted", F.slice("sorted", 2, F.greatest(F.size("sorted"), F.lit(1))), lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))),
    )
    places = F.zip_with(
        "sorted",
        F.zip_with("equal", F.concat(F.array(F.lit(False)), F.col("equal")), lambda x, y: F.coalesce(x, F.lit(False)) | y),
        lambda s, hit: F.when(hit, s["i"]),
    )
    rows = rows.withColumn("places", F.sort_array(F.filter(places, lambda p: p.isNotNull())))
    return rows.select(
        "doc_id",
        *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        F.coalesce(_covered(F.col("places")), F.lit(0)).cast("long").alias("n_repeat_words"),
        *[F.col(c).cast("long").alias(c) for c in _MORE],
    )


def votes(figures: DataFrame, rules=RULES) -> DataFrame:
    """The rows with one column for each rule: 1 good, -1 bad, 0 abstains."""
    cast = {
        f"vote_{r.name}": F.expr(f"case when ({r.bad}) and not ({r.good}) then -1 when ({r.good}) and not ({r.bad}) then 1 else 0 end")
        for r in rules
    }
    return figures.withColumns(cast)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict[int, float]]]:
    """Log odds of good over bad, and of each rule's votes, from counted patterns, by EM.

    The first guess trusts a document less for each bad vote.  Counts are
    smoothed by one document for each vote and class.
    """
    if not patterns:
        return -1.0, []
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    n_rules = len(patterns[0][0])
    q = [0.95 * 0.1 ** sum(v < 0 for v in votes_) for votes_, _ in patterns]
    odds, weights = 0.0, []
    for _ in range(rounds):
        good = sum(n * p for (_, n), p in zip(patterns, q, strict=True))
        odds = math.log((good + 1) / (total - good + 1))
        weights = []
        for r in range(n_rules):
            yes, no = {-1: 1.0, 0: 1.0, 1: 1.0}, {-1: 1.0, 0: 1.0, 1: 1.0}
            for (votes_, n), p in zip(patterns, q, strict=True):
                yes[votes_[r]] += n * p
                no[votes_[r]] += n * (1 - p)
            a, b = sum(yes.values()), sum(no.values())
            weights.append({v: math.log(yes[v] / a) - math.log(no[v] / b) for v in yes})
        logits = [odds + sum(w[v] for w, v in zip(weights, votes_, strict=True)) for votes_, _ in patterns]
        q = [1 / (1 + math.exp(-max(-40.0, min(40.0, x)))) for x in logits]
    return odds, weights


def judge(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base figures, base_failed, kept, posterior)."""
    figures = votes(features(docs, id_col, text_col), rules).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    figures = cut(figures)
    names = [f"vote_{r.name}" for r in rules]
    counted = figures.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n")).collect()
    odds, weights = estimate([(tuple(row[c] for c in names), row["n"]) for row in counted])
    logit = F.lit(odds)
    for name, weight in zip(names, weights, strict=False):
        logit = logit + F.when(F.col(name) > 0, weight[1]).when(F.col(name) < 0, weight[-1]).otherwise(weight[0])
    posterior = F.round(1 / (1 + F.exp(-logit)), 9)
    return figures.select(
        "doc_id", *BASE, "base_failed", (~F.col("base_failed") & (posterior >= 0.5)).alias("kept"), posterior.alias("posterior")
    )
