"""URL filter: host and path rules, then a character language-model ratio.

The rules decide the urls they fit.  Those urls also train two smoothed
variable-order Markov models of characters, one of accepted and one of
rejected urls; every other url gets the verdict of the calibrated,
length-normalised difference of its two log-likelihoods.

All steps are DataFrame expressions.  A character's probability depends on the
longest context of up to ``order`` characters seen in training, with
Witten-Bell interpolation into the shorter ones, so the difference of a
character is a function of its (order + 1)-gram.  The grams of the table are
counted first, the difference is worked out once for each distinct gram, and
the urls look their grams up.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is blocked, as nothing can be fetched there.  An empty table
gives an empty result.  If the rules leave one of the classes without urls,
there is no model and every url without a rule is allowed.  Repeated rows are
judged alike; further columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import cut, join_one

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before a url's first character in a gram.
START = "\u0002"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, "(?s)://([^/?#]*)([^?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def _first_fit(rules, host: Column, path: Column, value) -> Column:
    """Rules are tried from the longest on."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        out = F.when(_fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def apply_rules(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    judged = pages.select(
        F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")
    )
    host, path = F.col("host"), F.col("path")
    return judged.withColumns(
        {
            "rule": _first_fit(rules, host, path, lambda r: r.text),
            "rule_verdict": _first_fit(rules, host, path, lambda r: r.verdict),
        }
    )


def _grams(order: int) -> Column:
    """All (order + 1)-grams of host and path, one for each character."""
    padded = F.concat(F.lit(START * order), F.col("host"), F.col("path"))
    n = F.length(padded) - order
    return F.when(
        n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(order + 1)))
    ).otherwise(F.array().cast("array<string>"))


def _model(counts: DataFrame, order: int, side: str, alphabet: int) -> DataFrame:
    """log p of every distinct gram of the table under one class.

    p_k(x | c) = (n(cx) + t(c) * p_{k-1}(x | c')) / (n(c) + t(c)), where n
    counts, t counts the distinct characters seen after c, and the shortest
    level interpolates with 1 / alphabet.
    A gram whose context was not seen takes the probability of the next
    shorter context; a character not seen after a seen context gets the
    share that the context leaves to the shorter ones.
    """
    out = counts.select("gram", F.lit(1.0 / alphabet).alias("p"))
    for k in range(order + 1):
        level = counts.groupBy(F.expr(f"right(gram, {k + 1})").alias("g")).agg(F.sum(side).alias("n")).where("n > 0")
        totals = level.groupBy(F.expr("left(g, length(g) - 1)").alias("c")).agg(
            F.sum("n").alias("nc"), F.count("*").alias("tc")
        )
        out = (
            out.withColumn("g", F.expr(f"right(gram, {k + 1})"))
            .withColumn("c", F.expr("left(g, length(g) - 1)"))
            .join(totals, "c", "left")
            .join(level, "g", "left")
            .select(
                "gram",
                F.when(F.col("nc").isNull(), F.col("p"))
                .otherwise((F.coalesce("n", F.lit(0)) + F.col("tc") * F.col("p")) / (F.col("nc") + F.col("tc")))
                .alias("p"),
            )
        )
    return out.select("gram", F.log("p").alias("logp"))


def filter_urls(
    pages: DataFrame,
    rules=RULES,
    order: int = 3,
    alphabet: int = 128,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score).

    ``score`` is the mean over characters of log p(accepted) - log p(rejected);
    null where there is no url or no model.  The threshold lies between the
    class means on the rule-judged urls, nearer to the class that varies less.
    A score equal to the threshold is accepted.  Four fifths of those urls count for the models, the rest (by a hash of the
    url) for the threshold.
    """
    judged = apply_rules(pages, rules, id_col, url_col)
    side = (F.crc32(F.concat("host", "path")) % 5 != 0) & F.col("rule_verdict").isNotNull()
    # Copies of a url are judged once and counted together: a frequent url or host is one row from here on.
    # An explode makes some eighty rows of one, so the urls are dealt over all tasks and not by their bytes.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = judged.groupBy("host", "path", "rule_verdict").agg(F.count("*").alias("times")).repartition(parts, "host", "path")
    grams = urls.select(
        "host",
        "path",
        F.when(side & (F.col("rule_verdict") == "allow"), F.col("times")).otherwise(0).alias("good"),
        F.when(side & (F.col("rule_verdict") == "block"), F.col("times")).otherwise(0).alias("bad"),
        F.explode(_grams(order)).alias("gram"),
    )
    counts = cut(grams.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    total = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not total["good"] or not total["bad"]:
        verdict = F.when((F.col("host") == "") & (F.col("path") == ""), "block").otherwise("allow")
        return judged.select(
            "page_id", "host", "path", "rule", F.coalesce("rule_verdict", verdict).alias("verdict"),
            F.lit(None).cast("double").alias("score"),
        )
    accepted = _model(counts, order, "good", alphabet).withColumnRenamed("logp", "a")
    rejected = _model(counts, order, "bad", alphabet).withColumnRenamed("logp", "r")
    ratios = cut(accepted.join(rejected, "gram").select("gram", (F.col("a") - F.col("r")).alias("ratio")))
    scored = cut(
        join_one(grams.select("host", "path", "gram"), ratios, ["gram"])
        .groupBy("host", "path")
        .agg(F.round(F.avg("ratio"), 9).alias("score"))
    )
    threshold = calibrate(urls.join(scored, ["host", "path"]))
    verdict = F.coalesce(
        F.col("rule_verdict"),
        F.when(F.col("score").isNull() | (F.col("score") < threshold), "block").otherwise("allow"),
    )
    return join_one(judged, scored, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "score"
    )


def calibrate(scored: DataFrame) -> float:
    """Where two normal distributions with the classes' means and deviations cut off equal tails."""
    held = scored.where((F.crc32(F.concat("host", "path")) % 5 == 0) & F.col("rule_verdict").isNotNull())
    rows = {
        r["rule_verdict"]: (r["m"], math.sqrt(max(0.0, (r["s"] or 0.0) - r["m"] ** 2)))
        for r in held.groupBy("rule_verdict")
        .agg(
            (F.sum(F.col("score") * F.col("times")) / F.sum("times")).alias("m"),
            (F.sum(F.col("score") * F.col("score") * F.col("times")) / F.sum("times")).alias("s"),
        )
        .collect()
    }
    if len(rows) < 2:
        return 0.0
    (good, wide), (bad, narrow) = rows["allow"], rows["block"]
    spread = wide + narrow
    return (good + bad) / 2 if spread == 0 else (good * narrow + bad * wide) / spread
