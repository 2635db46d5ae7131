"""Language, toxicity, quality, urls and mixing."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geoloom.llm import langid, mixing, quality, queries, toxicity, urls

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_texts(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op1_language_id(spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd, none):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[1].lang_pred == got[3].lang_pred == got[7].lang_pred == "und" and got[7].rejected
    assert got[8].rejected, "a script that was never learned"
    assert langid.predict(none, model).count() == 0
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.keep_known(odd, model).columns == odd.columns


def test_clean_documents_are_not_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = langid.keep_known(docs, langid.fit(docs)).count()
    assert kept >= 0.998 * docs.count()


def test_toxicity_of_held_out_labels(spark):
    """Against ``labels.toxic`` of rows that were not learned from; on the larger table, where 120 of them are toxic."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    rows = queries.op3_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) > 90
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, 0), (None, 1), (99, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.5}, "two rows of 4 against 5 and 6"
    assert toxicity.score(none, model).count() == 0
    for some, share in (("toxic = 1", 1.0), ("toxic = 0 and doc_id > 4", 0.0), ("doc_id = 99", 0.0)):
        assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, labels.where(some))).collect()} == {share}


def test_toxicity_query_with_labels_of_one_class(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.selectExpr("doc_id", "1 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == 20 and {(r.score, r.predicted) for r in rows} == {(1.0, 1)}


def plain_ratios(rows, sigmas):
    """log p(toxic) - log p(ordinary) by word and by stem, from (text, toxic), with the words themselves for keys."""
    pairs = {}
    for text, toxic in rows:
        words = re.findall(r"[a-z0-9é]+", text)
        for pair in set(zip([None, *words], words)):
            pairs.setdefault(pair, [0, 0])[1 - toxic] += 1
    counts = [sum(c[k] for c in pairs.values()) for k in (0, 1)]
    total = sum(counts)
    stem = lambda w: w[: toxicity.STEM] + "-" if len(w) > toxicity.STEM else w + "."
    out = {}
    levels = []
    for unit in (stem, lambda w: w):
        types, seen, expected = Counter(), [Counter(), Counter()], [Counter(), Counter()]
        for (_, word), c in pairs.items():
            types[unit(word)] += 1
            for k in (0, 1):
                seen[k][unit(word)] += c[k] > 0
                expected[k][unit(word)] += 1 - (1 - counts[k] / total) ** sum(c)
        levels.append((types, seen, expected))
    every = sum(levels[0][0].values())
    log = []
    for k in (0, 1):
        kept = []
        for types, seen, expected in levels:
            n = sum(seen[k].values())
            kept.append({u: max(seen[k][u] - expected[k][u] - sigmas * math.sqrt(expected[k][u] + 1), 0) / n for u in types})
        left = [1 - sum(x.values()) for x in kept]
        p = {s: kept[0][s] + left[0] * n / every for s, n in levels[0][0].items()}
        of_words = {w: kept[1][w] + left[1] * p[stem(w)] * n / levels[0][0][stem(w)] for w, n in levels[1][0].items()}
        log.append({w: math.log(v) for w, v in of_words.items()} | {("stem", s): math.log(left[1] * v) for s, v in p.items()})
    return {w: log[0][w] - log[1][w] for w in log[0]}


@pytest.fixture(scope="module")
def wide(spark):
    """More words than 2 ** 17, one that only toxic texts have, in 20 contexts, and a stem of theirs with many endings."""
    rng, rows = random.Random(13), []
    for i in range(2000):
        words = [f"n{i}x{j}" for j in range(75)] + [f"c{rng.randrange(300)}" for _ in range(25)]
        rng.shuffle(words)
        if i % 5 == 0 and i < 100:
            words[50] = "vile"
            words[60], words[70] = f"tréq{i}", f"tréqu{i}"
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.mark.parametrize("parts", [1, 3])
def test_ratios_are_those_of_words_that_share_no_counts(spark, wide, parts):
    rows, df = wide
    stats = toxicity._statistics(toxicity.count_pairs(df), 0.2).cache()
    model = toxicity._model(stats, 0.2, toxicity.SIGMAS, toxicity.MODEL_WORDS)
    assert model.parts == 1
    model.parts = parts
    want = plain_ratios([(t, y) for _, t, y in rows], toxicity.SIGMAS)
    assert want["vile"] > 1 and len(want) > 1 << 17
    assert want["tréq45"] > 1 and want["stem", "n6x3."] == want["n6x3"]
    words = ["vile", "c1", "c2", "n6x3", "unknown", "tréq45", "tréqunseen"]
    texts = spark.createDataFrame([(w, w) for w in words] + [("both", "c1 vile C1 vile"), ("both", "c1 vile C1 vile"), ("none", None)], "name string, text string")
    got = [tuple(r) for r in model.means(texts, "name").collect()]
    want["unknown"], want["tréqunseen"] = want["n6x3"], want["stem", "tréq-"]
    want["both"] = (2 * want["c1"] + want["vile"]) / 3
    assert len(got) == 10 and ("none", None) in got
    assert all(x == pytest.approx(want[name], abs=1e-4) for name, x in got if name != "none")


def plain_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_figures_are_those_of_brute_force(spark, odd):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "é|", "\t", "\x0b", "# "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in quality.BASE) for r in quality.features(docs).collect()}
    assert got == {i: plain_figures(t) for i, t in enumerate(texts)}
    got = {r.doc_id: tuple(r[c] for c in quality.BASE) for r in quality.features(odd).collect()}
    assert got[1] == got[2] == (0, 0, 0, 0, 0) and got[5][0] == 30_000


def test_quality_parts_good_from_bad(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op4_quality_rules(spark, SF).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_estimated_accuracies():
    """EM finds a rare class that several rules agree on, and a rule that says nothing."""
    rng = random.Random(8)
    rows = []
    for _ in range(4000):
        bad = rng.random() < 0.15
        rows.append(tuple((-1 if rng.random() < 0.9 else 1) if bad else (-1 if rng.random() < 0.03 else 1) for _ in range(3)) + (rng.choice([-1, 0, 1]),))
    odds, weights = quality.estimate(list(Counter(rows).items()))
    assert abs(1 / (1 + math.exp(-odds)) - 0.85) < 0.03
    assert all(w[-1] < -2 and w[1] > 1.5 for w in weights[:3]) and all(abs(v) < 0.3 for v in weights[3].values())
    assert quality.estimate([])[1] == []


def test_quality_of_odd_rows(odd, none):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows if r.base_failed)
    assert quality.judge(none).count() == 0


def test_urls(spark):
    rows = [
        ("HTTP://Sub.Example.ORG/es/1", "sub.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/1x?y", "example.org", "/en/1x", "example.org/en/1", "block"),
        ("https://a.org", "a.org", "", None, None),
        ("https://a.org/", "a.org", "/", "org/", "allow"),
        ("https://notexample.com/de/#x", "notexample.com", "/de/", "com/de/", "block"),
        ("https://x.com/fr/a://b", "x.com", "/fr/a://b", "com/fr/", "allow"),
        ("no scheme", "", "", None, "block"),
        (None, "", "", None, "block"),
        ("", "", "", None, "block"),
    ]
    pages = spark.createDataFrame([(i, r[0], "h", "clash") for i, r in enumerate(rows)], "page_id long, url string, html string, host string")
    for r in urls.filter_urls(pages).collect():
        _, host, path, rule, verdict = rows[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict in (None, r.verdict)
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_url_model_parts_the_rest(spark):
    """On 2,500 urls: the 250 of the smaller table leave too few that the rules judge."""
    rows = [r for r in queries.op10_url_filter(spark, "/root/testdata/sf0.1").collect() if r.rule is None]
    assert all(r.verdict == ("allow" if r.verdict == "allow" else "block") for r in rows)
    share = lambda p: [r.verdict == "allow" for r in rows if r.path.startswith(p)]
    assert sum(share("/fr/")) > 0.8 * len(share("/fr/")) and sum(share("/de/")) < 0.2 * len(share("/de/"))


def brute_mix(sizes, entropy_share, repeats, budget=1.0):
    total = sum(sizes.values())
    p = {k: v / total for k, v in sizes.items()}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {k: x**a / z for k, x in p.items()}

    def fine(a):
        w = weights(a)
        return -sum(x * math.log2(x) for x in w.values()) >= entropy_share * math.log2(len(p)) - 1e-12

    def low(ok, lo=0.0, hi=1.0):
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo

    a = 1.0 if fine(1.0) else low(fine)
    reach = lambda d: max(budget * x / p[k] for k, x in weights(1 - d).items()) <= repeats
    return weights(max(a, 1 - (1.0 if reach(1.0) else low(reach))))


@pytest.mark.parametrize(("entropy_share", "repeats"), [(0.95, 4.0), (1.0, 1.5), (None, 2.0)])
def test_mixture_meets_its_weights(spark, entropy_share, repeats):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice("aaaaaaaaabbc")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, entropy_share, repeats).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute_mix(sizes, entropy_share if entropy_share is not None else 0, repeats)
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    for s, w in want.items():
        assert -30 <= tokens[s] - w * sum(sizes.values()) <= 0.01
    times = Counter((r.doc_id, r.epoch) for r in got)
    assert max(times.values()) == 1
    assert max(Counter(r.doc_id for r in got).values()) <= math.ceil(repeats)


def test_mixture_equals_its_sql_on_skewed_sources(spark, tmp_path):
    import duckdb

    from geoloom.llm import oracles

    rng = random.Random(10)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a"] * 12 + ["b", "b", "c", None])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_source_mixing(spark, str(tmp_path)).select("doc_id", "source", "epoch", "place", "n_tokens").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(oracles.OP7).fetchall()
    assert len({r.epoch for r in got}) > 1
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_mixture_of_odd_rows(odd, none):
    rows = mixing.mix(odd, None, None).collect()
    assert len(rows) == odd.where("length(text) > 0").count() or len(rows) <= odd.count()
    assert {r.score for r in rows} <= {"x", None}
    assert mixing.mix(none).count() == 0


def test_mixture_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    names = ("key", "full", "cut", "epoch", "Place", "n_tokens", "place_", "p", "rest", "_parts")
    more = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    got = mixing.mix(more)
    assert got.columns == ["doc_id", "text", "source", "key", "full", "cut", "place_", "p", "rest", "_parts", "epoch", "n_tokens", "place"]
    assert sorted(tuple(r) for r in got.select("doc_id", "text", "source", "epoch", "n_tokens", "place").collect()) == want
    assert {(r.key, r.cut) for r in got.collect()} == {("own key", "own cut")}


def plain_bigrams(rows, sigmas):
    """log p(toxic) - log p(ordinary) of a pair of words by two Kneser-Ney models, from (text, toxic)."""
    pairs = {}
    for text, toxic in rows:
        words = re.findall(r"[a-z0-9é]+", text)
        for pair in set(zip([None, *words], words)):
            pairs.setdefault(pair, [0, 0])[1 - toxic] += 1
    stem = lambda w: w[: toxicity.STEM] + "-" if len(w) > toxicity.STEM else w + "."
    q = sum(c[0] for c in pairs.values()) / sum(sum(c) for c in pairs.values())
    every, probability, telling = len(pairs), [None, None], set()

    def discount(counts):
        ones, twos = (sum(n == k for n in counts) for k in (1, 2))
        return ones / (ones + 2 * twos)

    for k in (0, 1):
        p = None
        for unit in (stem, lambda w: w):
            types, seen, expected = Counter(), Counter(), Counter()
            for (_, word), c in pairs.items():
                types[unit(word)] += 1
                seen[unit(word)] += c[k] > 0
                expected[unit(word)] += 1 - (1 - (1 - q, q)[k == 0]) ** sum(c)
            telling |= {(p is not None, u) for u in types if seen[u] - expected[u] > sigmas * math.sqrt(expected[u] + 1)}
            off, n = discount(seen.values()), sum(seen.values())
            left = off * sum(x > 0 for x in seen.values()) / n
            below = {u: m / every for u, m in types.items()} if p is None else {u: p[stem(u)] * m / of_stem[stem(u)] for u, m in types.items()}
            p, of_stem = {u: max(seen[u] - off, 0) / n + left * below[u] for u in types}, types
            probability[k] = (probability[k] or []) + [p]
    offs = [discount([c[k] for c in pairs.values()]) for k in (0, 1)]
    before = [{}, {}]
    for (h, _), c in pairs.items():
        for k in (0, 1):
            n, m = before[k].get(h, (0, 0))
            before[k][h] = n + c[k], m + (c[k] > 0)

    def ratio(h, w):
        if (True, w) not in telling:
            return math.log(probability[0][0][stem(w)] / probability[1][0][stem(w)]) if (False, stem(w)) in telling else 0.0
        both = [probability[k][1][w] for k in (0, 1)]
        if (h, w) in pairs:
            for k in (0, 1):
                n, m = before[k][h]
                both[k] = (max(pairs[h, w][k] - offs[k], 0) + offs[k] * m * both[k]) / n if n else both[k]
        return math.log(both[0] / both[1])

    return ratio, pairs


def test_bigrams_are_those_of_two_kneser_ney_models(spark, wide):
    rows, _ = wide
    rows = [(i, t.replace("c7 ", "c7 vile ") if y and i % 3 == 0 else t, y) for i, t, y in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.bigram_model(df, 0.21)
    ratio, pairs = plain_bigrams([(t, y) for _, t, y in rows], toxicity.SIGMAS)
    assert ("c7", "vile") in pairs and ratio("c7", "vile") != ratio("unknown", "vile") > 1
    texts = ["vile", "c7 vile", "c7 c8", "c1 vile c7 vile c7 vile", "tréqunseen unknown", rows[0][1], rows[1][1], rows[45][1]]
    got = {r.text: r.x for r in model.means(spark.createDataFrame([(t, t) for t in texts], "name string, text string"), "name").withColumnRenamed("name", "text").collect()}
    for text in texts:
        words = text.split()
        found = [ratio(h, w) for h, w in set(zip([None, *words], words))]
        assert got[text] == pytest.approx(sum(found) / len(found), abs=1e-5)


def test_bigrams_shuffle_less_than_two_keys_for_each_pair(spark):
    """Pairs are sent once, sorted by word; of the words before only what their back-off weights need."""
    rng = random.Random(5)
    parts = [[(" ".join(f"w{rng.randrange(600)}" for _ in range(150)), int(i % 8 == 0)) for i in range(700)] for _ in range(2)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(parts, 2).flatMap(list), "text string, toxic int")
    pairs = sum(len({pair for text, _ in rows for pair in zip([None, *text.split()], text.split())}) for rows in parts)
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    toxicity.bigram_model(df, 0.125)
    assert 0 < written() - before < 14.5 * pairs


def test_pairs_are_summed_over_several_hand_overs(spark, monkeypatch):
    """However few pairs a task sums at once, and where a word follows many: all counts are those of plain Python."""
    rows = [(f"w{i % 7} hub {'x' * (i % 3 + 1)} hub y{i} hub w{i % 7} hub", int(i % 4 == 0)) for i in range(3000)]
    monkeypatch.setattr(toxicity, "PAIRS", 500)
    want = Counter()
    for text, toxic in rows:
        words = text.split()
        for pair in set(zip([None, *words], words)):
            want[(*pair, toxic)] += 1
    got = toxicity.count_pairs(spark.createDataFrame(rows, "text string, toxic int").repartition(3)).collect()
    assert len(got) == len({(r.word, r.before) for r in got}) == len({k[:2] for k in want})
    pairs = Counter((want[(*k, 1)], want[(*k, 0)]) for k in {k[:2] for k in want})
    assert Counter((r.toxic, r.ordinary) for r in got) == pairs
