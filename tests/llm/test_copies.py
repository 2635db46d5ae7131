"""Near duplicates, repeated passages and benchmark copies against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from geoloom.llm import decontaminate, jaccard, session, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_groups(rows, k=5):
    sets, inverted, parent = {}, defaultdict(list), {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in rows:
        w = WORD.findall(lower(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        parent[i] = i
    for i, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for j in inverted[g]:
                common[j] += 1
            inverted[g].append(i)
        for j, o in common.items():
            if 100 * o >= 80 * (len(s) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def copies():
    """Chains of edits, large groups of near copies, a passage that most documents share, short texts."""
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 12)):
            add(words)
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(60):
        words = list(base)
        words[rng.randrange(len(words))] = f"u{rng.random()}"
        add(words)
    for _ in range(40):
        head = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        add(head + passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 15))])
    for text in (["a"], ["a"], ["A"], ["a", "b"], [], ["x", "y", "z", "w", "q", "r"]):
        add(text)
    return rows


@pytest.mark.parametrize(("frequent", "light"), [(2, 2), (5, 3), (5, 1000), (1000, 100)])
def test_groups_are_those_of_brute_force(spark, copies, frequent, light):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, frequent=frequent, light=light).collect()}
    assert got == brute_groups(copies)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_long_combination(percent):
    """Pairs just above the threshold, with and without tokens of their own, share a key; sets far apart rarely do."""
    rng = np.random.default_rng(percent)
    far = met = 0
    for _ in range(300):
        n = int(rng.integers(5, 400))
        base = np.unique(rng.integers(0, 1 << 48, n, np.uint64))
        n = len(base)
        common = int(rng.integers(-(-percent * n // 100), n + 1))
        most = 100 * common // percent - common
        left, right = int(rng.integers(0, most + 1)), 0
        right = int(rng.integers(0, most - left + 1))
        extra = rng.integers(0, 1 << 48, left + right, np.uint64)
        a, b = np.concatenate([base[:common], extra[:left]]), np.concatenate([base[:common], extra[left:]])
        assert 100 * common >= percent * (common + left + right)
        own = rng.integers(0, 2, 2)  # whether the tokens that differ are in no other document
        shared = [base[:common] if own[i] else x for i, x in enumerate((a, b))]
        keys = [jaccard.long_combinations(len(x), s, percent) for x, s in zip((a, b), shared, strict=True)]
        assert len(np.intersect1d(*keys))
        if n > 100 and percent >= 80:
            other = np.concatenate([base[: n // 2], rng.integers(0, 1 << 48, n - n // 2, np.uint64)])
            met += len(np.intersect1d(keys[0], jaccard.long_combinations(n, other, percent))) > 0
            far += 1
    assert met <= 0.5 * far


def test_keys_with_many_rows_are_dealt_over_tasks(spark):
    rows = spark.createDataFrame([(i % 7 and 1, i) for i in range(700)], "k long, v long")
    one = spark.createDataFrame([(0, "a"), (1, "b")], "k long, w string")
    for how in ("inner", "left"):
        got = session.join_one(rows, one, ["k"], how, hot_rows=10, rows_bound=50 if how == "left" else 0)
        assert sorted((r.v, r.w) for r in got.collect()) == [(i, "b" if i % 7 else "a") for i in range(700)]


def test_groups_on_odd_rows(odd, none):
    rows = jaccard.similar_groups(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (0, 1) and got[3] == (0, 3) and got[6] == (29_996, 5) and got[7] == (1, 7)
    assert jaccard.similar_groups(none).count() == 0


def test_several_texts_of_one_id_tie_groups(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 1}


def test_an_id_with_a_copied_text_and_another_keeps_its_links(spark):
    x, y = ([f"{c}{i}" for i in range(40)] for c in "xy")
    docs = [(1, x), (5, x), (5, y), (9, [*y[:38], "end"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    rows = jaccard.similar_groups(docs).collect()
    assert len(rows) == 4 and {r.component_id for r in rows} == {1}


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in [*range(40), 1000]:
        keys = np.sort(rng.integers(0, 1 << 63 if n % 2 else n + 1, n, np.uint64))
        assert (jaccard.unpack(jaccard.pack(keys)) == keys).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 200]], "doc_id long")
    got = {r.doc_id: r.label for r in jaccard.components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}


def brute_removed(rows, size):
    first, out = {}, {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(i, first.get(key, i))
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize(("size", "core", "hot"), [(50, 12, 1000), (50, 12, 2), (9, 3, 20)])
def test_removed_words_are_those_of_brute_force(spark, copies, size, core, hot):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, size, core, hot).collect()}
    assert got == brute_removed(copies, size)


def test_removal_on_odd_rows(odd, none):
    rows = substrings.remove_repeats(odd).collect()
    got = {r.doc_id: (r.n_words, r.n_removed) for r in rows}
    assert len(rows) == odd.count()
    assert got[5] == (30_000, 0) and got[6] == (30_000, 30_000) and got[1] == (0, 0)
    assert substrings.remove_repeats(none).count() == 0


def plain_alignment(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_scores():
    rng = np.random.default_rng(2)
    items, lengths, windows = np.zeros((40, 12), np.uint64), rng.integers(1, 13, 40), rng.integers(2, 6, (40, 20)).astype(np.uint64)
    for i, n in enumerate(lengths):
        items[i, :n] = rng.integers(2, 6, n)
    got = decontaminate.smith_waterman(items, lengths, windows)
    assert got.tolist() == [plain_alignment(items[i, :n].tolist(), windows[i].tolist()) for i, n in enumerate(lengths)]


def test_copies_and_edited_copies_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, words(rng.randint(15, 50))) for i in range(12)]
    docs, expected = [], set()
    for i in range(60):
        body = words(150)
        if i % 3 == 0:
            item, text = items[i % 12]
            text = [("edited" if rng.random() < 0.15 else w) for w in text]
            if i % 2:
                text = [w.upper() + "," for w in text]
            body = body[:70] + text + body[70:]
            expected.add((i, item))
        docs.append((i, " ".join(body)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for block_chars in (1 << 20, 200):
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, benchmark, block_chars=block_chars).collect()}
        assert got == expected
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()}
    assert left == set(range(60)) - {d for d, _ in expected}


@pytest.mark.parametrize(("every", "exact"), [(4, 0), (4, 1), (5, 0), (5, 1), (6, 0), (6, 1)])
def test_copies_with_regular_edits_are_found(spark, every, exact):
    """An edit in each stretch of words, alone or beside an exact copy."""
    rng = random.Random(every)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, words(n)) for i, n in enumerate((20, 40, 80))]
    docs = []
    for i, text in items:
        edited = [f"edit{rng.random()}" if j % every == every - 1 else w for j, w in enumerate(text)]
        docs.append((10 + i, words(60) + edited + words(60)))
        docs += [(20 + i, words(60) + text + words(60))] * exact
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, benchmark).collect()}
    assert got == {(d + i, i) for d in (10, 20)[: 1 + exact] for i in range(3)}


def test_scores_are_those_of_whole_documents(spark):
    """Replaced, inserted and dropped words in texts of few words: every pair with three aligned words in a row."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items, docs = [(i, words(rng.randint(5, 30))) for i in range(10)], []
    for i in range(60):
        text = []
        for w in items[i % 10][1]:
            r = rng.random()
            text += [w] if r < 0.75 else words(1) if r < 0.85 else [] if r < 0.9 else [w, *words(rng.randint(1, 8))]
        docs.append((i, words(rng.randint(0, 80)) + text + words(rng.randint(0, 80))))
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    best = {(d, i): plain_alignment(w, t) / (2 * len(w)) for d, t in docs for i, w in items if grams(w) & grams(t)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_contamination(docs, benchmark).collect()}
    assert len(got) > 30 and got == {k: v for k, v in best.items() if v >= decontaminate.LEAST}


def test_contamination_on_odd_rows(spark, odd, none):
    benchmark = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (None, None), (3, ""), (4, "one two")], "item_id long, text string")
    rows = decontaminate.find_contamination(odd, benchmark).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(4, 1), (4, 1)]
    assert decontaminate.find_contamination(none, benchmark).count() == 0
    assert decontaminate.drop_contaminated(odd, benchmark.limit(0)).count() == odd.count()
    assert decontaminate.drop_contaminated(odd, benchmark).columns == odd.columns


def test_hashes_depend_on_bytes_only():
    import pyarrow as pa

    from geoloom.llm import textblocks

    blocks = list(textblocks.blocks(pa.array(["a bc", None, "bc  a\n", "", "a"]), 4))
    seen = {}
    for b in blocks:
        words = textblocks.find_words(b.data, b.offsets)
        raw = b.data.tobytes()
        for s, e, h in zip(words.starts, words.ends, textblocks.span_hashes(b.data, words.starts, words.ends)):
            assert seen.setdefault(raw[s:e], h) == h
    assert set(seen) == {b"a", b"bc"} and hashlib.sha256(b"").hexdigest()


def test_no_table_of_documents_is_broadcast_beyond_its_own_bound(spark, monkeypatch):
    """Joins by document are right without any broadcast, and ask for the lower bound."""
    words = [f"w{i}" for i in range(60)]
    texts = [words, words, [*words[:58], "x", "y"], [f"v{i}" for i in range(60)], [*words[:59], "z"]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    want = sorted(map(tuple, jaccard.similar_groups(docs).collect()))
    asked = []
    plain = session.is_small
    monkeypatch.setattr(jaccard, "DOCUMENTS", 0)
    monkeypatch.setattr(session, "is_small", lambda df, rows=session.BROADCAST_ROWS: asked.append(("doc_id" in df.columns or "a" in df.columns, rows)) or plain(df, rows))
    assert sorted(map(tuple, jaccard.similar_groups(docs).collect())) == want
    assert [r[2] for r in want] == [0, 0, 0, 3, 0]
    assert asked and {rows for of_documents, rows in asked if of_documents} == {0}
