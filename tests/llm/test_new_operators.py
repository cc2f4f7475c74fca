"""op11 to op13 against plain Python, on small fixtures with all edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import cells, divergence, metricjoin, resampling

SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# --- op11 ---------------------------------------------------------------------------------


def shingle_set(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} or ({" ".join(words)} if words else set())


def brute_components(rows, percent=90):
    """rows: (doc_id, text), doc_ids may repeat. {doc_id: smallest doc_id reachable}."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i, _ in rows}


def near_copies(seed=5):
    """Crowds of near-copies at, above and below the threshold, chains, a common passage, unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, passage = [], [word() for _ in range(60)]
    for size, edits in ((120, 2), (80, 4), (60, 7)):
        base = [word() for _ in range(90)]
        for _ in range(size):
            w = base[:]
            for at in rng.sample(range(90), rng.randint(0, edits)):
                w[at] = word()
            rows.append(" ".join(w))
    chain = [word() for _ in range(200)]
    for n in range(12):
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append(" ".join(chain))
    for _ in range(150):
        rows.append(" ".join([word() for _ in range(rng.randint(5, 120))] + passage))
    for _ in range(100):
        rows.append(" ".join(word() for _ in range(rng.randint(1, 60))))
    rows += ["a b c d e f g h i j k", "a b c d e f g h i j k l", "A B c", "a b C", "a b", "a  b ", "x", "", " \t", None]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize(
    "p",
    [
        metricjoin.MetricJoin(), metricjoin.MetricJoin(crowd=4, cells=cells.Cells(90, few=3)), metricjoin.MetricJoin(crowd=4, cells=cells.Cells(90, cap=20, few=2, pivots=4, depth=2)),
        metricjoin.MetricJoin(crowd=1, cells=cells.Cells(90, cap=8, few=2, pivots=3)),
    ],
    ids=["default", "crowded", "recursion", "all crowded"],
)
def test_jaccard_join_against_brute_force(spark, p):
    rows = near_copies()
    out = metricjoin.components_of(frame(spark, [(i, t, None, None) for i, t in rows]), p).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in out} == want
    assert {r.doc_id: r.n_shingles for r in out} == {i: len(shingle_set(t)) for i, t in rows}


def test_jaccard_join_edges(spark):
    text = " ".join(map(str, range(40)))
    rows = [(7, text), (3, text), (3, "some other text of these few words"), (9, "some other text of these few words"), (None, text), (4, None), (4, None), (5, "")]
    out = metricjoin.components_of(frame(spark, [(i, t, None, None) for i, t in rows]).withColumnsRenamed({"lang": "node", "source": "low"})).collect()
    told = defaultdict(set)
    for r in out:
        told[r.doc_id].add(r.component_id)
    assert len(out) == len(rows)
    assert dict(told) == {7: {3}, 3: {3}, 9: {3}, None: {None}, 4: {4}, 5: {5}}
    assert metricjoin.components_of(frame(spark, [])).collect() == []


def test_sketches_never_exceed_the_sets_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.integers(0, 2**63, rng.integers(1, 300), np.uint64)
        y = np.concatenate([x[: rng.integers(1, len(x) + 1)], rng.integers(0, 2**63, rng.integers(0, 200), np.uint64)])
        a, b = cells.folded([cells.sketch(np.unique(x)), cells.sketch(np.unique(y), 4)])
        assert cells.apart(a[None], b[None])[0] <= len(np.setxor1d(x, y))


def test_crowds_make_few_pairs(spark):
    """Near-copies of one text are linked by centres: pairs grow with the crowd, not with its square."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    made = {}
    for size in (600, 1200):
        rows = []
        for i in range(size):
            w = base[:]
            w[rng.randrange(200)] = f"x{i}"
            rows.append((i, " ".join(w), None, None))
        p = metricjoin.MetricJoin()
        wide = metricjoin.described(frame(spark, rows), p)
        lows = wide.selectExpr("row as node", "n_shingles as n", "low", "sketch").cache()
        rows = cells.banded(metricjoin.regions(lows, p), F.col("pivot"), p.cells).join(lows.select("node", "sketch"), "node")
        small = cells.bounded(rows, p.cells)
        made[size] = cells.candidates(small.withColumn("label", small.node), p.cells, "centres", 4).count()
    # A point is in as many cells as it has pivots, 20 at most here.
    assert all(n < 4 * size for size, n in made.items())


# --- op12 ---------------------------------------------------------------------------------


def brute_audit(rows, most=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        others = [s for g, s in groups if g == lang]

        def shares(names):
            total = sum(count[lang, s][t] for s in names for t in kept)
            return {t: 1 + 10**9 * (sum(count[lang, s][t] for s in names) + 1) // (total + len(kept)) for t in kept}  # noqa: B023

        own, all_ = shares([source]), shares(others)
        f = lambda p, q: (p - q) ** 2 // q
        parts = {"pair": {s: sum(f(own[t], q) for t, q in shares([s]).items()) for s in others if s != source}, "term": {t: f(own[t], all_[t]) for t in kept if count[lang, source][t] and own[t] > all_[t]}}
        for part, items in parts.items():
            for rank, (item, value) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or rank <= most:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


def audit_rows(seed=2):
    rng = random.Random(seed)
    vocabulary = ["Ärger", "naïve", "É", "the", "Of", "x1y2", "e-mail", "日本", "Zoo", *[f"w{chr(97 + i)}" for i in range(20)]]
    rows = []
    for i in range(400):
        source = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", "", None])
        lang = rng.choice(["en", "en", "de", None])
        text = None if rng.random() < 0.05 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))
        rows.append((i, text, lang, source))
    rows += [(900, "only one source", "fr", "a"), (901, "", "xx", "p"), (902, None, "xx", "q"), (903, "rare words here", "xx", "q")]
    rows += [(950 + i, "long " * 3000, "en", "a") for i in range(3)] + rows[:5]
    return rows


def test_audit_against_brute_force(spark):
    rows = audit_rows()
    for p in (divergence.Audit(), divergence.Audit(gathered=5), divergence.Audit(terms=4)):
        out = divergence.audit(frame(spark, rows).withColumn("term", frame(spark, rows).doc_id), p).collect()
        assert sorted(tuple(r) for r in out) == brute_audit(rows, p.terms)
    assert divergence.audit(frame(spark, [])).collect() == []


def test_audit_of_large_counts(spark):
    """Shares are exact where 10^9 times a count doesn't fit into 64 bits."""
    n, total = 10**13 + 7, 3 * 10**13 + 1
    row = spark.sql(f"select {n}L as n, {total}L as total, 5L as kept").select(divergence._share("n", "total", "kept", divergence.Audit())).first()[0]
    assert row == 1 + 10**9 * (n + 1) // (total + 5)


# --- op13 ---------------------------------------------------------------------------------


def brute_drawn(rows, target, p):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % p.buckets for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + p.buckets) / ((s[b] + 1) * (T + p.buckets))))
    out = []
    for i, text in rows:
        words, found = features(text)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= p.min_words))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for place, r in enumerate(fit[: p.percent * len(fit) // 100], 1):
        drawn[r[:4] + (place,)] += 1
    for r in fit[p.percent * len(fit) // 100 :] + [r for r in out if not r[4]]:
        drawn[r[:4] + (None,)] += 1
    return drawn


def test_resampling_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["Ärger", "naïve", "É", "the", "Of", "x1y2", "e-mail", "日本", "Zoo", "12", *[f"w{i}" for i in range(50)]]
    text = lambda: " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 19, 20, 21, 60])))
    copied = " ".join(rng.choices(vocabulary, k=40))
    rows = [(i, copied if i % 3 == 0 else text()) for i in range(300)] + [(900, None), (901, ""), (None, copied), (5, text()), (902, "long word " * 20_000)]
    rows += rows[:4]
    target = [text() for _ in range(40)] + [None]
    docs = frame(spark, [(i, t, None, None) for i, t in rows]).withColumnsRenamed({"lang": "weight", "source": "digest"})
    for p in (resampling.Resampling(percent=20), resampling.Resampling(percent=50, hot=2, buckets=100)):
        out = resampling.drawn(docs, spark.createDataFrame([(t,) for t in target], "text string"), p).collect()
        assert Counter(tuple(r) for r in out) == brute_drawn(rows, target, p)


def test_resampling_of_empty_tables(spark):
    none = frame(spark, [])
    assert resampling.drawn(none, none).collect() == []
    assert [tuple(r)[:3] for r in resampling.drawn(frame(spark, [(1, "a b", None, None)]), none).collect()] == [(1, 3, 3 * math.floor(1000 * math.log(10003 / (2 * 10000))))]


def test_twins_of_the_new_operators(spark, duck, data):
    from leadloom.llm import oracles, queries

    for name in ("op11_jaccard_join", "op12_divergence", "op13_resampling"):
        ours = queries.queries()[name](spark, data)
        rows = Counter(tuple(r[c] for c in sorted(ours.columns)) for r in ours.collect())
        twin = duck.sql(oracles.oracle_sql()[name])
        at = [twin.columns.index(c) for c in sorted(twin.columns)]
        assert sorted(ours.columns) == sorted(twin.columns)
        assert rows == Counter(tuple(r[i] for i in at) for r in twin.fetchall()), name
