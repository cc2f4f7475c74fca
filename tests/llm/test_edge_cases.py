"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables
and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from leadloom.llm import chaining, langid, minhash, mixing, pieces, pii, quality_rules, sharding, suffixes, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, ids string, chunk long, node long, shard int, kept string, entities string, bucket string, _gone string, _bad string, _in string"
EXTRA = ("c", "i", 7, 8, 9, "k", "e", "b", "g", "b", "i")
LONG = "word " * 60_000
ROWS = [
    (0, None, "en", "a"), (1, "", "en", "a"), (2, "   \n\t ", "en", None), (3, "one", None, "a"), (4, LONG, "en", "a"), (5, "x" * 200_000, "en", "a"),
    (6, "the same text of some words that is here twice and of the and to in is", "en", "b"), (7, "the same text of some words that is here twice and of the and to in is", "en", "b"),
    (7, "the same text of some words that is here twice and of the and to in is", "en", "b"), (None, "no id at all", "en", "b"), (8, "漢字かな交じり文 🙂 é", "xx", "c"), (9, "12345 !!! ???", "en", "c"),
]


def table(spark, rows):
    return spark.createDataFrame([r + (None if r[1] is None else len(r[1]), *EXTRA) for r in rows], SCHEMA)


OPERATORS = {
    "quality": lambda d: quality_rules.judge(d), "quality_keep": lambda d: quality_rules.keep(d), "mixing": lambda d: mixing.sample(d), "mixing_keep": lambda d: mixing.keep(d),
    "langid": lambda d: langid.predict(d, langid.fit(d)), "sharding": lambda d: sharding.assign(d), "pieces": lambda d: pieces.digest(d, pieces.read_model()),
    "pieces_texts": lambda d: pieces.decode(pieces.encode(d, pieces.read_model()), pieces.read_model()), "pii": lambda d: pii.protect(d), "minhash": lambda d: minhash.components_of(d),
    "minhash_keep": lambda d: minhash.keep(d), "chaining": lambda d: chaining.fuzzy(d), "suffixes": lambda d: suffixes.removed(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = OPERATORS[name](table(spark, ROWS)).collect()
    assert len(rows) == len(ROWS) or name.endswith("keep")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, ROWS).limit(0)).collect() == []


def test_defined_results(spark):
    d = table(spark, ROWS)
    got = {r["doc_id"]: r for r in quality_rules.judge(d).collect()}
    assert (got[0]["n_words"], got[0]["base_failed"], got[0]["kept"]) == (0, True, False)
    assert got[4]["n_words"] == got[4]["n_repeat_words"] == 60_000
    got = {r["doc_id"]: r for r in minhash.components_of(d, minhash.NearDup(width=2)).collect()}
    assert (got[0]["n_shingles"], got[0]["component_id"], got[7]["component_id"], got[7]["kept"], got[3]["n_shingles"]) == (0, 0, 6, False, 1)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(d, langid.fit(d)).collect()}
    assert got[0] == got[1] == got[9] == "und" and got[6] == "en"
    got = {r["doc_id"]: r for r in suffixes.removed(d).collect()}
    assert (got[0]["n_bytes"], got[6]["n_removed"], got[7]["n_removed"], got[5]["n_removed"]) == (0, 0, got[7]["n_bytes"], 0)
    got = sharding.assign(d).collect()
    assert sorted(r["size"] for r in got)[:2] == [1, 1]
    assert {r["doc_id"]: r["text"] for r in pii.protect(d).collect()}[0] is None


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, v string")
    got = topk.top_k(topk.quantised(df), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 4096), (0, 2, 2048), (0, 2, 2048), (0, 20, -4096), (20, 2, -2048), (20, 2, -2048), (20, 0, -4096), (20, 1, -4096)]
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("vec_id") % 20 == 0).collect() == []


def test_topk_lengths_sizes_and_repeated_queries(spark):
    """Against plain Python: vectors of any length, components beyond 53 bits, a query id of two rows."""
    import math

    rows = [(0, [1.0, 0.5]), (0, [-1.0, 2.0, 3.0]), (1, []), (2, [1e9, 1.0]), (3, [1e17, -1e17]), (4, [1.0, 1.0, 1.0, 1.0]), (20, [1e17]), (40, [3e18, 1.0]), (41, [3e18, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    top = (1 << 63) - 1
    v = [(i, [max(-top - 1, min(top, math.floor(64 * x))) for x in e]) for i, e in rows]
    want = set()
    for q in (0, 20, 40):
        pairs = [(max(-top - 1, min(top, sum(a * b for a, b in zip(x, y, strict=False)))), j) for i, x in v if i == q for j, y in v if j != q]
        want |= {(q, n + 1, j, s) for n, (s, j) in enumerate(sorted(pairs, key=lambda p: (-p[0], p[1]))[:20])}
    assert {tuple(r) for r in topk.top_k(topk.quantised(df), F.col("vec_id") % 20 == 0).collect()} == want
