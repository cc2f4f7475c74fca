"""Targets that can't be met are told."""

import pytest

from leadloom.llm import mixing


def docs(spark, cells):
    rows = [(i, " ".join(["word"] * n), source, lang) for i, (source, lang, n) in enumerate(cells)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_targets_that_cannot_be_met(spark):
    df = docs(spark, [("a", "en", 1000), ("b", "de", 10), ("b", "fr", 10)])
    with pytest.warns(UserWarning, match="can't all be met"):
        got = mixing.sample(df).collect()
    shares = {}
    for r in got:
        shares[r.source] = shares.get(r.source, 0) + r.weight
    want = {"a": 1000**0.5, "b": 20**0.5}
    off = max(abs(shares[s] - w / sum(want.values())) for s, w in want.items())
    assert {r.miss for r in got} == {got[0].miss} and got[0].miss > mixing.Mix().tolerance
    assert abs(off - got[0].miss) < 1e-6


def test_targets_that_are_met(spark, recwarn):
    df = docs(spark, [(s, g, 50 + 30 * i) for i, (s, g) in enumerate((s, g) for s in "abc" for g in ("en", "de"))])
    got = mixing.sample(df).collect()
    assert got[0].miss <= mixing.Mix().tolerance and not [w for w in recwarn if "off by" in str(w.message)]
    with pytest.warns(UserWarning, match="after 1 rounds"):
        assert mixing.sample(df, mixing.Mix(rounds=1, tolerance=0.0)).first().miss > 0
