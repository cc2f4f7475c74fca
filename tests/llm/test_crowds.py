"""Crowds of texts that share most of their words without being linked: results as by brute force, few pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import cells, minhash
from leadloom.llm.common import written

from .test_operators import _brute_components


def crowd(size, seed=4):
    """Each text has 48 of the same 80 words."""
    rng = random.Random(seed)
    return [" ".join(rng.sample([f"w{i}" for i in range(80)], 48)) for _ in range(size)]


def made_pairs(spark, texts, mode):
    p = minhash.NearDup(width=1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = minhash.described(df, p).select(F.col("doc_id").alias("node"), "set_key", "doc_id", "text_hash", "n_shingles", "bands").cache()
    here = found.select("node", "n_shingles", F.explode("bands").alias("bucket"), F.col("node").alias("component"))
    small = written(minhash._in_cells(here, minhash._sets(df, found, p), p))
    return cells.candidates(small.withColumn("label", F.col("node")), minhash._cells(p), mode, 4).count()


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark):
    for size in (750, 1500, 3000):
        assert made_pairs(spark, crowd(size), "whole") <= size / 50


def test_a_crowd_with_links_equals_brute_force(spark):
    rng = random.Random(9)
    texts = crowd(400)
    for i in range(60):  # copies with a few other words: linked with one of the crowd
        w = texts[i].split()
        for at in rng.sample(range(48), rng.randint(0, 7)):
            w[at] = f"own{i}x{at}"
        texts.append(" ".join(w))
    got = minhash.components_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), minhash.NearDup(width=1)).collect()
    want = _brute_components({i: set(t.split()) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("cap, pivots", [(30, 3), (100, 8)])
def test_split_cells_lose_no_pair(spark, cap, pivots):
    """A cell that is split by pivots, or in blocks, makes the pairs that it makes as a whole."""
    texts = crowd(150, 1) + [" ".join(t.split()[:44] + [f"x{i}" for i in range(4)]) for t in crowd(60, 1)]
    p = minhash.NearDup(width=1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = minhash.described(df, p).select(F.col("doc_id").alias("node"), "set_key", "doc_id", "text_hash", "n_shingles").cache()
    rows = cells.banded(found.select(F.lit(1).alias("bucket"), "node", F.col("n_shingles").alias("n")), F.col("bucket"), cells.Cells(80))
    sets = {r.node: bytes(r.hashes) for r in minhash._sets(df, found, p).collect()}
    sketches = spark.createDataFrame([(n, cells.sketch(np.frombuffer(h, np.uint64), 4)) for n, h in sets.items()], "node long, sketch binary")
    now = written(rows.join(sketches, "node"))
    pairs = lambda c: {tuple(r) for r in cells.candidates(cells.bounded(now, c).withColumn("label", F.col("node")), c, "whole", 4).collect()}
    whole = pairs(cells.Cells(80))
    assert len(whole) >= 60 and pairs(cells.Cells(80, cap=cap, pivots=pivots, depth=3)) == whole
