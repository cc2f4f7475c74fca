"""Links that the exact join of cells lost: between parts of a cell, and after a search among the nearest that found nothing new."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import cells, metricjoin, minhash

from .test_operators import _brute_components


def test_parts_of_a_cell_measure_alike(spark):
    """Two equal points in different parts, one of them beside a point with a shorter sketch, meet in a cell."""
    places = spark.range(1, 60).select("id", F.xxhash64("id", F.lit(0)).alias("place"), F.pmod(F.xxhash64("id", F.lit("part")), F.lit(2)).alias("part")).orderBy("place", "id").collect()
    (p, q), rest = [r.id for r in places[:2]], places[2:]
    x, short = [r.id for r in rest if r.part == 0][:2]
    y = next(r.id for r in rest if r.part == 1)
    points = lambda *ranges: np.concatenate([np.arange(*r) for r in ranges]).astype(np.uint64)
    point = points((0, 70))
    # In 128 bits q is nearer to the point (20 bits to 40), in 64 bits p is (0 to 20).
    sets = {x: point, y: point, p: points((0, 10), (30, 70), (74, 94)), q: points((0, 30), (40, 70), (110, 120)), short: points((0, 60))}
    rows = [(1, 5, i, 70, True, cells.sketch(s)) for i, s in sets.items()]
    assert len(rows[0][-1]) == 16 and len(rows[-1][-1]) == 8
    now = spark.createDataFrame(rows, "cell long, size long, node long, n long, home boolean, sketch binary")
    out = cells.split(now, 0, cells.Cells(90, cap=3, pivots=2)).filter(F.col("node").isin(x, y)).collect()
    homes = {r.node: r.cell for r in out if r.home}
    meets = {(r.node, r.cell) for r in out}
    assert (x, homes[y]) in meets or (y, homes[x]) in meets


@pytest.mark.parametrize("module, percent, width", [(metricjoin, 90, 3), (minhash, 80, 1)])
def test_no_news_among_the_nearest_do_not_end_the_search(spark, monkeypatch, module, percent, width):
    """The nearest of another component may have been tested in another cell; farther ones of it weren't."""
    known = cells.candidates

    def candidates(rows, p, mode, tasks):
        out = known(rows, p, mode, tasks)
        return out if mode == "whole" else out.limit(0)

    monkeypatch.setattr(module, "candidates", candidates)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join([*words[:70], *[f"own{i}x{j}" for j in range(2)], *words[70:]]) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = metricjoin.MetricJoin(width) if module is metricjoin else minhash.NearDup(width=width, rounds=0)
    got = {r.doc_id: r.component_id for r in module.components_of(df, p).collect()}
    assert set(got.values()) == {0}
    assert _brute_components({i: set(zip(*[t.split()[j:] for j in range(width)], strict=False)) for i, t in enumerate(texts)}, percent) == got
