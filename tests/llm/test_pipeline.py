"""The pipeline against plain Python over what each stage was given."""

import pytest

import corpus_pipeline
from leadloom.llm import mixing, pieces, pii, quality_rules
from leadloom.llm.common import written

from .test_edge_cases import ROWS, table
from .test_operators import _brute_components


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, data))
        seen[name] = (before.collect(), docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    was, now = seen["quality"]
    kept = {r["doc_id"] for r in quality_rules.judge(spark.read.parquet(f"{data}/documents.parquet")).filter("kept").collect()}
    assert {r["doc_id"] for r in now} == kept and 0 < len(kept) < len(was)
    was, now = seen["near_dup"]
    sets = {}
    for r in was:
        w = r["text"].encode().lower().split()
        n = min(5, len(w))
        sets[r["doc_id"]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    roots = _brute_components(sets)
    assert {r["doc_id"] for r in now} == {i for i in roots if roots[i] == i}
    was, now = seen["private"]
    surrogates = pii.Surrogates()
    want = {r["doc_id"]: pii.replaced(r["text"], surrogates, {})[0] for r in was}
    assert {r["doc_id"]: r["text"] for r in now} == want and all(r["n_chars"] == len(r["text"]) for r in now)
    was, now = seen["mix"]
    chosen = {r["doc_id"] for r in mixing.sample(spark.createDataFrame(was)).filter("sampled").collect()}
    assert {r["doc_id"] for r in now} == chosen and 0 < len(chosen) < len(was)
    was, now = seen["pieces"]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    texts = {r["doc_id"]: r["text"] for r in was}
    assert len(now) == len(was)
    for r in now:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["round_trip"]


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and all(r["round_trip"] for r in rows)


#: Documents that the rules keep: thirty different ones, the first of them twice.
_LINE = "The old river runs past the town and {0} people walk along its bank in the evening, while the lamps of number {1} streets are lit and the boats come home to rest by the harbour wall. Nobody there asks why the water is brown or where it goes after the bridge."
CLEAN = [(100 + i, _LINE.format(i, i * 3), "en", "a") for i in range(30)]


@pytest.mark.parametrize("rows", [ROWS + CLEAN + CLEAN[:1], []], ids=["odd", "empty"])
def test_odd_tables(spark, tmp_path, rows):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, an empty table."""
    table(spark, rows or ROWS).limit(len(rows)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-2]:
        docs = written(stage(spark, docs, str(tmp_path)))
        ids.append(sorted(r["doc_id"] for r in docs.collect()))
        assert docs.columns == columns
    kept = {i for i, *_ in CLEAN} if rows else set()
    assert kept <= set(ids[0]) and kept <= set(ids[1]) and ids[1] == ids[2] and len(ids[1]) == len(set(ids[1]))
    assert not {0, 1, 2} & set(ids[0])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(ids[2]) and all(r["round_trip"] for r in out)
