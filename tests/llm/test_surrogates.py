"""Surrogates follow from key and value alone; names without spaces; long texts; collisions with real names."""

import random
import time
from collections import defaultdict

import pytest

from leadloom.llm import pii


def surrogates(spark, texts, s=None):
    """For each text the texts of its surrogates, and the new texts."""
    out = pii.protect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), s).orderBy("doc_id").collect()
    return [[r["text"][e["start"] : e["end"]] for e in r["entities"]] for r in out], [r["text"] for r in out]


def test_other_rows_change_nothing(spark):
    alone = surrogates(spark, ["Dear Mr. Smith, hello."])[1][0]
    others = ["Dr. 山田太郎は昨日東京大学で講演をしました。", "Mr. " + "Ab" * 300, "Mrs. Bokamelonadefilan", "Mr. 王小明今天去北京。"]
    assert surrogates(spark, ["Dear Mr. Smith, hello.", *others])[1][0] == alone
    assert pii.replaced("Dear Mr. Smith, hello.", pii.Surrogates(), {})[0] == alone
    assert len(alone) < 45


@pytest.mark.parametrize(
    "text, name, rest",
    [
        ("Dr. 山田太郎は昨日東京大学で講演。山田太郎も。", "山田太郎", "は昨日東京大学で講演。{}も。"),
        ("Mr. 王小明今天去北京大学。", "王小明", "今天去北京大学。"),
        ("Mr. 김철수는 갔다", "김철수", "는 갔다"),
        ("Mr. 山田太郎次, hallo", "山田太郎次", ", hallo"),
        ("Mr. ジョンは来た", "ジョン", "は来た"),
        ("Mr. 山田 太郎 hat", "山田 太郎", " hat"),
    ],
)
def test_sentences_after_a_name_stay(text, name, rest):
    found = pii.find(text)
    assert found[0][3] == name
    new, spans = pii.replaced(text, pii.Surrogates(), {})
    made = new[spans[0]["start"] : spans[0]["end"]]
    assert new == text.split(name)[0] + made + rest.format(made) and made != name and len(made) <= len(name) + 4
    assert pii._script(made) == pii._script(name)


def test_long_texts_take_linear_time():
    for text in ("a" * 1_000_000 + " @ x@y.org", "x@" + "a" * 1_000_000, "a.b-" * 250_000 + "@", "Mr. A" + "a" * 500_000 + " @" + "山" * 500_000, "a@" * 300_000):
        began = time.perf_counter()
        pii.find(text)
        assert time.perf_counter() - began < 4  # squares would take hours
    assert [f[3] for f in pii.find("x" * 100_000 + " a.b+c@d-e.example.org, <q@w.de>; u@v@x.org")] == ["a.b+c@d-e.example.org", "q@w.de", "v@x.org"]


def brute(texts, s):
    """Parts of names and what they became, by plain Python over all texts."""
    made = defaultdict(set)
    for text in texts:
        new, spans = pii.replaced(text, s, {})
        for (_, _, kind, value, _), e in zip(pii.find(text, s.kinds), spans, strict=True):
            if kind == "name":
                for old, part in zip(value.split(), new[e["start"] : e["end"]].split(), strict=True):
                    made[old.lower()].add(part.lower())
    return made


def test_distinct_and_coreferent_and_no_real_names(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzäöé"
    names = ["".join(rng.choices(letters, k=rng.randint(2, 9))).capitalize() for _ in range(400)]
    names += ["Bokamelona", "Banadel", "Lan", "Dana", "Müller", "李明", "Иван", "Νίκος", "たなか", "محمد", "דוד"]
    texts = [" ".join(f"{rng.choice(['Mr.', 'Mrs.', 'Dr.'])} {rng.choice(names)} and {rng.choice(names)}." for _ in range(5)) for _ in range(400)]
    s = pii.Surrogates(key="k")
    made = brute(texts, s)
    owner = {}
    for old, parts in made.items():
        for part in parts:
            assert owner.setdefault(part, old) == old, "two names share a surrogate"
    assert not set(owner) & set(made), "a surrogate is a real name"
    assert all(len(parts) <= 3 for parts in made.values())  # by gender alone
    assert surrogates(spark, texts, s)[1] == [pii.replaced(t, s, {})[0] for t in texts]


def test_collisions_move_to_a_second_domain(spark):
    """A corpus that holds a name's surrogate as a real name: both stay apart, and no surrogate is a real name."""
    s = pii.Surrogates(key="k")
    taken = pii.surrogate("name", "Smith", "any", s)
    texts = ["Mr. Smith met Dr. Jones.", f"Mr. {taken} wrote to Mrs. Anna Smith."]
    found = pii.checked(spark.createDataFrame([(t,) for t in texts], "text string"), s)
    assert found.moved == {pii.part_hash("smith")}
    made = brute(texts, found)
    values = [v for parts in made.values() for v in parts]
    assert taken.lower() not in values and len(set(values)) == sum(len(v) for v in made.values())
    assert made["jones"] == brute(texts, s)["jones"], "others keep theirs"
    assert all("-" in v for v in made["smith"])
    assert pii.checked(spark.createDataFrame([(t,) for t in texts[:1]], "text string"), s).moved == frozenset()
    with pytest.raises(ValueError, match="another key"):
        pii.checked(spark.createDataFrame([(t,) for t in texts], "text string"), pii.Surrogates(key="k", most_moved=0))
