"""Operators against brute force, other libraries, round trips or held-out accuracy."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import chaining, langid, linking, minhash, mixing, pieces, pii, quality_rules, queries, sharding, suffixes, topk
from leadloom.llm.oracles import oracle_sql

from ..conftest import same


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, duck, data, name):
    assert same(queries.queries()[name](spark, data).toPandas(), duck.sql(oracle_sql()[name]).df())


def test_quality_counts_brute_force(docs):
    def brute(text):
        words = text.encode().split()
        seen = defaultdict(list)
        for i in range(len(words) - 7):
            seen[tuple(words[i : i + 8])].append(i)
        covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    got = {r["doc_id"]: tuple(r[1:6]) for r in quality_rules.judge(docs).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == brute(r["text"]), r["doc_id"]


def test_divergence_tells_junk(spark):
    rng = random.Random(3)
    words = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "house", "river", "stone", "green", "walk", "paper"]
    clean = [" ".join(rng.choice(words) for _ in range(150)).capitalize() + "." for _ in range(60)]
    junk = [" ".join(rng.choice("#*$%&") * 3 + str(rng.random()) for _ in range(150)) for _ in range(3)]
    rows = [(i, t, "en") for i, t in enumerate(clean + junk)] + [(100, clean[0].upper().replace(" ", "!! "), None)]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in (60, 61, 62, 100))


def test_documents_in_two_languages_are_kept(spark):
    """A text that is half English, half German is far from either, but near their blend; one without
    common words is far from all. Distances against plain Python."""
    import math

    rng = random.Random(5)
    common = {"en": ["the", "of", "and", "to", "a"], "de": ["der", "die", "und", "den", "von"]}
    other = ["house", "river", "stone", "green", "walk", "paper", "night", "boat"]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(common[lang] * 2 + other, 150), lang) for i, lang in enumerate(["en", "de"] * 30)]
    mixed = text(common["en"] * 2 + other, 75) + " " + text(common["de"] * 2 + other, 75)
    rows += [(100, mixed, "en"), (101, text(other, 150), "en")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    vocabulary = quality_rules.Divergence().vocabulary

    def hist(texts):
        words = [w for t in texts for w in t.split()]
        counts = [words.count(v) for v in vocabulary]
        return [c / len(words) for c in (*counts, len(words) - sum(counts))]

    def apart(p, q):
        half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x) / 2
        return math.sqrt(half(p, q) + half(q, p))

    # The learned references hold these two documents, too.
    en, de = (hist([t for _, t, g in rows if g == lang]) for lang in ("en", "de"))
    own, blend = apart(hist([mixed]), en), apart(hist([mixed]), [(a + b) / 2 for a, b in zip(en, de, strict=True)])
    assert own > quality_rules.Divergence().max_word_distance and abs(got[100]["word_distance"] - blend) < 1e-6
    assert got[100]["kept"] and not got[101]["kept"] and all(got[i]["kept"] for i in range(60))


def test_references_of_every_language(spark):
    """A language without a list of common words has its own reference; a rare one isn't judged, and
    texts without a language go by the nearest."""
    rng = random.Random(4)
    kana = [chr(0x3041 + rng.randrange(80)) + chr(0x3041 + rng.randrange(80)) for _ in range(40)]
    latin = ["the", "of", "and", "to", "house", "river", "stone", "green", "walk", "paper"]
    text = lambda words, n=150: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(kana), "ja") for i in range(40)] + [(100 + i, text(latin), "en") for i in range(40)]
    junk = ["".join(rng.choice("#%$@&12") for _ in range(4)) for _ in range(60)]
    rows += [(200, text(kana), None), (201, text(junk), None), (202, text(junk), "xx"), (203, text(junk), "ja")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in [*range(40), *range(100, 140), 200, 202]) and not got[201]["kept"] and not got[203]["kept"]
    assert got[202]["char_distance"] is None and got[0]["char_distance"] < 0.2


def test_raking_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["en", "en", "de"]), rng.choice("abbbb")) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix({"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.25, "de": 0.75}}, rounds=20, tolerance=0.0, whole=0.0)
    got = mixing.sample(df, mix).toPandas()
    got["expected"] = got["probability"] * got["tokens"]
    for d, want in (("source", {"a": 0.5, "b": 0.5}), ("lang", {"en": 0.25, "de": 0.75})):
        share = got.groupby(d)["expected"].sum() / got["expected"].sum()
        assert all(abs(share[k] - v) < 1e-6 for k, v in want.items())
    assert got["probability"].max() == 1.0
    assert abs(got["sampled"].sum() - got["probability"].sum()) < 4 * (got["probability"] * (1 - got["probability"])).sum() ** 0.5


def test_default_mix_meets_its_targets(docs):
    """Shares of expected tokens under the parameters of the query: tokens to the power `temper`."""
    got = mixing.sample(docs).toPandas().fillna({"source": "", "lang": ""})
    got["expected"] = got["probability"] * got["tokens"]
    for d in mixing.DIMENSIONS:
        want = got.groupby(d)["tokens"].sum() ** mixing.Mix().temper
        share = got.groupby(d)["expected"].sum() / got["expected"].sum()
        assert (share - want / want.sum()).abs().max() < 1e-3, d


def test_language_held_out(docs):
    model = langid.fit(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_kernel_brute_force():
    marks = ["das haus der sonne", "the house of the rising", "the sun of a house", "la casa del sol"]
    orders = langid.Kernel().orders
    model = langid.Model([[langid.grams(t, n) for n in orders] for t in marks], ["de", "en", "en", "es"], langid.Kernel())
    sets = lambda t: [{t.encode()[i : i + n] for i in range(len(t.encode()) - n + 1)} for n in orders]
    for got in (model.kernel(["the red house"])[0], model.row("the red house")):
        for j, m in enumerate(marks):
            want = np.mean([len(a & b) / np.sqrt(len(a) * len(b)) for a, b in zip(sets("the red house"), sets(m), strict=True)])
            assert abs(got[j] - want) < 1e-5


def test_language_sample_holds_repeated_rows_once(spark):
    """One document is a third of all rows; equal ones are learned from once, in any order of rows."""
    words = {"en": "the house of the rising sun is near the river".split(), "de": "das haus der sonne ist nahe bei dem fluss".split()}
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["en", "de"] * 150)]
    rows += [rows[2]] * 150
    schema, k = "doc_id long, text string, lang string", langid.Kernel(sample=1000)
    one = langid.fit(spark.createDataFrame(rows, schema), k)
    other = langid.fit(spark.createDataFrame(sorted(set(rows), reverse=True), schema).repartition(5), k)
    assert sum(v.shape[1] for v in one.there[:1]) <= 2 * k.landmarks
    texts = [t for _, t, _ in rows[:40]]
    assert [one.langs[i] for i in one.predict(texts)[0]] == [g for _, _, g in rows[:40]] == [other.langs[i] for i in other.predict(texts)[0]]


def test_shards_are_even_and_groups_whole(spark):
    rng = random.Random(2)
    rows = [(i, f"text {rng.randrange(900)}") for i in range(1500)] + [(2000 + i, "hot text") for i in range(800)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    n = got.groupby("shard").size()
    assert len(n) == 8 and n.max() - n.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    groups = got.groupby(["text_crc32", "size"])["shard"].agg(["nunique", "size"])
    small = groups[(groups["size"] > 1) & (groups["size"] < 100)]
    assert (small["nunique"] > 1).mean() < 0.05
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()


def test_topk_brute_force(spark):
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(700, 12)) * 9).astype(int)
    v[100:130] = v[5]  # ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<int>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, topk.Search(query_block=7, block=90, step=16)).collect()
    want = set()
    for q in range(0, 700, 20):
        s = v @ v[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:20]
        want |= {(q, n + 1, i, int(s[i])) for n, i in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_pieces_equal_the_library(docs):
    import sentencepiece

    raw = pieces.read_model()
    texts = [r["text"] for r in docs.limit(80).collect()] + ["Hello  world \n\t a b é 漢 🙂", "  x", "", " ", "▁x", "a\x00b<s></s>", "x" * 300, "    \n    foo", "こんにちは世界 привет"]
    model, library = pieces.Model(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for ids, text, want in zip(model.encode(texts, {}), texts, library.encode(texts), strict=True):
        ids = np.frombuffer(ids, "<i4")
        assert ids.tolist() == want
        assert model.decode(ids) == library.decode(want)
        assert model.decode(ids) == text or "▁" in text
    # The same pieces as a unigram model: plain Viterbi, as the library's lattice has it.
    at = raw.index(b"tok_v0") + 6
    assert raw[at : at + 2] == b"\x18\x02"
    flipped = raw[:at] + b"\x18\x01" + raw[at + 2 :]
    model, library = pieces.Model(flipped), sentencepiece.SentencePieceProcessor(model_proto=flipped)
    words = sorted({w for t in texts[:20] for w in model.words(t) if w.count("▁") == 1 and w[0] == "▁" and len(w) > 1})
    for word, ids in model.encode_sorted(words):
        best = library.nbest_encode_as_ids(word[1:], 1)[0]
        score = lambda x: sum(model.pieces[i][1] for i in x)
        assert score(np.frombuffer(ids, "<i4").tolist()) >= score(best) - 1e-3


def test_pieces_round_trip(spark, docs):
    out = pieces.decode(pieces.encode(docs, pieces.read_model()), pieces.read_model())
    assert out.filter("decoded <> text").count() == 0 and out.columns[:5] == docs.columns


def test_permutations_are_bijections():
    for size in (2, 10, 97, 1000):
        assert sorted(pii.permuted(i, size, b"k", "t") for i in range(size)) == list(range(size))
    assert len({pii.permuted_text(f"{i:03d}", b"k" * 8, "t") for i in range(1000)}) == 1000


def test_surrogates(spark):
    s = pii.Surrogates(key="k")
    text = "Mrs. Anna Schmidt, Mr. Иван Петров, ANNA.x@Mail.example.com anna.X@mail.example.com +1 (826) 555-4081 1.2.3.4 4111 1111 1111 1111 4111-1111-1111-1111 token = \"0123456789abcdef0123\""
    new, spans = pii.replaced(text, s, {})
    kinds = [x["kind"] for x in spans]
    values = [new[x["start"] : x["end"]] for x in spans]
    assert kinds == ["name", "name", "email", "email", "phone", "ip", "card", "card", "secret"]
    assert values[0].isascii() and values[0].split()[0][-1] == "a"  # a woman's first name
    assert all("Ѐ" <= c <= "ӿ" for c in values[1].replace(" ", "")) and len(values[1].split()) == 2
    assert values[2] == values[3] and values[2].endswith(".com") and values[2].count("@") == 1  # coreference, across case
    assert values[4].startswith("+1 (") and len(values[4]) == len("+1 (826) 555-4081")
    assert values[6].replace(" ", "") == values[7].replace("-", "") and pii._luhn(values[6].replace(" ", "")[:-1]) == int(values[6][-1])
    assert not any(v in new for v in ("Anna Schmidt", "Петров", "555-4081", "4111 1111", "0123456789abcdef0123", "1.2.3.4"))
    assert pii.replaced(text, s, {}) == (new, spans) and pii.replaced(text, pii.Surrogates(key="other"), {})[0] != new


def test_distinct_people_stay_distinct(spark):
    rows = [(i, f"Mr. {chr(65 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}n wrote to u{i}@x.org") for i in range(1500)]
    out = pii.protect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [[r["text"][e["start"] : e["end"]] for e in r["entities"]] for r in out]
    assert len({f[0] for f in found}) == len({f[1] for f in found}) == 1500


def test_many_names_have_their_own_surrogates(spark):
    """More one-word names than keys can be found for by trying, in texts that also hold made-up names."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"{letters[i % 26].upper()}{letters[i // 26 % 26]}{letters[i // 676 % 26]}n" for i in range(9000)]
    names += ["Bokamelona", "Bokamelonadefilan", "Müller", "Anne-Marie", "李明", "Иван", "Ἀθηνᾶ", "Νίκος"]
    rows = [(i, f"Mr. {n}, hello") for i, n in enumerate(names)]
    out = pii.protect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    new = [r["text"][e["start"] : e["end"]] for r in out for e in r["entities"]]
    assert len(new) == len(set(new)) == len(names) and not set(new) & set(names)


def test_names_keep_their_script(spark):
    names = {"CJK": ["山田", "太郎", "李明", "山田太郎次"], "HIRAGANA": ["たなか", "さくら"], "KATAKANA": ["ジョン", "アンナ"], "HANGUL": ["김철수", "박영희"], "ARABIC": ["محمد"], "HEBREW": ["דוד"], "CYRILLIC": ["Петров"], "GREEK": ["Νίκος"]}
    rows = [(i, f"Mr. {n} hat {n} gesehen") for i, n in enumerate(n for ns in names.values() for n in ns)]
    out = pii.protect(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    found = [[r["text"][e["start"] : e["end"]] for e in r["entities"]] for r in out]
    assert [pii._script(f[0]) for f in found] == [s for s, ns in names.items() for _ in ns]
    assert all(len(f) == 2 and f[0] == f[1] for f in found)
    assert len({f[0] for f in found}) == len(rows) and not {f[0] for f in found} & {n for ns in names.values() for n in ns}


def test_a_hundred_thousand_names(spark):
    """Distinct names have distinct surrogates, none of them a name of the corpus, by comparing all."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"{letters[i % 26].upper()}{letters[i // 26 % 26]}{letters[i // 676 % 26]}{letters[i // 17576]}o" for i in range(100_000)]
    rows = spark.createDataFrame([(i, " ".join(f"Mr. {n}." for n in names[i : i + 100])) for i in range(0, 100_000, 100)], "doc_id long, text string")
    new = [r["text"][e["start"] : e["end"]] for r in pii.protect(rows).collect() for e in r["entities"]]
    assert len(new) == len(set(new)) == 100_000 and not set(new) & set(names)


def test_many_spans_in_one_text():
    text = " ".join(f"{i:03d}-{i % 90 + 10}-{i:04d}" for i in range(1000)) * 20
    assert len(pii.find(text)) >= 19_000


def test_hot_groups_hang_on_many_hubs(spark):
    nodes = spark.range(10_000).select(F.col("id").alias("node"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text_key"))
    links = sharding.equal_links(nodes, 100)
    assert links.groupBy("hub").count().agg(F.max("count")).first()[0] < 250
    got = linking.components(links.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    assert got.count() == 3334 and got.select("component").distinct().count() == 1


def test_mentions_of_a_name_agree():
    s = pii.Surrogates(key="k")
    text = "Mr. John Smith met Dr. Smith. John Smith's house; SMITH left. Mr. Smith\nand Mrs. Anna Maria Luisa Weber Klein, then Klein, Smithson and Ms. O'Hara. Dr. John Smith. г-н Иван Петров сказал"
    new, spans = pii.replaced(text, s, {})
    values = [new[x["start"] : x["end"]] for x in spans]
    john, smith = values[0].split()
    assert values[1:5] == [smith, f"{john} {smith}", smith.upper(), smith] and values[8] == f"{john} {smith}"
    assert f"{john} {smith}'s house" in new and "Smithson" in new and new.endswith(" сказал")
    assert not any(x in new.replace("Smithson", "") for x in ("John", "Smith", "SMITH", "Klein", "Weber", "Hara", "Иван", "Петров"))
    assert len(values[5].split()) == 5 and values[6] == values[5].split()[-1]


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 105), (105, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[105] == got[101] == got[100] == 100


def _brute_components(sets, percent=80):
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rounds", [0, 1])
def test_near_copies_brute_force(spark, rounds):
    """A crowd of copies with so many edits that many are just below the limit."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(80)] = f"e{rng.randrange(300)}"
        texts.append(" ".join(words[: 80 - rng.randrange(0, 10)]))
    texts += [texts[3], texts[3].upper(), "", "a", "a", "b c"]
    sets = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        sets[i] = {tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = minhash.components_of(df, minhash.NearDup(width=2, rounds=rounds)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _brute_components(sets)
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)


def test_copies_under_one_id_keep_their_links(spark):
    """A document of two rows links what either text is near to; ids in equal sets don't merge."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    rows = [(7, a), (7, b), (8, b[:-1] + ["x"]), (9, a[:-1] + ["y"]), (3, a[:20]), (3, a[:20])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = minhash.components_of(df, minhash.NearDup(width=2)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (3, 3), (7, 7), (7, 7), (8, 7), (9, 7)]
    assert sorted(r["doc_id"] for r in minhash.keep(df, minhash.NearDup(width=2)).collect()) == [3, 7, 7]


def test_repeated_ids_brute_force(spark):
    rng = random.Random(12)
    base = [[f"g{g}w{i}" for i in range(40)] for g in range(6)]
    rows = []
    for _ in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(40)] = f"e{rng.randrange(300)}"
        rows.append((rng.randrange(70), " ".join(words)))
    each = {n: set(zip(t.split(), t.split()[1:], strict=False)) for n, (_, t) in enumerate(rows)}
    parent = _brute_components(each)
    root = {i: i for i, _ in rows}  # documents over rows

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, _) in enumerate(rows):
        x, y = find(i), find(rows[parent[n]][0])
        root[max(x, y)] = min(x, y)
    got = minhash.components_of(spark.createDataFrame(rows, "doc_id long, text string"), minhash.NearDup(width=2)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in root} and len(got) == len(rows)


def test_crowd_below_the_limit_makes_no_pairs(spark):
    """Copies that all have many edits of their own: no pair of them is made, whatever their number."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for n in range(1500):
        words = list(base)
        for j in rng.sample(range(100), 9):
            words[j] = f"own{n}x{j}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = minhash.NearDup(width=2)
    sets = minhash.described(df, p).select(F.col("doc_id").alias("node"), "set_key", "doc_id", "text_hash", "n_shingles")
    here = sets.select("node", "n_shingles", F.col("node").alias("component"), F.explode(F.array(F.lit(1), F.lit(2)).cast("array<long>")).alias("bucket"))
    assert minhash._apart(here, minhash._sets(df, sets, p), p).count() == 0
    assert all(r["kept"] for r in minhash.components_of(df, p).collect())


def test_min_max_signatures_estimate(spark):
    p = minhash.NearDup(permutations=512)
    a, b = minhash._constants(p)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 900).astype(np.uint64)
    s, t = (minhash.signature(np.unique(v), a, b) for v in (x[:800], x[100:]))
    assert abs((s == t).mean() - 700 / 900) < 0.05


def test_chains():
    c = chaining.Chains()
    x, y = [0, 10, 20, 30, 12], [5, 15, 26, 36, 90]
    assert chaining.chains(x, y, c)[0] == [0, 1, 2, 3]
    rng = random.Random(0)
    for _ in range(20):  # against all predecessors
        n = 25
        x, y = [rng.randrange(60) for _ in range(n)], [rng.randrange(60) for _ in range(n)]
        for chain in chaining.chains(x, y, c):
            assert all(x[i] < x[j] and y[i] < y[j] for i, j in zip(chain, chain[1:], strict=False))
    tree, values = chaining.Fenwick(40), {}
    for _ in range(200):
        i, v = rng.randrange(40), rng.random()
        tree.put(i, v, i)
        values[i] = max(v, values.get(i, 0))
        q = rng.randrange(40)
        assert tree.best(q)[0] == max([w for j, w in values.items() if j <= q], default=float("-inf"))


def test_chains_brute_force():
    """Scores against all predecessors in reach, with passages at different offsets."""
    c, rng = chaining.Chains(), random.Random(6)

    def step(x, y, i, j):
        dx, dy = x[j] - x[i], y[j] - y[i]
        inside = 0 < dx <= c.max_gap and 0 < dy <= c.max_gap
        return min(c.k, dx, dy) - c.gap_cost * (max(0, dx - c.k) + max(0, dy - c.k)) if inside else -1e9

    for _ in range(60):
        x, y, at = [], [], 0
        for _ in range(rng.randrange(1, 5)):
            shift = rng.randrange(500)
            for _ in range(rng.randrange(1, 20)):
                at += rng.randrange(1, 9)
                x.append(at)
                y.append(at + shift)
            at += rng.randrange(60)
        best = []
        for i in range(len(x)):
            best.append(max([float(c.k)] + [best[j] + step(x, y, j, i) for j in range(i)]))
        chain = chaining.chains(x, y, c)[0]
        assert abs(c.k + sum(step(x, y, i, j) for i, j in zip(chain, chain[1:], strict=False)) - max(best)) < 1e-9


def test_passages_of_one_leader(spark):
    """Passages at different offsets, and a copy with an inserted paragraph, are found whole."""
    rng = random.Random(8)
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(10):
        a = fresh(600)
        rows += [(i, a), (100 + i, fresh(30) + a[50:150] + fresh(90) + a[300:380] + fresh(20)), (200 + i, a[:200] + fresh(60) + a[200:])]
        rows.append((300 + i, a[400:500] + fresh(70) + a[200:270] + fresh(50) + a[20:110]))
        want |= {100 + i: 180, 200 + i: 600, 300 + i: 260}
    got = chaining.fuzzy(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert all(r["n_dup_words"] >= want[r["doc_id"]] for r in got if r["doc_id"] in want)
    assert all(r["n_passages"] == (3 if r["doc_id"] >= 300 else 2) for r in got if r["doc_id"] in want)


def test_passages_that_overlap(spark):
    """Adjacent passages of two leaders that share a chance word, both found; words count once."""
    rng = random.Random(9)
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(10):
        p, q = fresh(100), fresh(100)
        rows += [(3 * i, fresh(40) + p + q[:1]), (3 * i + 1, q + fresh(40)), (1000 + i, fresh(20) + p + q + fresh(20))]
    got = chaining.fuzzy(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    for r in got:
        if r["doc_id"] >= 1000:
            covered = {w for p in r["passages"] for w in range(p["start"], p["end"])}
            assert r["n_passages"] == 2 and covered == set(range(20, 220)) and r["n_dup_words"] == 200


def test_a_passage_in_pieces_elsewhere_is_whole(spark):
    """Earlier documents hold pieces of a passage that a later one has whole."""
    rng = random.Random(10)
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for g in range(20):
        p, at = fresh(120), 1000 * g
        rows += [(at + n, fresh(30) + p[i : i + 34] + fresh(30)) for n, i in enumerate(range(0, 120, 17))]
        rows += [(at + 100, fresh(50) + p + fresh(40)), (at + 101, fresh(20) + p + fresh(70))]
    got = {r["doc_id"]: r for r in chaining.fuzzy(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()}
    for g in range(20):
        r = got[1000 * g + 101]
        assert [(p["start"], p["end"], p["partner_id"]) for p in r["passages"]] == [(20, 140, 1000 * g + 100)] and r["n_dup_words"] == 120


def _shared_words(a, b, least=50):
    """Words of a in stretches of `least` words or more that b has word for word, by all pairs of words."""
    out = np.zeros(len(a), bool)
    number: dict = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in t]) for t in (a, b))
    same = x[:, None] == y[None]
    if same.any():
        for k in range(-len(x) + 1, len(y)):
            d = np.flatnonzero(np.diff(np.diagonal(same, k).astype(np.int8), prepend=0, append=0))
            for s, e in zip(d[::2].tolist(), d[1::2].tolist(), strict=True):
                if e - s >= least:
                    out[s + max(0, -k) : e + max(0, -k)] = True
    return out


def test_spliced_documents_against_all_pairs(spark):
    """Documents spliced from pieces of earlier ones, pieces of pieces included: at least 95 % of the
    words that all pairs find are found, and few others."""
    rng = random.Random(11)
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    docs = []
    for i in range(130):
        words = []
        while len(words) < 250:
            if i >= 20 and rng.random() < 0.6:
                source = docs[rng.randrange(i)]
                n = rng.randrange(20, 130)
                at = rng.randrange(max(1, len(source) - n))
                words += source[at : at + n]
            else:
                words += fresh(rng.randrange(10, 60))
        docs.append(words)
    want = [np.any([_shared_words(w, docs[j]) for j in range(i)] + [np.zeros(len(w), bool)], axis=0) for i, w in enumerate(docs)]
    got = {r["doc_id"]: r["passages"] for r in chaining.fuzzy(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()}
    found = []
    for i, w in enumerate(docs):
        mask = np.zeros(len(w), bool)
        for p in got[i]:
            mask[p["start"] : p["end"]] = True
        found.append(mask)
    hits = sum(int((a & b).sum()) for a, b in zip(want, found, strict=True))
    assert hits >= 0.95 * sum(map(np.sum, want)) and sum(map(np.sum, found)) <= 1.05 * sum(map(np.sum, want))


def test_fuzzy_passages(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(5000)]
    rows, planted = [], []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(300)]
        rows.append((i, " ".join(words)))
        part = words[50:150]
        for j in range(14, 100, 14):
            part[j] = rng.choice(vocab)
        del part[33]
        rest, at = [rng.choice(vocab) for _ in range(120)], rng.randrange(100)
        rows.append((1000 + i, " ".join(rest[:at] + part + rest[at:])))
        planted.append((1000 + i, at, at + 99, i))
    got = {r["doc_id"]: r for r in chaining.fuzzy(spark.createDataFrame(rows, "doc_id long, text string"), chaining.Chains(chunk_bytes=20_000, block_seeds=500)).collect()}
    hits = sum(any(p["partner_id"] == i and min(b, p["end"]) - max(a, p["start"]) >= 80 for p in got[d]["passages"]) for d, a, b, i in planted)
    assert hits >= 54
    assert all(got[i]["n_passages"] == 0 for i in range(60))


def test_exact_passages_are_all_found(spark):
    """Passages of 60 words, word for word, in documents all over, whatever the chunks."""
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(9000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(80):
        words = [rng.choice(vocab) for _ in range(100)]
        rows.append((i, " ".join(words[:40] + passage + words[40:])))
    got = chaining.fuzzy(spark.createDataFrame(rows, "doc_id long, text string"), chaining.Chains(chunk_bytes=9000, block_seeds=300)).collect()
    assert all(r["n_dup_words"] >= 60 for r in got if r["doc_id"]) and all(p["partner_id"] == 0 for r in got for p in r["passages"])


def _brute_removed(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(d, first.get(k, d))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        out[d] = (len(b), int(gone.sum()), len(spans) // 2, hashlib.sha256(np.frombuffer(b, "u1")[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("r", [suffixes.Repeats(), suffixes.Repeats(chunk_bytes=20_000, block_runs=500, bucket=200), suffixes.Repeats(chunk_bytes=20_000, block_runs=500, crowded=5)])
def test_suffixes_brute_force(spark, docs, r):
    rows = [(x["doc_id"], x["text"]) for x in docs.filter("n_chars < 6000").collect()]
    rows += [(5000, "ab" * 400), (5001, "b" + "ab" * 300 + "x" * 60), (5002, None), (5003, ""), (5004, "x" * 500), (5005, "é" * 120), (5006, "zé" + "é" * 40)]
    got = suffixes.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), r).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got} == _brute_removed(rows)


def test_suffix_order():
    rng = random.Random(0)
    for text in (bytes(rng.choice(b"ab") for _ in range(900)), b"abc" * 300, b"a" * 500, bytes(rng.randrange(256) for _ in range(700))):
        order = suffixes.SuffixOrder(text, 4 * len(text))
        for most in (50, 10**6):
            got = np.concatenate(list(order.buckets(np.arange(len(text)), most))).tolist()
            padded = text + bytes(6 * len(text))
            assert [padded[i : i + len(text) * 2] for i in got] == sorted(padded[i : i + len(text) * 2] for i in range(len(text)))


def test_cover():
    assert Counter((a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER).keys() == set(range(suffixes.PERIOD))
