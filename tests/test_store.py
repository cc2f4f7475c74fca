"""Keyed tables, commits, claims and summaries that batches are merged into."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadloom.functions.dates import moment
from leadloom.operators import dedupe, finance, run_state, upsert
from leadloom.operators.store import Conflict, Store, Table

T = Table("t", ("k",), 8)


def rows(spark, values, schema="k string, v long"):
    return spark.createDataFrame(values, schema)


def folders(store, table="t"):
    return store.snapshot().state["tables"][table]["folders"]


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("t") is None
    upsert.upsert_into(store, T, rows(spark, [(f"k{i}", 1) for i in range(100)]), "v")
    before = folders(store)
    upsert.upsert_into(store, T, rows(spark, [("k1", 2), ("new", 2)]), "v")
    after = folders(store)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and len(before) == 8
    assert as_set(store.read("t")) == {(f"k{i}", 2 if i == 1 else 1) for i in range(100)} | {("new", 2)}
    # The old version can still be read.
    assert as_set(store.read("t", 1)) == {(f"k{i}", 1) for i in range(100)}
    gone = store.clean(keep=1)
    assert len([g for g in gone if g.startswith("data")]) == len([b for b in changed if b in before])
    assert as_set(store.read("t")) == {(f"k{i}", 2 if i == 1 else 1) for i in range(100)} | {("new", 2)}


def test_replay_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for n in (0, 1, 1, 0):
        upsert.bump_into(store, Table("t", ("k",), 4), rows(spark, [("a", n, "2024-01-01"), ("b", n, "2024-01-01")], "k string, ord long, day string").withColumn("received_at", F.col("day").cast("timestamp")), batch=("stream", n))
    assert store.versions() == [1, 2]
    assert {(r.k, r.ord, r.duplicate_count) for r in store.read("t").collect()} == {("a", 0, 1), ("b", 0, 1)}


def test_buckets_and_keys_are_fixed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    upsert.upsert_into(store, T, rows(spark, [("a", 1)]), "v")
    with pytest.raises(ValueError):
        upsert.upsert_into(store, Table("t", ("k",), 16), rows(spark, [("a", 1)]), "v")


def test_null_keys_and_other_number_types(spark, tmp_path):
    store, t = Store(spark, str(tmp_path)), Table("t", ("k",), 8)
    upsert.upsert_into(store, t, rows(spark, [(1, 1), (None, 1)], "k long, v long"), "v")
    upsert.upsert_into(store, t, rows(spark, [(1, 2), (None, 2)], "k int, v long").withColumn("k", F.col("k").cast("long")), "v")
    assert Counter(tuple(r) for r in store.read("t").collect()) == Counter([(1, 2), (None, 1), (None, 2)])
    upsert.upsert_into(store, t, rows(spark, [], "k long, v long"), "v")
    assert store.read("t").count() == 3


def test_two_writers_of_one_key(spark, tmp_path):
    """The one that commits second merges again, over what the first has written."""
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    turns = []

    def change(own):
        turns.append(own.version)
        own.merge(T, rows(spark, [("a", 1)]), lambda there, new: new if there is None else there.unionByName(new.join(there, "k", "left_anti")))
        if len(turns) == 1:  # somebody else is faster
            upsert.upsert_into(other, T, rows(spark, [("a", 9), ("b", 9)]), "v")

    store.update(change)
    assert turns == [0, 1] and as_set(store.read("t")) == {("a", 9), ("b", 9)}
    # Buckets that a loser wrote are gone.
    assert len(store.files.names(f"{tmp_path}/data/t")) == 2


def test_two_writers_of_different_buckets_both_pass_at_once(spark, tmp_path):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    turns = []

    def change(own):
        turns.append(own.version)
        own.merge(T, rows(spark, [("a", 1)]), lambda there, new: new)
        if len(turns) == 1:
            other.merge(Table("u", ("k",), 8), rows(spark, [("a", 9)]), lambda there, new: new)

    store.update(change)
    assert turns == [0] and store.versions() == [1, 2]
    assert as_set(store.read("t")) == {("a", 1)} and as_set(store.read("u")) == {("a", 9)}


def test_endless_conflicts_end(spark, tmp_path):
    store = Store(spark, str(tmp_path))

    def change(own):
        own.merge(T, rows(spark, [("a", 1)]), lambda there, new: new)
        Store(spark, str(tmp_path)).merge(T, rows(spark, [("a", 2)]), lambda there, new: new)

    with pytest.raises(Conflict):
        store.update(change, tries=2)


def test_create_is_exclusive(spark, tmp_path):
    files = Store(spark, str(tmp_path)).files
    assert files.create(f"{tmp_path}/versions/1.json", "a") and not files.create(f"{tmp_path}/versions/1.json", "b")
    assert files.read(f"{tmp_path}/versions/1.json") == "a"


# --- claims -------------------------------------------------------------------------------


def candidates(spark, ids):
    return spark.createDataFrame([(i, i, f"charge.{i}", "stripe_charge", "2024-01-02", "charge") for i in ids], "ord string, entity_id string, event_type string, signal_type string, event_date string, source string").withColumn("event_date", F.col("event_date").cast("date"))


def test_claims_are_idempotent_and_one_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert finance.persist(store, candidates(spark, "abca"), "acct", moment("2024-01-02 01:00:00")) == (3, 1)
    assert store.versions() == [1]
    assert finance.persist(store, candidates(spark, "bcd"), "acct", moment("2024-01-02 02:00:00")) == (1, 2)
    assert finance.persist(store, candidates(spark, "x"), "acct", moment("2024-01-02 12:00:00"), window_open=False) == (0, 0)
    assert {r.entity_id for r in store.read("finance_signals").collect()} == set("abcd")
    told = {(r.run_timestamp_utc[11:13], r.mode, r.candidate_count, r.dedupe_count) for r in store.read("quiet_receipt_log").collect()}
    assert told == {("01", "read_only_ingestion", 4, 1), ("02", "read_only_ingestion", 3, 2), ("12", "outside_window_noop", 0, 0)}
    # A version holds all three tables or none.
    assert {frozenset(store.snapshot(v).state["tables"]) for v in store.versions()} == {frozenset({"finance_event_dedupe", "finance_signals", "quiet_receipt_log"})}


def test_two_runs_claim_a_key_once(spark, tmp_path, monkeypatch):
    store, first = Store(spark, str(tmp_path)), []
    real = finance.stored

    def stored(there, found):
        if not first:
            first.append(True)
            assert finance.persist(Store(spark, str(tmp_path)), candidates(spark, "ab"), "acct", moment("2024-01-02 02:00:00")) == (2, 0)
        return real(there, found)

    monkeypatch.setattr(finance, "stored", stored)
    assert finance.persist(store, candidates(spark, "bc"), "acct", moment("2024-01-02 03:00:00")) == (1, 1)
    claims = store.read("finance_event_dedupe")
    assert claims.count() == claims.select("dedupe_key").distinct().count() == 3


def test_a_failed_run_leaves_an_error_receipt(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    bad = candidates(spark, "a").withColumn("entity_id", F.raise_error(F.lit("no page")).cast("string"))
    with pytest.raises(Exception, match="no page"):
        finance.persist(store, bad, "acct", moment("2024-01-02 01:00:00"))
    assert [(r.window_open, r.mode, r.candidate_count) for r in store.read("quiet_receipt_log").collect()] == [(False, "error", 0)]
    assert store.read("finance_signals") is None


# --- upserts of all types, arg-max, summaries ---------------------------------------------


def test_variant_and_map_columns(spark):
    df = spark.sql("select * from values ('a', 1, map('x', 1), parse_json('{\"n\": 1}')), ('a', 2, map('x', 2), parse_json('{\"n\": 2}')), ('a', 2, map('x', 3), parse_json('{\"n\": 3}')) as t(k, ord, m, v)")
    one = upsert.latest_wins(df.limit(0), df, ["k"], "ord").selectExpr("k", "ord", "m['x'] as m", "variant_get(v, '$.n', 'int') as n").collect()
    assert len(one) == 1 and one[0].ord == 2 and one[0].m == one[0].n in (2, 3)
    bumped = upsert.insert_or_bump(df.withColumn("received_at", F.lit("2024-01-01").cast("timestamp")), "k").selectExpr("ord", "m['x'] as m", "duplicate_count").collect()
    assert [tuple(r) for r in bumped] == [(1, 1, 2)]


def test_one_address_in_two_states(spark):
    subs = rows(spark, [("a@x.org", "past_due", 2), ("a@x.org", "active", 1)], "email string, status string, ts long")
    leads = rows(spark, [("A@x.org",), ("b@x.org",)], "email string")
    assert as_set(upsert.tag_by_email(leads, subs)) == {("A@x.org", "past_due"), ("b@x.org", "none")}


@pytest.mark.parametrize("hot", [1000, 2])
def test_arg_max_of_a_hot_group(spark, hot):
    rng = random.Random(1)
    made = [(i, None if rng.random() < 0.05 else "hot" if rng.random() < 0.9 else f"g{rng.randrange(30)}", rng.randrange(5)) for i in range(2000)]
    df = rows(spark, made, "ord long, g string, s int").repartition(5)
    want_best, want_first = {}, {}
    for i, g, s in made:
        if g not in want_best or s > want_best[g][0]:
            want_best[g] = (s, i)
        want_first.setdefault(g, i)
    flagged = dedupe.flag_best(df, ["g"], "s", hot=hot)
    got = flagged.collect()
    assert len(got) == len(made)
    assert {r.g: (r.s, r.ord) for r in got if r.is_unique} == want_best and sum(r.is_unique for r in got) == len(want_best)
    assert {r.g: r.first_seen for r in got} == want_first
    assert {r.g: (r.s, r.ord, r.first_seen) for r in dedupe.best(df, ["g"], "s").collect()} == {g: (*b, want_first[g]) for g, b in want_best.items()}
    for out in (flagged, dedupe.best(df, ["g"], "s"), dedupe.first_new(df, "g")):
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_summaries_of_batches_equal_those_of_one_pass(spark, tmp_path):
    rng = random.Random(7)
    made = []
    for i in range(400):
        score = rng.randrange(0, 101, 5)
        made.append((i, rng.randrange(4), f"g{rng.randrange(60)}", score, "high" if score >= 80 else "usable" if score >= 50 else "low", rng.randrange(3)))
    df = rows(spark, made, "ord long, run_id long, duplicate_group_id string, lead_score int, score_band string, signal_count int")
    state = run_state.RunState(signals="signal_count", buckets=4)
    once, often = Store(spark, f"{tmp_path}/once"), Store(spark, f"{tmp_path}/often")
    assert run_state.summaries(once, state) is None
    run_state.add(once, df, state)
    for n in (0, 1, 2, 2):
        run_state.add(often, df.filter(F.pmod(F.xxhash64("ord"), F.lit(3)) == n), state, ("items", n))
    a, b = (run_state.summaries(s, state).orderBy("run_id").collect() for s in (once, often))
    assert a == b
    for r in a:
        own = [m for m in made if m[1] == r.run_id]
        best = {}
        for o, _, g, s, _, _ in own:
            first = best[g][2] if g in best else o
            if g not in best or s > best[g][0]:
                best[g] = (s, o, first)
        top = sorted(best.values(), key=lambda x: (-x[0], x[2]))[:3]
        assert (r.total, r.unique_count, r.total_signals) == (len(own), len(best), sum(m[5] for m in own))
        assert (r.instant_alert, r.nurture, r.hold) == (sum(b[0] >= 80 for b in best.values()), sum(50 <= b[0] < 80 for b in best.values()), sum(b[0] < 50 for b in best.values()))
        assert [(i.ord, i.lead_score) for i in r.top_items] == [(o, s) for s, o, _ in top]
