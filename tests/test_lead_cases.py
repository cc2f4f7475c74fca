"""Records, SQL functions, signatures, identities: cases that differ from the usual ones."""

import hashlib
import hmac
import json
import random

from pyspark.sql import functions as F

from leadloom import api
from leadloom.functions import hashing, text, web
from leadloom.operators import finance, registry
from leadloom.operators.identity import connected
from leadloom.sources import landing, table_functions


def test_keyword_arrays_are_joined(spark):
    items = [{"name": "A", "keywords": ["new", "location"]}, {"name": "B", "keywords": "new location"}, {"name": "C", "keywords": ["new", None, "location"]}, {"name": "D", "keywords": []}, {"name": "E"}, {"name": "F", "keywords": ["new\tlocation "]}]
    leads = landing.lead_records(landing.inline_items(spark, [json.dumps(i) for i in items]))
    got = api.score(leads, "full").orderBy("ord").collect()
    assert [r["keywords"] for r in got] == ["new location"] * 3 + ["", "", "new location"]
    assert [r["score_intent"] for r in got] == [12, 12, 12, 0, 0, 12]


def test_items_of_unknown_runs_stay(spark):
    runs = spark.createDataFrame([(1, "Roofing", "Waco", "csv", "2024-01-02")], "id long, niche string, city string, source string, requested_at string")
    items = spark.createDataFrame([(1, 1), (2, None), (3, 2)], "ord long, run_id long")
    got = landing.with_run(items, runs).orderBy("ord").collect()
    assert [tuple(r)[2:] for r in got] == [("Roofing", "Waco", "csv", "2024-01-02"), ("HVAC", "Austin", "apify", None), ("HVAC", "Austin", "apify", None)]


def test_ratio_counts_only_as_a_number(spark):
    items = [{"upVoteRatio": "0.9", "upvoteRatio": 0.5}, {"upVoteRatio": 1}, {"upvoteRatio": True}, {"upVoteRatio": None}, {}]
    got = landing.post_records(landing.inline_items(spark, [json.dumps(i) for i in items])).orderBy("ord").collect()
    assert [r["upvote_ratio"] for r in got] == [0.5, 1.0, None, None, None]


def test_sql_functions_equal_column_functions(spark):
    hashing.register(spark)
    rng = random.Random(3)
    pieces = ["http://", "HTTPS://", "www.", "shop", ".example", ".com", "/a?b=1", "?x=1", "#top", "user@", ":80", " ", "\t", "é", "--", "+1", "(512) 555-0100", "", "1", "<&>", "\x01", "a b", "."]
    values = ["".join(rng.choices(pieces, k=rng.randint(0, 6))) for _ in range(600)] + [None, "https://example.com?x=1", "https://user@example.com/x", "a\tb c"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    both = {"normalize_text": text.normalize_text, "normalize_domain": text.normalize_domain, "normalize_phone": text.normalize_phone, "normalize_email": text.normalize_email, "slugify": text.slugify, "html_escape": text.html_escape, "is_email": text.is_email}
    got = df.select("x", *[f("x").alias(f"c_{n}") for n, f in both.items()], *[F.expr(f"{n}(x)").alias(f"s_{n}") for n in both], hashing.stable_group_id("x", F.lit(""), F.lit("q")).alias("c_id"), F.expr("stable_group_id(array(x, '', 'q'))").alias("s_id")).collect()
    for r in got:
        for n in (*both, "id"):
            assert r[f"c_{n}"] == r[f"s_{n}"], (n, r["x"])


def test_signatures_equal_the_standard_librarys(spark):
    rng = random.Random(5)
    for secret in ("s", "x" * 64, "long " * 40, "ключ"):
        rows = [(str(i), "".join(rng.choices("abcü{}\n\x00,=", k=rng.randint(0, 200)))) for i in range(50)]
        sign = lambda t, b: hmac.new(secret.encode(), f"{t}.{b}".encode(), hashlib.sha256).hexdigest()  # noqa: B023, E731
        df = spark.createDataFrame([(t, b, f"t=0,t={t},v1=x,v1={sign(t, b)}", sign(t, b)) for t, b in rows], "t string, b string, h string, want string")
        got = df.select("want", web.hmac_sha256(secret, F.concat("t", F.lit("."), "b")).alias("x"), web.signature_valid(secret, F.col("h"), F.col("b")).alias("ok"), web.signature_valid(secret + "!", F.col("h"), F.col("b")).alias("no"))
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        assert all(r["want"] == r["x"] and r["ok"] and not r["no"] for r in got.collect())
    odd = spark.createDataFrame([("v1=ab", "b"), ("t=1", "b"), ("", "b"), (None, None), ("t=1,v1=", "b")], "h string, b string")
    assert not any(r[0] for r in odd.select(web.signature_valid("s", F.col("h"), F.col("b"))).collect())


def brute_entities(rows):
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for keys in rows:
        for k in keys[1:]:
            a, b = sorted((find(keys[0]), find(k)))
            root[b] = a
    return {k: find(k) for keys in rows for k in keys}


def test_connected_keys(spark):
    rng = random.Random(8)
    rows = [[f"k{rng.randrange(150)}" for _ in range(rng.randint(1, 3))] for _ in range(130)] + [["hot", f"h{i}"] for i in range(300)] + [[f"c{i}", f"c{i + 1}"] for i in range(40)]
    given = [[*r, None, r[0]] for r in rows] + [[], [None]]
    got = connected(spark.createDataFrame([(r,) for r in given], "keys array<string>")).collect()
    assert {r.key: r.label for r in got} == brute_entities(rows) and len(got) == len(brute_entities(rows))


def test_registry_of_entities(spark):
    rows = [
        ("K1", "http://a/", "Acme", "x", "s", 1, "lane2", 10), ("K2", "HTTP://A/", "", "", "", 2, "lane3", 60), ("", "", "acme", "X", "S", 3, "lane2", 5),
        ("K9", None, None, None, None, 4, "lane4", 49), (None, " ", "Acme", "y", "s", 5, "lane2", None), ("", "", "", "", "", 6, "lane2", 99),
    ]
    df = spark.createDataFrame(rows, "canonical_key string, url string, entity string, geo string, signal string, seen_at long, lane string, score long")
    got = {r.registry_key: r for r in registry.resolved(df, spark.createDataFrame([("url:http://a/",)], "registry_key string")).collect()}
    assert len(got) == 3
    one = next(r for r in got.values() if r.merged_count == 3)
    assert (one.first_seen_at, one.last_seen_at, one.score, one.file_worthy, one.filing_state, one.source_lanes) == (1, 3, 60, True, "filed", ["lane2", "lane3"])
    assert [(p.lane, p.rows, p.first_seen_at, p.last_seen_at) for p in one.provenance] == [("lane2", 2, 1, 3), ("lane3", 1, 2, 2)]
    assert (got["key:K9"].score, got["key:K9"].file_worthy, got["key:K9"].filing_state) == (49, False, "ready")
    assert {r.score for r in got.values()} == {60, 49, None}


def test_table_functions(spark):
    spark.createDataFrame([("finance_event:acct:charge.b:2024-01-02",)], "dedupe_key string").createOrReplaceTempView("finance_event_dedupe")
    known = api.intake(spark.createDataFrame([("Ann", "a@x.org", "n", "c", "", None, 1, "2024-01-01")], "name string, email string, niche string, city string, cadence string, notes string, ord long, at string").withColumn("received_at", F.col("at").cast("timestamp")))
    known.select("dedupe_key", F.lit("r-1").alias("receipt_id"), "status", "sla_due_at").createOrReplaceTempView("sample_intake_requests")
    table_functions.register(spark)
    rows = spark.createDataFrame([(i, e, f"charge.{e}", "stripe_charge", "2024-01-02", "charge") for i, e in enumerate("abca")], "ord long, entity_id string, event_type string, signal_type string, event_date string, source string").withColumn("event_date", F.col("event_date").cast("date"))
    keyed = finance.keyed(rows, "acct")
    given = keyed.orderBy("ord").select(F.to_json(F.struct("dedupe_key", "entity_id", "signal_key", "signal_type", "event_type", "event_date"))).collect()
    got = spark.sql("SELECT dedupe_key, signal_key, entity_id, signal_type, event_type, event_date FROM new_finance_signals(:rows)", {"rows": "[" + ",".join(r[0] for r in given) + "]"})
    want = finance.new_signals(keyed, spark.table("finance_event_dedupe")).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2
    ask = lambda name: spark.sql("SELECT * FROM intake_sample_request(:name, 'A@x.org', 'n', ' c', 'weekly', '', TIMESTAMP '2024-02-01')", {"name": name}).first()
    old, new = ask("\tann "), ask("Bob")
    assert (old.receipt_id, old.duplicate, str(old.sla_due_at)) == ("r-1", True, "2024-01-02 00:00:00")
    assert (new.status, new.owner, new.duplicate, str(new.sla_due_at)) == ("queued", "sakuya", False, "2024-02-02 00:00:00") and new.receipt_id != "r-1"


def test_error_receipt(spark):
    r = finance.error_receipt(spark, F.lit("2024-01-01 01:00:00").cast("timestamp")).first()
    assert r.asDict() == {"run_timestamp_utc": "2024-01-01T01:00:00.000Z", "window_open": False, "candidate_count": 0, "dedupe_count": 0, "pagination_exhausted": False, "mode": "error", "sources": {}}

