"""Hand-traced cases, and plain-Python twins of scoring."""

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom import api
from leadloom.functions import dates, hashing, text
from leadloom.operators import budget, dedupe, finance, queue, upsert
from leadloom.plans.models import MODELS
from leadloom.sources import landing
from leadloom.streaming.finance_stream import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def leads(spark, items, **context):
    return landing.lead_records(landing.inline_items(spark, [json.dumps(i) for i in items]), **context)


def test_lane_golden(spark):
    rows = leads(spark, [{"name": "Acme HVAC", "city": "Austin", "phone": "512-555-0100"}], context_niche="HVAC", context_city="Austin", collected_at="2024-01-01")
    got = api.process(rows, "hvac").items.first()
    assert (got["phone"], got["score_fit"], got["score_intent"], got["score_quality"], got["lead_score"]) == ("+15125550100", 70, 0, 32, 36)
    assert (got["score_band"], got["recommended_action"], got["duplicate_group_id"]) == ("low", "hold", "d6c2396aca6ae757")


def test_simple_golden(spark):
    raw = spark.createDataFrame([(0, "Acme HVAC", "", "512-555-0100", "", "Austin", "", False, False)], "ord long, raw_name string, raw_website string, raw_phone string, raw_email string, city string, niche string, hiring_intent boolean, recent_activity boolean")
    got = api.process(api.normalized_leads(raw, "simple"), "simple").items.first()
    assert (got["lead_score"], got["group_hash"], got["canonical_entity_id"]) == (42, "h3f06ff60", "h77ae7700")


def test_job_golden(spark):
    rows = landing.job_records(landing.inline_items(spark, [json.dumps({"title": "Instructional Designer", "company": "Acme Corp"})]), "indeed", "instructional design")
    got = api.process(rows.withColumn("age_hours", F.lit(None).cast("double")), "jobs").items.first()
    assert (got["score_fit"], got["score_intent"], got["score_quality"], got["lead_score"], got["duplicate_group_id"]) == (47, 10, 24, 27, "7dc26bb855827248")


def test_post_golden(spark):
    item = {"title": "Looking for LMS recommendations", "selftext": "We need to replace our current platform..."}
    rows = landing.post_records(landing.inline_items(spark, [json.dumps(item)]), "instructionaldesign")
    got = api.process(rows.withColumn("age_hours", F.lit(None).cast("double")), "posts").items.first()
    assert got["matched_signals"] == ["looking for", "replace"]
    assert (got["score_fit"], got["score_intent"], got["score_quality"], got["score_engagement"], got["signal_score"]) == (30, 15, 16, 8, 19)
    assert got["duplicate_group_id"] == "0781532095b889ba"
    assert "signals:2" in got["score_reasons"]


def test_last_alias_wins(spark):
    item = {"title": "T", "company": "A", "companyName": "", "summary": "s", "description": "d" * 3000}
    got = landing.job_records(landing.inline_items(spark, [json.dumps(item)]), "indeed").first()
    assert got["company_name"] == "A" and got["raw_snippet"] == "d" * 2000  # an empty last alias wins, then falls back


def test_keys(spark):
    fields = ["ada lovelace", "ada@example.com", "software consulting", "london", "weekly", "need a sample"]
    assert one(spark, hashing.intake_key(*[F.lit(f) for f in fields])) == "sha256:308ba74a5dd0b40bc4e6a4dfd16923c0842b235450c4c913bcb6cee1489e42e6"
    assert one(spark, hashing.hash32(F.lit("Acme HVAC|x"))) == "h7ff0eab2"
    assert one(spark, hashing.event_key(F.lit("acct_123"), F.lit("charge.ch_first"), F.lit("2026-07-19"))) == "finance_event:acct_123:charge.ch_first:2026-07-19"
    assert one(spark, hashing.signal_key(F.lit("ch_first"), F.lit("stripe_charge"))) == "finance_signal:ch_first:stripe_charge"


@settings(max_examples=15, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=12))
def test_hash32(spark, s):
    h = 0
    raw = s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    assert one(spark, hashing.hash32(F.lit(s))) == f"h{abs(h):x}"


@pytest.mark.parametrize(("raw", "want"), [("HTTPS://www.Example.com/a", "example.com"), ("example.com:8080/x", "example.com"), ("", ""), ("www.a.b", "a.b"), ("not a url/x", "not a url")])
def test_domain(spark, raw, want):
    assert one(spark, text.normalize_domain(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("(512) 555-0100", "+15125550100"), ("1 512 555 0100", "+15125550100"), ("+44 20 1", "+44201"), ("12345", "12345"), (None, ""), ("123456789", "+123456789")])
def test_phone(spark, raw, want):
    assert one(spark, text.normalize_phone(F.lit(raw).cast("string"))) == want


def test_null_and_absent(spark):
    rows = leads(spark, [{"freshness_hours": None}, {}, {"freshness_hours": "abc"}, {"freshness_hours": "12"}, {"hiring_intent": "false"}, {"hiring_intent": 0}, {"hiring_intent": False}])
    got = rows.orderBy("ord").select("freshness_hours", "hiring_intent").collect()
    assert [r[0] for r in got][:4] == [0.0, None, None, 12.0]
    assert [r[1] for r in got][4:] == [True, False, False]


def test_window(spark):
    for t, want in (("2024-01-01 00:00:00", True), ("2024-01-01 05:59:59", True), ("2024-01-01 06:00:00", False)):
        assert one(spark, dates.overnight(dates.moment(t))) is want


def test_posting_date(spark):
    assert one(spark, dates.posting_date(F.lit("1784422800"))) == "2026-07-19T01:00:00.000Z"
    assert one(spark, dates.posting_date(F.lit("2024-01-01T00:00:00Z"))) == "2024-01-01T00:00:00Z"
    assert one(spark, dates.posting_date(F.lit("yesterday"))) == "yesterday"


def test_tie_break(spark):
    df = spark.createDataFrame([(0, "A", 40), (1, "B", 55), (2, "A", 55), (3, "B", 55), (4, "C", 10)], "ord long, g string, s int")
    assert [(r["g"], r["ord"]) for r in dedupe.ranked(dedupe.best(df, ["g"], "s"), "s").collect()] == [("A", 2), ("B", 1), ("C", 4)]


@settings(max_examples=10, deadline=None)
@given(st.permutations(list(range(12))))
def test_permutation_invariance(spark, order):
    rows = [(i, f"g{i % 4}", (i * 37) % 101) for i in order]
    got = dedupe.best(spark.createDataFrame(rows, "ord long, g string, s int"), ["g"], "s").select("ord").collect()
    assert sorted(r["ord"] for r in got) == sorted(max((r for r in rows if r[1] == g), key=lambda r: r[2])[0] for g in {r[1] for r in rows})


def test_counts_add_up(spark, data):
    from leadloom.plans.catalogue import _leads

    b = api.process(_leads(spark, data, "hvac"))
    c = b.counts.first()
    assert c["high"] + c["usable"] + c["low"] == c["total"] >= c["unique_count"] == b.unique.count()
    assert 0 <= b.items.agg(F.min("lead_score")).first()[0] and b.items.agg(F.max("lead_score")).first()[0] <= 83


def test_maxima():
    for name, most in (("full", 82.5), ("hvac", 82.5), ("jobs", 47.6), ("posts", 46.0)):
        total = 0.0
        for c, w in MODELS[name].weights.items():
            points = {}
            for r in MODELS[name].rules:
                if r.component == c and r.points != "0":
                    # of conditions on the same age or freshness only one holds
                    key = r.when.split(" ")[0] if r.when.startswith(("age_hours", "freshness")) else r.when
                    points[key] = max(points.get(key, 0), 15 if "least" in r.points else int(r.points))
            total += min(100, sum(points.values())) * float(w)
        assert math.isclose(total, most), name


def test_finance_selection(spark):
    cand = spark.createDataFrame([(0, "ch_first", "charge"), (1, "ch_first", "charge"), (2, "ch_second", "balance"), (3, "ch_third", "balance")], "ord long, dedupe_key string, source string")
    seen = spark.createDataFrame([("ch_first",)], "dedupe_key string")
    new = finance.new_signals(cand, seen)
    assert sorted(r["dedupe_key"] for r in new.collect()) == ["ch_second", "ch_third"]
    now = dates.moment("2026-07-19 01:02:03")
    r = finance.receipt(cand, new, now=now).first()
    assert r.asDict() == {"run_timestamp_utc": "2026-07-19T01:02:03.000Z", "window_open": True, "candidate_count": 4, "dedupe_count": 2, "pagination_exhausted": True, "mode": "read_only_ingestion", "sources": {"balance": 1, "charges": 2, "subscriptions": 0, "balance_transactions": 0}}
    r = finance.receipt(cand, new, window_open=False, now=now).first()
    assert (r["mode"], r["window_open"], r["candidate_count"], r["sources"]) == ("outside_window_noop", False, 0, {})


def test_finance_stream_is_idempotent(spark, tmp_path):
    landing_, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for n in range(2):  # the same charge lands twice
        spark.createDataFrame([("ch_1", 1784422800)], "id string, created bigint").coalesce(1).write.mode("append").json(landing_)
        ingest(spark, landing_, out, ckpt, "acct").awaitTermination()
        rows = spark.read.parquet(out).collect()
        assert [r["dedupe_key"] for r in rows] == ["finance_event:acct:charge.ch_1:2026-07-19"], n


def test_intake(spark):
    rows = [(0, "  Ada  Lovelace ", "ADA@EXAMPLE.COM ", "  Software   consulting ", " London  ", " weekly ", " Need a sample "), (1, "Ada Lovelace", "ada@example.com", "software consulting", "london", "", "need a sample"), (2, "", "x@y.z", "a", "b", "", ""), (3, "n", "bad", "a", "b", "", "")]
    df = spark.createDataFrame(rows, "ord long, name string, email string, niche string, city string, cadence string, notes string").withColumn("received_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = api.intake(df).collect()
    assert len(got) == 1 and got[0]["name"] == "Ada Lovelace" and got[0]["duplicate_count"] == 1 and got[0]["cadence"] == "weekly"
    assert str(got[0]["sla_due_at"]) == "2024-01-02 00:00:00"
    again = api.intake(df, api.intake(df)).collect()
    assert len(again) == 1 and again[0]["duplicate_count"] == 3


def test_budget(spark):
    rows = [(0.05, 0.10, 0.05, 0.0, 0.0), (5.0, 0.10, 0.05, 0.0, 0.0), (5.0, 1.0, 0.05, 4.5, 0.0)]
    a, b, c = budget.check(spark.createDataFrame(rows, "budget_cap double, est_run_cost double, overhead_pct double, monthly_usage double, plan_limit double")).collect()
    assert (a["state"], a["reason"]) == ("capped", "run_cost_exceeds_safe_budget:0.1050>0.0475")
    assert b["state"] == "within_budget" and math.isclose(b["remaining"], 4.895)
    assert c["state"] == "over_budget" and c["reason"].startswith("insufficient_remaining:1.0500>0.5000")


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 3), (None, 2)], "k string, v int")
    assert sorted((r["k"] or "", r["v"]) for r in upsert.latest_wins(old, new, ["k"], "v").collect()) == [("", 1), ("", 2), ("a", 3), ("b", 1)]
    assert sorted((r["k"], r["v"]) for r in upsert.merge_by(old.filter("k is not null"), spark.createDataFrame([("a", None), ("c", 9)], "k string, v int"), "k").collect()) == [("a", 1), ("b", 1), ("c", 9)]


def test_queue_settles(spark):
    q = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "pending")], "id long, status string")
    done = spark.createDataFrame([(1, True), (2, False)], "id long, ok boolean")
    assert sorted((r["id"], r["status"]) for r in queue.settle(q, done).collect()) == [(2, "failed"), (3, "pending")]


def test_sql_functions(spark):
    hashing.register(spark)
    assert spark.sql("SELECT normalize_text('  a\tb ') AS x, round_half_up(2.5D) AS y, is_email('a@b.c') AS z").first() == ("a b", 3, True)
    assert spark.sql("SELECT normalize_phone('(512) 555-0100'), normalize_email(' A@B.C '), normalize_domain('HTTPS://www.Example.com/a'), slugify('Big  Tent #1'), html_escape('<a>&')").first() == ("+15125550100", "a@b.c", "example.com", "big-tent-1", "&lt;a&gt;&amp;")
    assert spark.sql("SELECT clamp(120D), first_filled('', 'x'), event_key('a', 'b', 'c'), signal_key('a', 'b'), ratio(1L, 3L)").first() == (100.0, "x", "finance_event:a:b:c", "finance_signal:a:b", 0.333)


def test_plan_shapes(spark, data):
    """One shuffle serves both windows of a batch; columns are pruned at the scan."""
    from leadloom.plans.catalogue import queries

    plan = queries()["dedupe_hvac"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(duplicate_group_id") == 1
    plan = queries()["payload_hash_dedupe"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_boundaries(spark, tmp_path):
    import hashlib
    import hmac

    from leadloom.functions import web
    from leadloom.operators import runs

    good = hmac.new(b"s", b"1.body", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(f"t=1,v1={good}", "body"), (f"t=1,v1={good}", "other"), ("", "body"), (None, None)], "h string, b string")
    assert [r[0] for r in df.select(web.signature_valid("s", F.col("h"), F.col("b"))).collect()] == [True, False, False, False]
    with pytest.raises(ValueError, match="h: "):
        web.assert_shape(df, __import__("pyspark.sql.types", fromlist=["x"]).StructType().add("h", "long"))
    (tmp_path / "u.json").write_text(json.dumps({"data": {"current": {"monthlyUsageUsd": 1.5}, "limits": {"maxMonthlyUsageUsd": 9}}}))
    assert tuple(runs.usage_limits(spark, str(tmp_path / "u.json")).first()) == (1.5, 9.0)


def test_score_against_plain_python(spark, data):
    """The rule compiler against a scorer that walks one record at a time."""
    import re

    from leadloom.plans.catalogue import _leads

    flags = {"hiring_intent": 15, "recent_activity": 10, "review_velocity": 8, "pricing_signal": 8, "social_proof_signal": 8, "trigger_event": 12}
    for r in api.score(_leads(spark, data, "hvac"), "hvac").collect():
        fit = sum(p for c, p in (("business_name", 10), ("website", 20), ("phone", 10), ("email", 10), ("city", 10), ("niche", 10)) if r[c])
        search = " ".join(r[c] or "" for c in ("business_name", "niche", "city", "website", "context_niche", "context_city")).lower()
        fit += sum(15 for c in ("context_niche", "context_city") if r[c] and r[c].lower() in search)
        intent = sum(p for c, p in flags.items() if r[c])
        intent += 12 if re.search("hiring|growth|expanding|opening|campaign|new location|request a quote", f"{r['title']} {r['description']} {r['notes']}".lower()) else 0
        quality = 8 * sum(bool(r[c]) for c in ("business_name", "website", "phone", "email", "city", "source_url", "collected_at")) + 8 * bool(r["source_confidence"]) + 8 * bool(r["extraction_confidence"])
        fresh = r["freshness_hours"]
        quality += 0 if fresh is None else 12 if fresh <= 24 else 6 if fresh <= 72 else 0
        engagement = 8 * (r["reviews_count"] >= 20) + 6 * (r["rating"] >= 4.2) + 4 * (r["employee_count"] >= 5) + 12 * bool(r["previous_response"] or r["reply_count"] or r["engagement_signal"])
        total = math.floor(min(100, fit) * 0.45 + min(100, intent) * 0.30 + min(100, quality) * 0.15 + min(100, engagement) * 0.10 + 0.5)
        assert (r["score_fit"], r["score_intent"], r["score_quality"], r["score_engagement"], r["lead_score"]) == (fit, intent, quality, engagement, total)


def test_place_golden(spark):
    item = {"raw": {"name": "Acme HVAC", "phone": "512-555-0100", "reviewCount": "25", "services": ["repair", "ducts"], "emergency_service": "no", "freshness_hours": None, "region": " TX "}}
    got = landing.place_records(landing.inline_items(spark, [json.dumps(item)]), "2024-01-01").first()
    assert (got["business_name"], got["niche"], got["city"], got["state"], got["hvac_type"], got["phone"]) == ("Acme HVAC", "HVAC", "Austin", "TX", "both", "+15125550100")
    assert (got["reviews_count"], got["services"], got["serving_zips"], got["emergency_service"], got["freshness_hours"], got["rating"]) == (25.0, ["repair", "ducts"], [], True, 0.0, None)


def test_run_attributes_reach_items(spark):
    runs = spark.createDataFrame([(1, "Roofing", "", None, "2024-01-02"), (2, None, "Dallas", "csv", None)], "id long, niche string, city string, source string, requested_at string")
    items = landing.inline_items(spark, ['{"name": "A"}', '{"name": "B", "city": "Waco"}']).withColumn("run_id", F.col("ord") + 1)
    got = landing.place_records(landing.with_run(items, runs)).orderBy("ord").collect()
    assert [(r["niche"], r["city"], r["collected_at"], r["context_source"]) for r in got] == [("Roofing", "Austin", "2024-01-02", "apify"), ("HVAC", "Waco", "", "csv")]


def test_lead_fields(spark):
    got = leads(spark, [{"name": "Acme", "website": "acme.com", "revenue_band": "1-5m"}, {"name": "B", "sourceType": "maps"}])
    a, b = got.orderBy("ord").collect()
    assert (a["source"], a["source_type"], a["revenue_band"], b["source"], b["source_type"]) == ("apify", "apify", "1-5m", "maps", "maps")
    assert a["fingerprint"] == one(spark, hashing.stable_group_id(F.lit("Acme"), F.lit("acme.com")))


def test_pages_need_a_cursor(spark, tmp_path):
    page = "data array<struct<id: string>>, has_more boolean"
    good = spark.createDataFrame([([("a",), ("b",)], True), ([("c",)], False), ([], False)], page)
    assert [r["entry"]["id"] for r in landing.pages(good, has_more="has_more").collect()] == ["a", "b", "c"]
    for bad in ([("a",), (None,)], []):
        with pytest.raises(Exception, match="cursor missing"):
            landing.pages(spark.createDataFrame([(bad, True)], page), has_more="has_more").collect()
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text('{"a": ')
    assert landing.single_object(spark, str(tmp_path / "good.json")).select(F.variant_get("item", "$.a", "int")).first()[0] == 1
    with pytest.raises(Exception, match="MALFORMED|malformed|parse"):
        landing.single_object(spark, str(tmp_path / "bad.json")).collect()


def test_stream_outside_the_window(spark, tmp_path):
    land, out, ckpt, receipts = (str(tmp_path / x) for x in ("in", "out", "ck", "r"))
    spark.createDataFrame([("ch_1", 1784422800)], "id string, created bigint").coalesce(1).write.json(land)
    assert ingest(spark, land, out, ckpt, "acct", receipts=receipts, now="2026-07-19 12:00:00") is None
    ingest(spark, land, out, ckpt, "acct", receipts=receipts, now="2026-07-20 01:00:00").awaitTermination()
    got = spark.read.parquet(receipts).orderBy("run_timestamp_utc").collect()
    assert [(r["mode"], r["candidate_count"], r["dedupe_count"]) for r in got] == [("outside_window_noop", 0, 0), ("read_only_ingestion", 1, 0)]


def test_embedded_items_win(spark):
    runs = spark.createDataFrame([(1, ["x"]), (2, []), (3, None)], "run_id long, sample_items array<string>")
    landed = spark.createDataFrame([(1, 0, "l1"), (2, 0, "l2"), (3, 0, "l3")], "run_id long, ord int, line string")
    assert sorted((r["run_id"], r["line"]) for r in landing.embedded_or_landed(runs, landed).collect()) == [(1, "x"), (2, "l2"), (3, "l3")]


def test_leads_stream(spark, tmp_path):
    from leadloom.streaming import leads_stream

    land, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    acme = {"name": "Acme HVAC", "city": "Austin", "phone": "512-555-0100"}
    (tmp_path / "in" / "a.json").write_text("\n".join([json.dumps(acme), json.dumps(acme | {"email": "a@b.c"}), "not json"]))
    leads_stream.ingest(spark, land, out, ckpt).awaitTermination()
    (tmp_path / "in" / "b.json").write_text(json.dumps(acme | {"hiring_intent": True}))
    leads_stream.ingest(spark, land, out, ckpt).awaitTermination()
    rows = leads_stream.latest(spark, out).collect()
    assert len(rows) == 1 and rows[0]["batch_id"] == 1 and rows[0]["email"] == "" and "hiring_intent" in rows[0]["score_reasons"]
