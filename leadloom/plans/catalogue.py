"""Named queries over the given tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import dates, hashing, text, web
from ..operators import budget, dedupe, finance, queue, registry, run_machine, run_state, runs, summary, upsert
from ..operators.store import Store, Table
from ..sources import landing, paged, sweeps, table_functions
from ..sources.folders import shared_folder
from ..streaming import finance_stream
from .models import MODELS, SIGNALS
from .twins import scored as d_scored
from .views import JOBS as JOB_VIEW
from .views import LEADS, NOW, duck, view
from .views import POSTS as POST_VIEW

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL of the twins: normalisation, keys, scores ---

_D_TEXT = "trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\\x00-\\x1f\\x7f]', ' ', 'g'), '[\\s\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{85}}]+', ' ', 'g'))"


def d_text(x: str) -> str:
    return _D_TEXT.format(x=x)


def d_domain(x: str) -> str:
    return f"regexp_replace(split_part(split_part(regexp_replace(lower({d_text(x)}), '^https?://', ''), '/', 1), ':', 1), '^www\\.', '')"


def d_phone(x: str) -> str:
    raw = f"regexp_replace({x}, '[^0-9+]', '', 'g')"
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN starts_with({raw}, '+') THEN {raw} WHEN length({digits}) = 11 AND starts_with({digits}, '1') THEN '+' || {digits} WHEN length({digits}) = 10 THEN '+1' || {digits} WHEN length({digits}) BETWEEN 8 AND 15 THEN '+' || {digits} ELSE {digits} END"


def d_group(*parts: str) -> str:
    return "left(sha1(concat_ws('|', " + ", ".join(f"nullif({p}, '')" for p in parts) + ")), 16)"


def d_hash32(x: str) -> str:
    wrapped = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"
    return f"(SELECT 'h' || lower(to_hex(CASE WHEN w >= 2147483648 THEN 4294967296 - w ELSE w END)) FROM (SELECT {wrapped} AS w))"


def d_ratio(part: str, total: str, digits: int) -> str:
    s = 10**digits
    return f"CASE WHEN {total} = 0 THEN 0.0::DOUBLE ELSE (({part}) * {2 * s} + {total})::BIGINT // (({total}) * 2)::BIGINT / {s}.0::DOUBLE END"


def d_leads(model: str) -> str:
    name, email = d_text("raw_name"), f"lower({d_text('raw_email')})"
    website = d_text("raw_website") if model == "simple" else d_domain("raw_website")
    phone = d_text("raw_phone") if model == "simple" else d_phone("raw_phone")
    return f"SELECT *, {name} AS business_name, {website} AS website, {phone} AS phone, {email} AS email FROM ({duck(LEADS)})"


def d_posts() -> str:
    # Signals are looked for in a post's first 5,000 characters, as the feature has it.
    signals = "list_filter([" + ", ".join(f"'{s}'" for s in SIGNALS) + "], lambda k: contains(lower(concat_ws(' ', job_title, left(body, 5000))), k))"
    return f"SELECT *, len({signals})::INT AS signal_count, array_to_string({signals}, '|') AS signals FROM ({duck(POST_VIEW)})"


_GROUPS = {
    "full": d_group("business_name", "coalesce(nullif(website, ''), nullif(phone, ''), email)", "coalesce(nullif(city, ''), context_city)"),
    "hvac": d_group("business_name", "coalesce(nullif(website, ''), nullif(phone, ''), email)", "coalesce(nullif(city, ''), context_city)"),
    "simple": "concat_ws('|', business_name, website, phone, email, city)",
    "jobs": d_group("lower(company_name)", "lower(job_title)", "source"),
    "posts": d_group("coalesce(nullif(post_id, ''), posting_url)", "company_name", "subreddit"),
}


def d_flagged(model: str, records: str, by: str = "") -> str:
    m = MODELS[model]
    scored = f"SELECT *, {_GROUPS[model]} AS g FROM ({d_scored(model, records)})"
    part = f"PARTITION BY {by + ', ' if by else ''}g"
    return f"SELECT *, row_number() OVER ({part} ORDER BY {m.score} DESC, ord) = 1 AS is_unique, min(ord) OVER ({part}) AS first_seen FROM ({scored})"


def _leads(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    return api.normalized_leads(view(spark, sf_dir, LEADS, "customer", "nation"), model)


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = view(spark, sf_dir, POST_VIEW, "documents").withColumn("matched_signals", text.matched_keywords(F.concat_ws(" ", "job_title", F.left("body", F.lit(5000))), SIGNALS))
    return posts.withColumn("signal_count", F.size("matched_signals"))


# --- scalar functions ---


@query(f"SELECT doc_id, {d_text('text')} AS normalized FROM documents")
def normalize_text_documents(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.normalize_text("text").alias("normalized"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(p_name || ' ' || p_type || ' #' || p_brand), '[^a-z0-9\\s.-]', '', 'g')), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugify_parts(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" "), "p_type", F.lit(" #"), "p_brand")).alias("slug"))


@query(f"SELECT page_id, {d_domain('url')} AS domain FROM pages")
def normalize_domain_pages(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.normalize_domain("url").alias("domain"))


_URL_D = "CASE page_id % 6 WHEN 0 THEN url || '?next=https://other.test/' WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN 'WWW.' || split_part(url, '://', 2) || '#a@b' WHEN 3 THEN regexp_replace(url, '^([a-z]+://[^/?#]+).*$', '\\1:8080') WHEN 4 THEN regexp_replace(url, '^([a-z]+://[^/?#]+).*$', '\\1?q=a/b') ELSE '  ' || upper(url) || chr(9) END"
_HOST_D = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({x}, ' ' || chr(9))), '^https?://', ''), '[/?#].*$', ''), '^.*@', ''), ':[0-9]*$', '')"


@query(f"SELECT page_id, regexp_replace({_HOST_D.format(x='raw')}, '^www[.]', '') AS domain, regexp_replace({_HOST_D.format(x='raw')}, '^www[.]', '') AS sql_domain FROM (SELECT page_id, {_URL_D} AS raw FROM pages)")
def normalize_domain_odd_urls(spark, sf_dir):
    """Query strings, user parts, fragments, ports, capitals; by the column function and by the SQL function."""
    hashing.register(spark)
    k, url, root = F.col("page_id") % 6, F.col("url"), F.regexp_replace("url", "^([a-z]+://[^/?#]+).*$", "$1")
    raw = F.when(k == 0, F.concat(url, F.lit("?next=https://other.test/"))).when(k == 1, F.replace(url, F.lit("://"), F.lit("://user:pw@"))).when(k == 2, F.concat(F.lit("WWW."), F.split_part(url, F.lit("://"), F.lit(2)), F.lit("#a@b")))
    raw = raw.when(k == 3, F.concat(root, F.lit(":8080"))).when(k == 4, F.concat(root, F.lit("?q=a/b"))).otherwise(F.concat(F.lit("  "), F.upper(url), F.lit("\t")))
    pages = _t(spark, sf_dir, "pages").withColumn("raw", raw)
    return pages.select("page_id", text.normalize_domain("raw").alias("domain"), F.expr("normalize_domain(raw)").alias("sql_domain"))


@query(f"SELECT id, {d_phone('raw_phone')} AS phone, lower({d_text('raw_email')}) AS email FROM ({duck(LEADS)})")
def normalize_phone_customers(spark, sf_dir):
    return view(spark, sf_dir, LEADS, "customer", "nation").select("id", text.normalize_phone("raw_phone").alias("phone"), text.normalize_email("raw_email").alias("email"))


@query(f"SELECT c_custkey, {d_group('c_name', 'c_mktsegment', 'CAST(c_nationkey AS VARCHAR)')} AS group_id, sha1(c_name) AS name_sha1 FROM customer")
def stable_group_ids(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", hashing.stable_group_id("c_name", "c_mktsegment", "c_nationkey").alias("group_id"), F.sha1(F.col("c_name").cast("binary")).alias("name_sha1"))


@query(f"SELECT s_suppkey, {d_hash32('x')} AS hash FROM (SELECT s_suppkey, s_name || '|' || CAST(s_nationkey AS VARCHAR) AS x FROM supplier)")
def hash32_suppliers(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    return s.select("s_suppkey", hashing.hash32(F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string"))).alias("hash"))


@query("SELECT sha1(text) AS payload_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def payload_hash_dedupe(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("payload_hash"))
    return docs.groupBy("payload_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[\\s\\x0b]+', ' ', 'g')) AS visible FROM pages")
def visible_text_pages(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", text.visible_text("html").alias("visible"))


@query("SELECT doc_id, w AS email FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE regexp_matches(w, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')")
def email_extract_valid(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("email"))
    return words.filter(text.is_email("email"))


@query("SELECT turn, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, conv_id FROM conversations")
def escape_conversations(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("turn", text.html_escape("text").alias("escaped"), "conv_id")


@query(f"SELECT ord, signal_count, signals FROM ({d_posts()})")
def keyword_signals(spark, sf_dir):
    return _posts(spark, sf_dir).select("ord", "signal_count", F.concat_ws("|", "matched_signals").alias("signals"))


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'the.*of|and') AS broad, regexp_matches(lower(text), 'zu|der|que') AS narrow FROM conversations")
def intent_regex_flags(spark, sf_dir):
    low = F.lower("text")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", low.rlike("the.*of|and").alias("broad"), low.rlike("zu|der|que").alias("narrow"))


_FIELDS = ["business_name", "website", "phone", "email", "city", "source_url"]


@query(f"SELECT id, ({' + '.join(f'CASE WHEN {c} <> {chr(39) * 2} THEN 1 ELSE 0 END' for c in _FIELDS)})::INT AS filled FROM ({d_leads('hvac')})")
def field_completeness(spark, sf_dir):
    return _leads(spark, sf_dir, "hvac").select("id", text.filled_count(*_FIELDS).alias("filled"))


_HVAC_D = "CASE WHEN regexp_matches(lower(d), '\\b(commercial|industrial|contractor)\\b') THEN 'commercial' WHEN regexp_matches(lower(d), '\\b(residential|home|household)\\b') THEN 'residential' ELSE 'both' END"


@query(f"SELECT c_custkey, {_HVAC_D} AS hvac_type, contains(lower(d), 'urgent') OR contains(lower(d), '24hr') AS emergency, array_to_string(list_transform(string_split(d, ','), lambda s: trim(s)), '|') AS services FROM (SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ', Home, urgent' WHEN c_custkey % 5 = 0 THEN ',Industrial , 24hr' ELSE '' END AS d FROM customer)")
def hvac_enrichment(spark, sf_dir):
    tail = F.when(F.col("c_custkey") % 3 == 0, ", Home, urgent").when(F.col("c_custkey") % 5 == 0, ",Industrial , 24hr").otherwise("")
    d = F.concat("c_mktsegment", tail)
    return _t(spark, sf_dir, "customer").select("c_custkey", text.hvac_type(d).alias("hvac_type"), text.emergency_service(d).alias("emergency"), F.concat_ws("|", text.service_list(d)).alias("services"))


# --- scores ---


def _score_query(model: str, records, sql_records: str, key: str = "ord"):
    m = MODELS[model]
    parts = [f"score_{c}" for c in m.weights]
    sql = f"SELECT {key}, {', '.join(parts)}, {m.score}, score_band, recommended_action, reasons FROM ({d_scored(model, sql_records)})"

    def run(spark, sf_dir):
        return api.score(records(spark, sf_dir), model).select(key, *parts, m.score, "score_band", "recommended_action", F.concat_ws("|", "score_reasons").alias("reasons"))

    run.__name__ = f"score_{model}"
    return query(sql)(run)


_score_query("full", lambda s, d: _leads(s, d, "full"), d_leads("full"))
_score_query("hvac", lambda s, d: _leads(s, d, "hvac"), d_leads("hvac"))
_score_query("jobs", lambda s, d: view(s, d, JOB_VIEW, "documents"), duck(JOB_VIEW))
_score_query("posts", _posts, d_posts())


@query(f"SELECT ord, lead_score, score_band, recommended_action FROM ({d_scored('simple', d_leads('simple'))})")
def score_simple(spark, sf_dir):
    return api.score(_leads(spark, sf_dir, "simple"), "simple").select("ord", "lead_score", "score_band", "recommended_action")


# --- duplicates, ranking, counts ---


def _process_queries(model: str, records, sql_records: str, by: tuple[str, ...] = ()):
    m = MODELS[model]
    flagged = d_flagged(model, sql_records, ", ".join(by))
    keys = "".join(f"{b}, " for b in by)
    tail = f" GROUP BY {', '.join(by)}" if by else ""
    signals = ", sum(signal_count)::BIGINT AS total_signals" if model == "posts" else ""
    counts = (
        f"SELECT {keys}count(*) AS total, count(*) FILTER (WHERE is_unique) AS unique_count, count(*) FILTER (WHERE score_band = 'high') AS high, count(*) FILTER (WHERE score_band = 'usable') AS usable, count(*) FILTER (WHERE score_band = 'low') AS low{signals}, "
        f"{d_ratio('count(*) - count(*) FILTER (WHERE is_unique)', 'count(*)', 3)} AS duplicate_rate, {d_ratio(f'sum({m.score})', 'count(*)', 1)} AS average_score FROM ({flagged}){tail}"
    )
    routing = (
        f"SELECT {keys}count(*) FILTER (WHERE is_unique AND {m.score} >= {m.high}) AS instant_alert, count(*) FILTER (WHERE is_unique AND {m.score} >= {m.nurture} AND {m.score} < {m.high}) AS nurture, count(*) FILTER (WHERE is_unique AND {m.score} < {m.nurture}) AS hold FROM ({flagged}){tail}"
    )

    def unique(spark, sf_dir):
        return api.process(records(spark, sf_dir), model, by).unique.select(*by, "ord", "first_seen", m.score)

    def count(spark, sf_dir):
        return api.process(records(spark, sf_dir), model, by).counts

    def route(spark, sf_dir):
        return api.process(records(spark, sf_dir), model, by).routing

    for name, f, sql in (("dedupe", unique, f"SELECT {keys}ord, first_seen, {m.score} FROM ({flagged}) WHERE is_unique"), ("counts", count, counts), ("routing", route, routing)):
        f.__name__ = f"{name}_{model}" + "_by_run" * bool(by)
        query(sql)(f)


_process_queries("hvac", lambda s, d: _leads(s, d, "hvac"), d_leads("hvac"))
_process_queries("hvac", lambda s, d: _leads(s, d, "hvac"), d_leads("hvac"), ("run_id",))
_process_queries("full", lambda s, d: _leads(s, d, "full"), d_leads("full"))
_process_queries("jobs", lambda s, d: view(s, d, JOB_VIEW, "documents"), duck(JOB_VIEW))
_process_queries("posts", _posts, d_posts())

_FLAGGED = d_flagged("hvac", d_leads("hvac"))


@query(f"SELECT ord, business_name, website, phone, email, city, lead_score, score_band, first_seen FROM ({_FLAGGED}) WHERE is_unique ORDER BY lead_score DESC, first_seen LIMIT 10")
def dedupe_ranked_top10(spark, sf_dir):
    return api.process(_leads(spark, sf_dir, "hvac")).top_items.select("ord", "business_name", "website", "phone", "email", "city", "lead_score", "score_band", "first_seen")


@query(f"SELECT ord, business_name, website, phone, email, city, lead_score, score_band, recommended_action, reasons, first_seen FROM ({_FLAGGED}) WHERE is_unique")
def dedupe_ranked(spark, sf_dir):
    unique = api.process(_leads(spark, sf_dir, "hvac")).unique
    return dedupe.ranked(unique, "lead_score").select("ord", "business_name", "website", "phone", "email", "city", "lead_score", "score_band", "recommended_action", F.concat_ws("|", "score_reasons").alias("reasons"), "first_seen")


@query(f"SELECT run_id, string_agg(ord || ':' || lead_score, '|' ORDER BY lead_score DESC, first_seen) AS top_items FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY lead_score DESC, first_seen) AS rk FROM ({d_flagged('hvac', d_leads('hvac'), 'run_id')}) WHERE is_unique) WHERE rk <= 3 GROUP BY run_id")
def run_summary_top3(spark, sf_dir):
    unique = api.process(_leads(spark, sf_dir, "hvac"), by=("run_id",)).unique
    best = summary.top(unique, ["run_id"], 3, "lead_score", ["ord", "lead_score"])
    return best.select("run_id", F.array_join(F.transform("top_items", lambda x: F.concat_ws(":", x["ord"].cast("string"), x["lead_score"].cast("string"))), "|").alias("top_items"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE is_unique) AS unique_count, max(lead_score) FILTER (WHERE is_unique) AS top_score, arg_max(recommended_action, lead_score) FILTER (WHERE is_unique) AS top_action FROM ({_FLAGGED})")
def batch_summary(spark, sf_dir):
    items = api.process(_leads(spark, sf_dir, "hvac")).items
    return summary.batch_summary(items)


@query(f"SELECT 25 AS runs, count(*) AS total_fetched, count(*) FILTER (WHERE is_unique) AS unique_count, count(*) FILTER (WHERE score_band = 'high') AS high FROM ({d_flagged('hvac', d_leads('hvac'), 'run_id')})".replace("25 AS runs", "count(DISTINCT run_id) AS runs"))
def totals_across_runs(spark, sf_dir):
    return summary.across_runs(api.process(_leads(spark, sf_dir, "hvac"), by=("run_id",)).counts)


@query(f"SELECT id, lead_score, row_number() OVER (ORDER BY lead_score DESC, id)::INT AS row_index, CASE WHEN lead_score >= 80 THEN 'high' WHEN lead_score >= 50 THEN 'usable' ELSE 'low' END AS label FROM (SELECT * FROM ({d_scored('hvac', d_leads('hvac'))}) WHERE run_id = 7 ORDER BY lead_score DESC, id LIMIT 100)")
def delivery_of_a_run(spark, sf_dir):
    """The whole entry point: the run is looked up, its leads joined to it."""
    runs_ = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") == 7, "processed").otherwise("queued").alias("status"), F.lit(None).cast("timestamp").alias("processed_at"))
    return api.delivery(runs_, api.score(_leads(spark, sf_dir, "hvac"), "hvac"), 7, 500).select("id", "lead_score", "row_index", "label")


@query(f"SELECT id, {d_hash32('x')} AS group_hash, {d_hash32('y')} AS canonical_entity_id FROM (SELECT id, concat_ws('|', business_name, website, phone, email, city) AS x, concat_ws('|', business_name, CASE WHEN website <> '' THEN website WHEN phone <> '' THEN phone ELSE email END, city) AS y FROM ({d_leads('simple')}))")
def simple_ids(spark, sf_dir):
    return api.with_groups(_leads(spark, sf_dir, "simple"), "simple").select("id", "group_hash", "canonical_entity_id")


# --- runs, queues, deliveries ---

_RUNS_D = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'queued' ELSE 'sample_delivered' END AS status, o_orderdate AS requested_at, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS processed_at FROM orders"


def _runs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "O", "queued").otherwise("sample_delivered")
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("requested_at"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate")).alias("processed_at"))


@query(f"SELECT * FROM ({_RUNS_D}) WHERE status = 'queued' ORDER BY requested_at, id LIMIT 25")
def queued_runs(spark, sf_dir):
    return queue.queued(_runs(spark, sf_dir))


@query(f"SELECT * FROM ({_RUNS_D}) WHERE status = 'processed' ORDER BY processed_at DESC NULLS FIRST, id DESC LIMIT 1")
def latest_processed_run(spark, sf_dir):
    return queue.resolve_run(_runs(spark, sf_dir))


@query(f"SELECT id, lead_score, row_number() OVER (ORDER BY lead_score DESC, id)::INT AS row_index, CASE WHEN lead_score >= 80 THEN 'high' WHEN lead_score >= 50 THEN 'usable' ELSE 'low' END AS label FROM (SELECT * FROM ({d_scored('hvac', d_leads('hvac'))}) WHERE run_id = 7 ORDER BY lead_score DESC, id LIMIT 50)")
def delivery_top50(spark, sf_dir):
    leads = api.score(_leads(spark, sf_dir, "hvac").filter("run_id = 7"), "hvac")
    return queue.delivery(leads).select("id", "lead_score", "row_index", "label")


_QUEUE_D = "SELECT event_id AS id, 'user' || user_id || '@example.com' AS email, (event_id % 5)::INT AS step, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'pending' END AS status, ts AS scheduled_for FROM events"
_OPT_D = "SELECT DISTINCT 'user' || c_custkey || '@example.com' AS email FROM customer WHERE c_custkey % 3 = 0"
_DUE_D = f"SELECT * FROM ({_QUEUE_D}) WHERE status = 'pending' AND scheduled_for <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY scheduled_for, id LIMIT 50"


def _queue(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"), (F.col("event_id") % 5).cast("int").alias("step"), F.when(F.col("event_id") % 9 == 0, "failed").otherwise("pending").alias("status"), F.col("ts").alias("scheduled_for"))


def _optouts(spark, sf_dir):
    return _t(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit(" User"), F.col("c_custkey").cast("string"), F.lit("@Example.com")).alias("email"))


@query(f"SELECT id, email, step, scheduled_for, CASE step WHEN 1 THEN 'reminder' WHEN 2 THEN 'proof' WHEN 3 THEN 'last_call' ELSE 'welcome' END AS template FROM ({_DUE_D}) WHERE email NOT IN ({_OPT_D})")
def due_queue_minus_optouts(spark, sf_dir):
    return api.due_messages(_queue(spark, sf_dir), _optouts(spark, sf_dir), dates.moment("2024-01-15 00:00:00"))[0].select("id", "email", "step", "scheduled_for", "template")


@query(f"SELECT id, email FROM ({_DUE_D}) WHERE email IN ({_OPT_D})")
def queue_optout_deletes(spark, sf_dir):
    return api.due_messages(_queue(spark, sf_dir), _optouts(spark, sf_dir), dates.moment("2024-01-15 00:00:00"))[1].select("id", "email")


@query(f"SELECT ord, email, lead_score, TIMESTAMP '{NOW}' + INTERVAL 1 MINUTE * (rn - 1) AS scheduled_for FROM (SELECT *, row_number() OVER (ORDER BY lead_score DESC, first_seen) AS rn FROM ({_FLAGGED}) WHERE is_unique AND lead_score >= 50 AND email <> '') WHERE rn <= 20")
def followup_stagger(spark, sf_dir):
    unique = api.process(_leads(spark, sf_dir, "hvac")).unique
    return queue.followups(unique, dates.moment(NOW)).select("ord", "email", "lead_score", "scheduled_for")


@query(f"SELECT id, CASE WHEN id % 4 = 1 THEN 'failed' ELSE status END AS status FROM ({_QUEUE_D}) WHERE id % 4 <> 0")
def queue_settled(spark, sf_dir):
    waiting = _queue(spark, sf_dir)
    results = waiting.filter("id % 4 < 2").select("id", (F.col("id") % 4 == 0).alias("ok"))
    return queue.settle(waiting, results).select("id", "status")


# --- finance ---

_CAND_D = (
    "SELECT 'balance.available.' || n AS entity_id, 'balance.available.' || n AS event_type, 'stripe_balance' AS signal_type, DATE '2024-01-31' AS event_date, 'balance' AS source FROM (SELECT DISTINCT lower(n_name) AS n FROM nation WHERE n_nationkey < 3) "
    "UNION ALL SELECT 'balance.pending.' || n, 'balance.pending.' || n, 'stripe_balance', DATE '2024-01-31', 'balance' FROM (SELECT DISTINCT lower(n_name) AS n FROM nation WHERE n_nationkey < 3) "
    "UNION ALL SELECT x, 'charge.' || x, 'stripe_charge', ts::DATE, 'charge' FROM (SELECT user_id || '_' || event_type AS x, ts FROM events WHERE event_id % 50 > 0) "
    "UNION ALL SELECT x, 'subscription.' || x, 'stripe_subscription', d::DATE, 'subscription' FROM (SELECT CAST(o_custkey AS VARCHAR) AS x, o_orderdate AS d FROM orders)"
)
_KEYED_D = f"SELECT *, 'finance_event:acct:' || event_type || ':' || CAST(event_date AS VARCHAR) AS dedupe_key, 'finance_signal:' || entity_id || ':' || signal_type AS signal_key FROM ({_CAND_D})"


def _candidates(spark, sf_dir):
    day = F.lit("2024-01-31").cast("date")
    money = F.collect_list(F.struct(F.lower("n_name").alias("currency")))
    balances = _t(spark, sf_dir, "nation").filter("n_nationkey < 3").agg(money.alias("available"), money.alias("pending"))
    charges = _t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 100 == 0, "").when(F.col("event_id") % 50 > 0, F.concat_ws("_", F.col("user_id").cast("string"), "event_type")).alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"))
    subs = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"))
    return finance.union_all([finance.balance_candidates(balances, day), finance.list_candidates(charges, "charge", "stripe_charge", day), finance.list_candidates(subs, "subscription", "stripe_subscription", day)])


@query(f"SELECT * REPLACE (CAST(event_date AS VARCHAR) AS event_date) FROM ({_KEYED_D})")
def finance_candidates_union(spark, sf_dir):
    return finance.keyed(_candidates(spark, sf_dir), "acct").withColumn("event_date", F.col("event_date").cast("string"))


@query(f"SELECT DISTINCT dedupe_key, signal_key, source, CAST(event_date AS VARCHAR) AS event_date FROM ({_KEYED_D}) WHERE day(event_date) <> 5")
def finance_new_signals(spark, sf_dir):
    rows = finance.keyed(_candidates(spark, sf_dir), "acct").withColumn("ord", F.col("entity_id"))
    seen = rows.filter(F.dayofmonth("event_date") == 5).select("dedupe_key").distinct()
    return finance.new_signals(rows, seen).select("dedupe_key", "signal_key", "source", F.col("event_date").cast("string").alias("event_date"))


@query(
    f"SELECT '2024-01-31T00:00:00.000Z' AS run_timestamp_utc, true AS window_open, count(*) AS candidate_count, count(*) - count(DISTINCT dedupe_key) AS dedupe_count, true AS pagination_exhausted, 'read_only_ingestion' AS mode, "
    f"'balance:1|balance_transactions:0|charges:' || count(*) FILTER (WHERE source = 'charge') || '|subscriptions:' || count(*) FILTER (WHERE source = 'subscription') AS sources FROM ({_KEYED_D})"
)
def finance_receipt(spark, sf_dir):
    out = api.ingest_finance(_candidates(spark, sf_dir).withColumn("ord", F.col("entity_id")), None, True, "acct", dates.moment(NOW))[1]
    entries = F.sort_array(F.transform(F.map_entries("sources"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return out.withColumn("sources", F.array_join(entries, "|"))


@query(f"SELECT source, count(*) AS candidates FROM ({_CAND_D}) GROUP BY source")
def finance_source_counts(spark, sf_dir):
    return _candidates(spark, sf_dir).groupBy("source").agg(F.count("*").alias("candidates"))


@query(f"SELECT signal_key, CAST(min(event_date) AS VARCHAR) AS first_date, CAST(max(event_date) AS VARCHAR) AS last_date FROM ({_KEYED_D}) GROUP BY signal_key")
def finance_stored_signals(spark, sf_dir):
    rows = finance.keyed(_candidates(spark, sf_dir), "acct").withColumn("updated_at", F.col("event_date")).select("signal_key", "dedupe_key", "event_date", "updated_at")
    # Days arrive in order, so what is stored first is the earliest.
    early = F.col("event_date") < "1997-01-01"
    out = finance.stored(rows.filter(early), rows.filter(~early))
    return out.select("signal_key", F.col("event_date").cast("string").alias("first_date"), F.col("updated_at").cast("string").alias("last_date"))


@query("SELECT event_id, hour(ts) < 6 AS open, CAST(ts::DATE AS VARCHAR) AS day FROM events")
def overnight_window_events(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", dates.overnight(F.col("ts")).alias("open"), F.to_date("ts").cast("string").alias("day"))


_AGE_D = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9::DOUBLE"


@query(f"SELECT CASE WHEN {_AGE_D} <= 24 THEN 'fresh_24h' WHEN {_AGE_D} <= 72 THEN 'fresh_72h' WHEN {_AGE_D} <= 168 THEN 'fresh_week' ELSE 'old' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def freshness_buckets(spark, sf_dir):
    age = dates.age_hours(F.col("ts").cast("timestamp"), dates.moment(NOW))
    bucket = F.when(age <= 24, "fresh_24h").when(age <= 72, "fresh_72h").when(age <= 168, "fresh_week").otherwise("old")
    return _t(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


# --- upserts, intake, subscribers ---


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def upsert_latest_wins(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    cut = 5000
    return upsert.latest_wins(e.filter(F.col("event_id") < cut), e.filter(F.col("event_id") >= cut), ["user_id", "event_type"], "event_id")


@query("SELECT min(event_id) AS first_id, user_id, event_type, count(*) - 1 AS duplicate_count, arg_min(ts, event_id) + INTERVAL 1 DAY AS sla_due_at FROM events GROUP BY user_id, event_type")
def intake_insert_or_bump(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("k"))
    return upsert.insert_or_bump(e, "k", "event_id", at="ts").select(F.col("event_id").alias("first_id"), "user_id", "event_type", "duplicate_count", "sla_due_at")


@query("SELECT 'sha256:' || sha256('[\"' || lower(c_name) || '\",\"' || lower(c_mktsegment) || '\"]') AS dedupe_key, c_custkey FROM customer")
def intake_keys(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(hashing.intake_key("c_name", "c_mktsegment").alias("dedupe_key"), "c_custkey")


_STATE_D = "CASE event_type WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'past_due' WHEN 'signup' THEN 'trialing' WHEN 'click' THEN 'cancelled' END"


@query(f"SELECT lower(c.c_name) AS email, user_id::VARCHAR AS customer_id, status, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT *, {_STATE_D} AS status FROM events WHERE event_type <> 'view')) e JOIN customer c ON c.c_custkey = e.user_id WHERE rn = 1")
def subscriber_status_sync(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "checkout.session.completed").when(F.col("event_type") == "click", "customer.subscription.deleted").when(F.col("event_type") == "view", "invoice.paid").otherwise("customer.subscription.updated")
    status = F.when(F.col("event_type") == "error", "unpaid").when(F.col("event_type") == "signup", "trialing")
    events = _t(spark, sf_dir, "events").select("event_id", "ts", kind.alias("type"), F.col("user_id").cast("string").alias("customer_id"), F.lit("").alias("email"), status.alias("status"), F.lit("starter").alias("tier"), F.lit("subscription").alias("mode"))
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_email"))
    none = spark.createDataFrame([], "email string, customer_id string, status string, ts timestamp").withColumn("ts", F.col("ts").cast(dict(events.dtypes)["ts"]))
    return api.sync_subscribers(none, events, customers)


@query(f"SELECT id, email, CASE WHEN email IN (SELECT 'info' || c_custkey || '@example.com' FROM customer WHERE c_custkey < 100) THEN 'active' ELSE 'none' END AS subscription_status FROM ({d_leads('hvac')})")
def tag_leads_by_email(spark, sf_dir):
    subs = _t(spark, sf_dir, "customer").filter("c_custkey < 100").select(F.concat(F.lit("info"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"), F.lit("active").alias("status"))
    return upsert.tag_by_email(_leads(spark, sf_dir, "hvac").select("id", "email"), subs)


@query("SELECT id, status FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'sample_delivered' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 0)")
def patch_and_delete(spark, sf_dir):
    runs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return upsert.without(upsert.patch(runs, runs.filter("id % 7 = 0"), {"status": "sample_delivered"}), runs.filter("id % 5 = 0"))


# --- keyed tables and commits ---


def _store(spark: SparkSession) -> Store:
    return Store(spark, shared_folder(spark, "store"))


def _in_thirds(df: DataFrame, number: str) -> tuple[DataFrame, Column]:
    """The rows, and which of three batches (0 to 2) each is in, by the order of `number`."""
    return df, F.floor(F.col(number) * 3 / (df.agg(F.max(number)).first()[0] + 1))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def upsert_keyed_table(spark, sf_dir):
    """Events in three batches, in order, each merged into the buckets of its own keys; the last batch comes twice."""
    store, table = _store(spark), Table("events", ("user_id", "event_type"), 16)
    e, third = _in_thirds(_t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), "event_id")
    for n in (0, 1, 2, 2):
        upsert.upsert_into(store, table, e.filter(third == n), "event_id", ("events", n))
    return store.read("events")


@query("SELECT min(event_id) AS first_id, user_id, event_type, count(*) - 1 AS duplicate_count, arg_min(ts, event_id) + INTERVAL 1 DAY AS sla_due_at FROM events GROUP BY user_id, event_type")
def intake_keyed_table(spark, sf_dir):
    """Requests in three batches, in order: the first of a key stays, later ones are counted."""
    store, table = _store(spark), Table("requests", ("k",), 16)
    e, third = _in_thirds(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("k")), "event_id")
    for n in range(3):
        upsert.bump_into(store, table, e.filter(third == n), "event_id", at="ts", batch=("requests", n))
    return store.read("requests").select(F.col("event_id").alias("first_id"), "user_id", "event_type", "duplicate_count", "sla_due_at")


@query(f"SELECT 'claim' AS kind, dedupe_key AS k, CAST(min(event_date) AS VARCHAR) AS first_date FROM ({_KEYED_D}) GROUP BY dedupe_key UNION ALL SELECT 'signal', signal_key, CAST(min(event_date) AS VARCHAR) FROM ({_KEYED_D}) GROUP BY signal_key")
def finance_atomic_claims(spark, sf_dir):
    """Candidates in two runs, by date, each one commit of claims, signals and receipt."""
    store, rows = _store(spark), _candidates(spark, sf_dir).withColumn("ord", F.col("entity_id"))
    early = F.col("event_date") < "1997-01-01"
    for n, part in enumerate((rows.filter(early), rows.filter(~early))):
        finance.persist(store, part, "acct", dates.moment(f"2024-01-3{n} 01:00:00"), batch=("finance", n))
    pick = lambda table, kind, key: store.read(table).select(F.lit(kind).alias("kind"), F.col(key).alias("k"), F.col("event_date").cast("string").alias("first_date"))
    return pick("finance_event_dedupe", "claim", "dedupe_key").unionByName(pick("finance_signals", "signal", "signal_key"))


@query(f"""SELECT run_id, count(*) AS total, count(*) FILTER (WHERE is_unique) AS unique_count, count(*) FILTER (WHERE score_band = 'high') AS high, count(*) FILTER (WHERE score_band = 'usable') AS usable, count(*) FILTER (WHERE score_band = 'low') AS low,
 {d_ratio('(count(*) - count(*) FILTER (WHERE is_unique))', 'count(*)', 3)} AS duplicate_rate, {d_ratio('sum(lead_score)', 'count(*)', 1)} AS average_score, count(*) FILTER (WHERE is_unique AND lead_score >= 80) AS instant_alert, count(*) FILTER (WHERE is_unique AND lead_score >= 50 AND lead_score < 80) AS nurture, count(*) FILTER (WHERE is_unique AND lead_score < 50) AS hold,
 string_agg(ord || ':' || lead_score, '|' ORDER BY lead_score DESC, first_seen) FILTER (WHERE is_unique AND rk <= 3) AS top_items FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN is_unique THEN lead_score ELSE -1 END DESC, first_seen) AS rk FROM ({d_flagged('hvac', d_leads('hvac'), 'run_id')})) GROUP BY run_id""")
def run_summary_incremental(spark, sf_dir):
    """Leads in three batches; each adds to the summaries of its runs."""
    store, state = _store(spark), run_state.RunState(buckets=8)
    scored = api.with_groups(api.score(_leads(spark, sf_dir, "hvac"), "hvac"), "hvac")
    for n in range(3):
        run_state.add(store, scored.filter(F.pmod(F.xxhash64("ord"), F.lit(3)) == n), state, ("leads", n))
    items = F.array_join(F.transform("top_items", lambda x: F.concat_ws(":", x["ord"].cast("string"), x["lead_score"].cast("string"))), "|")
    return run_state.summaries(store, state).drop("total_signals").withColumn("top_items", items)


_MACHINE = run_machine.TRANSITIONS
_STEPS_D = {"view": "queued", "error": "failed", "click": "processing", "purchase": "processed", "signup": "sample_delivered"}
_STEP_D = "CASE event_type " + " ".join(f"WHEN '{e}' THEN {list(_MACHINE).index(to)}" for e, to in _STEPS_D.items()) + " ELSE -1 END"
_MAY_D = "(" + " OR ".join(f"(s % 100 = {a} AND x = {list(_MACHINE).index(b)})" for a, (_, bs) in enumerate(_MACHINE.items()) for b in bs) + ")"


@query(f"SELECT run_id, ['', {', '.join(repr(m) for m in list(_MACHINE)[1:])}][(r % 100 + 1)::INT] AS state, (r // 100)::BIGINT AS accepted, n - r // 100 AS refused FROM (SELECT user_id AS run_id, count(*) AS n, list_reduce(list({_STEP_D}::BIGINT ORDER BY ts, event_id), lambda s, x: CASE WHEN {_MAY_D} THEN s - s % 100 + x + 100 ELSE s END, 0::BIGINT) AS r FROM events GROUP BY user_id)")
def run_states(spark, sf_dir):
    """Events as steps of a run per user, in order; steps that a run's state doesn't allow are refused."""
    status = F.element_at(F.create_map(*[F.lit(x) for kv in _STEPS_D.items() for x in kv]), F.col("event_type"))
    steps = _t(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("id"), status.alias("status"))
    return run_machine.last_states(run_machine.fold(steps, block=64))


# --- budgets, sweeps, registry ---

_SCEN_D = "SELECT o_orderkey AS id, CAST(o_orderkey % 40 AS DOUBLE) / 4 AS budget_cap, CAST(o_orderkey % 90 AS DOUBLE) / 16 AS est_run_cost, 0.25::DOUBLE AS overhead_pct, CAST(o_orderkey % 30 AS DOUBLE) / 2 AS monthly_usage, CAST(o_orderkey % 3 AS DOUBLE) * 8 AS plan_limit FROM orders"
_GUARD_D = "SELECT *, least(greatest(0.0::DOUBLE, CASE WHEN plan_limit > 0 THEN plan_limit ELSE budget_cap END - monthly_usage), budget_cap) AS r, budget_cap * (1.0::DOUBLE - overhead_pct) AS p, est_run_cost * (1.0::DOUBLE + overhead_pct) AS e FROM (" + _SCEN_D + ")"


def _money(x: str) -> str:
    """Four decimal places, halves up."""
    return f"printf('%.4f', floor({x} * 10000 + 0.5) / 10000)"


def _scenarios(spark, sf_dir):
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(k.alias("id"), ((k % 40).cast("double") / 4).alias("budget_cap"), ((k % 90).cast("double") / 16).alias("est_run_cost"), F.lit(0.25).alias("overhead_pct"), ((k % 30).cast("double") / 2).alias("monthly_usage"), ((k % 3).cast("double") * 8).alias("plan_limit"))


@query(f"SELECT id, e <= p AND e <= r AS allowed, CASE WHEN e > p THEN 'capped' WHEN e > r THEN 'over_budget' ELSE 'within_budget' END AS state, CASE WHEN e > p OR e > r THEN r ELSE r - e END AS remaining, CASE WHEN e > p THEN 'run_cost_exceeds_safe_budget:' || {_money('e')} || '>' || {_money('p')} WHEN e > r THEN 'insufficient_remaining:' || {_money('e')} || '>' || {_money('r')} ELSE '' END AS reason FROM ({_GUARD_D})")
def budget_guard_scenarios(spark, sf_dir):
    return budget.check(_scenarios(spark, sf_dir)).select("id", "allowed", "state", "remaining", "reason")


@query(f"SELECT id, state, r FROM (SELECT id, CASE WHEN e > p THEN 'capped' WHEN e > r THEN 'over_budget' ELSE 'within_budget' END AS state, p - monthly_usage - e AS r FROM ({_GUARD_D}))")
def budget_simulation(spark, sf_dir):
    return budget.simulate(_scenarios(spark, sf_dir)).select("id", "state", F.col("remaining").alias("r"))


_SWEEP_D = "SELECT ((p_partkey - 1) * 2 + s)::INT AS ord, p_name AS keyword, CASE s WHEN 0 THEN 'indeed' ELSE 'linkedin' END AS source, CASE s WHEN 0 THEN 0.59::DOUBLE ELSE 1.50::DOUBLE END AS est_cost FROM part, range(0, 2) b(s)"


def _keywords(spark, sf_dir):
    """Names of parts as search terms."""
    return _t(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("keyword"))


@query(f"""SELECT *, CASE source WHEN 'indeed' THEN '{{"search":"' || keyword || '","maxResults":150}}' ELSE '{{"query":"' || keyword || '","maxItems":100}}' END AS actor_input FROM ({_SWEEP_D})""")
def sweep_configs(spark, sf_dir):
    return sweeps.job_sweep(spark, _keywords(spark, sf_dir))


@query("""SELECT id, search_string, '{"searchString":"' || search_string || '","maxCrawledPlaces":50,"proxyConfig":{"useApifyProxy":true},"onlyWithWebsite":false,"includeReviews":true,"includeReviewsImages":false,"sortBy":"relevance"}' AS actor_input
 FROM (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'Roofing' ELSE 'HVAC' END || ' in ' || CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'Austin' END || ', TX' AS search_string FROM nation)""")
def place_search_inputs(spark, sf_dir):
    k = F.col("n_nationkey")
    places = _t(spark, sf_dir, "nation").select(k.alias("id"), F.when(k % 2 == 0, "Roofing").alias("niche"), F.when(k % 3 == 0, F.col("n_name")).alias("city"), F.lit(None).cast("string").alias("state"))
    return sweeps.place_search(places).select("id", "search_string", "actor_input")


@query(f"SELECT count(*) AS runs, round(sum(est_cost), 2) AS total_cost FROM ({_SWEEP_D})")
def sweep_cost(spark, sf_dir):
    return sweeps.cost(sweeps.job_sweep(spark, _keywords(spark, sf_dir)))


@query("""SELECT *, '{"subreddits":["' || subreddit || '"],"sort":"new","maxItems":100,"maxPostCount":100}' AS actor_input FROM (SELECT s_suppkey::INT AS ord, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS subreddit, 'r/' || lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS label, 0.5::DOUBLE AS est_cost FROM supplier)""")
def forum_sweep(spark, sf_dir):
    names = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("ord"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")).alias("subreddit"))
    return sweeps.forum_sweep(spark, names)


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE doc_id % 4 > 0) AS succeeded, count(*) FILTER (WHERE doc_id % 4 = 0) AS failed FROM documents GROUP BY source")
def trigger_outcomes(spark, sf_dir):
    return summary.outcomes(_t(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 4 > 0).alias("ok")))


@query("SELECT CASE WHEN k <> '' THEN 'key:' || k WHEN u <> '' THEN 'url:' || u ELSE 'esg:' || left(sha1(lower(e)), 16) END AS registry_key, count(*) - 1 AS merged_count, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes, max(score) AS score FROM (SELECT CASE WHEN user_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS k, CASE WHEN user_id % 3 = 1 THEN 'http://x/' || user_id ELSE '' END AS u, event_type AS e, 'lane' || (event_id % 3) AS lane, value AS score FROM events) GROUP BY 1")
def registry_merge(spark, sf_dir):
    u = F.col("user_id")
    rows = _t(spark, sf_dir, "events").select(F.when(u % 3 == 0, u.cast("string")).alias("canonical_key"), F.when(u % 3 == 1, F.concat(F.lit("http://x/"), u.cast("string"))).alias("url"), F.col("event_type").alias("entity"), F.lit("").alias("geo"), F.lit("").alias("signal"), F.col("ts").alias("seen_at"), F.concat(F.lit("lane"), (F.col("event_id") % 3).cast("string")).alias("lane"), F.col("value").alias("score"))
    return registry.merged(rows).select("registry_key", "merged_count", F.concat_ws(",", "source_lanes").alias("lanes"), "score")


_FACTS_D = "SELECT CASE WHEN event_id % 3 = 0 THEN 'key:k' || (user_id % 40) END AS k1, CASE WHEN event_id % 4 < 2 THEN 'url:http://x/' || (user_id % 60) END AS k2, CASE WHEN event_id % 5 > 0 THEN 'esg:' || left(sha1('shop' || (user_id % 500 + event_id % 2 * 500) || '||'), 16) END AS k3, 'lane' || (event_id % 3) AS lane, ts, value FROM events WHERE user_id % 2 = 0 OR event_id % 4 > 0"


@query(
    f"WITH RECURSIVE f AS (SELECT row_number() OVER () AS r, list_filter([k1, k2, k3], lambda x: x IS NOT NULL) AS ks, lane, ts, value FROM ({_FACTS_D})), e AS (SELECT DISTINCT list_sort(ks)[1] AS a, unnest(ks) AS b FROM f WHERE len(ks) > 0), "
    "s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a, a AS b FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON reach.b = s.a), label AS (SELECT a AS k, min(b) AS registry_key FROM reach GROUP BY a) "
    "SELECT registry_key, count(*) AS merged_count, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes, max(value) AS score, min(ts) AS first_seen_at, max(ts) AS last_seen_at, coalesce(max(value) >= 50, false) AS file_worthy FROM f JOIN label ON label.k = ks[1] GROUP BY registry_key"
)
def registry_identity(spark, sf_dir):
    """Rows that share a canonical key, a URL or an entity, directly or through others."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = _t(spark, sf_dir, "events").filter("user_id % 2 = 0 OR event_id % 4 > 0").select(
        F.when(e % 3 == 0, F.concat(F.lit("k"), (u % 40).cast("string"))).alias("canonical_key"), F.when(e % 4 < 2, F.concat(F.lit("http://X/"), (u % 60).cast("string"))).alias("url"),
        F.when(e % 5 > 0, F.concat(F.lit("Shop"), (u % 500 + e % 2 * 500).cast("string"))).alias("entity"), F.lit("").alias("geo"), F.lit(None).cast("string").alias("signal"), F.col("ts").alias("seen_at"), F.concat(F.lit("lane"), (e % 3).cast("string")).alias("lane"), F.col("value").alias("score"),
    )
    out = registry.resolved(rows)
    return out.select("registry_key", "merged_count", F.concat_ws(",", "source_lanes").alias("lanes"), "score", "first_seen_at", "last_seen_at", "file_worthy")


# --- boundaries and storage ---


_PADS_D = ["".join(f"\\x{k ^ b:02X}" for k in b"secret".ljust(64, b"\0")) for b in (0x36, 0x5C)]


@query(f"SELECT event_id, signature, event_id % 3 > 0 AS valid FROM (SELECT event_id, sha256('{_PADS_D[1]}'::BLOB || unhex(sha256('{_PADS_D[0]}'::BLOB || encode(event_id || '.' || props)))) AS signature FROM events)")
def signed_events(spark, sf_dir):
    """The HMAC of each event, and whether a header with it (or with another event's) is valid."""
    e = _t(spark, sf_dir, "events").withColumn("t", F.col("event_id").cast("string"))
    e = e.withColumn("signature", web.hmac_sha256("secret", F.concat("t", F.lit("."), "props")))
    given = F.when(F.col("event_id") % 3 > 0, F.col("signature")).otherwise(F.reverse("signature"))
    header = F.concat(F.lit("v0=x,t="), "t", F.lit(",v1="), given)
    return e.withColumn("h", header).select("event_id", "signature", web.signature_valid("secret", F.col("h"), F.col("props")).alias("valid"))


@query("SELECT user_id, 'k' || event_type AS dedupe_key, min(event_id)::VARCHAR AS entity_id, count(*) AS input_rows FROM events WHERE event_type <> 'view' GROUP BY user_id, event_type")
def finance_table_function(spark, sf_dir):
    """The SQL table function over each user's events as one request; keys of views are claimed."""
    spark.createDataFrame([("kview",)], "dedupe_key string").createOrReplaceTempView("finance_event_dedupe")
    spark.createDataFrame([], "dedupe_key string, receipt_id string, status string, sla_due_at timestamp").createOrReplaceTempView("sample_intake_requests")
    table_functions.register(spark)
    signal = F.struct("event_id", F.concat(F.lit("k"), "event_type").alias("dedupe_key"), F.col("event_id").cast("string").alias("entity_id"))
    given = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.sort_array(F.collect_list(signal))).alias("signal_rows"))
    return spark.sql("SELECT user_id, f.dedupe_key, f.entity_id, f.input_rows FROM {given} AS g, LATERAL new_finance_signals(g.signal_rows) AS f", given=given)


@query("SELECT page_id, url LIKE '%example%' AS allowed FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://www.shop.example.com/x' WHEN page_id % 4 = 1 THEN '' ELSE 'https://other.test/example' END AS url FROM pages) WHERE url LIKE 'https://www%' UNION ALL SELECT page_id, page_id % 4 = 1 FROM pages WHERE page_id % 4 > 0")
def origin_allow_list(spark, sf_dir):
    k = F.col("page_id") % 4
    url = F.when(k == 0, "https://www.shop.example.com/x").when(k == 1, "").otherwise("https://other.test/example")
    return _t(spark, sf_dir, "pages").select("page_id", web.origin_allowed(url, ["shop.example.com"]).alias("allowed"))


@query(f"SELECT id, concat_ws('|', CASE WHEN website = '' THEN 'website' END, CASE WHEN email = '' THEN 'email' END) AS missing FROM ({d_leads('hvac')}) WHERE website = '' OR email = ''")
def required_fields_quarantine(spark, sf_dir):
    return web.split_required(_leads(spark, sf_dir, "hvac"), "website", "email")[1].select("id", F.concat_ws("|", "missing").alias("missing"))


@query(f"SELECT count(*) FILTER (WHERE lead_score >= 80) AS high, count(*) FILTER (WHERE lead_score >= 50 AND lead_score < 80) AS usable, count(*) FILTER (WHERE lead_score < 50) AS low, count(*) AS delivered FROM (SELECT * FROM ({d_scored('hvac', d_leads('hvac'))}) ORDER BY lead_score DESC, id LIMIT 100)")
def delivery_stats(spark, sf_dir):
    return runs.delivery_stats(queue.delivery(api.score(_leads(spark, sf_dir, "hvac"), "hvac"), 500))


@query("SELECT sha1(text) AS payload_hash, max(doc_id) AS run_id FROM documents GROUP BY 1")
def raw_upsert(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.col("text").alias("payload"))
    return runs.raw_rows(docs).select("payload_hash", "run_id")


@query(f"SELECT run_id, g AS canonical_entity_id, lead_score FROM ({d_flagged('hvac', d_leads('hvac'), 'run_id')}) WHERE is_unique")
def lead_upsert(spark, sf_dir):
    unique = api.process(_leads(spark, sf_dir, "hvac"), by=("run_id",)).unique.select("run_id", "canonical_entity_id", "lead_score")
    return runs.lead_rows(unique)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30) THEN 'failed' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'processed' END AS status FROM orders")
def stuck_runs_fail(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("processed").alias("status"))
    return runs.failed_without_items(orders, _t(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("run_id")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def cascade_children(spark, sf_dir):
    return runs.cascade(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), _t(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id")), "l_orderkey")


@query(f"SELECT id, CASE WHEN e <= p AND e <= r THEN 'queued' ELSE 'capped' END AS status FROM ({_GUARD_D})")
def run_record_status(spark, sf_dir):
    return runs.run_records(budget.check(_scenarios(spark, sf_dir)), dates.moment(NOW)).select("id", "status")


@query("SELECT o_orderkey AS id, o_totalprice AS est_cost, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice + 1 END AS actual_cost, CASE WHEN o_orderkey % 3 > 0 THEN (o_totalprice + 1) - o_totalprice ELSE 0 END AS difference FROM orders")
def spend_log(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("est_cost"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") + 1).alias("actual_cost"))
    return runs.spend_log(o)


@query("SELECT DISTINCT 'user' || (c_custkey % 700) || '@example.com' AS email, 'page' AS source FROM customer")
def optouts_upsert(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.concat(F.lit(" User"), (F.col("c_custkey") % 700).cast("string"), F.lit("@Example.com ")).alias("email"), F.lit("page").alias("source"), F.col("c_custkey").alias("ord"))
    old = rows.filter("ord % 3 = 0").withColumn("email", F.lower(F.btrim("email"))).dropDuplicates(["email"])
    return api.upsert_optouts(old, rows).select("email", "source")


@query("SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN o_orderstatus ELSE 'processed' END AS status, coalesce(n, 0) AS lead_count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_orderkey = o_orderkey")
def run_summary_update(spark, sf_dir):
    runs_ = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    done = _t(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("id")).agg(F.lit("processed").alias("status"), F.count("*").alias("lead_count"))
    return queue.update_runs(runs_, done).withColumn("lead_count", F.coalesce("lead_count", F.lit(0)))


@query("SELECT c_custkey AS id, CASE WHEN known AND run_id % 2 = 0 THEN 'Roofing' ELSE 'HVAC' END AS context_niche, CASE WHEN known AND run_id % 3 = 0 THEN n_name ELSE 'Austin' END AS context_city, CASE WHEN known AND run_id % 5 = 0 THEN 'csv' ELSE 'apify' END AS context_source, CASE WHEN known THEN '2024-01-' || (10 + run_id % 20) END AS context_collected_at FROM (SELECT *, coalesce(run_id % 4 > 0, false) AS known FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS run_id FROM customer) LEFT JOIN nation ON run_id = n_nationkey)")
def run_context(spark, sf_dir):
    """Every item, whether its run is known, unknown or null."""
    k = F.col("n_nationkey")
    runs_ = _t(spark, sf_dir, "nation").filter(k % 4 > 0).select(k.alias("id"), F.when(k % 2 == 0, "Roofing").alias("niche"), F.when(k % 3 == 0, F.col("n_name")).alias("city"), F.when(k % 5 == 0, "csv").otherwise("").alias("source"), F.concat(F.lit("2024-01-"), (10 + k % 20).cast("string")).alias("requested_at"))
    items = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_nationkey")).alias("run_id"))
    return landing.with_run(items, runs_).drop("run_id")


# --- landed JSON ---


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'p' || conv_id ELSE '' END AS entry FROM conversations")
def landed_pages(spark, sf_dir):
    entry = F.struct(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("p"), F.col("conv_id").cast("string"))).otherwise("").alias("id"), "turn")
    landed = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("data")).withColumn("has_more", F.lit(False))
    return landing.pages(landed, has_more="has_more").select("conv_id", "entry.turn", F.col("entry.id").alias("entry"))


def _land_pages(spark, sf_dir) -> str:
    """Conversations as list pages of 400 entries at most, one file each; a page starts after the last entry of the one before."""
    per, folder = 400, shared_folder(spark, "pages")
    turns = _t(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    entry = F.struct("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), "turns", "chars")
    pages = rows.withColumn("page", F.floor(F.col("conv_id") / per)).groupBy("page").agg(F.sort_array(F.collect_list(entry)).alias("data"))
    last = F.element_at("data", -1)["id"]
    ends = pages.select((F.col("page") + 1).alias("page"), last.alias("starting_after"))
    follow = pages.select((F.col("page") - 1).alias("page"), F.lit(True).alias("has_more"))
    value = F.to_json(F.struct("data", F.coalesce("has_more", F.lit(False)).alias("has_more"), "starting_after"))
    landed = pages.join(ends, "page", "left").join(follow, "page", "left").select(F.lpad(F.col("page").cast("string"), 9, "0").alias("page"), value.alias("value"))
    landed.write.partitionBy("page").text(folder)
    return folder


@query("SELECT (conv_id // 400)::BIGINT AS page, (row_number() OVER (PARTITION BY conv_id // 400 ORDER BY conv_id) - 1)::BIGINT AS place, 'c' || conv_id AS id, count(*)::BIGINT AS turns, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM conversations GROUP BY conv_id")
def paged_list_source(spark, sf_dir):
    paged.register(spark)
    rows = spark.read.format(paged.NAME).load(_land_pages(spark, sf_dir))
    item = F.parse_json("entry")
    return rows.select("page", "place", "id", F.variant_get(item, "$.turns", "long").alias("turns"), F.variant_get(item, "$.chars", "long").alias("chars"))


@query("SELECT user_id || '_' || event_type AS id, CAST(ts::DATE AS VARCHAR) AS day, count(*) - 1 AS repeats FROM events GROUP BY ALL")
def finance_stream_repeats(spark, sf_dir):
    """Events landed as files, read as a stream with a value per key: each new key once, and how often it came again."""
    folder = shared_folder(spark, "finance")
    charge = F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("id")
    events = _t(spark, sf_dir, "events").select(charge, F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"))
    events.repartition(events.count() // 500_000 + 2).write.json(f"{folder}/in")  # short rows: files of so many
    finance_stream.ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", "acct", repeats=f"{folder}/repeats").awaitTermination()
    return finance_stream.counted(spark, f"{folder}/out", f"{folder}/repeats").select(F.col("entity_id").alias("id"), F.col("event_date").cast("string").alias("day"), "repeats")


@query(f"SELECT id, business_name, CASE WHEN id % 2 = 0 THEN 'Roofing' ELSE 'HVAC' END AS niche, CASE WHEN id % 5 = 0 THEN 'Waco' ELSE 'Austin' END AS city, 'TX' AS state, phone, CASE WHEN id % 3 = 0 THEN 'residential' ELSE 'both' END AS hvac_type, id % 4 = 0 AS emergency_service, CASE WHEN id % 7 > 0 THEN CAST(id % 7 AS DOUBLE) WHEN id % 2 = 0 THEN 0 END AS rating FROM ({d_leads('hvac')})")
def landed_places(spark, sf_dir):
    i = F.col("id")
    rating = F.when(i % 7 > 0, F.concat(F.lit(', "rating": "'), (i % 7).cast("string"), F.lit('"'))).when(i % 2 == 0, ', "rating": null').otherwise("")
    raw = F.to_json(F.struct(F.col("raw_name").alias("company_name"), F.col("raw_phone").alias("telephone"), F.when(i % 2 == 0, "Roofing").otherwise("").alias("category"), F.when(i % 5 == 0, "Waco").alias("location"), F.when(i % 3 == 0, "residential").alias("hvac_type"), F.when(i % 4 == 0, "yes").otherwise("").alias("emergency_service")))
    item = F.concat(F.lit('{"raw": '), F.regexp_replace(raw, r"\}$", ""), rating, F.lit("}}"))
    items = view(spark, sf_dir, LEADS, "customer", "nation").select("id", F.parse_json(item).alias("item"))
    return landing.place_records(items).select("id", "business_name", "niche", "city", "state", "phone", "hvac_type", "emergency_service", "rating")


@query("SELECT doc_id, 'Job ' || doc_id AS job_title, CASE WHEN doc_id % 2 = 0 THEN 'B' || doc_id ELSE 'A' END AS company_name, 'https://x.org/' || doc_id AS posting_url, left(trim(coalesce(text, ''), ' '), 2000) AS raw_snippet FROM documents")
def landed_job_posts(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    item = F.struct(F.concat(F.lit(" Job "), i).alias("title"), F.lit("A").alias("company"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("B"), i)).otherwise("").alias("companyName"), F.concat(F.lit("https://x.org/"), i).alias("link"), F.col("text").alias("summary"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.parse_json(F.to_json(item)).alias("item"))
    return landing.job_records(docs, "indeed").select("doc_id", "job_title", "company_name", "posting_url", "raw_snippet")


_SIGNALS_D = "list_filter([" + ", ".join(f"'{s}'" for s in SIGNALS) + "], lambda k: contains(lower('Post ' || doc_id || ' ' || body), k))"


@query(f"SELECT doc_id, 'forum' || (doc_id % 3) AS subreddit, CASE WHEN doc_id % 4 = 0 THEN 'https://y.org/' || doc_id ELSE 'https://www.reddit.com/r/forum' || (doc_id % 3) || '/comments/t' || doc_id || '/' END AS posting_url, CASE WHEN doc_id % 5 = 0 THEN '2024-01-01T00:00:00Z' WHEN doc_id % 5 = 1 THEN 'soon' ELSE strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * doc_id, '%Y-%m-%dT%H:%M:%S.000Z') END AS posting_date, (doc_id % 23)::DOUBLE AS upvotes, (doc_id % 13)::DOUBLE AS comment_count, 'user' || (doc_id % 60) AS company_name, 'Post ' || doc_id AS job_title, left(body, 2000) AS raw_snippet, len({_SIGNALS_D})::INT AS signal_count, array_to_string({_SIGNALS_D}, '|') AS signals FROM (SELECT *, left(trim(coalesce(text, ''), ' '), 5000) AS body FROM documents)")
def landed_forum_posts(spark, sf_dir):
    d = F.col("doc_id")
    i = d.cast("string")
    created = F.when(d % 5 == 0, "2024-01-01T00:00:00Z").when(d % 5 == 1, "soon").otherwise((F.lit(1704067200) + d).cast("string"))
    item = F.struct(F.concat(F.lit("r/forum"), (d % 3).cast("string")).alias("communityName"), F.concat(F.lit("t"), i).alias("id"), F.when(d % 4 == 0, F.concat(F.lit("https://y.org/"), i)).alias("url"), created.alias("created_utc"), (d % 23).alias("ups"), (d % 13).alias("num_comments"), F.col("text").alias("selftext"), F.concat(F.lit("user"), (d % 60).cast("string")).alias("username"), F.concat(F.lit(" Post "), i).alias("title"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.parse_json(F.to_json(item)).alias("item"))
    return landing.post_records(docs).select("doc_id", "subreddit", "posting_url", "posting_date", "upvotes", "comment_count", "company_name", "job_title", "raw_snippet", "signal_count", F.concat_ws("|", "matched_signals").alias("signals"))


@query(f"SELECT id, trim(regexp_replace(c, ' +', ' ', 'g')) AS keywords, {d_text('raw_name')} AS business_name, CASE WHEN contains(c, 'new location') THEN 12 ELSE 0 END AS intent FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 'new location ' || niche WHEN id % 3 = 1 THEN niche || '  plain' ELSE '' END AS c FROM ({duck(LEADS)}))")
def landed_lead_keywords(spark, sf_dir):
    """Keywords as an array (with a null), as a text, and absent; the array's words are found together."""
    i = F.col("id")
    words = F.when(i % 3 == 0, F.concat(F.lit('["new", "location", null, "'), "niche", F.lit('"]'))).when(i % 3 == 1, F.concat(F.lit('"'), "niche", F.lit('  plain"')))
    item = F.concat(F.lit('{"name": "'), "raw_name", F.lit('"'), F.coalesce(F.concat(F.lit(', "keywords": '), words), F.lit("")), F.lit("}"))
    leads = landing.lead_records(view(spark, sf_dir, LEADS, "customer", "nation").select("id", F.parse_json(item).alias("item")))
    return api.score(leads, "full").select("id", "keywords", "business_name", F.col("score_intent").cast("int").alias("intent"))


@query("SELECT event_id, sha1('{\"k\":' || (props->>'$.k') || '}') AS raw_item_hash, NULL::DOUBLE AS missing, '{\"k\":' || (props->>'$.k') || '}' AS canonical, (props->>'$.k')::DOUBLE AS k FROM events")
def variant_ingest(spark, sf_dir):
    """Events' props as dynamic records: canonical hash, and a number with its null-or-absent rule."""
    items = _t(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("item"))
    return items.select("event_id", F.sha1(F.to_json("item").cast("binary")).alias("raw_item_hash"), landing.number_field(F.col("item"), "missing").alias("missing"), F.to_json("item").alias("canonical"), landing.number_field(F.col("item"), "k").alias("k"))


@query()
def variant_leads(spark, sf_dir):
    """Pages as landed lead items, normalised and scored."""
    item = F.to_json(F.struct(F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("name"), F.col("url").alias("website"), F.lit("512-555-0100").alias("phone")))
    leads = landing.lead_records(_t(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.parse_json(item).alias("item")), "HVAC", "Austin", NOW)
    out = api.process(leads, "full").unique
    return out.select("ord", "business_name", "website", "phone", "city", "lead_score", "score_band")
