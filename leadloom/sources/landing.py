"""Landed JSON: one VARIANT column, and look-ups with the semantics of dynamic records.

A field may be absent, null, or hold any type. Look-ups keep the difference: an absent
number is null, a null number is 0 (as is an empty text), other texts are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled, normalize_email, normalize_text


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, item: the VARIANT, null where a line isn't JSON."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.try_parse_json("value").alias("item"))


def inline_items(spark: SparkSession, items: list[str]) -> DataFrame:
    """Items given as JSON texts, numbered by `ord`."""
    return spark.createDataFrame(list(enumerate(items)), "ord long, line string").withColumn("item", F.try_parse_json("line"))


def embedded_or_landed(runs: DataFrame, landed: DataFrame) -> DataFrame:
    """run_id, ord, line: a run's own sample_items, or where it has none the items landed for it."""
    own = runs.filter(F.size(F.coalesce("sample_items", F.array().cast("array<string>"))) > 0).select("run_id", F.posexplode("sample_items").alias("ord", "line"))
    rest = landed.join(own.select("run_id").distinct(), "run_id", "left_anti").select("run_id", "ord", "line")
    return own.unionByName(rest)


def pages(df: DataFrame, data: str = "data", has_more: str | None = None) -> DataFrame:
    """The entries of landed list pages, in order of page and place. With `has_more`, a page that others
    follow must end with an entry that has an id (the cursor), or the query fails."""
    if has_more:
        last = F.try_element_at(data, F.lit(-1))["id"]
        lost = F.coalesce(has_more, F.lit(False)) & (F.coalesce(last, F.lit("")) == "")
        df = df.withColumn(data, F.when(lost, F.raise_error(F.lit("pagination cursor missing"))).otherwise(F.col(data)))
    return df.select("*", F.posexplode(data).alias("place", "entry")).drop(data)


def single_object(spark: SparkSession, path: str) -> DataFrame:
    """item: the one document of a file; no text gives an empty object, text that isn't JSON fails the query."""
    text = F.coalesce(F.nullif(F.btrim("value"), F.lit("")), F.lit("{}"))
    return spark.read.text(path, wholetext=True).select(F.parse_json(text).alias("item"))


#: What a run that doesn't say has.
RUN_DEFAULTS = {"niche": "HVAC", "city": "Austin", "source": "apify"}


def with_run(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items with the attributes of their run (run_id), with defaults: context_niche, context_city, context_source
    and context_collected_at for records without their own. Items of unknown runs, or of none, have the defaults."""
    own = runs.select(F.col("id").alias("_run"), *[F.col(c).alias(f"_{c}") for c in RUN_DEFAULTS], F.col("requested_at").cast("string").alias("context_collected_at"))
    joined = items.join(own, F.col("run_id") == F.col("_run"), "left")
    return joined.select(*items.columns, *[first_filled(f"_{c}", F.lit(d)).alias(f"context_{c}") for c, d in RUN_DEFAULTS.items()], "context_collected_at")


def unwrapped(item: Column) -> Column:
    """The record inside `raw`, where there is one."""
    return F.coalesce(F.try_variant_get(item, "$.raw", "variant"), item)


def raw_text(item: Column, name: str) -> Column:
    """The field as text; null if absent, null, false or zero (which count as missing)."""
    value = F.try_variant_get(item, f"$.{name}", "string")
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
    return F.when(kind.isin("BOOLEAN") & (value == "false"), None).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (value.rlike(r"^-?0(\.0*)?$")), None).otherwise(value)


def text_field(item: Column, *names: str) -> Column:
    """The first alias that is filled, then normalised."""
    return normalize_text(first_filled(*[raw_text(item, n) for n in names]))


def joined_text(item: Column, name: str) -> Column:
    """As text_field, but the elements of an array are joined by spaces (nulls as empty texts)."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    array = F.array_join(F.try_variant_get(item, f"$.{name}", "array<string>"), " ", "")
    return normalize_text(F.when(F.schema_of_variant(value).startswith("ARRAY"), array).otherwise(first_filled(raw_text(item, name))))


def number_only(item: Column, name: str) -> Column:
    """The field if it is a number; texts, flags and nulls count as absent."""
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(item, f"$.{name}", "double"))


def number_field(item: Column, name: str) -> Column:
    value = F.try_variant_get(item, f"$.{name}", "variant")
    text = F.btrim(F.try_variant_get(item, f"$.{name}", "string"))
    number = text.try_cast("double")
    flag = F.when(text == "true", 1.0).when(text == "false", 0.0)
    return F.when(F.is_variant_null(value), 0.0).when(value.isNull(), None).when(text == "", 0.0).otherwise(F.coalesce(number, F.when(F.schema_of_variant(value) == "BOOLEAN", flag)))


def flag_field(item: Column, *names: str) -> Column:
    """Whether any alias holds a true value; any text but the empty one is true."""
    return F.coalesce(*[F.nullif(raw_text(item, n), F.lit("")) for n in names]).isNotNull()


#: Aliases of a business lead's fields, in order of precedence.
LEAD_ALIASES = {
    "business_name": ["business_name", "company_name", "name", "organization", "title", "businessName"],
    "website": ["website", "domain", "url", "source_url", "sourceUrl", "link"],
    "phone": ["phone", "phone_number", "contact_phone", "telephone"],
    "email": ["email", "contact_email", "contactEmail"],
    "niche": ["niche", "category", "industry"],
    "city": ["city", "location", "locality"],
    "source_url": ["source_url", "sourceUrl", "url", "link"],
    "collected_at": ["collected_at", "collectedAt", "timestamp"],
    "title": ["title", "role", "heading"],
    "description": ["description", "summary", "body"],
    "keywords": ["keywords"],
    "notes": ["notes", "note"],
    "source": ["source", "source_type", "sourceType"],
}
LEAD_FLAGS = {
    "hiring_intent": ["hiring_intent", "hiringIntent"], "recent_activity": ["recent_activity", "recentActivity"], "review_velocity": ["review_velocity", "reviewVelocity"],
    "pricing_signal": ["pricing_signal", "pricingSignal"], "social_proof_signal": ["social_proof_signal", "socialProofSignal"], "trigger_event": ["trigger_event", "triggerEvent"],
    "previous_response": ["previous_response", "previousResponse"], "engagement_signal": ["engagement_signal", "engagementSignal"],
}


def lead_records(items: DataFrame, context_niche: str = "", context_city: str = "", collected_at: str = "", context_source: str = "apify") -> DataFrame:
    """Normalised business leads from `item` VARIANTs; other columns are kept."""
    from ..functions.hashing import stable_group_id
    from ..functions.text import normalize_domain, normalize_phone

    item = unwrapped(F.col("item"))
    fields = {k: text_field(item, *names) for k, names in LEAD_ALIASES.items()}
    fields["website"] = normalize_domain(first_filled(*[raw_text(item, n) for n in LEAD_ALIASES["website"]]))
    fields["phone"] = normalize_phone(fields["phone"])
    fields["email"] = normalize_email(fields["email"])
    for name, default in (("niche", context_niche), ("city", context_city), ("collected_at", collected_at)):
        fields[name] = first_filled(fields[name], F.lit(default))
    fields["keywords"] = joined_text(item, "keywords")
    fields |= {k: flag_field(item, *names) for k, names in LEAD_FLAGS.items()}
    fields |= {k: number_field(item, k) for k in ("source_confidence", "extraction_confidence", "freshness_hours", "rating", "employee_count")}
    fields["reviews_count"] = F.coalesce(F.nullif(number_field(item, "reviews_count"), F.lit(0.0)), number_field(item, "review_count"))
    fields["reply_count"] = F.coalesce(number_field(item, "reply_count"), number_field(item, "replyCount"), F.lit(0.0))
    fields["source"] = first_filled(fields["source"], F.lit(context_source))
    fields["source_type"] = first_filled(text_field(item, "source_type", "sourceType"), fields["source"])
    fields["revenue_band"] = F.try_variant_get(item, "$.revenue_band", "string")
    fields["fingerprint"] = stable_group_id(*[fields[k] for k in ("business_name", "website", "phone", "email", "city")])
    fields |= {"context_niche": F.lit(context_niche), "context_city": F.lit(context_city), "raw_item_hash": F.sha1(F.to_json("item").cast("binary"))}
    return items.withColumns(fields)


#: Aliases of a local business's fields, in order of precedence.
PLACE_ALIASES = {
    "business_name": ["business_name", "company_name", "name", "title"], "niche": ["niche", "category"], "city": ["city", "location"], "state": ["state", "region"],
    "phone": ["phone", "telephone", "contact_phone"], "email": ["email", "contact_email"], "source_url": ["source_url", "url", "link"], "collected_at": ["collected_at", "timestamp"],
    "title": ["title"], "description": ["description", "summary"], "licensing_info": ["licensing_info"], "hvac_type": ["hvac_type"],
}
PLACE_WEBSITE = ["website", "domain", "url", "source_url"]
PLACE_DEFAULTS = {"niche": "HVAC", "city": "Austin", "state": "TX", "hvac_type": "both"}
PLACE_FLAGS = ["hiring_intent", "recent_activity", "review_velocity", "pricing_signal", "social_proof_signal", "trigger_event", "previous_response", "engagement_signal", "emergency_service", "insurance_verified"]
PLACE_NUMBERS = ["rating", "employee_count", "source_confidence", "extraction_confidence", "freshness_hours", "years_in_business"]


def place_records(items: DataFrame, collected_at: str = "") -> DataFrame:
    """Normalised local businesses. The context comes from columns context_niche, context_city and
    context_collected_at where there are some (as with_run gives), else from the defaults."""
    from ..functions.text import normalize_domain, normalize_phone

    item = unwrapped(F.col("item"))
    context = lambda name, default: first_filled(*([f"context_{name}"] if f"context_{name}" in items.columns else []), F.lit(default))
    defaults = {k: context(k, v) for k, v in PLACE_DEFAULTS.items()} | {"collected_at": context("collected_at", collected_at)}
    any_of = lambda names: first_filled(*[raw_text(item, n) for n in names])
    # The default comes before the normalisation: a blank field is one that is filled.
    fields = {k: normalize_text(first_filled(any_of(names), defaults[k])) if k in defaults else normalize_text(any_of(names)) for k, names in PLACE_ALIASES.items()}
    fields["website"] = normalize_domain(any_of(PLACE_WEBSITE))
    fields["phone"] = normalize_phone(any_of(PLACE_ALIASES["phone"]))
    fields["email"] = normalize_email(any_of(PLACE_ALIASES["email"]))
    fields |= {k: flag_field(item, k) for k in PLACE_FLAGS} | {k: number_field(item, k) for k in PLACE_NUMBERS}
    other = F.nullif(number_field(item, "reviews_count"), F.lit(0.0))
    fields["reviews_count"] = F.coalesce(other, number_field(item, "reviewCount"))
    fields["reply_count"] = F.coalesce(number_field(item, "reply_count"), F.lit(0.0))
    fields |= {k: F.coalesce(F.try_variant_get(item, f"$.{k}", "array<string>"), F.array().cast("array<string>")) for k in ("services", "serving_zips")}
    fields |= {"source": F.lit("apify"), "notes": F.lit(""), "keywords": F.lit(""), "raw_item_hash": F.sha1(F.to_json("item").cast("binary"))}
    fields |= {f"context_{k}": defaults[k] for k in ("niche", "city")}
    return items.withColumns(fields)


#: Aliases of a job post's fields by source; the LAST that isn't null wins.
JOB_ALIASES = {
    "indeed": {"job_title": ["title"], "company_name": ["company", "companyName"], "location": ["location"], "salary": ["salary"], "raw_snippet": ["summary", "description"], "posting_date": ["postedDate", "date"], "posting_url": ["url", "link", "jobUrl", "sourceUrl"], "company_url": [], "workplace_type": [], "job_level": []},
    "linkedin": {"job_title": ["title"], "company_name": ["company", "companyName", "company_name"], "location": ["location"], "salary": [], "raw_snippet": ["description", "summary"], "posting_date": ["postedDate", "date", "postingDate"], "posting_url": ["url", "link", "jobPostingUrl", "sourceUrl"], "company_url": ["companyUrl"], "workplace_type": ["workplaceType"], "job_level": ["jobLevel"]},
}
#: What is tried where the field's own aliases leave it empty.
JOB_FALLBACKS = {"job_title": ["title"], "company_name": ["company"], "posting_url": ["url", "link"], "posting_date": ["date", "postedDate"], "location": ["location"], "raw_snippet": ["description", "summary"], "workplace_type": ["workplaceType"], "job_level": ["jobLevel"]}


def job_records(items: DataFrame, source: str = "indeed", keyword: str = "") -> DataFrame:
    """Normalised job posts of one source."""
    item = unwrapped(F.col("item"))
    plain = lambda n: F.try_variant_get(item, f"$.{n}", "string")
    fields = {}
    for name, aliases in JOB_ALIASES[source].items():
        last = F.coalesce(*[plain(a) for a in reversed(aliases)], F.lit(None).cast("string"))
        fields[name] = F.btrim(first_filled(last, *[raw_text(item, f) for f in JOB_FALLBACKS.get(name, [])]))
    fields["raw_snippet"] = F.left(fields["raw_snippet"], F.lit(2000))
    return items.withColumns(fields | {"source": F.lit(source), "keyword": F.lit(keyword)})


def post_records(items: DataFrame, subreddit: str = "", signals: list[str] | None = None) -> DataFrame:
    """Normalised forum posts."""
    from ..functions.dates import posting_date
    from ..functions.text import matched_keywords
    from ..plans.models import SIGNALS

    item = unwrapped(F.col("item"))
    # The aliases below, in order of precedence.
    any_of = lambda *names: first_filled(*[raw_text(item, n) for n in names])
    count = lambda *names: F.coalesce(*[number_field(item, n) for n in names], F.lit(0.0))
    body = F.left(F.btrim(any_of("selfText", "selftext", "text", "description")), F.lit(5000))
    title = F.btrim(any_of("title"))
    place = F.regexp_replace(first_filled(any_of("communityName", "subreddit"), F.lit(subreddit)), "^r/", "")
    post_id, url = any_of("id"), any_of("url", "permalink")
    built = F.when((place != "") & (post_id != ""), F.concat(F.lit("https://www.reddit.com/r/"), place, F.lit("/comments/"), post_id, F.lit("/"))).otherwise("")
    matched = matched_keywords(F.concat_ws(" ", title, body), SIGNALS if signals is None else signals)
    out = items.withColumns(
        {
            "job_title": title, "company_name": F.btrim(any_of("username", "author", "name")), "subreddit": place, "post_id": post_id,
            "posting_url": F.when(url != "", url).otherwise(built), "posting_date": posting_date(F.nullif(any_of("createdAt", "created_utc", "created"), F.lit(""))),
            "raw_snippet": F.left(body, F.lit(2000)), "upvotes": count("upVotes", "score", "ups"), "comment_count": count("numberOfComments", "num_comments", "commentCount", "comments"),
            "upvote_ratio": F.coalesce(number_only(item, "upVoteRatio"), number_only(item, "upvoteRatio")), "matched_signals": matched,
        }
    )
    return out.withColumn("signal_count", F.size("matched_signals"))
