"""Scores in plain SQL for DuckDB, written out by hand from the models' definitions, without the rule tables."""

from __future__ import annotations

_ROUND = "floor({0} + 0.5::DOUBLE)::INT"
_BAND = "CASE WHEN {0} >= 80 THEN 'high' WHEN {0} >= 50 THEN 'usable' ELSE 'low' END AS score_band, CASE WHEN {0} >= 80 THEN 'send_first' WHEN {0} >= 50 THEN 'keep' ELSE 'hold' END AS recommended_action"


def _tags(*pairs: tuple[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {when} THEN {tag} END" for when, tag in pairs) + ") AS reasons"


def _finish(inner: str, weights: tuple[str, ...], score: str, tags: str) -> str:
    total = " + ".join(f"score_{c} * {w}::DOUBLE" for c, w in zip(("fit", "intent", "quality", "engagement"), weights, strict=False))
    return f"SELECT *, {_BAND.format(score)}, {tags} FROM (SELECT *, {_ROUND.format(total)} AS {score} FROM ({inner}))"


def lead(records: str, keywords: bool) -> str:
    """Business leads; the full model looks for intent in keywords, too."""
    told = "lower(title || ' ' || description || ' ' || notes" + (" || ' ' || keywords)" if keywords else ")")
    seen = "lower(business_name || ' ' || niche || ' ' || city || ' ' || website || ' ' || context_niche || ' ' || context_city)"
    inner = f"""SELECT *,
 ((business_name <> '')::INT * 10 + (website <> '')::INT * 20 + (phone <> '')::INT * 10 + (email <> '')::INT * 10 + (city <> '')::INT * 10 + (niche <> '')::INT * 10 + near_niche::INT * 15 + near_city::INT * 15)::INT AS score_fit,
 (hiring_intent::INT * 15 + recent_activity::INT * 10 + review_velocity::INT * 8 + pricing_signal::INT * 8 + social_proof_signal::INT * 8 + trigger_event::INT * 12 + worded::INT * 12)::INT AS score_intent,
 (8 * ((business_name <> '')::INT + (website <> '')::INT + (phone <> '')::INT + (email <> '')::INT + (city <> '')::INT + (source_url <> '')::INT + (collected_at <> '')::INT) + 8 * (coalesce(source_confidence, 0) <> 0)::INT + 8 * (coalesce(extraction_confidence, 0) <> 0)::INT
   + CASE WHEN freshness_hours IS NULL THEN 0 WHEN freshness_hours <= 24 THEN 12 WHEN freshness_hours <= 72 THEN 6 ELSE 0 END)::INT AS score_quality,
 ((coalesce(reviews_count, 0) >= 20)::INT * 8 + (coalesce(rating, 0) >= 4.2::DOUBLE)::INT * 6 + (coalesce(employee_count, 0) >= 5)::INT * 4 + engaged::INT * 12)::INT AS score_engagement
 FROM (SELECT *, context_niche <> '' AND contains({seen}, lower(context_niche)) AS near_niche, context_city <> '' AND contains({seen}, lower(context_city)) AS near_city,
  regexp_matches({told}, 'hiring|growth|expanding|opening|campaign|new location|request a quote') AS worded, previous_response OR reply_count <> 0 OR engagement_signal AS engaged FROM ({records}))"""
    tags = _tags(
        ("business_name <> ''", "'has_name'"), ("website <> ''", "'has_website'"), ("phone <> ''", "'has_phone'"), ("email <> ''", "'has_email'"), ("city <> ''", "'has_city'"), ("niche <> ''", "'has_niche'"), ("near_niche", "'matches_niche'"), ("near_city", "'matches_city'"),
        *[(f, f"'{f}'") for f in ("hiring_intent", "recent_activity", "review_velocity", "pricing_signal", "social_proof_signal", "trigger_event")], ("worded", "'intent_keywords'"),
        ("source_confidence <> 0", "'source_confidence'"), ("extraction_confidence <> 0", "'extraction_confidence'"), ("freshness_hours <= 24", "'fresh_24h'"), ("freshness_hours > 24 AND freshness_hours <= 72", "'fresh_72h'"),
        ("reviews_count >= 20", "'review_volume'"), ("rating >= 4.2::DOUBLE", "'strong_rating'"), ("employee_count >= 5", "'team_size'"), ("engaged", "'engagement_signal'"),
    )
    return _finish(inner, ("0.45", "0.30", "0.15", "0.10"), "lead_score", tags)


def simple(records: str) -> str:
    score = "least(100, 14 * ((business_name <> '')::INT + (website <> '')::INT + (phone <> '')::INT + (email <> '')::INT + (city <> '')::INT + (niche <> '')::INT) + 12 * hiring_intent::INT + 8 * recent_activity::INT)::INT"
    return f"SELECT *, {_BAND.format('lead_score')}, '' AS reasons FROM (SELECT *, {score} AS score_fit, {score} AS lead_score FROM ({records}))"


def jobs(records: str) -> str:
    seen = "lower(job_title || ' ' || company_name || ' ' || raw_snippet || ' ' || source || ' ' || keyword)"
    niche = "instructional design|learning|training|e-learning|elearning|education|course|curriculum|learning management|talent development|organizational development|learning and development"
    inner = f"""SELECT *,
 ((company_name <> '')::INT * 12 + (job_title <> '')::INT * 10 + (location <> '')::INT * 8 + keyed::INT * 15 + about::INT * 10 + afar::INT * 5)::INT AS score_fit, (active::INT * 12 + senior::INT * 8 + edtech::INT * 10 + whole::INT * 5)::INT AS score_intent,
 (8 * filled + CASE WHEN age_hours IS NULL THEN 0 WHEN age_hours <= 48 THEN 10 WHEN age_hours <= 168 THEN 5 WHEN age_hours <= 720 THEN 2 ELSE 0 END)::INT AS score_quality, ((company_url <> '')::INT * 10 + (source = 'linkedin')::INT * 5)::INT AS score_engagement
 FROM (SELECT *, keyword <> '' AND contains(seen, lower(keyword)) AS keyed, regexp_matches(seen, '{niche}') AS about, regexp_matches(seen, 'remote|hybrid|work from home|wfh|telecommute|virtual|distributed') AS afar,
  regexp_matches(said, 'urgent|immediate|now hiring|join our team|growing|expansion|new position') AS active, regexp_matches(said, 'senior|lead|principal|manager|director|head of|leadership|cxo|chief') AS senior,
  regexp_matches(said, 'lms|learning platform|e-learning platform|corporate training|instructional design') AS edtech, regexp_matches(said, 'full.time|permanent|regular') AS whole,
  (company_name <> '')::INT + (job_title <> '')::INT + (posting_url <> '')::INT + (location <> '')::INT + (raw_snippet <> '')::INT + (source <> '')::INT AS filled
  FROM (SELECT *, {seen} AS seen, lower(job_title || ' ' || raw_snippet || ' ' || company_name) AS said FROM ({records})))"""
    tags = _tags(
        ("company_name <> ''", "'has_company'"), ("job_title <> ''", "'has_title'"), ("location <> ''", "'has_location'"), ("keyed", "'keyword_match'"), ("about", "'niche_relevant'"), ("afar", "'remote_friendly'"),
        ("active", "'active_hiring'"), ("senior", "'senior_role'"), ("edtech", "'edtech_signal'"), ("whole", "'full_time'"), ("filled >= 5", "'rich_record'"), ("age_hours <= 48", "'fresh_48h'"), ("age_hours > 48 AND age_hours <= 168", "'fresh_7d'"),
        ("age_hours > 168 AND age_hours <= 720", "'fresh_30d'"), ("company_url <> ''", "'known_company'"), ("source = 'linkedin'", "'linkedin_source'"),
    )
    return _finish(inner, ("0.40", "0.30", "0.20", "0.10"), "lead_score", tags)


def posts(records: str) -> str:
    inner = f"""SELECT *,
 ((job_title <> '')::INT * 12 + (raw_snippet <> '')::INT * 8 + (company_name <> '')::INT * 5 + least(signal_count * 5, 15))::INT AS score_fit, (buyer::INT * 15 + hires::INT * 12 + pain::INT * 10 + money::INT * 8 + content::INT * 8)::INT AS score_intent,
 (8 * filled + CASE WHEN age_hours IS NULL THEN 0 WHEN age_hours <= 24 THEN 12 WHEN age_hours <= 72 THEN 8 WHEN age_hours <= 168 THEN 4 WHEN age_hours <= 720 THEN 2 ELSE 0 END + (coalesce(upvotes, 0) >= 10)::INT * 5 + (coalesce(comment_count, 0) >= 5)::INT * 5)::INT AS score_quality,
 ((lower(subreddit) = 'instructionaldesign')::INT * 8 + (coalesce(upvote_ratio, 0) >= 0.85::DOUBLE)::INT * 5 + (coalesce(comment_count, 0) >= 10)::INT * 7)::INT AS score_engagement
 FROM (SELECT *, regexp_matches(said, 'looking for|recommend.*lms|best.*lms|alternative|switching|replace|considering') AS buyer, regexp_matches(said, 'hiring|we.*hire|job.*opening|position.*available|looking.*hire|recruiting') AS hires,
  regexp_matches(said, 'too expensive|frustrated|struggling|difficult|waste|broken|terrible|bad.*experience') AS pain, regexp_matches(said, 'budget|vendor|quote|pricing|cost|spend|invest|contract') AS money,
  regexp_matches(said, 'create.*course|course.*creation|authoring|content.*development|curriculum') AS content, (job_title <> '')::INT + (raw_snippet <> '')::INT + (company_name <> '')::INT + (posting_url <> '')::INT AS filled
  FROM (SELECT *, lower(job_title || ' ' || raw_snippet) AS said FROM ({records})))"""
    tags = _tags(
        ("job_title <> ''", "'has_title'"), ("raw_snippet <> ''", "'has_body'"), ("company_name <> ''", "'has_author'"), ("signal_count > 0", "'signals:' || signal_count"), ("buyer", "'buyer_intent'"), ("hires", "'hiring_signal'"), ("pain", "'pain_signal'"),
        ("money", "'budget_signal'"), ("content", "'content_signal'"), ("filled >= 3", "'rich_post'"), ("age_hours <= 24", "'fresh_24h'"), ("age_hours > 24 AND age_hours <= 72", "'fresh_72h'"), ("age_hours > 72 AND age_hours <= 168", "'fresh_week'"),
        ("age_hours > 168 AND age_hours <= 720", "'fresh_month'"), ("upvotes >= 10", "'upvoted'"), ("comment_count >= 5", "'discussed'"), ("lower(subreddit) = 'instructionaldesign'", "'primary_community'"), ("upvote_ratio >= 0.85::DOUBLE", "'strong_sentiment'"), ("comment_count >= 10", "'active_discussion'"),
    )
    return _finish(inner, ("0.30", "0.40", "0.20", "0.10"), "signal_score", tags)


def scored(model: str, records: str) -> str:
    return {"full": lambda: lead(records, True), "hvac": lambda: lead(records, False), "simple": lambda: simple(records), "jobs": lambda: jobs(records), "posts": lambda: posts(records)}[model]()
