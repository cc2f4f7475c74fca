"""The five scoring models. Points, words and cut points are fixed values."""

from __future__ import annotations

from .scoring import Rule, ScoreModel

#: Terms of the niche of job posts.
NICHE_TERMS = ["instructional design", "learning", "training", "LMS", "e-learning", "elearning", "education", "course", "curriculum", "learning management", "talent development", "organizational development", "L&D", "learning and development"]
#: Signals in forum posts.
SIGNALS = [
    "hiring", "job", "career", "position", "opening", "recruiting", "looking for", "need help", "opportunity", "apply",
    "LMS", "learning management", "switching from", "moving from", "replace", "alternative to", "too expensive", "too complicated", "looking for LMS", "recommend an LMS", "LMS recommendation",
    "course creation", "create courses", "training content", "instructional design", "learning experience", "content development",
    "budget", "vendor", "pricing", "quote", "demo", "trial", "implementation", "rollout", "deployment",
]
#: Search terms and sources of job sweeps, with the cost of a run.
SEARCH_KEYWORDS = ["instructional design", "LMS", "e-learning", "training content", "course creation", "training coordinator", "learning & development"]
JOB_SOURCES = {"indeed": 0.59, "linkedin": 1.50}
SUBREDDITS = ["instructionaldesign", "elearning"]
SUBREDDIT_COST = 0.50
#: Most results of a run, by source.
MOST_ITEMS = {"indeed": 150, "linkedin": 100, "forum": 100, "places": 50}


def _filled(column: str) -> str:
    return f"coalesce({column}, '') <> ''"


def _count(columns: list[str]) -> str:
    return " + ".join(f"CASE WHEN {_filled(c)} THEN 1 ELSE 0 END" for c in columns)


def _matches(text: str, pattern: str) -> str:
    """A pattern of alternatives: those that are plain words are looked for as such, the others only
    where all their words occur."""
    tests = []
    for one in pattern.split("|"):
        words = [w for part in one.split(".*") for w in part.split(".") if w]
        plain = " AND ".join(f"contains({text}, '{w}')" for w in words)
        tests.append(plain if len(words) == 1 else f"({plain} AND regexp_like({text}, '{one}'))")
    return "(" + " OR ".join(tests) + ")"


def _any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_LEAD_SEEN = (("_search", "lower(concat_ws(' ', coalesce(business_name, ''), coalesce(niche, ''), coalesce(city, ''), coalesce(website, ''), coalesce(context_niche, ''), coalesce(context_city, '')))"),)
_LEAD_TOLD = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(notes, '')"
_LEAD_SEARCH, _LEAD_TEXT = "_search", "_text"
_LEAD_FIELDS = ["business_name", "website", "phone", "email", "city", "source_url", "collected_at"]


def _lead_rules() -> tuple[Rule, ...]:
    fit = [Rule("fit", _filled(c), p, f"has_{r}") for c, p, r in (("business_name", "10", "name"), ("website", "20", "website"), ("phone", "10", "phone"), ("email", "10", "email"), ("city", "10", "city"), ("niche", "10", "niche"))]
    fit += [Rule("fit", f"{_filled(f'context_{c}')} AND contains({_LEAD_SEARCH}, lower(context_{c}))", "15", f"matches_{c}") for c in ("niche", "city")]
    flags = {"hiring_intent": "15", "recent_activity": "10", "review_velocity": "8", "pricing_signal": "8", "social_proof_signal": "8", "trigger_event": "12"}
    intent = [Rule("intent", f"coalesce({c}, false)", p, c) for c, p in flags.items()]
    intent.append(Rule("intent", _matches(_LEAD_TEXT, "hiring|growth|expanding|opening|campaign|new location|request a quote"), "12", "intent_keywords"))
    quality = [Rule("quality", _filled(c), "8") for c in _LEAD_FIELDS]
    quality += [Rule("quality", f"coalesce({c}, 0) <> 0", "8", c) for c in ("source_confidence", "extraction_confidence")]
    quality += [Rule("quality", "freshness_hours <= 24", "12", "fresh_24h"), Rule("quality", "freshness_hours > 24 AND freshness_hours <= 72", "6", "fresh_72h")]
    engagement = [
        Rule("engagement", "coalesce(reviews_count, 0) >= 20", "8", "review_volume"),
        Rule("engagement", "coalesce(rating, 0) >= CAST(4.2 AS DOUBLE)", "6", "strong_rating"),
        Rule("engagement", "coalesce(employee_count, 0) >= 5", "4", "team_size"),
        Rule("engagement", "coalesce(previous_response, false) OR coalesce(reply_count, 0) <> 0 OR coalesce(engagement_signal, false)", "12", "engagement_signal"),
    ]
    return (*fit, *intent, *quality, *engagement)


_WEIGHTS = {"fit": "0.45", "intent": "0.30", "quality": "0.15", "engagement": "0.10"}
#: The full model looks for intent in keywords, too.
FULL = ScoreModel("full", _WEIGHTS, _lead_rules(), derived=(*_LEAD_SEEN, ("_text", f"{_LEAD_TOLD}, coalesce(keywords, '')))")), nurture=60)
HVAC = ScoreModel("hvac", _WEIGHTS, _lead_rules(), derived=(*_LEAD_SEEN, ("_text", f"{_LEAD_TOLD}))")))

_SIMPLE_FIELDS = ["business_name", "website", "phone", "email", "city", "niche"]
SIMPLE = ScoreModel(
    "simple",
    {"fit": "1"},
    (*[Rule("fit", _filled(c), "14") for c in _SIMPLE_FIELDS], Rule("fit", "coalesce(hiring_intent, false)", "12"), Rule("fit", "coalesce(recent_activity, false)", "8")),
)

_JOB_DERIVED = (("_search", "lower(concat_ws(' ', coalesce(job_title, ''), coalesce(company_name, ''), coalesce(raw_snippet, ''), coalesce(source, ''), coalesce(keyword, '')))"), ("_text", "lower(concat_ws(' ', coalesce(job_title, ''), coalesce(raw_snippet, ''), coalesce(company_name, '')))"))
_JOB_SEARCH, _JOB_TEXT = "_search", "_text"
_JOB_FIELDS = ["company_name", "job_title", "posting_url", "location", "raw_snippet", "source"]
JOBS = ScoreModel(
    "jobs",
    {"fit": "0.40", "intent": "0.30", "quality": "0.20", "engagement": "0.10"},
    (
        Rule("fit", _filled("company_name"), "12", "has_company"),
        Rule("fit", _filled("job_title"), "10", "has_title"),
        Rule("fit", _filled("location"), "8", "has_location"),
        Rule("fit", f"{_filled('keyword')} AND contains({_JOB_SEARCH}, lower(keyword))", "15", "keyword_match"),
        Rule("fit", _any_of(_JOB_SEARCH, NICHE_TERMS), "10", "niche_relevant"),
        Rule("fit", _matches(_JOB_SEARCH, "remote|hybrid|work from home|wfh|telecommute|virtual|distributed"), "5", "remote_friendly"),
        Rule("intent", _matches(_JOB_TEXT, "urgent|immediate|now hiring|join our team|growing|expansion|new position"), "12", "active_hiring"),
        Rule("intent", _matches(_JOB_TEXT, "senior|lead|principal|manager|director|head of|leadership|cxo|chief"), "8", "senior_role"),
        Rule("intent", _matches(_JOB_TEXT, "lms|learning platform|e-learning platform|corporate training|instructional design"), "10", "edtech_signal"),
        Rule("intent", _matches(_JOB_TEXT, "full.time|permanent|regular"), "5", "full_time"),
        *[Rule("quality", _filled(c), "8") for c in _JOB_FIELDS],
        Rule("quality", f"({_count(_JOB_FIELDS)}) >= 5", "0", "rich_record"),
        Rule("quality", "age_hours <= 48", "10", "fresh_48h"),
        Rule("quality", "age_hours > 48 AND age_hours <= 168", "5", "fresh_7d"),
        Rule("quality", "age_hours > 168 AND age_hours <= 720", "2", "fresh_30d"),
        Rule("engagement", _filled("company_url"), "10", "known_company"),
        Rule("engagement", "source = 'linkedin'", "5", "linkedin_source"),
    ),
    derived=_JOB_DERIVED,
)

_POST_DERIVED = (("_text", "lower(concat_ws(' ', coalesce(job_title, ''), coalesce(raw_snippet, '')))"),)
_POST_TEXT = "_text"
_POST_FIELDS = ["job_title", "raw_snippet", "company_name", "posting_url"]
POSTS = ScoreModel(
    "posts",
    {"fit": "0.30", "intent": "0.40", "quality": "0.20", "engagement": "0.10"},
    (
        Rule("fit", _filled("job_title"), "12", "has_title"),
        Rule("fit", _filled("raw_snippet"), "8", "has_body"),
        Rule("fit", _filled("company_name"), "5", "has_author"),
        Rule("fit", "signal_count > 0", "least(signal_count * 5, 15)", reason_sql="concat('signals:', CAST(signal_count AS STRING))"),
        Rule("intent", _matches(_POST_TEXT, "looking for|recommend.*lms|best.*lms|alternative|switching|replace|considering"), "15", "buyer_intent"),
        Rule("intent", _matches(_POST_TEXT, "hiring|we.*hire|job.*opening|position.*available|looking.*hire|recruiting"), "12", "hiring_signal"),
        Rule("intent", _matches(_POST_TEXT, "too expensive|frustrated|struggling|difficult|waste|broken|terrible|bad.*experience"), "10", "pain_signal"),
        Rule("intent", _matches(_POST_TEXT, "budget|vendor|quote|pricing|cost|spend|invest|contract"), "8", "budget_signal"),
        Rule("intent", _matches(_POST_TEXT, "create.*course|course.*creation|authoring|content.*development|curriculum"), "8", "content_signal"),
        *[Rule("quality", _filled(c), "8") for c in _POST_FIELDS],
        Rule("quality", f"({_count(_POST_FIELDS)}) >= 3", "0", "rich_post"),
        Rule("quality", "age_hours <= 24", "12", "fresh_24h"),
        Rule("quality", "age_hours > 24 AND age_hours <= 72", "8", "fresh_72h"),
        Rule("quality", "age_hours > 72 AND age_hours <= 168", "4", "fresh_week"),
        Rule("quality", "age_hours > 168 AND age_hours <= 720", "2", "fresh_month"),
        Rule("quality", "coalesce(upvotes, 0) >= 10", "5", "upvoted"),
        Rule("quality", "coalesce(comment_count, 0) >= 5", "5", "discussed"),
        Rule("engagement", "lower(coalesce(subreddit, '')) = 'instructionaldesign'", "8", "primary_community"),
        Rule("engagement", "upvote_ratio >= CAST(0.85 AS DOUBLE)", "5", "strong_sentiment"),
        Rule("engagement", "coalesce(comment_count, 0) >= 10", "7", "active_discussion"),
    ),
    score="signal_score",
    derived=_POST_DERIVED,
)
MODELS = {m.name: m for m in (FULL, HVAC, SIMPLE, JOBS, POSTS)}
