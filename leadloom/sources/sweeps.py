"""Configurations of search sweeps, and their costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.models import JOB_SOURCES, MOST_ITEMS, SEARCH_KEYWORDS, SUBREDDIT_COST, SUBREDDITS


def job_sweep(spark: SparkSession, keywords: list[str] | DataFrame = SEARCH_KEYWORDS, sources: dict[str, float] = JOB_SOURCES) -> DataFrame:
    """One row per keyword and source, in that order. keywords: a list, or a table of k (from 0) and keyword."""
    words = keywords if isinstance(keywords, DataFrame) else spark.createDataFrame(list(enumerate(keywords)), "k int, keyword string")
    places = F.posexplode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(c).alias("est_cost")) for s, c in sources.items()])).alias("s", "x")
    out = words.select("k", "keyword", places).select((F.col("k") * len(sources) + F.col("s")).cast("int").alias("ord"), "keyword", "x.source", "x.est_cost")
    search = F.to_json(F.struct(F.col("keyword").alias("search"), F.lit(MOST_ITEMS["indeed"]).alias("maxResults")))
    actor_input = F.when(F.col("source") == "indeed", search).otherwise(F.to_json(F.struct(F.col("keyword").alias("query"), F.lit(MOST_ITEMS["linkedin"]).alias("maxItems"))))
    return out.withColumn("actor_input", actor_input)


def forum_sweep(spark: SparkSession, subreddits: list[str] | DataFrame = SUBREDDITS) -> DataFrame:
    """One row per forum. subreddits: a list, or a table of ord and subreddit."""
    names = subreddits if isinstance(subreddits, DataFrame) else spark.createDataFrame(list(enumerate(subreddits)), "ord int, subreddit string")
    out = names.select("ord", "subreddit", F.concat(F.lit("r/"), "subreddit").alias("label"), F.lit(SUBREDDIT_COST).alias("est_cost"))
    most = MOST_ITEMS["forum"]
    return out.withColumn("actor_input", F.to_json(F.struct(F.array("subreddit").alias("subreddits"), F.lit("new").alias("sort"), F.lit(most).alias("maxItems"), F.lit(min(most, 100)).alias("maxPostCount"))))


def place_search(places: DataFrame, most: int = MOST_ITEMS["places"]) -> DataFrame:
    """places: niche, city, state (null for the defaults). Adds search_string and actor_input."""
    part = lambda c, d: F.coalesce(c, F.lit(d))
    out = places.withColumn("search_string", F.concat(part("niche", "HVAC"), F.lit(" in "), part("city", "Austin"), F.lit(", "), part("state", "TX")))
    proxy = F.struct(F.lit(True).alias("useApifyProxy")).alias("proxyConfig")
    flags = [F.lit(False).alias("onlyWithWebsite"), F.lit(True).alias("includeReviews"), F.lit(False).alias("includeReviewsImages"), F.lit("relevance").alias("sortBy")]
    return out.withColumn("actor_input", F.to_json(F.struct(F.col("search_string").alias("searchString"), F.lit(most).alias("maxCrawledPlaces"), proxy, *flags)))


def cost(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.count("*").alias("runs"), F.round(F.sum("est_cost"), 2).alias("total_cost"))
