"""Ratings: activity counts, the minimum-activity filter, thresholds, stats.

Scale notes.  Counts are hash aggregates with map-side partial aggregation,
so a user or film holding a third of all rows still costs one small partial
row per task.  The activity filter reads the two key columns once for both
counts (grouping sets) and the rows once.  Where few users or films fall out,
their ids are broadcast in an anti-join and the rows stay where they are; else
the rows shuffle for a semi-join with the ids that stay, both sides plain
shuffles, so AQE splits a hot user or film over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.session import cut_lineage

RATING_COLS = ("userId", "movieId", "rating", "timestamp")

# Defaults of the modelled app.
MIN_USER_RATINGS = 5
MIN_MOVIE_RATINGS = 10
MIN_RATING_FOR_RULES = 3.5
FEW_IDS = 100_000  # ids that filter_active broadcasts at most; results don't depend on it


def rating_counts(ratings: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Rows per ``key`` value (every row counts, null ratings included)."""
    return ratings.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def user_rating_counts(ratings: DataFrame) -> DataFrame:
    return rating_counts(ratings, "userId", "user_count")


def movie_rating_counts(ratings: DataFrame) -> DataFrame:
    return rating_counts(ratings, "movieId", "movie_count")


def activity_counts(ratings: DataFrame) -> DataFrame:
    """Per-user and per-film row counts in one pass over the ratings (grouping
    sets): columns userId, movieId, n, gid (1 = a user's count, 2 = a film's)."""
    return (ratings.groupingSets([["userId"], ["movieId"]], "userId", "movieId")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")))


def filter_active(ratings: DataFrame, min_user: int = MIN_USER_RATINGS,
                  min_item: int = MIN_MOVIE_RATINGS) -> DataFrame:
    """Keep ratings of users with >= ``min_user`` rows and films with >=
    ``min_item`` rows.  One pass: both counts come from the unfiltered input,
    so a user can fall under ``min_user`` after films are removed.

    The counts are cut from their lineage (checkpointed, or persisted without
    a checkpoint folder: one row per user or film).  A semi-join against an
    aggregate on its own key would have no shuffle on that side, and AQE splits
    a skewed partition only between two plain shuffles; against the written
    counts it can, so a user holding a third of the rows is no single task.
    Where at most ``FEW_IDS`` fall out, no row is shuffled (unless the session
    forbids broadcasts)."""
    counts = cut_lineage(activity_counts(ratings))
    lacking = {r["gid"]: r["n"] for r in counts.filter(F.col("n") < F.when(F.col("gid") == 1, min_user).otherwise(min_item))
               .groupBy("gid").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    may_send = not ratings.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    out = ratings
    for gid, key, least in ((1, "userId", min_user), (2, "movieId", min_item)):
        of_key = counts.filter(F.col("gid") == gid)
        if may_send and lacking.get(gid, 0) <= FEW_IDS:
            out = out.filter(F.col(key).isNotNull()).join(F.broadcast(of_key.filter(F.col("n") < least).select(key)), key, "left_anti")
        else:
            out = out.join(of_key.filter(F.col("n") >= least).select(key), key, "left_semi")
    return out.select(*RATING_COLS)


def high_rated(ratings: DataFrame, min_rating: float = MIN_RATING_FOR_RULES) -> DataFrame:
    """Ratings at or above ``min_rating``."""
    return ratings.filter(F.col("rating") >= min_rating)


def with_titles(ratings: DataFrame, movies: DataFrame, title_col: str = "title") -> DataFrame:
    """Inner join of ratings to film titles (films without a title row drop)."""
    return (ratings.join(movies.select("movieId", title_col), "movieId")
            .select("userId", "movieId", title_col, "rating", "timestamp"))


def rating_stats(ratings: DataFrame) -> DataFrame:
    """Per film: number of non-null ratings and their mean.  Rows with a null
    film id are dropped, as a keyed group-by over a table would."""
    return (ratings.filter(F.col("movieId").isNotNull())
            .groupBy("movieId")
            .agg(F.count("rating").alias("count"), F.avg("rating").alias("avg_rating")))


def movies_with_min_votes(movies: DataFrame, ratings: DataFrame,
                          min_votes: int = 100) -> DataFrame:
    """Films with at least ``min_votes`` rating rows, with their vote count.
    The count is filtered before the join, so only qualifying keys travel."""
    counts = rating_counts(ratings, "movieId").filter(F.col("count") >= min_votes)
    return movies.join(counts, "movieId").select("movieId", "title", "genres", "count")


def rated_movie_ids(ratings: DataFrame) -> DataFrame:
    """Distinct rated film ids."""
    return ratings.select("movieId").distinct()
