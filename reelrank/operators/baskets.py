"""Per-user baskets for rule mining.

High ratings are joined to item labels (cleaned film titles, or any other
label such as a brand), ranked per user, capped, and gathered as a set.

Scale notes.  A user holding a third of all rows cannot be split by a window
partition, so the cap is what keeps that group bounded: ``row_number`` with a
``<= cap`` filter plans as ``WindowGroupLimit``, applied once per task
*before* the shuffle and once after, so at most ``cap`` rows per user and
task cross the network.  The "best or recent" mode unions two such capped
selections instead of filtering on an OR of two ranks, which the planner
could not push below the shuffle.  ``collect_set`` then sees at most
``cap`` (or 50) rows per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelrank.functions.titles import clean_title
from reelrank.operators.ranking import row_number_within
from reelrank.operators.ratings import MIN_RATING_FOR_RULES, high_rated

# Per-user caps of the modelled app ("best" as coded; the
# documented "best or recent" variant keeps 30 best and 20 recent).
BASKET_CAP = 50
BEST_CAP = 30
RECENT_CAP = 20


def _best_order():
    return [F.col("rating").desc(), F.col("timestamp").desc(), F.col("movieId").asc()]


def _recent_order():
    return [F.col("timestamp").desc(), F.col("movieId").asc()]


def clean_movies(movies: DataFrame) -> DataFrame:
    """Films with normalised titles (``clean_title``)."""
    return movies.withColumn("title", clean_title("title"))


def rank_best(df: DataFrame) -> DataFrame:
    """Adds ``rank_best`` to every row: per user by rating desc, time desc,
    film id asc (the film id makes equal (rating, time) pairs rank
    deterministically).  Full ranking, balanced for hot users
    (``ranking.row_number_within``)."""
    return row_number_within(df, "userId", _best_order(), "rank_best")


def rank_recent(df: DataFrame) -> DataFrame:
    """Adds ``rank_recent``: per user by time desc, film id asc (full ranking)."""
    return row_number_within(df, "userId", _recent_order(), "rank_recent")


def top_per_user(df: DataFrame, cap: int = BASKET_CAP, by: str = "best") -> DataFrame:
    """Rows ranked within the first ``cap`` per user (``by``: best | recent),
    with the rank column.  ``row_number() <= cap`` plans as WindowGroupLimit,
    so at most ``cap`` rows per user and task cross the shuffle."""
    orders = {"best": _best_order, "recent": _recent_order}
    if by not in orders:
        raise ValueError(f"unknown ranking {by!r}")
    name = f"rank_{by}"
    w = Window.partitionBy("userId").orderBy(*orders[by]())
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= cap)


def basket_rows(ratings: DataFrame, items: DataFrame, min_rating: float = MIN_RATING_FOR_RULES,
                mode: str = "best", cap: int | None = BASKET_CAP,
                best_cap: int = BEST_CAP, recent_cap: int = RECENT_CAP) -> DataFrame:
    """userId, movieId, item rows that enter baskets.

    ``items`` has columns movieId, item.  ``mode``: ``"best"`` keeps the
    ``cap`` best-rated rows per user (``cap=None``: all); ``"best_or_recent"``
    keeps the union of the ``best_cap`` best and ``recent_cap`` most recent.
    """
    rows = (high_rated(ratings, min_rating)
            .join(items.select("movieId", "item"), "movieId")
            .select("userId", "movieId", "item", "rating", "timestamp"))
    if mode == "best":
        if cap is not None:
            rows = top_per_user(rows, cap, "best")
    elif mode == "best_or_recent":
        best = top_per_user(rows, best_cap, "best").select("userId", "movieId", "item")
        recent = top_per_user(rows, recent_cap, "recent").select("userId", "movieId", "item")
        rows = best.unionByName(recent)
    else:
        raise ValueError(f"unknown basket mode {mode!r}")
    return rows.select("userId", "movieId", "item")


def build_baskets(ratings: DataFrame, items: DataFrame, **kwargs) -> DataFrame:
    """userId, items: the sorted set of item labels per user (labels shared by
    several films merge into one entry)."""
    return (basket_rows(ratings, items, **kwargs)
            .groupBy("userId")
            .agg(F.array_sort(F.collect_set("item")).alias("items")))


def title_items(movies: DataFrame) -> DataFrame:
    """movieId, item: cleaned titles as basket labels."""
    return clean_movies(movies).select("movieId", F.col("title").alias("item"))


def distinct_items(baskets: DataFrame, col: str = "items") -> DataFrame:
    """Remove repeated labels inside each basket (FP-Growth rejects them)."""
    return baskets.withColumn(col, F.array_distinct(col))
