"""Popularity ranking with external ids.

The ranking is a global top-n: ``orderBy(..).limit(n)`` plans as
``TakeOrderedAndProject``, where every task keeps only its own best n rows,
so the final merge sees at most n x tasks rows whatever the data size.  The
link lookup then joins a table of at most n rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelrank.operators.ratings import rating_stats

MAX_TOP_N = 10_000  # the ranking is shipped to tasks as one array by the feeds


def _order():
    return (F.col("count").desc(), F.col("avg_rating").desc(), F.col("movieId").asc())


def external_id_map(links: DataFrame) -> DataFrame:
    """movieId -> tmdbId: rows without an external id dropped, id cast to an
    integer (truncating, as the source stores it as a float)."""
    return (links.filter(F.col("tmdbId").isNotNull())
            .select("movieId", F.col("tmdbId").cast("long").alias("tmdbId")))


def with_external_id(df: DataFrame, links: DataFrame, how: str = "left",
                     bounded: bool = False) -> DataFrame:
    """Attach ``tmdbId`` by film id (``how='inner'`` drops unmapped films).

    ``bounded=True`` states that ``df`` is a top-n (a few rows): the link
    table is first narrowed to those ids by a semi-join against the
    broadcast top-n, so the lookup never shuffles the whole link table (a
    left join can only broadcast its right side, and the full link table
    may exceed the broadcast threshold)."""
    ids = external_id_map(links)
    if bounded:
        ids = ids.join(F.broadcast(df.select("movieId")), "movieId", "left_semi")
    return df.join(ids, "movieId", how)


def popular_movies(ratings: DataFrame, links: DataFrame | None = None,
                   top_n: int = 20, min_count: int = 5) -> DataFrame:
    """Most-rated films with >= ``min_count`` non-null ratings, ordered by count
    desc, mean desc, id asc; columns rank, movieId, tmdbId, count, avg_rating.
    ``top_n`` is at most ``MAX_TOP_N``."""
    if not 0 <= top_n <= MAX_TOP_N:
        raise ValueError(f"top_n must be in 0..{MAX_TOP_N}")
    top = (rating_stats(ratings)
           .filter(F.col("count") >= min_count)
           .orderBy(*_order())
           .limit(top_n))
    # At most top_n rows: an unpartitioned window over them is bounded.
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*_order())))
    if links is None:
        ranked = ranked.withColumn("tmdbId", F.lit(None).cast("long"))
    else:
        ranked = with_external_id(ranked, links, "left", bounded=True)
    return ranked.select("rank", "movieId", "tmdbId", "count", "avg_rating")


def popular_prefix(popular: DataFrame, n: int) -> DataFrame:
    """First ``n`` entries of a materialised popularity table."""
    return popular.filter(F.col("rank") <= n)


def popular_with_external_id(popular: DataFrame) -> DataFrame:
    """Popular films that have an external id (the popular-list endpoint)."""
    return popular.filter(F.col("tmdbId").isNotNull())


def popular_id_list(popular: DataFrame) -> DataFrame:
    """One row, one column ``items``: the popular film ids in rank order.
    Its size is bounded by the popularity table's ``top_n``."""
    from reelrank.functions.lists import ordered_list

    return popular.agg(ordered_list("movieId", "rank").alias("items"))
