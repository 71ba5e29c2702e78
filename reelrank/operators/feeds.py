"""Serving compositions as batch operators: per-user and per-film lists with
a popularity fallback, resolved to external ids.

The fallback list is one bounded array (the popularity table's top-n) that
enters the plan as a scalar subquery: computed once, shipped with the task
closures, with no join at all.  Where entries are resolved to external ids or
records, the list is resolved first, once, and enters as an array of results,
so the many copies of it are never shuffled.  Own lists arrive through left joins on the
entity key; small tier tables are broadcast by AQE from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelrank.functions.catalog import DETAIL_FIELDS, project_movie_detail
from reelrank.functions.lists import ordered_list
from reelrank.operators.popular import external_id_map, popular_id_list
from reelrank.session import cut_lineage

SOURCE_PRECOMPUTED = "precomputed"
SOURCE_ALS = "als"
SOURCE_RULES = "rules"
SOURCE_POPULAR = "popular"


def fallback_list(popular: DataFrame) -> Column:
    """The popular ids as one array-valued scalar subquery."""
    return popular_id_list(popular).scalar()


def _tier(table: DataFrame, key: str, tag: str) -> DataFrame:
    return table.select(key, F.col("items").alias(f"{tag}_items"), F.lit(True).alias(f"{tag}_hit"))


def user_feed(users: DataFrame, precomputed: DataFrame, als_lists: DataFrame,
              popular: DataFrame) -> DataFrame:
    """userId, source, items.  Tier chosen by key presence: the precomputed
    cache, else the ALS table, else nothing; an empty or null chosen list is
    replaced by the popular list.  (A cached empty list therefore yields the
    popular list even when the ALS table has one.)"""
    j = (users.select("userId")
         .join(_tier(precomputed, "userId", "t1"), "userId", "left")
         .join(_tier(als_lists, "userId", "t2"), "userId", "left"))
    chosen = F.when(F.col("t1_hit"), F.col("t1_items")).when(F.col("t2_hit"), F.col("t2_items"))
    source = F.when(F.col("t1_hit"), F.lit(SOURCE_PRECOMPUTED)).when(F.col("t2_hit"), F.lit(SOURCE_ALS))
    has_own = F.coalesce(F.size(chosen) > 0, F.lit(False))
    return j.select(
        "userId",
        F.when(has_own, source).otherwise(F.lit(SOURCE_POPULAR)).alias("source"),
        F.when(has_own, chosen).otherwise(fallback_list(popular)).alias("items"),
    )


def movie_feed(movies: DataFrame, related: DataFrame, popular: DataFrame) -> DataFrame:
    """movieId, source, items: the film's related list, else the popular list."""
    j = movies.select("movieId").join(_tier(related, "movieId", "r"), "movieId", "left")
    has_own = F.coalesce(F.col("r_hit") & (F.size("r_items") > 0), F.lit(False))
    return j.select(
        "movieId",
        F.when(has_own, F.lit(SOURCE_RULES)).otherwise(F.lit(SOURCE_POPULAR)).alias("source"),
        F.when(has_own, F.col("r_items")).otherwise(fallback_list(popular)).alias("items"),
    )


def _entries(feed: DataFrame, key: str) -> DataFrame:
    return feed.select(F.col(key).alias("_key"), "source", F.posexplode("items").alias("_pos", "movieId"))


def _resolved_once(popular: DataFrame, records: DataFrame, columns: list[str]) -> Column:
    """The popular list joined to ``records`` (by movieId), as one array of
    (_pos, columns) in list order.  At most top-n rows; only their records are gathered."""
    top = popular.select("movieId", (F.col("rank") - 1).cast("int").alias("_pos"))
    found = records.join(F.broadcast(top), "movieId")  # popular.MAX_TOP_N rows at most
    # an array is never null, so an empty list gives no rows
    return found.agg(F.array_sort(F.collect_list(F.struct("_pos", *columns))).alias("list")).scalar()


def _with_records(feed: DataFrame, records: DataFrame, popular: DataFrame | None, key: str, columns: list[str]) -> DataFrame:
    """_key, source, position and ``columns`` of the listed films; entries without a record drop."""
    place = (F.col("_pos") + 1).alias("position")
    if popular is None:
        return _entries(feed, key).join(records, "movieId").select("_key", "source", place, *columns)
    is_popular = F.col("source") == SOURCE_POPULAR
    own = _entries(feed.filter(~is_popular), key).join(records, "movieId").select("_key", "source", place, *columns)
    shown = feed.filter(is_popular).select(F.col(key).alias("_key"), "source",
                                           F.explode(_resolved_once(popular, records, columns)).alias("_r"))
    return own.unionByName(shown.select("_key", "source", (F.col("_r._pos") + 1).alias("position"), *[F.col(f"_r.{c}").alias(c) for c in columns]))


def resolve_feed(feed: DataFrame, links: DataFrame, key: str, popular: DataFrame | None = None) -> DataFrame:
    """key, source, position, itemId, tmdbId: the lists flattened (position
    1-based, list order) and resolved to the listed films' external ids;
    entries without an external id drop.  With ``popular``, the table that the
    feed was made with, the fallback list is resolved once."""
    ids = external_id_map(links).withColumn("itemId", F.col("movieId"))
    got = _with_records(feed, ids, popular, key, ["itemId", "tmdbId"])
    return got.select(F.col("_key").alias(key), "source", "position", "itemId", "tmdbId")


def movie_details(catalog: DataFrame, links: DataFrame) -> DataFrame:
    """Trimmed detail records for every mapped film whose detail document is
    present: movieId, tmdbId and the detail fields."""
    docs = project_movie_detail(catalog, keep=("tmdbId",))
    return (external_id_map(links).join(docs, "tmdbId")
            .select("movieId", "tmdbId", *DETAIL_FIELDS, F.col("movieId").alias("id")))


def detailed_feed(feed: DataFrame, details: DataFrame, popular: DataFrame, key: str) -> DataFrame:
    """key, source, position, then the listed film's full record: the lists
    flattened as by ``resolve_feed``, films without a detail record dropped.
    ``popular`` is the table that ``feed`` was made with: its films are looked
    up once, and only own lists are shuffled to the records."""
    got = _with_records(feed, details, popular, key, ["tmdbId", *DETAIL_FIELDS, "id"])
    return got.select(F.col("_key").alias(key), "source", "position", "tmdbId", *DETAIL_FIELDS, "id")


def popular_details(popular: DataFrame, details: DataFrame) -> DataFrame:
    """rank and the full record of every popular film that has one (a top-n: it is broadcast)."""
    return details.join(F.broadcast(popular.select("rank", "movieId")), "movieId").select(
        "rank", "tmdbId", *DETAIL_FIELDS, "id")


def movie_page_records(movies: DataFrame, details: DataFrame, related: DataFrame, popular: DataFrame) -> DataFrame:
    """The full film page as rows: movieId, source, position and a full record.
    Position 0 is the film itself, the others its related (or the popular)
    films by list position.  Films without a record have no page.  The records
    are written once, as three parts of the page read them."""
    details = cut_lineage(details)
    pages = movies.select("movieId").join(details, "movieId")
    feed = movie_feed(pages.select("movieId"), related, popular)
    own = pages.select("movieId", F.lit("page").alias("source"), F.lit(0).alias("position"), "tmdbId", *DETAIL_FIELDS, "id")
    return own.unionByName(detailed_feed(feed, details, popular, "movieId"))


def movie_pages(movies: DataFrame, links: DataFrame, related: DataFrame,
                popular: DataFrame, catalog: DataFrame) -> DataFrame:
    """One page per film that has an external id and a detail document:
    movieId, tmdbId, title, trailer_key, poster, source, related (ordered ids
    of related films that themselves resolve to a detail document).

    ``popular`` is the fallback table (the film page uses the top 10).  Lists
    are cut to films with a record before they meet the pages, so one join
    brings a page its source and list.
    """
    details = cut_lineage(movie_details(catalog, links).select("movieId", "tmdbId", "title", "trailer_key", "poster"))
    pages = movies.select("movieId").join(details, "movieId")
    known = details.select("movieId", F.lit(True).alias("_known"))
    listed = related.filter(F.size("items") > 0).select(F.col("movieId").alias("_page"), F.posexplode("items").alias("_pos", "movieId"))
    # a list whose films are all unknown still keeps its page off the popular list
    shown = listed.join(known, "movieId", "left").groupBy(F.col("_page").alias("movieId")).agg(
        ordered_list(F.when(F.col("_known"), F.col("movieId")), "_pos").alias("_list"))
    fallback = _resolved_once(popular, details.withColumn("itemId", F.col("movieId")), ["itemId"])
    own = F.filter("_list", lambda m: m.isNotNull())
    return pages.join(shown, "movieId", "left").select(
        "movieId", "tmdbId", "title", "trailer_key", "poster",
        F.when(F.col("_list").isNull(), F.lit(SOURCE_POPULAR)).otherwise(F.lit(SOURCE_RULES)).alias("source"),
        F.when(F.col("_list").isNull(), fallback.getField("itemId")).otherwise(own).alias("related"))
