"""Map the shared test tables (``/root/testdata/sf*/``) onto the input schemas
the operators expect.  These views only reshape rows; they do none of the
operators' work.  Definitions follow FIXTURES.md §3.

* ratings  – (customer, part) pairs from lineitem ⋈ orders; rating in 0.5..5.0
* movies   – parts as films, with the title shapes the cleaner must handle
* links    – external ids, every tenth missing
* brands   – part -> brand: a label shared by many ids, used as basket item
* catalog  – raw film-detail and videos JSON documents keyed by external id
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """userId, movieId, rating, timestamp.  (l_orderkey, l_linenumber) is not
    unique in lineitem, so repeated pairs are aggregated, not de-duplicated."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .groupBy(F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("movieId"))
        .agg(
            F.max(F.ceil(F.col("l_quantity") / 5.0) * 0.5).alias("rating"),
            # o_orderdate is TIMESTAMP_NTZ: epoch seconds do not depend on the session zone
            F.max(F.unix_timestamp("o_orderdate")).alias("timestamp"),
        )
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movieId, title, genres.  Titles cycle through trailing ``, The (yyyy)``,
    trailing ``, A``, padded ``(yyyy)`` and plain shapes."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base = F.concat(F.col("p_name"), F.lit(" "), k.cast("string"))
    year = (F.lit(1950) + F.col("p_size")).cast("string")
    title = (
        F.when(k % 4 == 0, F.concat(base, F.lit(", The ("), year, F.lit(")")))
        .when(k % 4 == 1, F.concat(base, F.lit(", A")))
        .when(k % 4 == 2, F.concat(F.lit("  "), base, F.lit(" ("), year, F.lit(") ")))
        .otherwise(base)
    )
    return p.select(
        k.alias("movieId"),
        title.alias("title"),
        F.concat(F.col("p_type"), F.lit("|"), F.col("p_brand")).alias("genres"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movieId, imdbId, tmdbId (double, null for every tenth film)."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("movieId"),
        F.lpad(k.cast("string"), 7, "0").alias("imdbId"),
        F.when(k % 10 == 0, F.lit(None).cast("double"))
        .otherwise((k * 7 + 1).cast("double")).alias("tmdbId"),
    )


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movieId, item: the brand plays the role of a title shared by many ids."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("movieId"), F.col("p_brand").alias("item"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tmdbId, detail (JSON string), videos (JSON string): one landed document
    pair per external id, shaped like the remote catalogue's responses.

    Cases covered: poster present / null, backdrop empty string, genres present
    / null, logos present / empty / missing, a YouTube trailer after a YouTube
    clip, only a YouTube featurette, only non-YouTube videos, no videos, and an
    empty detail document (a failed fetch)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    ks = k.cast("string")
    logo = lambda tag: F.struct(F.concat(F.lit(f"/logo{tag}"), ks, F.lit(".png")).alias("file_path"))
    logos = (
        F.when(k % 3 == 0, F.array(logo("a"), logo("b")))
        .when(k % 3 == 1, F.array().cast("array<struct<file_path:string>>"))
    )
    images = F.when(k % 3 != 2, F.struct(logos.alias("logos")))
    genres = F.when(k % 5 != 0, F.array(
        F.struct(F.col("p_type").alias("name")), F.struct(F.col("p_brand").alias("name"))))
    detail = F.struct(
        F.col("p_name").alias("title"),
        F.concat(F.col("p_name"), F.lit(" "), ks).alias("original_title"),
        F.concat((F.lit(1950) + F.col("p_size")).cast("string"), F.lit("-01-01")).alias("release_date"),
        F.concat(F.lit("About "), F.col("p_name")).alias("overview"),
        F.when(k % 4 != 1, F.concat(F.lit("/poster"), ks, F.lit(".jpg"))).alias("poster_path"),
        F.when(k % 4 == 2, F.lit("")).otherwise(F.concat(F.lit("/back"), ks, F.lit(".jpg"))).alias("backdrop_path"),
        (F.col("p_retailprice") / 200.0).alias("vote_average"),
        (F.col("p_size") * 10).cast("long").alias("vote_count"),
        genres.alias("genres"),
        images.alias("images"),
    )
    video = lambda site, typ, tag: F.struct(
        F.lit(site).alias("site"), F.lit(typ).alias("type"),
        F.concat(F.lit(tag), ks).alias("key"))
    videos = (
        F.when(k % 4 == 0, F.array(video("YouTube", "Teaser", "clip"), video("YouTube", "Trailer", "trl")))
        .when(k % 4 == 1, F.array(video("Vimeo", "Trailer", "vim")))
        .when(k % 4 == 2, F.array(video("Vimeo", "Trailer", "vim"), video("YouTube", "Featurette", "feat")))
    )
    return p.select(
        (k * 7 + 1).alias("tmdbId"),
        F.when(k % 7 == 3, F.lit("{}")).otherwise(F.to_json(detail)).alias("detail"),
        F.to_json(F.struct(videos.alias("results"))).alias("videos"),
    )


def _brand_group():
    return F.regexp_replace("p_brand", "[^0-9]", "").cast("int") % 5 + 1


def _rated_groups(spark: SparkSession, sf_dir: str, rated: DataFrame | None) -> DataFrame:
    """userId, movieId, rating, group of every rating of a known film; the group is found once a film, not once a rating."""
    groups = table(spark, sf_dir, "part").select("p_partkey", _brand_group().alias("group"))
    rows = (ratings(spark, sf_dir) if rated is None else rated).select("userId", "movieId", "rating")
    return rows.join(groups, F.col("movieId") == F.col("p_partkey")).select("userId", "movieId", "rating", "group")


def user_profiles(spark: SparkSession, sf_dir: str, rated: DataFrame | None = None) -> DataFrame:
    """id, features: factor rows of whole numbers that SQL can rebuild: a user's
    high ratings (3.5 or more) by the film's group of brands, then 1.  ``rated``: the
    ratings view, where the caller has written it."""
    high = [F.count_if((F.col("group") == g) & (F.col("rating") >= 3.5)).cast("double") for g in range(1, 6)]
    return _rated_groups(spark, sf_dir, rated).groupBy(F.col("userId").alias("id")).agg(F.array(*high, F.lit(1.0)).alias("features"))


def movie_profiles(spark: SparkSession, sf_dir: str, rated: DataFrame | None = None) -> DataFrame:
    """id, features: a film's ratings in its brand group's place, then the sum of its ratings in half stars."""
    votes = [F.count_if(F.col("group") == g).cast("double") for g in range(1, 6)]
    return _rated_groups(spark, sf_dir, rated).groupBy(F.col("movieId").alias("id")).agg(F.array(*votes, F.sum(F.col("rating") * 2)).alias("features"))


def asked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """userId, movieId: pairs to predict, some of unknown users or films (every rating's ids, doubled and moved by 50)."""
    return ratings(spark, sf_dir).select((F.col("userId") * 2).alias("userId"), (F.col("movieId") + 50).alias("movieId")).distinct()
