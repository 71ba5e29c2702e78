"""Explicit schemas for every source and for the derived tables.

Sources are never read with schema inference: it costs an extra pass over
CSV input and gives unstable types.
"""

from pyspark.sql import types as T

RATINGS = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("movieId", T.LongType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])

MOVIES = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
])

LINKS = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("imdbId", T.StringType()),
    T.StructField("tmdbId", T.DoubleType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
])

RULES = T.StructType([
    T.StructField("antecedent", T.ArrayType(T.StringType())),
    T.StructField("consequent", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("lift", T.DoubleType()),
    T.StructField("support", T.DoubleType()),
])

RELATED_INDEX = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
])

POPULAR = T.StructType([
    T.StructField("movieId", T.LongType()),
    T.StructField("tmdbId", T.LongType()),
    T.StructField("count", T.LongType()),
    T.StructField("avg_rating", T.DoubleType()),
])

# One user per JSON line: the scalable form of the userId -> [movieId] cache.
USER_LISTS = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
])

# Raw film-detail document as returned by the remote catalogue (detail call
# with images appended) and the separate videos call.
_GENRE = T.StructType([T.StructField("name", T.StringType())])
_LOGO = T.StructType([T.StructField("file_path", T.StringType())])
_VIDEO = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("key", T.StringType()),
])

MOVIE_DETAIL_RAW = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("original_title", T.StringType()),
    T.StructField("release_date", T.StringType()),
    T.StructField("overview", T.StringType()),
    T.StructField("poster_path", T.StringType()),
    T.StructField("backdrop_path", T.StringType()),
    T.StructField("vote_average", T.DoubleType()),
    T.StructField("vote_count", T.LongType()),
    T.StructField("genres", T.ArrayType(_GENRE)),
    T.StructField("images", T.StructType([T.StructField("logos", T.ArrayType(_LOGO))])),
])

MOVIE_VIDEOS_RAW = T.StructType([T.StructField("results", T.ArrayType(_VIDEO))])
