"""Film-detail projection over landed catalogue JSON.

The modelled app fetched two documents per film from a remote catalogue (the
detail with images appended, and the videos list) and trimmed them to a small
record.  Here the fetching is out of scope; the documents are a table of JSON
strings and the trimming is one native projection over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelrank import schemas

# Image URL prefixes of the remote catalogue, per image kind.
IMAGE_BASE_W300 = "https://image.tmdb.org/t/p/w300"
IMAGE_BASE_W500 = "https://image.tmdb.org/t/p/w500"
IMAGE_BASE_W1280 = "https://image.tmdb.org/t/p/w1280"

DETAIL_FIELDS = (
    "title", "original_title", "release_date", "vote_average", "vote_count",
    "genres", "trailer_key", "overview", "poster", "backdrop", "logo",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick_trailer(videos: Column | str) -> Column:
    """Key of the first YouTube trailer, else of the first YouTube video, else null."""
    v = _col(videos)
    youtube = F.filter(v, lambda x: x["site"] == "YouTube")
    trailers = F.filter(youtube, lambda x: x["type"] == "Trailer")
    return (F.when(F.size(trailers) > 0, F.get(trailers, 0)["key"])
            .otherwise(F.get(youtube, 0)["key"]))


def detail_present(detail_json: Column | str) -> Column:
    """False for a missing or empty detail document (a failed fetch)."""
    return F.coalesce(F.size(F.json_object_keys(_col(detail_json))) > 0, F.lit(False))


def _url(base: str, path: Column) -> Column:
    # An empty path is "no image", like a missing one.
    return F.when(F.length(path) > 0, F.concat(F.lit(base), path))


def parse_catalog(detail_json: Column | str, videos_json: Column | str) -> list[Column]:
    """The two parsing columns: ``_detail`` (struct), ``_videos`` (array) and
    ``_present`` (the detail document is non-empty).  Select them in their
    own projection and derive the fields from them in the next one: each
    document is then parsed once.  Writing ``from_json(..)[field]`` per output
    field instead lets the optimiser split the parse into one per field."""
    return [
        F.from_json(_col(detail_json), schemas.MOVIE_DETAIL_RAW).alias("_detail"),
        F.from_json(_col(videos_json), schemas.MOVIE_VIDEOS_RAW)["results"].alias("_videos"),
        detail_present(detail_json).alias("_present"),
    ]


def detail_fields(w300: str = IMAGE_BASE_W300, w500: str = IMAGE_BASE_W500,
                  w1280: str = IMAGE_BASE_W1280) -> list[Column]:
    """Named columns of the trimmed detail record (``DETAIL_FIELDS``), computed
    from the columns of ``parse_catalog``."""
    d = F.col("_detail")
    genres = F.coalesce(d["genres"], F.array().cast("array<struct<name:string>>"))
    logos = d["images"]["logos"]
    return [
        d["title"].alias("title"),
        d["original_title"].alias("original_title"),
        d["release_date"].alias("release_date"),
        d["vote_average"].alias("vote_average"),
        d["vote_count"].alias("vote_count"),
        F.transform(genres, lambda g: g["name"]).alias("genres"),
        pick_trailer("_videos").alias("trailer_key"),
        d["overview"].alias("overview"),
        _url(w500, d["poster_path"]).alias("poster"),
        _url(w1280, d["backdrop_path"]).alias("backdrop"),
        F.when(F.size(logos) > 0, F.concat(F.lit(w300), F.get(logos, 0)["file_path"])).alias("logo"),
    ]


def project_movie_detail(df: DataFrame, detail_json: str = "detail", videos_json: str = "videos",
                         keep: tuple[str, ...] = (), drop_missing: bool = True,
                         **image_bases: str) -> DataFrame:
    """``keep`` columns plus the trimmed detail fields, one row per input row;
    rows whose detail document is missing or empty (a failed fetch) are
    dropped unless ``drop_missing=False``."""
    parsed = df.select(*keep, *parse_catalog(detail_json, videos_json))
    if drop_missing:
        parsed = parsed.filter(F.col("_present"))
    return parsed.select(*keep, *detail_fields(**image_bases))
