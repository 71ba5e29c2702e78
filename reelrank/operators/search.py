"""Title search: case-insensitive, null-safe, first ``limit`` hits by film id,
with the external id attached.  Terms shorter than two characters give an
empty result.

By default the term is a regular expression (Java syntax, ``(?iu)``: Unicode
case folding); ``regex=False`` matches it literally.  The scan is a filter
over the film table followed by a top-``limit`` by id, so every task keeps at
most ``limit`` rows before the merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelrank.operators.popular import with_external_id

MIN_QUERY_LENGTH = 2


def search_titles(movies: DataFrame, links: DataFrame | None, q: str | None,
                  limit: int = 10, regex: bool = True) -> DataFrame:
    title = F.col("title")
    if not q or len(q) < MIN_QUERY_LENGTH:
        match = F.lit(False)
    elif regex:
        match = title.rlike("(?iu)" + q)
    else:
        match = F.upper(title).contains(q.upper())
    hits = (movies.filter(title.isNotNull() & match)
            .select("movieId", "title")
            .orderBy("movieId")
            .limit(limit))
    if links is None:
        hits = hits.withColumn("tmdbId", F.lit(None).cast("long"))
    else:
        hits = with_external_id(hits, links, "left", bounded=True)  # at most `limit` rows
    return hits.select("movieId", "title", "tmdbId")


TERM_BLOCK = 64
# Only literal characters, dots (with * or +) and anchors at the ends: what lies between the dots must occur.
_PLAIN = r"^\^?([^\\.\[\]{}()*+?|^$]|\.[*+]?)*\$?$"


def _folded(text: Column) -> Column:
    """Equal for strings that match regardless of case: both case maps, and a dotted capital I as I."""
    dotted = "\u0130\u0307"  # the capital, and the dot that lower-casing leaves over
    return F.translate(F.upper(F.lower(F.translate(text, dotted, "I"))), dotted, "I")


def _trigrams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3))))
                  ).otherwise(F.array().cast("array<string>"))


def _matches(regex: bool) -> Column:
    return F.expr("title rlike concat('(?iu)', term)") if regex else F.contains(F.upper("title"), F.upper("term"))


def search_titles_batch(movies: DataFrame, links: DataFrame | None, terms: DataFrame, limit: int = 10, regex: bool = False) -> DataFrame:
    """term, rank, movieId, title, tmdbId: for every distinct term of ``terms``
    (column term) what ``search_titles`` gives.  Null and too short terms, and
    terms without a hit, have no rows.

    Spark estimates an exploded table at the size of the file it comes from, so
    without hints it broadcasts the titles' trigrams through the driver; these
    joins are shuffled ones at every size."""
    spark = movies.sparkSession
    # dealt anew: a short file is few tasks, but its trigrams are many rows
    titles = movies.filter(F.col("title").isNotNull()).select("movieId", "title").repartition("movieId")
    asked = terms.select("term").filter(F.length("term") >= MIN_QUERY_LENGTH).distinct()
    parts = F.array("term") if not regex else F.when(F.col("term").rlike(_PLAIN), F.split(
        F.regexp_replace("term", r"^\^|\$$", ""), r"\.[*+]?")).otherwise(F.array().cast("array<string>"))
    asked = asked.withColumn("grams", F.array_distinct(F.flatten(F.transform(parts, lambda p: _trigrams(_folded(p))))))

    postings = titles.select("movieId", "title", F.explode(_trigrams(_folded(F.col("title")))).alias("gram"))
    wanted = asked.select("term", F.explode("grams").alias("gram"))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a trigram that no title has rules the term out: it counts as rarest and joins nothing
    rarest = wanted.join(counts.hint("merge"), "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("term", F.col("r.gram").alias("gram"))
    indexed = rarest.hint("merge").join(postings.hint("merge"), "gram").filter(_matches(regex)).select("term", "movieId", "title")

    scanned = asked.filter(F.size("grams") == 0).select("term")
    blocks = max(1, -(-scanned.count() // TERM_BLOCK))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grouped = scanned.groupBy(F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")).agg(
        F.collect_list("term").alias("terms")).withColumn("slice", every(slices))  # about TERM_BLOCK terms
    dealt = titles.withColumn("slice", F.pmod(F.xxhash64("movieId"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
    tested = dealt.hint("merge").join(grouped.hint("merge"), ["block", "slice"]).select("movieId", "title", F.explode("terms").alias("term")).filter(_matches(regex))

    w = Window.partitionBy("term").orderBy("movieId")
    hits = indexed.unionByName(tested).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    hits = hits.withColumn("tmdbId", F.lit(None).cast("long")) if links is None else with_external_id(hits.hint("merge"), links, "left")
    return hits.select("term", "rank", "movieId", "title", "tmdbId")
