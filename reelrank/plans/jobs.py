"""Batch jobs: the modelled app's offline pipeline as functions over paths.

    preprocess      raw ratings + films CSV -> baskets table, ALS input table
    train_rules     baskets -> rules table, related-film index
    train_als       ALS input -> id dictionaries, model directory, top-k table per user
    build_popular   raw ratings + links -> ranked popularity table
    precompute_user_lists
                    model + users -> JSON-lines cache of gated lists

Each job is gated on a commit record of its outputs, written last (``force=True``
rebuilds), and lets errors propagate.  Later stages read the written tables,
so every job boundary also cuts lineage on shared storage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reelrank.functions.lists import ordered_list
from reelrank.operators import als, baskets, indexing, popular, ratings, rules
from reelrank.session import cut_lineage
from reelrank.sources import files, sinks


@dataclass(frozen=True)
class Layout:
    """Output locations under one root (any Hadoop-compatible URI)."""

    root: str

    def _p(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def record(self, job: str) -> str:
        """Commit record of a job's outputs."""
        return self._p(f"commits/{job}")

    @property
    def baskets(self) -> str:
        return self._p("processed/baskets")

    @property
    def als_input(self) -> str:
        return self._p("processed/als_input")

    @property
    def rules(self) -> str:
        return self._p("results/rules")

    @property
    def related(self) -> str:
        return self._p("results/related_index")

    @property
    def als_model(self) -> str:
        return self._p("models/als")

    @property
    def user_index(self) -> str:
        return self._p("models/user_index")

    @property
    def movie_index(self) -> str:
        return self._p("models/movie_index")

    @property
    def als_recs(self) -> str:
        return self._p("results/als_recommendations")

    @property
    def popular(self) -> str:
        return self._p("results/popular")

    @property
    def user_cache(self) -> str:
        return self._p("cache/user_recommendations")


def preprocess(spark: SparkSession, ratings_csv: str, movies_csv: str, layout: Layout,
               force: bool = False, min_user: int = ratings.MIN_USER_RATINGS,
               min_item: int = ratings.MIN_MOVIE_RATINGS,
               min_rating: float = ratings.MIN_RATING_FOR_RULES,
               mode: str = "best", cap: int | None = baskets.BASKET_CAP) -> dict:
    """Clean ratings once, then write the per-user title baskets and the ALS
    input.  Returns {"skipped": bool, "clean_rows": int | None}; the row count
    is observed while the tables are written, not by an extra job."""
    seen = {"skipped": True, "clean_rows": None}
    outputs = [layout.baskets, layout.als_input]
    sinks.commit_job(spark, layout.record("preprocess"), outputs, lambda: seen.update(
        skipped=False, clean_rows=_preprocess(spark, ratings_csv, movies_csv, layout, min_user, min_item, min_rating, mode, cap)), force)
    return seen


def _preprocess(spark, ratings_csv, movies_csv, layout, min_user, min_item, min_rating, mode, cap) -> int:
    raw = files.read_ratings_csv(spark, ratings_csv)
    movies = files.read_movies_csv(spark, movies_csv)
    obs = Observation("clean_ratings")
    clean = (ratings.filter_active(raw, min_user, min_item)
             .observe(obs, F.count(F.lit(1)).alias("rows"))
             .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        tx = baskets.build_baskets(clean, baskets.title_items(movies), min_rating=min_rating,
                                   mode=mode, cap=cap)
        sinks.write_table(tx, layout.baskets)
        sinks.write_table(clean.select("userId", "movieId", "rating"), layout.als_input)
    finally:
        clean.unpersist()
    return obs.get["rows"]


def train_rules(spark: SparkSession, movies_csv: str, layout: Layout, force: bool = False,
                min_support: float = rules.MIN_SUPPORT,
                min_confidence: float = rules.MIN_CONFIDENCE, top_k: int = 10) -> dict:
    """Mine rules from the baskets; write them (an empty table when none are
    found, so readers keep a schema) and the related-film index keyed by id."""
    seen = {"skipped": True, "rules": None}
    sinks.commit_job(spark, layout.record("rules"), [layout.rules, layout.related], lambda: seen.update(
        skipped=False, rules=_train_rules(spark, movies_csv, layout, min_support, min_confidence, top_k)), force)
    return seen


def _train_rules(spark, movies_csv, layout, min_support, min_confidence, top_k) -> int:
    tx = files.read_table(spark, layout.baskets)
    model = rules.mine_rules(tx, min_support, min_confidence)
    found = rules.association_rules(model).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sinks.write_table(found, layout.rules)
        written = files.read_table(spark, layout.rules)
        labels = baskets.title_items(files.read_movies_csv(spark, movies_csv))
        sinks.write_table(rules.related_index(written, labels, top_k), layout.related)
        return written.count()
    finally:
        found.unpersist()
        model.freqItemsets.unpersist()


def _next_index(spark: SparkSession, path: str, data: DataFrame, col: str) -> DataFrame:
    """The dictionary at ``path`` with a number for every id of ``data``; ids that it holds keep theirs."""
    if sinks.has_success_marker(spark, path):
        index = cut_lineage(indexing.extend_index(files.read_table(spark, path), data, col))
    else:
        index = indexing.contiguous_index(data, col)
    sinks.write_table(index, path)
    return files.read_table(spark, path)


def train_als(spark: SparkSession, layout: Layout, force: bool = False, k: int = als.RECS_PER_USER,
              **params) -> dict:
    """Fit ALS on the ALS input; save the model and each user's top-k film ids.

    Ids are 64-bit and Spark ML's are 32-bit: the model is fitted on the numbers
    of two dictionaries, which are written first and grow with new ids, so a
    number never changes its meaning between runs."""
    outputs = [layout.als_recs, layout.user_index, layout.movie_index, layout.als_model + "/metadata"]
    built = sinks.commit_job(spark, layout.record("als"), outputs, lambda: _train_als(spark, layout, k, params), force)
    return {"skipped": not built}


def _train_als(spark: SparkSession, layout: Layout, k: int, params: dict) -> None:
    data = files.read_table(spark, layout.als_input)
    users = _next_index(spark, layout.user_index, data, "userId")
    movies = _next_index(spark, layout.movie_index, data, "movieId")
    mapped = indexing.apply_index(indexing.apply_index(data, users, "userId"), movies, "movieId").select(
        F.col("userIdIndex").cast("int").alias("userId"), F.col("movieIdIndex").cast("int").alias("movieId"), "rating")
    model = als.fit_als(mapped, **params)
    sinks.save_model(model, layout.als_model)
    cands = _original_ids(als.candidate_rows(model, None, k), users, movies)
    sinks.write_table(cands.groupBy("userId").agg(ordered_list("movieId", "pos").alias("recommendations")), layout.als_recs)


def _original_ids(cands: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    """Candidates of a model fitted on dictionary numbers (userId, pos, movieId, rating), under their ids."""
    numbered = cands.withColumnsRenamed({"userId": "userIdIndex", "movieId": "movieIdIndex"})
    return indexing.invert_index(indexing.invert_index(numbered, movies, "movieId"), users, "userId")


def build_popular(spark: SparkSession, ratings_csv: str, links_csv: str, layout: Layout,
                  top_n: int = 20, min_count: int = 5, force: bool = False) -> DataFrame:
    """The ranked popularity table (read by ``popular_prefix`` and feeds)."""
    raw = files.read_ratings_csv(spark, ratings_csv)
    links = files.read_links_csv(spark, links_csv)
    return sinks.materialize(spark, layout.popular,
                             lambda: popular.popular_movies(raw, links, top_n, min_count), force=force)


def precompute_user_lists(spark: SparkSession, users: DataFrame, ratings_csv: str, movies_csv: str,
                          layout: Layout, top_k: int = als.PRECOMPUTE_TOP_K,
                          min_votes: int = als.GATE_MIN_VOTES, force: bool = False) -> dict:
    """Gated ALS lists for the given users as a JSON-lines cache."""
    if not force and sinks.has_success_marker(spark, layout.user_cache):
        return {"skipped": True}
    model = files.load_als_model(layout.als_model)
    user_index, movie_index = files.read_table(spark, layout.user_index), files.read_table(spark, layout.movie_index)
    asked = indexing.apply_index(users.select("userId"), user_index, "userId").select(F.col("userIdIndex").alias("userId"))
    cands = _original_ids(als.candidate_rows(model, asked), user_index, movie_index)
    lists = als.gated_lists(als.gate_candidates(cands, files.read_movies_csv(spark, movies_csv),
                                                files.read_ratings_csv(spark, ratings_csv), min_votes, top_k))
    sinks.write_user_lists_json(lists, layout.user_cache)
    return {"skipped": False}
