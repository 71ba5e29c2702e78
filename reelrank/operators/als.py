"""Collaborative filtering with Spark ML's ALS.

Scale notes.  ALS keeps its factor blocks on the executors; with a shared
checkpoint folder configured (``spark.checkpoint.dir``) it checkpoints every
``checkpoint_interval`` iterations, which both bounds lineage and lets a lost
executor recover without replaying all iterations.  Users are scored by
``scoring.top_products``: exact, without the users x items product of Spark
ML's own all-user scoring.  Candidate lists are bounded by ``candidates``;
the gate (``gate_candidates``) works on those bounded lists, in one job for
all users instead of one lookup per candidate.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelrank.functions.lists import ordered_list
from reelrank.operators.ratings import movies_with_min_votes
from reelrank.operators.scoring import top_products
from reelrank.session import checkpoint_dir

# Training and serving parameters of the modelled app.
ALS_RANK = 20
ALS_MAX_ITER = 15
ALS_REG_PARAM = 0.1
RECS_PER_USER = 20
ALS_BLOCKS = 16  # not a value of the app: blocks change the factors, so they must not follow the cluster
RATINGS_A_BLOCK = 2_000_000  # a task holds a block's ratings and the factors they name: more ratings, more blocks
GATE_CANDIDATES = 100
GATE_MIN_VOTES = 100
GATE_TOP_K = 5
PRECOMPUTE_TOP_K = 10
PRECOMPUTE_USERS = (1, 10)  # user ids the modelled app precomputes


def fit_als(ratings: DataFrame, rank: int = ALS_RANK, max_iter: int = ALS_MAX_ITER,
            reg_param: float = ALS_REG_PARAM, nonnegative: bool = True,
            cold_start: str = "drop", seed: int = 42, checkpoint_interval: int = 10,
            num_blocks: int = ALS_BLOCKS, ratings_a_block: int = RATINGS_A_BLOCK):
    """Explicit-feedback ALS on userId, movieId, rating (ids must fit in
    32-bit ints; map larger ids with ``operators.indexing`` first).
    ``num_blocks`` is the number of user and of item blocks (one task a block and
    stage): the fitted factors depend on it, so it is fixed whatever the cluster and
    follows the ratings alone: more than ``ratings_a_block`` ratings a block on average
    make more blocks.  Spark ML keeps a block's ratings and all factors that they name in
    a task's heap, which is why ratings and blocks wait on disk between the stages."""
    from pyspark.ml.recommendation import ALS

    spark = ratings.sparkSession
    ckpt = checkpoint_dir(spark)
    if ckpt and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(ckpt)
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg_param,
              userCol="userId", itemCol="movieId", ratingCol="rating",
              coldStartStrategy=cold_start, nonnegative=nonnegative, seed=seed,
              checkpointInterval=checkpoint_interval)
    als = als.setIntermediateStorageLevel("DISK_ONLY")
    data = ratings.select("userId", "movieId", "rating").persist(StorageLevel.DISK_ONLY)
    try:
        return als.setNumBlocks(max(num_blocks, -(-data.count() // ratings_a_block))).fit(data)
    finally:
        data.unpersist()


def recommend_all(model, k: int = RECS_PER_USER) -> DataFrame:
    """userId, recommendations array<struct<movieId int, rating float>> of every user the model knows."""
    top = top_products(model.userFactors, model.itemFactors, k)
    entry = F.struct(F.col("movieId").cast("int").alias("movieId"), F.col("score").cast("float").alias("rating"))
    return top.groupBy(F.col("userId").cast("int").alias("userId")).agg(ordered_list(entry, "rank").alias("recommendations"))


def flatten_recommendations(recs: DataFrame) -> DataFrame:
    """userId, recommendations array<int>: the film ids, scores dropped."""
    return recs.select("userId", F.col("recommendations.movieId").alias("recommendations"))


def exclude_seen(recs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Drop (userId, movieId) pairs the user already rated (optional; the
    modelled app keeps them)."""
    return recs.join(ratings.select("userId", "movieId"), ["userId", "movieId"], "left_anti")


def candidate_rows(model, users: DataFrame | None, candidates: int = GATE_CANDIDATES) -> DataFrame:
    """userId, pos, movieId, rating: each user's top ``candidates`` films.
    Users unknown to the model yield no rows.  ``users=None`` means every
    user the model knows."""
    known = model.userFactors
    if users is not None:
        known = known.join(users.select(F.col("userId").alias("id")).distinct(), "id", "left_semi")
    return top_products(known, model.itemFactors, candidates).select(
        "userId", (F.col("rank") - 1).alias("pos"), "movieId", F.col("score").cast("float").alias("rating"))


def gate_candidates(cands: DataFrame, movies: DataFrame, ratings: DataFrame, min_votes: int = GATE_MIN_VOTES,
                    top_k: int = GATE_TOP_K, exclude_rated: bool = False) -> DataFrame:
    """The popularity gate over any ranked candidates (userId, pos, movieId,
    rating): in ``pos`` order, the first ``top_k`` of each user's films that have
    >= ``min_votes`` ratings.

    Columns: userId, rank, movieId, movie (title), genres, score (``rating``
    rounded half-even to 2 places), votes.  ``exclude_rated=True`` drops
    candidates the user has already rated before gating (the modelled app keeps
    them).  Candidates may be of any origin and number: the cut is a rank of at
    most ``top_k``, taken before the user shuffle as well."""
    if exclude_rated:
        cands = exclude_seen(cands, ratings)
    popular = movies_with_min_votes(movies, ratings, min_votes)
    per_user = Window.partitionBy("userId").orderBy("pos", "movieId")
    # Gate and cut first: titles only join what is left.
    return (cands.join(popular.select("movieId"), "movieId", "left_semi")
            .withColumn("rank", F.row_number().over(per_user))
            .filter(F.col("rank") <= top_k)
            .join(popular, "movieId")
            .select("userId", "rank", "movieId", F.col("title").alias("movie"), "genres",
                    F.bround(F.col("rating").cast("double"), 2).alias("score"),
                    F.col("count").alias("votes")))


def gated_lists(gated: DataFrame) -> DataFrame:
    """userId, items: gated rows as one ordered list of film ids per user."""
    return gated.groupBy("userId").agg(ordered_list("movieId", "rank").alias("items"))


def recommend_for_users(model, users: DataFrame | None, movies: DataFrame, ratings: DataFrame,
                        candidates: int = GATE_CANDIDATES, min_votes: int = GATE_MIN_VOTES,
                        top_k: int = GATE_TOP_K, exclude_rated: bool = False) -> DataFrame:
    """``gate_candidates`` over the model's candidates; ``users=None``: all users the model knows."""
    return gate_candidates(candidate_rows(model, users, candidates), movies, ratings, min_votes, top_k, exclude_rated)


def precompute_users(rows: DataFrame, user_range: tuple[int, int] | None = PRECOMPUTE_USERS) -> DataFrame:
    """Rows of the users that the cache covers, both ends included; ``None``: all."""
    return rows if user_range is None else rows.filter(F.col("userId").between(*user_range))


def precompute_user_lists(model, users: DataFrame | None, movies: DataFrame, ratings: DataFrame,
                          top_k: int = PRECOMPUTE_TOP_K, candidates: int = GATE_CANDIDATES,
                          min_votes: int = GATE_MIN_VOTES,
                          user_range: tuple[int, int] | None = None) -> DataFrame:
    """userId, items: the gated list per user as ordered film ids (the cache
    read by the user feed), built for all given users in one job;
    ``user_range`` keeps only those within it."""
    if user_range is not None:
        known = model.userFactors.select(F.col("id").alias("userId")) if users is None else users
        users = precompute_users(known, user_range)
    gated = recommend_for_users(model, users, movies, ratings, candidates, min_votes, top_k)
    return gated_lists(gated)
