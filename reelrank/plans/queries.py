"""Registered queries: ``REGISTRY[name](spark, sf_dir) -> DataFrame``.

Each query reads the shared test tables through ``sources.testviews``, runs
the library's operators over the whole tables, and formats the result with
``present`` (doubles rounded to 6 places, arrays as ``|``-joined strings) so
it can be compared with the matching SQL in ``plans.oracle``.

Parameters that differ from the modelled app's defaults are the test-data
settings of SURVEY §7.3 (the defaults never bite on these tables); each is
named where it is used.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelrank import schemas
from reelrank.operators import als, baskets, feeds, indexing, itemsets, popular, ratings, rules, scoring, search
from reelrank.functions.lists import ordered_list
from reelrank.plans import jobs
from reelrank.plans.present import present
from reelrank.session import scratch_path
from reelrank.sources import files, sinks
from reelrank.sources import testviews as tv

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def register(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return register


# Test-data settings.
STRICT_MIN = 30            # ratings_clean_strict: (30, 30)
TX_CAP = 10                # per-user basket cap; 50 never bites here
TX_BEST, TX_RECENT = 6, 4  # best-or-recent variant; *_50 and *_30_20 run the modelled app's own caps
RULES_SUPPORT = 0.20       # brand baskets: all rules one-to-one
RULES_SUPPORT_LOW = 0.15   # the modelled app's default: two-item antecedents appear
MIN_VOTES = 30             # no film reaches 100 votes in these tables
TOP_LIFT = 5
INDEX_CUT = 815_000_000    # 1995-10-29: some users have no rating before it
FIT_GAP = 1e-3             # largest violation of the normal equations, relative to their terms
ALS_COLS = ("userId", "movieId", "rating")
PREFIX_N = 10
SEARCH_TERM = "widget"


# ---------------------------------------------------------------- inputs

def _ratings(spark, sf):
    return tv.ratings(spark, sf)


def _clean(spark, sf):
    return ratings.filter_active(_ratings(spark, sf))


def _clean_once(spark, sf, *cols):
    """The clean ratings (all columns, or ``cols``) written once, for queries that read
    them several times: each pass over the view would join and group all order lines again."""
    path = scratch_path(spark, "clean-ratings")
    sinks.write_table(_clean(spark, sf).select(*cols or ratings.RATING_COLS), path)
    return files.read_table(spark, path)


def _ratings_once(spark, sf):
    """The ratings view written once (without timestamps), for queries that read it several times."""
    path = scratch_path(spark, "ratings")
    sinks.write_table(_ratings(spark, sf).select(*ALS_COLS), path)
    return files.read_table(spark, path)


def _brand_baskets(spark, sf):
    """Brands per user from high ratings, uncapped (raw ratings)."""
    return baskets.build_baskets(_ratings(spark, sf), tv.brands(spark, sf), cap=None)


_models: dict[tuple, object] = {}
_models_lock = threading.Lock()


def _fitted(kind: str, spark: SparkSession, sf: str, build: Callable[[], object]):
    """Fit once per (session, tables, kind): several queries read one model,
    as the modelled app's jobs read one saved model."""
    key = (kind, spark.sparkContext.applicationId, sf)
    with _models_lock:
        if key not in _models:
            _models[key] = build()
        return _models[key]


def _rule_model(spark, sf, support):
    return _fitted(f"fpgrowth-{support}", spark, sf,
                   lambda: rules.mine_rules(_brand_baskets(spark, sf), support, rules.MIN_CONFIDENCE))


def _rules(spark, sf, support=RULES_SUPPORT_LOW):
    return rules.association_rules(_rule_model(spark, sf, support))


def _related(spark, sf):
    return rules.related_index(_rules(spark, sf), tv.brands(spark, sf))


def _als_model(spark, sf, clean=None):
    """``clean``: the clean ratings (``ALS_COLS``), where the caller has written them."""
    return _fitted("als", spark, sf, lambda: als.fit_als(_clean(spark, sf) if clean is None else clean))


def _popular(spark, sf, top_n=20, min_count=5):
    return popular.popular_movies(_ratings(spark, sf), tv.links(spark, sf), top_n, min_count)


# ---------------------------------------------------------------- 1.x / 2.x sources and sinks

@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """Films written as a sorted CSV with header, read back with the fixed schema."""
    path = scratch_path(spark, "movies-csv")
    sinks.write_csv(tv.movies(spark, sf), path, sort_by=["movieId"])
    return files.read_movies_csv(spark, path)


@query("user_recs_json_roundtrip")
def q_user_recs_json_roundtrip(spark, sf):
    """Per-user lists written as JSON lines and read back: userId, position, movieId."""
    lists = _tier2_lists(spark, sf)
    path = scratch_path(spark, "user-lists-json")
    sinks.write_user_lists_json(lists, path)
    back = files.read_user_lists_json(spark, path)
    return back.select("userId", F.posexplode("items").alias("pos", "movieId")).select(
        "userId", (F.col("pos") + 1).alias("position"), "movieId")


@query("user_recs_json_roundtrip_all")
def q_user_recs_json_roundtrip_all(spark, sf):
    """The same sink and reader over the lists of all ratings, best first: every user and rated film."""
    lists = baskets.rank_best(_ratings(spark, sf)).groupBy("userId").agg(ordered_list("movieId", "rank_best").alias("items"))
    path = scratch_path(spark, "all-user-lists-json")
    sinks.write_user_lists_json(lists, path)
    back = files.read_user_lists_json(spark, path)
    return back.select("userId", F.posexplode("items").alias("pos", "movieId")).select(
        "userId", (F.col("pos") + 1).alias("position"), "movieId")


@query("user_map_json_roundtrip")
def q_user_map_json_roundtrip(spark, sf):
    """The lists of all ratings written as one JSON object by user, committed as one file, and read back by several tasks."""
    lists = baskets.rank_best(_ratings(spark, sf)).groupBy("userId").agg(ordered_list("movieId", "rank_best").alias("items"))
    parts, single = scratch_path(spark, "user-map-parts"), scratch_path(spark, "user-map") + ".json"
    sinks.write_user_map_json(lists, parts)
    sinks.commit_single_file(spark, parts, single)
    back = files.read_user_lists_json(spark, single)
    return back.select("userId", F.posexplode("items").alias("pos", "movieId")).select(
        "userId", (F.col("pos") + 1).alias("position"), "movieId")


@query("popular_json_roundtrip")
def q_popular_json_roundtrip(spark, sf):
    """The popularity table written as the JSON cache and read back (rank
    restored from file order)."""
    path = scratch_path(spark, "popular-json")
    sinks.write_popular_json(_popular(spark, sf), path)
    return present(files.read_popular_json(spark, path))


@query("materialized_steps")
def q_materialized_steps(spark, sf):
    """A table written if absent, found complete (the other build isn't run), and rebuilt by force: its rows after each step."""
    path = scratch_path(spark, "materialized")
    by_film, by_user = ratings.movie_rating_counts(_ratings(spark, sf)), ratings.user_rating_counts(_ratings(spark, sf))
    built = lambda df: df.toDF("id", "n")
    steps = []
    for step, df, force in (("written", by_film, False), ("kept", by_user, False), ("forced", by_user, True)):
        seen = sinks.materialize(spark, path, lambda df=df: built(df), force, files=1)
        copy = scratch_path(spark, f"materialized-{step}")  # the next step may replace what it reads
        sinks.write_table(seen.select(F.lit(step).alias("step"), "id", "n", F.lit(len(seen.inputFiles())).alias("files")), copy)
        steps.append(spark.read.parquet(copy))
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


@query("job_outputs")
def q_job_outputs(spark, sf):
    """The preprocessing and rule jobs from CSV: run, skipped, forced, and a support that no rule reaches (typed empty tables)."""
    root = scratch_path(spark, "jobs")
    r, m = f"{root}/ratings", f"{root}/movies"
    sinks.write_csv(_ratings(spark, sf), r)
    sinks.write_csv(tv.movies(spark, sf), m)
    lay = jobs.Layout(f"{root}/out")
    done = [("preprocess", jobs.preprocess(spark, r, m, lay)), ("preprocess again", jobs.preprocess(spark, r, m, lay)),
            ("preprocess forced", jobs.preprocess(spark, r, m, lay, force=True)),
            ("rules", jobs.train_rules(spark, m, lay, min_support=1.0)), ("rules again", jobs.train_rules(spark, m, lay))]
    ran = spark.createDataFrame([(k, v["skipped"], v.get("clean_rows", v.get("rules"))) for k, v in done], "step string, skipped boolean, n long")
    tables = [("table baskets", lay.baskets), ("table als_input", lay.als_input), ("table rules", lay.rules), ("table related", lay.related)]
    for name, path in tables:
        ran = ran.unionByName(files.read_table(spark, path).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("step"), F.lit(None).cast("boolean").alias("skipped"), "n"))
    return ran


@query("als_model_roundtrip")
def q_als_model_roundtrip(spark, sf):
    """The fitted model saved and loaded: its predictions for every clean rating, and for pairs of unknown ids (dropped),
    against the products of the factors of the model in memory."""
    clean, path = _clean_once(spark, sf, *ALS_COLS), scratch_path(spark, "als-model")
    model = _als_model(spark, sf, clean)
    sinks.save_model(model, path)
    asked = clean.select("userId", "movieId").unionByName(clean.select((-1 - F.col("userId")).alias("userId"), "movieId"))
    loaded = files.load_als_model(path).setColdStartStrategy("drop").transform(asked)
    here = scoring.predict_pairs(asked, model.userFactors, model.itemFactors)
    rows = loaded.select(F.col("userId").cast("long").alias("userId"), F.col("movieId").cast("long").alias("movieId"),
                         F.col("prediction").alias("loaded")).join(here, ["userId", "movieId"], "full")
    return rows.groupBy("userId").agg(F.count(F.lit(1)).alias("n"), F.bool_and(
        F.coalesce(F.abs(F.col("loaded") - F.col("prediction")) < 1e-4, F.lit(False))).alias("same"))


# ---------------------------------------------------------------- 3.x projections and filters

@query("clean_titles")
def q_clean_titles(spark, sf):
    return baskets.clean_movies(tv.movies(spark, sf)).select("movieId", "title")


@query("ratings_clean")
def q_ratings_clean(spark, sf):
    return present(_clean(spark, sf))


@query("ratings_clean_strict")
def q_ratings_clean_strict(spark, sf):
    return present(ratings.filter_active(_ratings(spark, sf), STRICT_MIN, STRICT_MIN))


@query("ratings_clean_isin_form")
def q_ratings_clean_isin_form(spark, sf):
    """The set-membership form of the filter is the same operator (semi joins);
    its oracle is written with IN-subqueries."""
    return present(ratings.filter_active(_ratings(spark, sf), STRICT_MIN, STRICT_MIN))


@query("high_rated")
def q_high_rated(spark, sf):
    return present(ratings.high_rated(_ratings(spark, sf)))


@query("external_id_map")
def q_external_id_map(spark, sf):
    return popular.external_id_map(tv.links(spark, sf))


@query("search_titles")
def q_search_titles(spark, sf):
    return search.search_titles(tv.movies(spark, sf), tv.links(spark, sf), SEARCH_TERM)


@query("search_titles_upper")
def q_search_titles_upper(spark, sf):
    return search.search_titles(tv.movies(spark, sf), tv.links(spark, sf), SEARCH_TERM.upper())


@query("search_titles_regex")
def q_search_titles_regex(spark, sf):
    return search.search_titles(tv.movies(spark, sf), tv.links(spark, sf), "^red.*The", limit=100)


@query("search_titles_literal")
def q_search_titles_literal(spark, sf):
    return search.search_titles(tv.movies(spark, sf), tv.links(spark, sf), "D WIDGET 1",
                                limit=25, regex=False)


@query("search_titles_batch")
def q_search_titles_batch(spark, sf):
    """A table of literal terms at once: every film name with the last digits of its ids, and every two-digit number."""
    p = tv.table(spark, sf, "part").select(F.upper("p_name").alias("name"), (F.col("p_partkey") % 50).cast("string").alias("n"))
    terms = p.select(F.concat("name", F.lit(" "), "n").alias("term")).unionByName(p.select(F.col("n").alias("term")))
    return search.search_titles_batch(tv.movies(spark, sf), tv.links(spark, sf), terms)


@query("search_titles_batch_regex")
def q_search_titles_batch_regex(spark, sf):
    """Patterns with anchors and gaps (indexed by their literal parts) and with alternatives (tested against all titles)."""
    p = tv.table(spark, sf, "part").select(F.split("p_name", " ").alias("w"), (F.col("p_partkey") % 50).cast("string").alias("n"))
    terms = p.select(F.concat(F.lit("^"), F.col("w")[0], F.lit(".*"), "n", F.lit(", the")).alias("term")).unionByName(
        p.select(F.concat(F.lit("("), F.col("w")[0], F.lit("|no such) .*"), F.col("w")[1]).alias("term")))
    return search.search_titles_batch(tv.movies(spark, sf), tv.links(spark, sf), terms, regex=True)


@query("movie_detail")
def q_movie_detail(spark, sf):
    return present(feeds.movie_details(tv.catalog(spark, sf), tv.links(spark, sf)),
                   ordered_arrays=("genres",))


@query("movie_trailers")
def q_movie_trailers(spark, sf):
    from reelrank.functions.catalog import pick_trailer

    cat = tv.catalog(spark, sf)
    videos = F.from_json("videos", schemas.MOVIE_VIDEOS_RAW)["results"]
    return cat.select("tmdbId", pick_trailer(videos).alias("trailer_key"))


# ---------------------------------------------------------------- 4.x aggregates

@query("user_rating_counts")
def q_user_rating_counts(spark, sf):
    return ratings.user_rating_counts(_ratings(spark, sf))


@query("movie_rating_counts")
def q_movie_rating_counts(spark, sf):
    return ratings.movie_rating_counts(_ratings(spark, sf))


@query("movie_rating_stats")
def q_movie_rating_stats(spark, sf):
    return present(ratings.rating_stats(_ratings(spark, sf)))


@query("clean_row_count")
def q_clean_row_count(spark, sf):
    return _clean(spark, sf).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- 5.x joins

@query("high_rated_titles")
def q_high_rated_titles(spark, sf):
    hr = ratings.high_rated(_clean(spark, sf))
    return present(ratings.with_titles(hr, baskets.clean_movies(tv.movies(spark, sf))))


@query("movies_with_min_votes")
def q_movies_with_min_votes(spark, sf):
    return ratings.movies_with_min_votes(tv.movies(spark, sf), _ratings(spark, sf), MIN_VOTES)


@query("rated_external_ids")
def q_rated_external_ids(spark, sf):
    rated = ratings.rated_movie_ids(_clean(spark, sf))
    return popular.with_external_id(rated, tv.links(spark, sf), "inner").orderBy("movieId")


# ---------------------------------------------------------------- 9.x windows, sorts, top-k

def _high_titles(spark, sf):
    return ratings.with_titles(ratings.high_rated(_clean(spark, sf)),
                               baskets.clean_movies(tv.movies(spark, sf)))


@query("ranked_best")
def q_ranked_best(spark, sf):
    return present(baskets.rank_best(_high_titles(spark, sf)))


@query("ranked_recent")
def q_ranked_recent(spark, sf):
    return present(baskets.rank_recent(_high_titles(spark, sf)))


@query("top_per_user")
def q_top_per_user(spark, sf):
    return present(baskets.top_per_user(_high_titles(spark, sf), TX_CAP))


@query("transactions")
def q_transactions(spark, sf):
    tx = baskets.build_baskets(_clean(spark, sf), baskets.title_items(tv.movies(spark, sf)), cap=TX_CAP)
    return present(tx, sorted_arrays=("items",))


@query("transactions_best_or_recent")
def q_transactions_best_or_recent(spark, sf):
    tx = baskets.build_baskets(_clean(spark, sf), baskets.title_items(tv.movies(spark, sf)),
                               mode="best_or_recent", best_cap=TX_BEST, recent_cap=TX_RECENT)
    return present(tx, sorted_arrays=("items",))


@query("top_per_user_50")
def q_top_per_user_50(spark, sf):
    return present(baskets.top_per_user(_high_titles(spark, sf), baskets.BASKET_CAP))


@query("transactions_50")
def q_transactions_50(spark, sf):
    tx = baskets.build_baskets(_clean(spark, sf), baskets.title_items(tv.movies(spark, sf)), cap=baskets.BASKET_CAP)
    return present(tx, sorted_arrays=("items",))


@query("transactions_best_or_recent_30_20")
def q_transactions_best_or_recent_30_20(spark, sf):
    tx = baskets.build_baskets(_clean(spark, sf), baskets.title_items(tv.movies(spark, sf)), mode="best_or_recent",
                               best_cap=baskets.BEST_CAP, recent_cap=baskets.RECENT_CAP)
    return present(tx, sorted_arrays=("items",))


@query("brand_baskets")
def q_brand_baskets(spark, sf):
    return present(_brand_baskets(spark, sf), sorted_arrays=("items",))


@query("transactions_distinct")
def q_transactions_distinct(spark, sf):
    """Brand lists with repeats (one entry per highly rated film of the user,
    all of them), de-duplicated."""
    rows = baskets.basket_rows(_ratings(spark, sf), tv.brands(spark, sf), cap=None)
    raw = rows.groupBy("userId").agg(F.collect_list("item").alias("items"))
    return present(baskets.distinct_items(raw), sorted_arrays=("items",))


@query("popular_movies")
def q_popular_movies(spark, sf):
    return present(_popular(spark, sf))


@query("popular_prefix")
def q_popular_prefix(spark, sf):
    return present(popular.popular_prefix(_popular(spark, sf), PREFIX_N))


@query("popular_with_external_id")
def q_popular_with_external_id(spark, sf):
    return present(popular.popular_with_external_id(_popular(spark, sf)))


# ---------------------------------------------------------------- 6.x association rules

@query("frequent_itemsets")
def q_frequent_itemsets(spark, sf):
    fi = rules.frequent_itemsets(_rule_model(spark, sf, RULES_SUPPORT))
    return present(fi, sorted_arrays=("items",))


@query("frequent_itemsets_by_parts")
def q_frequent_itemsets_by_parts(spark, sf):
    """The same itemsets by two passes over parts of 200 baskets (several parts on these tables)."""
    fi = itemsets.frequent_itemsets_by_parts(_brand_baskets(spark, sf), RULES_SUPPORT, part_rows=200, block_sets=100)
    return present(fi, sorted_arrays=("items",))


@query("association_rules")
def q_association_rules(spark, sf):
    return present(_rules(spark, sf, RULES_SUPPORT), sorted_arrays=("antecedent", "consequent"))


@query("association_rules_015")
def q_association_rules_015(spark, sf):
    return present(_rules(spark, sf, RULES_SUPPORT_LOW), sorted_arrays=("antecedent", "consequent"))


@query("rules_top_lift")
def q_rules_top_lift(spark, sf):
    top = rules.rules_top_lift(_rules(spark, sf, RULES_SUPPORT_LOW), TOP_LIFT)
    return present(top, sorted_arrays=("antecedent", "consequent"))


@query("rule_recommendations")
def q_rule_recommendations(spark, sf):
    items = _brand_baskets(spark, sf).select(F.explode("items").alias("item")).distinct()
    return present(rules.recommend_from_rules(_rules(spark, sf), items, top_k=10))


@query("related_index")
def q_related_index(spark, sf):
    return present(_related(spark, sf), ordered_arrays=("items",))


# ---------------------------------------------------------------- 7.x collaborative filtering (no SQL oracle)

@query("als_recommend_all")
def q_als_recommend_all(spark, sf):
    recs = als.recommend_all(_als_model(spark, sf), als.RECS_PER_USER)
    out = recs.select("userId", F.size("recommendations").alias("n"),
                      F.col("recommendations.movieId").alias("movieIds"))
    return present(out, ordered_arrays=("movieIds",))


@query("als_recommendations_flat")
def q_als_recommendations_flat(spark, sf):
    flat = als.flatten_recommendations(als.recommend_all(_als_model(spark, sf)))
    return present(flat, ordered_arrays=("recommendations",))


@query("als_popular_gated")
def q_als_popular_gated(spark, sf):
    """Gated lists for every user the model was trained on."""
    return present(als.recommend_for_users(_als_model(spark, sf), None, tv.movies(spark, sf),
                                           _ratings(spark, sf), min_votes=MIN_VOTES))


@query("precomputed_user_recs")
def q_precomputed_user_recs(spark, sf):
    lists = als.precompute_user_lists(_als_model(spark, sf), None, tv.movies(spark, sf),
                                      _ratings(spark, sf), min_votes=MIN_VOTES)
    return present(lists, ordered_arrays=("items",))


@query("als_fit_optimal")
def q_als_fit_optimal(spark, sf):
    """Every user's factors against the regularised normal equation of its
    ratings and the film factors (the last half step of the fit), factors being
    32-bit floats."""
    clean = _clean_once(spark, sf, *ALS_COLS)
    model = _als_model(spark, sf, clean)
    got = scoring.fit_residuals(clean, model.userFactors, model.itemFactors, als.ALS_RANK, als.ALS_REG_PARAM)
    return got.select("userId", "n_ratings", (F.col("least") >= 0).alias("nonnegative"), (F.col("gap") < FIT_GAP).alias("optimal"))


@query("als_lists_verified")
def q_als_lists_verified(spark, sf):
    """Every user's ALS list against all films: its length, whether scores fall
    and equal the factors' products, and whether no film outside scores more."""
    model = _als_model(spark, sf)
    path = scratch_path(spark, "als-lists")  # read twice: each reading would score all films again
    sinks.write_table(als.candidate_rows(model, None, als.RECS_PER_USER), path)
    listed = files.read_table(spark, path)
    again = scoring.predict_pairs(listed, model.userFactors, model.itemFactors)
    rows = listed.join(again, ["userId", "movieId"])
    after = Window.partitionBy("userId").orderBy("pos")
    rows = rows.withColumn("falls", F.coalesce(F.col("rating") <= F.lag("rating").over(after), F.lit(True)))
    lists = rows.groupBy("userId").agg(F.count(F.lit(1)).alias("n"), F.bool_and("falls").alias("ordered"),
                                       F.bool_and(F.abs(F.col("rating") - F.col("prediction")) < 1e-4).alias("scored"),
                                       F.min("prediction").alias("last"))
    # another way to the same bound: Spark ML's own list of one film more than ours
    ml = model.recommendForAllUsers(als.RECS_PER_USER + 1).select(
        F.col("userId").cast("long").alias("userId"), F.get("recommendations.rating", F.lit(als.RECS_PER_USER - 1)).alias("kth"),
        F.get("recommendations.rating", F.lit(als.RECS_PER_USER)).alias("next"))
    return lists.join(ml, "userId").select(
        "userId", "n", "ordered", "scored",
        ((F.abs(F.col("kth") - F.col("last")) < 1e-4) & (F.coalesce("next", F.lit(0.0)) <= F.col("last") + 1e-4)).alias("complete"))


def _profile_candidates(spark, sf, k, rated):
    return scoring.top_products(tv.user_profiles(spark, sf, rated), tv.movie_profiles(spark, sf, rated), k)


@query("profile_top_films")
def q_profile_top_films(spark, sf):
    """Exact top 20 by inner product over factor tables that SQL can rebuild, all users against all films."""
    return present(_profile_candidates(spark, sf, als.RECS_PER_USER, _ratings_once(spark, sf)))


def _profile_gated(spark, sf, top_k, rated):
    cands = _profile_candidates(spark, sf, als.GATE_CANDIDATES, rated).select(
        "userId", (F.col("rank") - 1).alias("pos"), "movieId", F.col("score").alias("rating"))
    return als.gate_candidates(cands, tv.movies(spark, sf), rated, MIN_VOTES, top_k)


@query("profile_candidates_gated")
def q_profile_candidates_gated(spark, sf):
    return present(_profile_gated(spark, sf, als.GATE_TOP_K, _ratings_once(spark, sf)))


@query("profile_user_lists")
def q_profile_user_lists(spark, sf):
    return present(als.gated_lists(_profile_gated(spark, sf, als.PRECOMPUTE_TOP_K, _ratings_once(spark, sf))), ordered_arrays=("items",))


@query("rated_candidates_gated")
def q_rated_candidates_gated(spark, sf):
    """The gate over candidates of another origin: each user's own films, best first."""
    best = baskets.rank_best(_ratings(spark, sf)).select("userId", F.col("rank_best").alias("pos"), "movieId", "rating")
    return present(als.gate_candidates(best, tv.movies(spark, sf), _ratings(spark, sf), MIN_VOTES))


@query("predicted_pairs")
def q_predicted_pairs(spark, sf):
    return present(scoring.predict_pairs(tv.asked_pairs(spark, sf), tv.user_profiles(spark, sf), tv.movie_profiles(spark, sf)))


@query("predicted_pairs_cold")
def q_predicted_pairs_cold(spark, sf):
    return scoring.cold_pairs(tv.asked_pairs(spark, sf), tv.user_profiles(spark, sf), tv.movie_profiles(spark, sf))


@query("user_index_map")
def q_user_index_map(spark, sf):
    return indexing.contiguous_index(_clean(spark, sf), "userId", "userIndex")


@query("movie_index_map")
def q_movie_index_map(spark, sf):
    return indexing.contiguous_index(_clean(spark, sf), "movieId", "movieIndex")


@query("user_index_extended")
def q_user_index_extended(spark, sf):
    """A dictionary of users with ratings before INDEX_CUT, extended by all other users."""
    r = _ratings(spark, sf)
    old = indexing.contiguous_index(r.filter(F.col("timestamp") < INDEX_CUT), "userId", "userIndex")
    return indexing.extend_index(old, r, "userId", "userIndex")


@query("index_roundtrip")
def q_index_roundtrip(spark, sf):
    """Clean ratings under dictionary numbers and back."""
    clean = _clean_once(spark, sf)
    users, movies = indexing.contiguous_index(clean, "userId"), indexing.contiguous_index(clean, "movieId")
    there = indexing.apply_index(indexing.apply_index(clean, users, "userId"), movies, "movieId").drop("userId", "movieId")
    back = indexing.invert_index(indexing.invert_index(there, users, "userId"), movies, "movieId")
    return present(back.select(*ratings.RATING_COLS))


# ---------------------------------------------------------------- 8.x serving compositions

# Stand-in tier tables for the user feed, in the schemas the feed reads
# (userId, items), bounded like the real ones.  The precomputed cache covers
# als.PRECOMPUTE_USERS, the range the modelled app precomputes, with up to 10 films
# each: the user's 5.0-rated films, most recent first, so a cached user may
# have an empty list.  The ALS-table stand-in lists up to 20 films per user
# (the ALS table's size): the user's best films rated 4.5 or more; users
# without such ratings are absent.

def _ranked_lists(rows, k, order):
    w = Window.partitionBy("userId").orderBy(*order)
    top = rows.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    return top.groupBy("userId").agg(ordered_list("movieId", "_rk").alias("items"))


def _tier1_lists(spark, sf, user_range=als.PRECOMPUTE_USERS):
    r = als.precompute_users(_ratings(spark, sf), user_range)
    fives = _ranked_lists(r.filter(F.col("rating") == 5.0), 10,
                          [F.col("timestamp").desc(), F.col("movieId").asc()])
    cached = r.select("userId").distinct()
    return cached.join(fives, "userId", "left").select(
        "userId", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def _tier2_lists(spark, sf):
    r = _ratings(spark, sf).filter(F.col("rating") >= 4.5)
    return _ranked_lists(r, als.RECS_PER_USER,
                         [F.col("rating").desc(), F.col("timestamp").desc(), F.col("movieId").asc()])


@query("user_feed")
def q_user_feed(spark, sf):
    users = _ratings(spark, sf).select("userId").distinct()
    top = _popular(spark, sf, 20, 3)
    feed = feeds.user_feed(users, _tier1_lists(spark, sf), _tier2_lists(spark, sf), top)
    return feeds.resolve_feed(feed, tv.links(spark, sf), "userId", top)


@query("user_feed_computed")
def q_user_feed_computed(spark, sf):
    """The user feed of every customer over tables that the scoring and gate
    operators made: cached gated lists for als.PRECOMPUTE_USERS, top lists for all
    users with ratings, the popular list for the others."""
    rated = _ratings_once(spark, sf)
    cached = als.precompute_users(als.gated_lists(_profile_gated(spark, sf, als.PRECOMPUTE_TOP_K, rated)))
    top_lists = _profile_candidates(spark, sf, als.RECS_PER_USER, rated).groupBy("userId").agg(ordered_list("movieId", "rank").alias("items"))
    users, top = tv.table(spark, sf, "customer").select(F.col("c_custkey").alias("userId")), popular.popular_movies(rated, tv.links(spark, sf), 20, 3)
    return feeds.resolve_feed(feeds.user_feed(users, cached, top_lists, top), tv.links(spark, sf), "userId", top)


@query("movie_feed")
def q_movie_feed(spark, sf):
    top = _popular(spark, sf, 20, 5)
    feed = feeds.movie_feed(tv.movies(spark, sf), _related(spark, sf), top)
    return feeds.resolve_feed(feed, tv.links(spark, sf), "movieId", top)


@query("movie_pages")
def q_movie_pages(spark, sf):
    pages = feeds.movie_pages(tv.movies(spark, sf), tv.links(spark, sf), _related(spark, sf),
                              _popular(spark, sf, 10, 5), tv.catalog(spark, sf))
    return present(pages, ordered_arrays=("related",))


def _details(spark, sf):
    return feeds.movie_details(tv.catalog(spark, sf), tv.links(spark, sf))


@query("popular_details")
def q_popular_details(spark, sf):
    return present(feeds.popular_details(_popular(spark, sf), _details(spark, sf)), ordered_arrays=("genres",))


@query("user_feed_details")
def q_user_feed_details(spark, sf):
    users, top = _ratings(spark, sf).select("userId").distinct(), _popular(spark, sf, 20, 3)
    feed = feeds.user_feed(users, _tier1_lists(spark, sf), _tier2_lists(spark, sf), top)
    return present(feeds.detailed_feed(feed, _details(spark, sf), top, "userId"), ordered_arrays=("genres",))


@query("movie_feed_details")
def q_movie_feed_details(spark, sf):
    top = _popular(spark, sf, 20, 5)
    feed = feeds.movie_feed(tv.movies(spark, sf), _related(spark, sf), top)
    return present(feeds.detailed_feed(feed, _details(spark, sf), top, "movieId"), ordered_arrays=("genres",))


@query("movie_page_records")
def q_movie_page_records(spark, sf):
    rows = feeds.movie_page_records(tv.movies(spark, sf), _details(spark, sf), _related(spark, sf), _popular(spark, sf, 10, 5))
    return present(rows, ordered_arrays=("genres",))


# Lists of film ids from a trained ALS model have no SQL form: als_fit_optimal and als_lists_verified check the
# fit and the lists by their properties, and profile_* the same operators over factor tables that SQL rebuilds.
NO_ORACLE = {"als_recommend_all", "als_recommendations_flat", "als_popular_gated",
             "precomputed_user_recs"}
