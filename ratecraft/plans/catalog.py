"""The query catalogue: one function ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the given tables (through :mod:`ratecraft.sources.fixtures`)
in full. Floating results are rounded to 6 decimals so a SQL engine computing
the same thing in another summation order agrees.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, vector_dim
from ..operators import aggregates as agg
from ..operators import evaluate as ev
from ..operators import scoring, sets, skew, splits
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import text
from . import recommend as rec
from . import refresh as rf
from . import train

# Result sizes and the popularity floor of the original
# (top 10 recommendations, 5 per user by default, at least 25 ratings).
TOP_N = 10
TOP_N_PER_USER = 5
MIN_RATINGS = 25

# Our own parameters: the damping grid of the deterministic baseline model,
# the window of "new" ratings for the refresh query, which users of the fold-in
# query have no history (one in three), rows that make an item hot in the query that
# shows the salted join, and result rounding.
DAMPING_GRID = (0.0, 5.0, 10.0, 25.0, 50.0)
REFRESH_WINDOW_DAYS = 30
NEWCOMERS = 3
HOT_ROWS = 30
R6 = 6


def _r(col: str) -> F.Column:
    return F.round(F.col(col), R6).alias(col)


# ---- shared derived inputs --------------------------------------------------

def _base_parsed(spark, sf, base=None):
    lines = fx.ratings_lines(spark, sf) if base is None else text.format_rating_lines(base)
    return text.parse_ratings(lines)


def _personal_positive(spark, sf):
    return text.load_positive_ratings(fx.personal_lines(spark, sf))


def _items(spark, sf):
    return text.parse_items(fx.item_lines(spark, sf))


def _base_counts(spark, sf, base=None):
    return agg.item_counts(fx.base(spark, sf) if base is None else base)


def _rated_pairs(spark, sf, base=None):
    """Every (user, item) known as rated: base ratings plus the personal positives."""
    return ((fx.base(spark, sf) if base is None else base).select("user_id", "item_id")
            .unionByName(_personal_positive(spark, sf).select("user_id", "item_id")))


# ---- 1-2: parsing ------------------------------------------------------------

def q_parse_ratings(spark, sf):
    return _base_parsed(spark, sf)


def q_item_stats(spark, sf):
    return agg.item_stats(_base_parsed(spark, sf)).select("item_id", "n_ratings",
                                                           _r("avg_rating"))


def q_parse_items(spark, sf):
    return _items(spark, sf)


def q_parse_rejects(spark, sf):
    lines = fx.spoiled_lines(spark, sf).unionByName(fx.item_lines(spark, sf))
    _, rejects = text.parse_ratings(lines, mode="quarantine")
    return rejects


def q_parse_text_files(spark, sf):
    """Rating lines written as text files to the shared folder, read back and
    parsed; malformed lines go to quarantine."""
    path = scratch_path(spark, "rating-text")
    fx.spoiled_lines(spark, sf).write.text(path)
    good, _ = text.parse_ratings(text.read_lines(spark, path), mode="quarantine")
    return good


def q_parse_posted(spark, sf):
    return text.parse_posted(fx.posted_bodies(spark, sf))


def q_positive_ratings(spark, sf):
    return text.load_positive_ratings(fx.odd_rating_lines(spark, sf))


# ---- 3: aggregates and splits ------------------------------------------------

def q_rating_stats(spark, sf):
    return agg.rating_stats(_base_parsed(spark, sf))


def q_item_counts(spark, sf):
    return agg.item_counts(_base_parsed(spark, sf))


def q_split_bucket(spark, sf):
    return splits.with_split(fx.base(spark, sf), "bucket")


def q_split_hash(spark, sf):
    return splits.with_split(fx.base(spark, sf), "hash")


def q_split_exact(spark, sf):
    return splits.with_split(fx.base(spark, sf).select("user_id", "item_id", "rating", "ts"), "exact")


def q_split_sizes(spark, sf):
    return splits.split_sizes(fx.base(spark, sf))


# ---- 4: sets and pairs -------------------------------------------------------

def q_training_union(spark, sf):
    train_rows = splits.split(_base_parsed(spark, sf))[0]
    return sets.training_union(train_rows, _personal_positive(spark, sf))


def q_training_union_presplit(spark, sf):
    cols = ["user_id", "item_id", "rating", "ts"]
    allr = _base_parsed(spark, sf).select(*cols).unionByName(
        _personal_positive(spark, sf).select(*cols))
    return splits.split(allr)[0].select("user_id", "item_id", "rating")


def q_excluded_items(spark, sf):
    return sets.excluded_items(_personal_positive(spark, sf))


def q_candidate_items(spark, sf):
    return sets.candidate_items(_items(spark, sf),
                                sets.excluded_items(_personal_positive(spark, sf)))


def q_candidate_pairs(spark, sf):
    return sets.pairs_for_user(q_candidate_items(spark, sf), fx.PERSONAL_USER)


def q_unrated_pairs(spark, sf):
    pairs = sets.pairs_for_user(_items(spark, sf), fx.PERSONAL_USER)
    return sets.unrated_pairs(pairs, _rated_pairs(spark, sf))


# ---- 5: scoring over explicit factors ---------------------------------------

def _score_known(spark, sf, pairs):
    uf, itf = fx.user_factors(spark, sf), fx.item_factors(spark, sf)
    return scoring.score_pairs(pairs.distinct(), uf, itf, vector_dim(uf))


def q_score_pairs(spark, sf):
    s = _score_known(spark, sf, fx.base(spark, sf).select("user_id", "item_id"))
    return s.select("user_id", "item_id", _r("score"))


def q_enrich_predictions(spark, sf):
    pairs = fx.base(spark, sf).select("user_id", "item_id")
    s = _score_known(spark, sf, pairs)
    e = scoring.enrich(s, _items(spark, sf), _base_counts(spark, sf), hot=skew.hot_keys(pairs, "item_id"))
    return e.select("user_id", "item_id", "title", _r("score"), "n_ratings")


def q_score_requested(spark, sf):
    requested = _stored(_requested(spark, sf), "requested")   # hot keys, then scores
    s = _score_known(spark, sf, requested)
    e = scoring.enrich(s, _items(spark, sf), _base_counts(spark, sf), hot=skew.hot_keys(requested, "item_id"))
    return e.select("user_id", "item_id", "title", _r("score"), "n_ratings")


def q_hot_item_join(spark, sf):
    """Every rating with its item's title and count, in a join that takes an item
    of more than ``HOT_ROWS`` rows as hot: many are, and their rows are dealt out."""
    rated = fx.base(spark, sf)
    about = rec.titles(_items(spark, sf)).join(_base_counts(spark, sf), "item_id")
    return skew.salted_join(rated, about, "item_id", "left", slice_rows=HOT_ROWS).select(
        "user_id", "item_id", "rating", "ts", "title", "n_ratings")


def q_top_n_global(spark, sf):
    recs = rec.recommend_for_user(fx.PERSONAL_USER, fx.user_factors(spark, sf),
                                  fx.item_factors(spark, sf), TOP_N,
                                  candidates=q_candidate_items(spark, sf))
    return recs.select("user_id", "rank", "item_id", _r("score"))


def q_popular_top_n(spark, sf):
    counts = _base_counts(spark, sf)
    items = _items(spark, sf)
    rated = _rated_pairs(spark, sf).where(F.col("user_id") == fx.PERSONAL_USER)
    recs = rec.recommend_for_user(fx.PERSONAL_USER, fx.user_factors(spark, sf),
                                  fx.item_factors(spark, sf), TOP_N, exclude_items=rated,
                                  candidates=items, counts=counts, min_ratings=MIN_RATINGS)
    out = rec.with_counts(rec.with_titles(recs, items), counts)
    return out.select("user_id", "rank", "item_id", "title", _r("score"), "n_ratings")


def q_top_n_per_user(spark, sf):
    recs = rec.recommend(fx.user_factors(spark, sf), fx.item_factors(spark, sf), TOP_N_PER_USER)
    return recs.select("user_id", "rank", "item_id", _r("score"))


def q_unrated_top_n(spark, sf):
    recs = rec.recommend(fx.user_factors(spark, sf), fx.item_factors(spark, sf), TOP_N,
                         exclude=_rated_pairs(spark, sf), counts=_base_counts(spark, sf),
                         min_ratings=MIN_RATINGS)
    return recs.select("user_id", "rank", "item_id", _r("score"))


def q_exclusion_sets(spark, sf):
    """Rated pairs with known items, through the compressed sets and back."""
    from ..operators import exclusions as ex
    items = fx.item_factors(spark, sf).select("item_id", F.pmod(F.xxhash64("item_id"), F.lit(4)).cast("int").alias("ib"))
    numbers = ex.numbered(items)
    return ex.excluded_pairs(ex.excluded_sets(_rated_pairs(spark, sf), numbers), numbers)


def q_pruned_top_n(spark, sf):
    """The rows of ``unrated_top_n`` by the pruned search."""
    recs = rec.recommend(fx.user_factors(spark, sf), fx.item_factors(spark, sf), TOP_N,
                         exclude=_rated_pairs(spark, sf), counts=_base_counts(spark, sf),
                         min_ratings=MIN_RATINGS, prune=True)
    return recs.select("user_id", "rank", "item_id", _r("score"))


def q_recommend_titles(spark, sf):
    items = _items(spark, sf)
    recs = rec.recommend_for_user(fx.PERSONAL_USER, fx.user_factors(spark, sf),
                                  fx.item_factors(spark, sf), TOP_N,
                                  candidates=q_candidate_items(spark, sf))
    return rec.with_titles(recs, items).select("user_id", "rank", "item_id", "title",
                                               _r("score"))


def q_recs_json(spark, sf):
    return rec.recs_json(q_top_n_per_user(spark, sf))


# ---- 6: evaluation with a deterministic predictor ---------------------------

def _heldout_predictions(spark, sf, damping=(0.0,)):
    s = splits.with_split(fx.base(spark, sf), "bucket")
    train_rows = s.where(F.col("split") == "train")
    heldout = s.where(F.col("split") != "train")
    return ev.item_mean_predictions(train_rows, heldout, damping)


def q_rmse(spark, sf):
    return ev.rmse_by_split(_heldout_predictions(spark, sf)).select("split", "n", _r("rmse"))


def q_rmse_pairwise(spark, sf):
    return ev.rmse_pairwise(_heldout_predictions(spark, sf)).select("split", "n", _r("rmse"))


def _damped_search(spark, sf):
    p = _heldout_predictions(spark, sf, DAMPING_GRID).where(F.col("split") == "validation")
    return p.groupBy("damping").agg(ev.rmse_of("prediction", "rating").alias("rmse"))


def q_damped_mean_search(spark, sf):
    return _damped_search(spark, sf).select("damping", _r("rmse"))


def q_select_best(spark, sf):
    return ev.select_best(_damped_search(spark, sf), param="damping").select("damping",
                                                                              _r("rmse"))


# ---- 7: ALS models: results in full (bench) ---------------------------------------

def _stored(df, name):
    """``df`` written below the shared folder and read back: for rows that several
    jobs of a query read, so that what made them runs once."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _requested(spark, sf):
    """The (user, item) pairs of the posted requests."""
    return text.parse_posted(fx.posted_bodies(spark, sf)).select("user_id", "item_id")


#: What a fit, its scores and its errors read of a rating.
MODEL_COLS = ("user_id", "item_id", "rating", "split")


def _stored_base(spark, sf):
    """The base ratings, line items and orders joined once for all that reads them."""
    return _stored(fx.base(spark, sf), "base-ratings")


def _als_ratings(spark, sf, cols=(), base=None):
    """The parsed base ratings with their split (``cols`` of them), made once."""
    s = splits.with_split(_base_parsed(spark, sf, base), "bucket")
    return _stored(s.select(*cols) if cols else s, "als-ratings")


def _als_split(spark, sf, ratings):
    train_rows = ratings.where(F.col("split") == "train")
    heldout = ratings.where(F.col("split") != "train")
    training = sets.training_union(train_rows, _personal_positive(spark, sf))
    return training, heldout


def _als_inputs(spark, sf, cols=(), base=None):
    return _als_split(spark, sf, _als_ratings(spark, sf, cols, base))


def full_als_rmse(spark, sf):
    training, heldout = _als_inputs(spark, sf, MODEL_COLS)
    model = train.fit(training)
    return train.heldout_rmse(model, heldout).select("split", "n", _r("rmse"))


def full_als_rmse_pairwise(spark, sf):
    """The original error formulation on the fitted model: predictions joined
    back to held-out rows on (user, item), k*k terms per pair rated k times."""
    training, heldout = _als_inputs(spark, sf, MODEL_COLS)
    model = train.fit(training)
    return ev.rmse_pairwise(train.predict(model, heldout)).select("split", "n", _r("rmse"))


def full_als_score_requested(spark, sf):
    """Requested (user, item) pairs (the posted requests) scored by the model,
    with titles and rating counts."""
    from .. import api
    ratings = _als_ratings(spark, sf, MODEL_COLS)      # of the fit and of the counts
    training, _ = _als_split(spark, sf, ratings)
    model = train.fit(training)
    requested = _stored(_requested(spark, sf).distinct(), "requested")   # hot keys, then scores
    out = api.score_requests(model, requested, _items(spark, sf), agg.item_counts(ratings))
    return out.select("user_id", "item_id", "title", _r("score"), "n_ratings")


def full_als_score(spark, sf):
    training, heldout = _als_inputs(spark, sf, MODEL_COLS)
    model = train.fit(training)
    test = heldout.where(F.col("split") == "test").select("user_id", "item_id", "rating")
    return train.predict(model, test).select("user_id", "item_id", "rating", _r("prediction"))


def full_als_rank_search(spark, sf):
    training, heldout = _als_inputs(spark, sf, MODEL_COLS)
    results, _, _ = train.rank_search(training, heldout.where(F.col("split") == "validation"))
    return results.select("rank", _r("rmse"))


def full_als_select_best(spark, sf):
    training, heldout = _als_inputs(spark, sf, MODEL_COLS)
    results, _, _ = train.rank_search(training, heldout.where(F.col("split") == "validation"))
    return ev.select_best(results, param="rank").select("rank", _r("rmse"))


def _als_recommended(spark, sf, base):
    """Top-10 unrated, popular items for every user of the fitted model."""
    training, _ = _als_inputs(spark, sf, MODEL_COLS, base)
    model = train.fit_durable(training)
    uf, itf = train.factors(model)
    return rec.recommend(uf, itf, TOP_N, exclude=_rated_pairs(spark, sf, base),
                         counts=_base_counts(spark, sf, base), min_ratings=MIN_RATINGS)


def full_als_recommend(spark, sf):
    return _als_recommended(spark, sf, _stored_base(spark, sf)).select("user_id", "rank", "item_id", _r("score"))


def _als_recommended_subset(spark, sf):
    """Spark's per-user top-N (no exclusion) for the users with held-out ratings."""
    training, heldout = _als_inputs(spark, sf, MODEL_COLS)
    model = train.fit(training)
    users = heldout.where(F.col("split") == "test").select("user_id").distinct()
    return train.recommend_users(model, users, TOP_N_PER_USER)


def full_als_recommend_subset(spark, sf):
    return _als_recommended_subset(spark, sf).select("user_id", "rank", "item_id", _r("score"))


def _als_recommended_all(spark, sf):
    training, _ = _als_inputs(spark, sf, MODEL_COLS)
    model = train.fit(training)
    return train.recommend_all(model, TOP_N)


def full_als_recommend_all(spark, sf):
    return _als_recommended_all(spark, sf).select("user_id", "rank", "item_id", _r("score"))


def full_model_roundtrip(spark, sf):
    training, heldout = _als_inputs(spark, sf, MODEL_COLS)
    model = train.fit(training)
    path = train.save(model, scratch_path(spark, "als-model"))
    loaded = train.load(path)
    # Same factors after the round trip (one aggregate, raises on any difference).
    a = model.userFactors.withColumnRenamed("features", "a")
    b = loaded.userFactors.withColumnRenamed("features", "b")
    diff = a.join(b, "id", "full_outer").where(~F.coalesce(F.col("a") == F.col("b"),
                                                           F.lit(False))).limit(1).count()
    if diff:
        raise AssertionError("model factors changed in save/load")
    test = heldout.where(F.col("split") == "test").select("user_id", "item_id", "rating")
    return train.predict(loaded, test).select("user_id", "item_id", "rating", _r("prediction"))


# ---- 8: refresh and streaming ingest ----------------------------------------

def _refresh_inputs(spark, sf, base=None):
    ratings = _stored_base(spark, sf) if base is None else base
    # One number, fetched once: every branch below filters on a literal.
    latest = ratings.agg(F.max("ts")).first()[0]
    cutoff = latest - REFRESH_WINDOW_DAYS * 86400
    return ratings.where(F.col("ts") < cutoff), ratings.where(F.col("ts") >= cutoff)


def _als_refreshed(spark, sf, base=None):
    history, new = _refresh_inputs(spark, sf, base)
    _, recs = rf.refresh(history, new, _items(spark, sf), TOP_N)
    return recs


def full_als_refresh(spark, sf):
    return _als_refreshed(spark, sf).select("user_id", "rank", "item_id", "title", _r("score"))


def _fold_in_inputs(spark, sf):
    """The refresh inputs, without the history of every ``NEWCOMERS``-th user:
    those only now send ratings."""
    history, new = _refresh_inputs(spark, sf)
    return history.where(F.pmod("user_id", F.lit(NEWCOMERS)) != 0), new


def full_als_fold_in(spark, sf):
    """Recommendations for the users of the new ratings by fold-in, no refit."""
    history, new = _fold_in_inputs(spark, sf)
    model = train.fit_durable(splits.split(history)[0])
    _, recs = rf.refresh_users(model, history, new, _items(spark, sf), TOP_N)
    return recs.select("user_id", "rank", "item_id", "title", _r("score"))


def q_report_sink(spark, sf):
    """The recommendation report written as a table (executors write, the
    driver holds nothing) and read back."""
    from ..sources.sinks import write_report
    path = write_report(q_recommend_titles(spark, sf), scratch_path(spark, "report"))
    return spark.read.parquet(path)


def q_ratings_table(spark, sf):
    """Parsed ratings written once, partitioned by bucket; the training split
    read back through partition pruning."""
    from .prepare import read_split, write_ratings_table
    path = write_ratings_table(fx.ratings_lines(spark, sf), scratch_path(spark, "ratings"))
    return read_split(spark, path, "train").select("user_id", "item_id", "rating", "ts",
                                                   "bucket")


def q_stream_ingest(spark, sf):
    src = scratch_path(spark, "posted")
    fx.posted_bodies(spark, sf).write.mode("overwrite").json(src)
    from ..streaming.ingest import ingest_posted
    return ingest_posted(spark, src, scratch_path(spark, "posted-sink"),
                         scratch_path(spark, "posted-ckpt")).select("user_id", "item_id", "rating")


def _spoiled_ingest(spark, sf):
    """Spoiled posts through a quarantining ingest: (posted table, its folder)."""
    from ..streaming.ingest import ingest_posted
    src, sink = scratch_path(spark, "spoiled-posts"), scratch_path(spark, "spoiled-sink")
    fx.spoiled_posts(spark, sf).write.text(src)
    return ingest_posted(spark, src, sink, scratch_path(spark, "spoiled-ckpt"),
                         mode="quarantine"), sink


def q_posted_rejects(spark, sf):
    """Every malformed record or line of the posts, as the ingest quarantines it."""
    from ..streaming.ingest import read_rejects
    return read_rejects(spark, _spoiled_ingest(spark, sf)[1])


def q_ratings_with_posts(spark, sf):
    """The prepared ratings table with ingested posts added, as refresh reads it."""
    from .prepare import read_ratings_table, write_ratings_table
    path = write_ratings_table(fx.ratings_lines(spark, sf), scratch_path(spark, "ratings"))
    posted, _ = _spoiled_ingest(spark, sf)
    both = read_ratings_table(spark, path).unionByName(posted)
    return agg.item_stats(both).select("item_id", "n_ratings", _r("avg_rating"))


def q_stream_replayed_posts(spark, sf):
    """Every post delivered twice, in files of two writes: each counts once."""
    from ..streaming.ingest import ingest_posted
    src = scratch_path(spark, "replayed")
    posts = fx.named_posts(spark, sf)
    posts.write.json(src)
    posts.write.mode("append").json(src)
    return ingest_posted(spark, src, scratch_path(spark, "replayed-sink"), scratch_path(spark, "replayed-ckpt"),
                         replay_hours=24).select("user_id", "item_id", "rating")


def q_sketched_stats(spark, sf):
    """Statistics of the prepared table and ingested posts from their sketches:
    ratings exactly, and whether the distinct counts are within 4 %."""
    from ..operators.sketches import sketched_stats
    from ..streaming.ingest import ingest_posted, read_posted_sketches
    from .prepare import read_ratings_table, read_table_sketches, write_ratings_table
    path = write_ratings_table(fx.ratings_lines(spark, sf), scratch_path(spark, "ratings"))
    src, sink = scratch_path(spark, "sketch-posts"), scratch_path(spark, "sketch-sink")
    fx.posted_bodies(spark, sf).write.json(src)
    posted = ingest_posted(spark, src, sink, scratch_path(spark, "sketch-ckpt"))
    got = sketched_stats(read_table_sketches(spark, path), read_posted_sketches(spark, sink))
    exact = agg.rating_stats(read_ratings_table(spark, path).unionByName(posted)) \
        .withColumnsRenamed({"n_users": "users", "n_items": "items"})
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.04 * F.col(b)
    return got.join(exact, "n_ratings").select("n_ratings", near("n_users", "users").alias("users_near"),
                                               near("n_items", "items").alias("items_near"))


def q_stream_item_stats(spark, sf):
    """Per-item count and mean kept up to date by a stateful stream over the posts."""
    src = scratch_path(spark, "posted-stats")
    fx.posted_bodies(spark, sf).write.mode("overwrite").json(src)
    from ..streaming.running import running_item_stats
    out = running_item_stats(spark, src, scratch_path(spark, "item-stats-sink"),
                             scratch_path(spark, "item-stats-ckpt"))
    return out.select("item_id", "n_ratings", _r("avg_rating"))


# ---- 9: ALS models: what must hold of any fit, checked row by row -----------

def _measured(df):
    """Replaces ``rmse`` by whether it is a number."""
    return df.withColumn("measured", F.col("rmse").isNotNull() & ~F.isnan("rmse")
                         & (F.col("rmse") >= 0)).drop("rmse")


def _lists_checked(recs, n, *bad):
    """Per user: rows of the list, and how many break a rule: ranks that are not
    1..n in order of (score descending, item), or a row that ``bad`` has too. The
    scores are those that ranked the rows: rounded, two may be equal that weren't."""
    by = Window.partitionBy("user_id").orderBy("rank")
    before = F.struct(-F.lag("score").over(by), F.lag("item_id").over(by))
    wrong = (F.col("rank") != F.row_number().over(by)) | F.isnan("score") | F.col("score").isNull()
    wrong = wrong | F.coalesce(before >= F.struct(-F.col("score"), F.col("item_id")), F.lit(False))
    marked = recs.select("user_id", "item_id", wrong.cast("long").alias("wrong"))
    for other, keys in bad:
        hit = other.select(*keys).distinct().withColumn("hit", F.lit(1))
        marked = marked.join(hit, keys, "left").withColumn(
            "wrong", F.col("wrong") + F.coalesce("hit", F.lit(0))).drop("hit")
    return marked.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("wrong").alias("n_broken"))


def q_als_rmse(spark, sf):
    return _measured(full_als_rmse(spark, sf))


def q_als_rmse_pairwise(spark, sf):
    return _measured(full_als_rmse_pairwise(spark, sf))


def q_als_rank_search(spark, sf):
    return _measured(full_als_rank_search(spark, sf))


def q_als_select_best(spark, sf):
    """The chosen rank against the whole table: none may be better."""
    training, heldout = _als_inputs(spark, sf, MODEL_COLS)
    results, best, _ = train.rank_search(training, heldout.where(F.col("split") == "validation"))
    chosen = ev.select_best(results, param="rank").first()
    return results.agg(
        F.count(F.lit(1)).alias("n_ranks"),
        F.count_if((F.col("rank") == chosen["rank"]) & (F.col("rank") == best)).alias("n_best"),
        F.count_if(F.col("rmse") < chosen["rmse"]).alias("n_better"))


def q_als_score(spark, sf):
    """Held-out predictions against the dot product of the model's factors."""
    training, heldout = _als_inputs(spark, sf, MODEL_COLS)
    model = train.fit_durable(training)
    test = heldout.where(F.col("split") == "test").select("user_id", "item_id", "rating")
    uf, itf = train.factors(model)
    got = train.predict(model, test) \
        .join(uf.withColumnRenamed("features", "_u"), "user_id") \
        .join(itf.withColumnRenamed("features", "_i"), "item_id")
    near = F.abs(F.col("prediction") - dot("_u", "_i", train.RANK)) <= 1e-4 * (1 + F.abs("prediction"))
    return got.select("user_id", "item_id", "rating", near.alias("is_dot"))


def q_als_score_requested(spark, sf):
    s = full_als_score_requested(spark, sf)
    return s.select("user_id", "item_id", "title", "n_ratings",
                    (F.col("score").isNotNull() & ~F.isnan("score")).alias("scored"))


def q_als_recommend(spark, sf):
    """Length and order of every user's list; none of its items rated or unpopular."""
    base = _stored_base(spark, sf)
    low = _base_counts(spark, sf, base).where(F.col("n_ratings") < MIN_RATINGS)
    return _lists_checked(_als_recommended(spark, sf, base), TOP_N,
                          (_rated_pairs(spark, sf, base), ["user_id", "item_id"]), (low, ["item_id"]))


def q_als_recommend_subset(spark, sf):
    return _lists_checked(_als_recommended_subset(spark, sf), TOP_N_PER_USER)


def q_als_recommend_all(spark, sf):
    return _lists_checked(_als_recommended_all(spark, sf), TOP_N)


def full_als_pruned(spark, sf):
    """Top-10 for all users of the fitted model by the pruned search."""
    training, _ = _als_inputs(spark, sf, MODEL_COLS)
    uf, itf = train.factors(train.fit_durable(training))
    return rec.recommend(uf, itf, TOP_N, prune=True).select("user_id", "rank", "item_id", _r("score"))


def q_als_pruned(spark, sf):
    """Every user's list by the pruned search: its length, and rows that the
    unpruned search doesn't have (item, rank and score to the last bit)."""
    training, _ = _als_inputs(spark, sf, MODEL_COLS)
    uf, itf = train.factors(train.fit_durable(training))
    whole = rec.recommend(uf, itf, TOP_N).withColumn("found", F.lit(0).cast("long"))
    return rec.recommend(uf, itf, TOP_N, prune=True).join(whole, ["user_id", "rank", "item_id", "score"], "left") \
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_items"),
                                F.sum(F.coalesce("found", F.lit(1).cast("long"))).alias("n_different"))


def q_als_refresh(spark, sf):
    base = _stored_base(spark, sf)
    return _lists_checked(_als_refreshed(spark, sf, base), TOP_N, (base, ["user_id", "item_id"]))


def q_als_fold_in(spark, sf):
    """Every user of the new ratings after a fold-in: ratings used, whether the
    old model knew the user, and whether the vector solves the normal equations,
    by the gradient of the user's squared error, summed rating by rating."""
    history, new = _fold_in_inputs(spark, sf)
    training = splits.split(history)[0]
    old = train.fit_durable(training)
    model, _ = rf.refresh_users(old, history, new, _items(spark, sf), TOP_N)
    uf, itf = train.factors(model)
    used = sets.training_union(training.join(new.select("user_id").distinct(), "user_id", "left_semi"), new)
    rows = used.join(uf.withColumnRenamed("features", "x"), "user_id").join(itf.withColumnRenamed("features", "v"), "item_id")
    err = dot("x", "v", train.RANK) - F.col("rating")
    part = lambda c, k: F.get(c, F.lit(k)).cast("double")
    norm = lambda c: F.sqrt(dot(c, c, train.RANK))
    sums = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_ratings"), F.first("x").alias("x"),
        F.array(*[F.sum(err * part("v", k)) for k in range(train.RANK)]).alias("g"),
        F.sum((norm("x") * norm("v") + F.abs("rating")) * norm("v")).alias("size"))
    gradient = F.greatest(*[F.abs(part("g", k) + train.REG_PARAM * F.col("n_ratings") * part("x", k))
                            for k in range(train.RANK)])
    known = train.factors(old)[0].select("user_id", F.lit(False).alias("newcomer"))
    return sums.join(known, "user_id", "left").select(
        "user_id", "n_ratings", F.coalesce("newcomer", F.lit(True)).alias("newcomer"),
        (gradient <= 1e-5 * (1 + F.col("size"))).alias("solved"))


def q_model_roundtrip(spark, sf):
    """Factors of a fit against those read back from its files."""
    training, _ = _als_inputs(spark, sf, MODEL_COLS)
    model = train.fit(training)
    loaded = train.load(train.save(model, scratch_path(spark, "als")))

    def pairs(a, b, kind):
        return a.withColumnRenamed("features", "x").join(
            b.withColumnRenamed("features", "y"), "id", "full_outer").select(
            F.lit(kind).alias("kind"), F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))
    both = pairs(model.userFactors, loaded.userFactors, "user").unionByName(
        pairs(model.itemFactors, loaded.itemFactors, "item"))
    return both.agg(F.count_if(F.col("kind") == "user").alias("n_users"),
                    F.count_if(F.col("kind") == "item").alias("n_items"),
                    F.count_if(~F.col("same")).alias("n_changed"))


#: Model queries with their full values, which depend on the fit (bench, tests).
FULL = {name[5:]: f for name, f in list(globals().items()) if name.startswith("full_")}


QUERIES = {
    "parse_ratings": q_parse_ratings,
    "item_stats": q_item_stats,
    "parse_items": q_parse_items,
    "parse_rejects": q_parse_rejects,
    "parse_text_files": q_parse_text_files,
    "parse_posted": q_parse_posted,
    "posted_rejects": q_posted_rejects,
    "ratings_with_posts": q_ratings_with_posts,
    "positive_ratings": q_positive_ratings,
    "rating_stats": q_rating_stats,
    "item_counts": q_item_counts,
    "split_bucket": q_split_bucket,
    "split_hash": q_split_hash,
    "split_exact": q_split_exact,
    "split_sizes": q_split_sizes,
    "training_union": q_training_union,
    "training_union_presplit": q_training_union_presplit,
    "excluded_items": q_excluded_items,
    "candidate_items": q_candidate_items,
    "candidate_pairs": q_candidate_pairs,
    "unrated_pairs": q_unrated_pairs,
    "score_pairs": q_score_pairs,
    "enrich_predictions": q_enrich_predictions,
    "score_requested": q_score_requested,
    "hot_item_join": q_hot_item_join,
    "top_n_global": q_top_n_global,
    "popular_top_n": q_popular_top_n,
    "top_n_per_user": q_top_n_per_user,
    "unrated_top_n": q_unrated_top_n,
    "exclusion_sets": q_exclusion_sets,
    "pruned_top_n": q_pruned_top_n,
    "recommend_titles": q_recommend_titles,
    "recs_json": q_recs_json,
    "rmse": q_rmse,
    "rmse_pairwise": q_rmse_pairwise,
    "damped_mean_search": q_damped_mean_search,
    "select_best": q_select_best,
    "als_rmse": q_als_rmse,
    "als_score": q_als_score,
    "als_rmse_pairwise": q_als_rmse_pairwise,
    "als_score_requested": q_als_score_requested,
    "als_rank_search": q_als_rank_search,
    "als_select_best": q_als_select_best,
    "als_recommend": q_als_recommend,
    "als_recommend_subset": q_als_recommend_subset,
    "als_recommend_all": q_als_recommend_all,
    "als_pruned": q_als_pruned,
    "model_roundtrip": q_model_roundtrip,
    "als_refresh": q_als_refresh,
    "als_fold_in": q_als_fold_in,
    "report_sink": q_report_sink,
    "ratings_table": q_ratings_table,
    "stream_ingest": q_stream_ingest,
    "stream_item_stats": q_stream_item_stats,
    "stream_replayed_posts": q_stream_replayed_posts,
    "sketched_stats": q_sketched_stats,
}
