"""End-to-end similarity answers: similar songs for a text query, and
nearest songs for a list of names, with explicit outcome messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.predicates import contains_ci
from cadenza.operators import features as FE
from cadenza.operators import similarity as SIM
from cadenza.operators.lookup import first_by_name
from cadenza.schema import NO_INPUT, NO_MATCH, NOT_FOUND, RECOMMENDER_FEATURES, SIMILAR_FEATURES
from cadenza.session import checkpoint_dir


def with_outcome(result: DataFrame, message: str) -> DataFrame:
    """``result`` plus a ``message`` column; when ``result`` is empty a
    single row carrying only ``message`` is returned instead (an EXISTS
    subquery, no driver-side count)."""
    spark = result.sparkSession
    out = result.withColumn("message", F.lit(None).cast("string"))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in result.schema.fields]
    reason = (spark.range(1).select(*nulls, F.lit(message).alias("message"))
              .where(~result.exists()))
    return out.unionByName(reason)


def similar_songs(catalogue: DataFrame, song: str | None = None, artist: str | None = None,
                  id_col: str = "id", features: list[str] | None = None,
                  category: str | None = "genre", k: int = 5, n: int = 5,
                  regex: bool = False, candidates: str = "top_k") -> DataFrame:
    """Songs similar to the rows matching a song and/or artist text.

    Matches are standard-scaled (population std, fitted on the matches)
    plus a one-hot category; candidates are the union of every match's
    top ``k`` (self excluded); they are ranked by their mean similarity to
    all matches, best ``n`` kept.

    The candidate rule is quadratic in the number of matches.
    ``candidates="all"`` ranks every match by its mean similarity instead
    (linear; it can differ, since a row with a high mean may be in no
    match's top ``k``)."""
    spark = catalogue.sparkSession
    if not song and not artist:
        return spark.range(1).select(F.lit(NO_INPUT).alias("message"))
    m = catalogue
    if song:
        m = m.filter(contains_ci("song", song, regex))
    if artist:
        m = m.filter(contains_ci("artist", artist, regex))
    feats = features or SIMILAR_FEATURES
    # the matches (a subset of the catalogue) feed several branches: one
    # reliable checkpoint reads the catalogue once
    checkpoint_dir(spark)
    z = (FE.standardize(m, feats).withColumn("_vec", FE.assemble(*feats))
         .select(id_col, "song", "artist", "_vec", *([category] if category else []))
         .checkpoint(eager=True))
    ms = SIM.mean_similarity(z, id_col, "_vec", category_col=category)
    if candidates == "top_k":
        cand = (SIM.top_k_neighbours(z, id_col, "_vec", k, category_col=category)
                .select(F.col("rid").alias(id_col)).distinct())
        ms = ms.join(cand, id_col, "left_semi")
    elif candidates != "all":
        raise ValueError("candidates must be 'top_k' or 'all'")
    best = (SIM.top_n(ms, "mean_similarity", id_col, n)
            .select(id_col, "song", "artist", F.col("mean_similarity").alias("similarity_score")))
    return with_outcome(best, NO_MATCH)


def recommend(catalogue: DataFrame, names: DataFrame, n: int = 1, name_col: str = "song",
              id_col: str = "id", features: list[str] | None = None,
              result_cols: tuple[str, ...] = ("song", "artist", "genre"),
              req_col: str = "request") -> DataFrame:
    """For each requested name: its first catalogue row, then the ``n``
    most similar other rows on min-max scaled features (missing -> 0).
    Unknown names get an error text. Work is O(requests x catalogue)."""
    feats = features or RECOMMENDER_FEATURES
    scaled = FE.minmax(catalogue, feats).withColumn("_vec", FE.assemble(*feats))
    req = names.select(req_col).distinct()
    # only the requested names are reduced to their first row (a semi join
    # against the small request list, before the aggregate)
    asked = scaled.select(name_col, id_col, "_vec").join(
        req.withColumnRenamed(req_col, name_col), name_col, "left_semi")
    first = first_by_name(asked, name_col, id_col)
    # the matched requests (bounded by the request list) feed three
    # branches; one reliable checkpoint keeps the catalogue from being
    # scanned again for each of them
    checkpoint_dir(catalogue.sparkSession)
    hits = (req.join(first, F.col(req_col) == F.col(name_col), "inner")
            .select(req_col, id_col, "_vec").checkpoint(eager=True))
    nb = SIM.top_k_neighbours(scaled, id_col, "_vec", n, queries=hits.select(id_col, "_vec"))
    attrs = catalogue.select(F.col(id_col).alias("rid"), *[F.col(c).alias(f"recommended_{c}")
                                                          for c in result_cols])
    found = (hits.select(req_col, F.col(id_col).alias("qid"))
             .join(nb, "qid").join(attrs, "rid")
             .select(req_col, "rank", *[f"recommended_{c}" for c in result_cols],
                     F.col("score").alias("similarity_score"),
                     F.lit(None).cast("string").alias("error")))
    missing = (req.join(hits.select(req_col), req_col, "left_anti")
               .select(req_col, F.lit(None).cast("int").alias("rank"),
                       *[F.lit(None).cast("string").alias(f"recommended_{c}") for c in result_cols],
                       F.lit(None).cast("double").alias("similarity_score"),
                       F.lit(NOT_FOUND).alias("error")))
    return found.unionByName(missing)


def similar_record(result: DataFrame, song: str | None, artist: str | None,
                   source: str = "WEBAPP") -> DataFrame:
    """The stored similar-songs record: one row with the request and the
    list of {song, artist, similarity_score} (at most ``n`` entries, in
    score order), or the outcome message when there was no answer."""
    items = F.struct("song", "artist", "similarity_score")
    ranked = result.filter(F.col("message").isNull()) if "message" in result.columns else result
    rec = ranked.agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("similarity_score")).alias("_k"), items.alias("_v")))).alias("_l"))
    out = rec.select(F.lit(song).cast("string").alias("reference_song"),
                     F.lit(artist).cast("string").alias("reference_artist"),
                     F.transform("_l", lambda e: e["_v"]).alias("similar_songs"),
                     F.lit(source).alias("source"),
                     F.current_timestamp().alias("created_at"))
    if "message" in result.columns:
        out = out.withColumn("message", result.agg(F.max("message")).scalar())
    return out


def recommend_record(result: DataFrame, req_col: str = "request",
                     result_cols: tuple[str, ...] = ("song", "artist", "genre")) -> DataFrame:
    """The stored recommendation record of one request batch: the list of
    requested names and a map name -> best result (or its error). Nesting
    is bounded by the request list (one entry per distinct name)."""
    best = result.filter(F.col("rank").isNull() | (F.col("rank") == 1))
    value = F.struct(*[F.col(f"recommended_{c}").alias(f"recommended_{c}") for c in result_cols],
                     "similarity_score", "error")
    return (best.agg(F.sort_array(F.collect_list(F.col(req_col))).alias("input_songs"),
                     F.map_from_entries(F.collect_list(F.struct(F.col(req_col), value))).alias("output"))
            .withColumn("created_at", F.current_timestamp()))
