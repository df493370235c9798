"""Scaling and similarity plans on ``embeddings`` (all vectors, 64-d) and
``part`` (size and price as numeric features, type as the category)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import features as FE
from cadenza.operators import similarity as SIM
from cadenza.plans.registry import plan
from cadenza.tables import table

R = 6  # output rounding of scores

_SCALED_SQL = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT vec_id, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i FROM e),
b AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i),
s AS (SELECT x.vec_id, list(CASE WHEN hi = lo THEN x - lo ELSE (x - lo) / (hi - lo) END ORDER BY x.i) AS v
      FROM x JOIN b ON x.i = b.i GROUP BY x.vec_id)"""

_COS_SQL = """CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0
      ELSE list_cosine_similarity({a}, {b}) END"""


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def _scaled_emb(spark, sf):
    return FE.minmax_array(_emb(spark, sf), "embedding")


@plan("cosine_pairs", f"""
SELECT a.vec_id, b.vec_id AS next_id,
       round({_COS_SQL.format(a='a.embedding::DOUBLE[]', b='b.embedding::DOUBLE[]')}, {R}) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf):
    e = _emb(spark, sf)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"),
                   F.col("embedding").alias("next_vec"))
    return (e.join(nxt, "vec_id")
            .select("vec_id", "next_id", F.round(SIM.cosine("embedding", "next_vec"), R).alias("cosine")))


def _topk_sql(src: str, k: int, extra: str = "") -> str:
    return f"""
p AS (SELECT a.vec_id, b.vec_id AS rid, {_COS_SQL.format(a='a.v', b='b.v')} AS c
      FROM {src} a JOIN {src} b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, rid) AS rk FROM p)
SELECT r.vec_id, {extra} round(r.c, {R}) AS score FROM r WHERE rk <= {k}"""


@plan("nearest_item", "WITH " + _SCALED_SQL + "," + _topk_sql(
    "s", 1, "r.rid AS nearest_id, (SELECT label FROM embeddings z WHERE z.vec_id = r.rid) AS nearest_label,"))
def nearest_item(spark, sf):
    s = _scaled_emb(spark, sf)
    nb = SIM.nearest(s, "vec_id", "embedding")
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("rid"),
                                                   F.col("label").alias("nearest_label"))
    return (nb.join(labels, "rid")
            .select(F.col("qid").alias("vec_id"), F.col("rid").alias("nearest_id"), "nearest_label",
                    F.round("score", R).alias("score")))


@plan("recommend_n", "WITH " + _SCALED_SQL + "," + _topk_sql("s", 2, "r.rk AS rank, r.rid AS neighbour_id,"))
def recommend_n(spark, sf):
    nb = SIM.top_k_neighbours(_scaled_emb(spark, sf), "vec_id", "embedding", 2)
    return nb.select(F.col("qid").alias("vec_id"), "rank", F.col("rid").alias("neighbour_id"),
                     F.round("score", R).alias("score"))


_RAW_SQL = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


def _raw_top5(spark, sf):
    return SIM.top_k_neighbours(_emb(spark, sf), "vec_id", "embedding", 5)


@plan("similar_top_k", "WITH " + _RAW_SQL + "," + _topk_sql("e", 5, "r.rk AS rank, r.rid AS neighbour_id,"))
def similar_top_k(spark, sf):
    return _raw_top5(spark, sf).select(F.col("qid").alias("vec_id"), "rank",
                                       F.col("rid").alias("neighbour_id"),
                                       F.round("score", R).alias("score"))


@plan("similar_candidates", f"""
WITH {_RAW_SQL},
p AS (SELECT a.vec_id, b.vec_id AS rid, {_COS_SQL.format(a='a.v', b='b.v')} AS c
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, rid) AS rk FROM p)
SELECT DISTINCT rid AS neighbour_id FROM r WHERE rk <= 5""")
def similar_candidates(spark, sf):
    return _raw_top5(spark, sf).select(F.col("rid").alias("neighbour_id")).distinct()


@plan("explode_nested", "WITH " + _RAW_SQL + "," + _topk_sql("e", 5, "r.rk AS pos, r.rid AS neighbour_id,"))
def explode_nested(spark, sf):
    nb = _raw_top5(spark, sf)
    # nested result per item (bounded by k), as stored by the similar-items table
    nested = nb.groupBy("qid").agg(F.collect_list(F.struct("rank", "rid", "score")).alias("similar"))
    return (nested.select(F.col("qid").alias("vec_id"), F.explode("similar").alias("s"))
            .select("vec_id", F.col("s.rank").alias("pos"), F.col("s.rid").alias("neighbour_id"),
                    F.round("s.score", R).alias("score")))


@plan("similar_by_mean", f"""
WITH {_RAW_SQL},
m AS (SELECT a.vec_id, avg({_COS_SQL.format(a='a.v', b='b.v')}) AS score FROM e a, e b GROUP BY a.vec_id)
SELECT vec_id, round(score, {R}) AS score FROM m ORDER BY round(score, 9) DESC, vec_id LIMIT 5""")
def similar_by_mean(spark, sf):
    ms = SIM.mean_similarity(_emb(spark, sf), "vec_id", "embedding")
    return (SIM.top_n(ms, "mean_similarity", "vec_id", 5)
            .select("vec_id", F.round("mean_similarity", R).alias("score")))


# --- part: standard-scaled size and price plus one-hot type --------------
def _part_pairs_sql(where: str, part: str = "part") -> str:
    return f"""
m AS (SELECT * FROM {part} {where}),
st AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp,
              stddev_pop(p_retailprice) AS sp FROM m),
z AS (SELECT p_partkey, p_name, p_brand, p_type,
             (p_size - ms) / CASE WHEN ss = 0 THEN 1 ELSE ss END AS z1,
             (p_retailprice - mp) / CASE WHEN sp = 0 THEN 1 ELSE sp END AS z2 FROM m, st),
pr AS (SELECT a.p_partkey AS q, b.p_partkey AS r,
              (a.z1 * b.z1 + a.z2 * b.z2 + CASE WHEN a.p_type IS NOT DISTINCT FROM b.p_type THEN 1 ELSE 0 END)
              / (sqrt(a.z1 * a.z1 + a.z2 * a.z2 + 1) * sqrt(b.z1 * b.z1 + b.z2 * b.z2 + 1)) AS c
       FROM z a, z b)"""


def _part_vectors(p):
    z = FE.standardize(p, ["p_size", "p_retailprice"])
    return z.withColumn("vec", FE.assemble("p_size", "p_retailprice"))


@plan("similar_full", "WITH " + _part_pairs_sql("WHERE contains(lower(p_name), 'ring')") + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, r) AS k FROM pr WHERE q <> r),
cand AS (SELECT DISTINCT r FROM rk WHERE k <= 5),
ms AS (SELECT r, avg(c) AS score FROM pr GROUP BY r)
SELECT z.p_partkey, z.p_name, z.p_brand, round(ms.score, {R}) AS score
FROM cand JOIN ms ON cand.r = ms.r JOIN z ON z.p_partkey = cand.r
ORDER BY round(ms.score, 9) DESC, z.p_partkey LIMIT 5""")
def similar_full(spark, sf):
    from cadenza.operators.recommend import similar_songs
    songs = table(spark, sf, "part").withColumnsRenamed({"p_name": "song", "p_brand": "artist", "p_type": "genre"})
    best = similar_songs(songs, song="ring", id_col="p_partkey", features=["p_size", "p_retailprice"])
    return best.filter(F.col("message").isNull()).select(
        "p_partkey", F.col("song").alias("p_name"), F.col("artist").alias("p_brand"),
        F.round("similarity_score", R).alias("score"))


@plan("one_hot_dot", "WITH " + _part_pairs_sql("") + f"""
SELECT q AS p_partkey, round(avg(c), {R}) AS score FROM pr GROUP BY q""")
def one_hot_dot(spark, sf):
    z = _part_vectors(table(spark, sf, "part"))
    ms = SIM.mean_similarity(z, "p_partkey", "vec", category_col="p_type")
    return ms.select("p_partkey", F.round("mean_similarity", R).alias("score"))


_NULL_TYPES_SQL = "(SELECT * REPLACE (CASE WHEN p_size < 10 THEN NULL ELSE p_type END AS p_type) FROM part)"


@plan("one_hot_dot_nulls", "WITH " + _part_pairs_sql("", _NULL_TYPES_SQL) + f"""
SELECT q AS p_partkey, round(avg(c), {R}) AS score FROM pr GROUP BY q""")
def one_hot_dot_nulls(spark, sf):
    """Items without a category share one."""
    part = table(spark, sf, "part").withColumn("p_type", F.when(F.col("p_size") >= 10, F.col("p_type")))
    ms = SIM.mean_similarity(_part_vectors(part), "p_partkey", "vec", category_col="p_type")
    return ms.select("p_partkey", F.round("mean_similarity", R).alias("score"))


@plan("minmax_scale", f"""
SELECT p_partkey,
  round((p_size - min(p_size) OVER ()) / CASE WHEN max(p_size) OVER () = min(p_size) OVER () THEN 1
        ELSE max(p_size) OVER () - min(p_size) OVER () END, {R}) AS p_size_scaled,
  round((p_retailprice - min(p_retailprice) OVER ()) / CASE WHEN max(p_retailprice) OVER () = min(p_retailprice) OVER () THEN 1
        ELSE max(p_retailprice) OVER () - min(p_retailprice) OVER () END, {R}) AS p_retailprice_scaled
FROM part""")
def minmax_scale(spark, sf):
    s = FE.minmax(table(spark, sf, "part"), ["p_size", "p_retailprice"], suffix="_scaled")
    return s.select("p_partkey", F.round("p_size_scaled", R).alias("p_size_scaled"),
                    F.round("p_retailprice_scaled", R).alias("p_retailprice_scaled"))


@plan("standard_scale", f"""
SELECT p_partkey,
  round((p_size - avg(p_size) OVER ()) / CASE WHEN stddev_pop(p_size) OVER () = 0 THEN 1 ELSE stddev_pop(p_size) OVER () END, {R}) AS p_size_scaled,
  round((p_retailprice - avg(p_retailprice) OVER ()) / CASE WHEN stddev_pop(p_retailprice) OVER () = 0 THEN 1 ELSE stddev_pop(p_retailprice) OVER () END, {R}) AS p_retailprice_scaled
FROM part""")
def standard_scale(spark, sf):
    s = FE.standardize(table(spark, sf, "part"), ["p_size", "p_retailprice"], suffix="_scaled")
    return s.select("p_partkey", F.round("p_size_scaled", R).alias("p_size_scaled"),
                    F.round("p_retailprice_scaled", R).alias("p_retailprice_scaled"))


@plan("recommend_names", f"""
WITH st AS (SELECT min(p_size) AS s0, max(p_size) AS s1, min(p_retailprice) AS r0, max(p_retailprice) AS r1 FROM part),
sc AS (SELECT p_partkey, p_name, p_brand, p_type,
              (p_size - s0) / CASE WHEN s1 = s0 THEN 1 ELSE s1 - s0 END AS x,
              (p_retailprice - r0) / CASE WHEN r1 = r0 THEN 1 ELSE r1 - r0 END AS y FROM part, st),
req AS (SELECT DISTINCT request FROM (SELECT p_name AS request FROM part
                                      WHERE p_partkey IN (SELECT l_partkey FROM lineitem)
                                      UNION ALL SELECT s_name FROM supplier)),
first AS (SELECT p_name, min(p_partkey) AS qid FROM part GROUP BY p_name),
q AS (SELECT req.request, first.qid, sc.x, sc.y FROM req JOIN first ON req.request = first.p_name
      JOIN sc ON sc.p_partkey = first.qid),
pr AS (SELECT q.request, sc.p_partkey AS rid, sc.p_name, sc.p_brand, sc.p_type,
              CASE WHEN (q.x * q.x + q.y * q.y) = 0 OR (sc.x * sc.x + sc.y * sc.y) = 0 THEN 0.0
                   ELSE (q.x * sc.x + q.y * sc.y) / (sqrt(q.x * q.x + q.y * q.y) * sqrt(sc.x * sc.x + sc.y * sc.y)) END AS c
       FROM q JOIN sc ON sc.p_partkey <> q.qid),
rk AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY round(c, 9) DESC, rid) AS rank FROM pr)
SELECT request, rank, p_name AS recommended_p_name, p_brand AS recommended_p_brand,
       p_type AS recommended_p_type, round(c, {R}) AS similarity_score, CAST(NULL AS VARCHAR) AS error
FROM rk WHERE rank <= 2
UNION ALL
SELECT request, CAST(NULL AS BIGINT), NULL, NULL, NULL, CAST(NULL AS DOUBLE), 'Song not found'
FROM req WHERE request NOT IN (SELECT p_name FROM part)""")
def recommend_names(spark, sf):
    from cadenza.operators.recommend import recommend
    part = table(spark, sf, "part")
    ordered = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    names = (part.join(ordered, "p_partkey", "left_semi").select(F.col("p_name").alias("request"))
             .unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("request"))))
    r = recommend(part, names, n=2, name_col="p_name", id_col="p_partkey",
                  features=["p_size", "p_retailprice"], result_cols=("p_name", "p_brand", "p_type"))
    return r.withColumn("similarity_score", F.round("similarity_score", R))
