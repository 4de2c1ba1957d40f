"""Driver queries: vectors and cluster scores (step 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketlake.functions.scalar import l2_normalise
from ticketlake.operators import vectors as vx
from ticketlake.plans.registry import query
from ticketlake.sources.tables import table

_NORMED = """
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm
  FROM embeddings"""

_LONG = """
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos
  FROM embeddings"""


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query("nearest_vector", sql=f"""
WITH n AS ({_NORMED}),
s AS (SELECT a.vec_id, b.vec_id AS bid, list_dot_product(a.e, b.e) / (a.nrm * b.nrm + 1e-8) AS score
      FROM n a JOIN n b ON a.vec_id <> b.vec_id)
SELECT vec_id, arg_max(bid, (score, -bid)) AS best_id, max(score) AS score FROM s GROUP BY vec_id""")
def nearest_vector(spark, sf_dir):
    """Every vector's nearest other vector by cosine (ties: lowest id)."""
    e = _emb(spark, sf_dir)
    return vx.nearest(e.withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "kid"),
                      qid="qid", kid="kid", exclude_self=True).withColumnRenamed("qid", "vec_id")


@query("pair_cosine", sql=f"""
WITH n AS ({_NORMED})
SELECT a.vec_id, list_dot_product(a.e, b.e) / (a.nrm * b.nrm + 1e-8) AS cosine
FROM n a JOIN n b ON b.vec_id = a.vec_id + 1""")
def pair_cosine(spark, sf_dir):
    """Agreement of two answers of one query — here vector i and vector i + 1."""
    e = _emb(spark, sf_dir)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vx.pair_cosine(e, nxt, "vec_id", "embedding", "other")


@query("l2_normalise", sql=f"""
WITH n AS ({_NORMED})
SELECT vec_id, pos - 1 AS pos, e[pos] / (nrm + 1e-12) AS x
FROM (SELECT *, generate_subscripts(e, 1) AS pos FROM n)""")
def l2_normalise_q(spark, sf_dir):
    """unit vectors (x / (|x| + 1e-12)), in long form."""
    e = _emb(spark, sf_dir).select("vec_id", l2_normalise("embedding").alias("n"))
    return e.select("vec_id", F.posexplode("n").alias("pos", "x"))


@query("mean_vector", sql=f"""
SELECT label, pos, avg(x) AS mean FROM ({_LONG}) GROUP BY label, pos""")
def mean_vector(spark, sf_dir):
    """Mean (pooled) vector per label, long form."""
    return vx.mean_vector(_emb(spark, sf_dir), "label", "embedding")


@query("silhouette", sql=f"""
WITH l AS ({_LONG}),
d AS (SELECT a.vec_id AS i, a.label AS ci, b.label AS cj, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dist
      FROM l a JOIN l b ON a.pos = b.pos GROUP BY a.vec_id, a.label, b.vec_id, b.label),
per AS (SELECT i, ci, cj, sum(dist) AS dsum, count(*) AS cnt FROM d GROUP BY i, ci, cj),
a AS (SELECT i, cnt AS n_own, CASE WHEN cnt > 1 THEN dsum / (cnt - 1) END AS a FROM per WHERE ci = cj),
b AS (SELECT i, min(dsum / cnt) AS b FROM per WHERE ci <> cj GROUP BY i),
s AS (SELECT CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0
                  ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END AS s
      FROM a LEFT JOIN b USING (i)),
n AS (SELECT count(*)::BIGINT AS n_points, count(DISTINCT label)::BIGINT AS n_clusters FROM embeddings)
SELECT CASE WHEN n_clusters >= 2 AND n_clusters <= n_points - 1 THEN (SELECT avg(s) FROM s)
            ELSE 'nan'::DOUBLE END AS silhouette, n_points, n_clusters FROM n""")
def silhouette(spark, sf_dir):
    """Exact Euclidean silhouette of the given labels."""
    return vx.silhouette(_emb(spark, sf_dir), "vec_id", "label", "embedding")


@query("davies_bouldin", sql=f"""
WITH l AS ({_LONG}),
c AS (SELECT label, pos, avg(x) AS c FROM l GROUP BY label, pos),
d AS (SELECT l.vec_id, l.label, sqrt(sum((l.x - c.c) * (l.x - c.c))) AS d
      FROM l JOIN c USING (label, pos) GROUP BY l.vec_id, l.label),
sp AS (SELECT label, avg(d) AS s FROM d GROUP BY label),
m AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m
      FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY a.label, b.label),
r AS (SELECT m.i, CASE WHEN m.m = 0 THEN 0.0 ELSE (si.s + sj.s) / m.m END AS r
      FROM m JOIN sp si ON si.label = m.i JOIN sp sj ON sj.label = m.j),
per_i AS (SELECT i, max(r) AS d_i FROM r GROUP BY i)
SELECT CASE WHEN (SELECT count(*) FROM sp) < 2 THEN 'nan'::DOUBLE
            WHEN (SELECT max(s) FROM sp) = 0 OR (SELECT max(m) FROM m) = 0 THEN 0.0
            ELSE (SELECT avg(d_i) FROM per_i) END AS davies_bouldin,
       (SELECT count(*) FROM sp)::BIGINT AS n_clusters""")
def davies_bouldin(spark, sf_dir):
    """Davies-Bouldin index of the given labels."""
    return vx.davies_bouldin(_emb(spark, sf_dir), "vec_id", "label", "embedding")


@query("knn_same_class", sql="""
SELECT vec_id, nb_rank, nb_id, dist FROM (
  SELECT a.vec_id, b.vec_id AS nb_id,
         list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist,
         row_number() OVER (PARTITION BY a.vec_id
                            ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),
                                     b.vec_id) AS nb_rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
WHERE nb_rank <= 5""")
def knn_same_class(spark, sf_dir):
    """ML9 neighbours: the 5 nearest same-class vectors of every vector."""
    return vx.knn_same_class(_emb(spark, sf_dir), "vec_id", "label", "embedding", 5)


@query("masked_mean_vector", sql=f"""
WITH m AS (SELECT vec_id, CASE WHEN embedding[1] > 0 THEN 1.0 ELSE 0.0 END AS mask FROM embeddings)
SELECT label, pos, sum(x * mask) / greatest(sum(mask), 1e-9) AS mean FROM ({_LONG}) JOIN m USING (vec_id)
GROUP BY label, pos""")
def masked_mean_vector(spark, sf_dir):
    """A19 with a mask: vectors whose first component is positive count, others do not."""
    e = _emb(spark, sf_dir).withColumn("mask", F.when(F.col("embedding")[0] > 0, 1.0).otherwise(0.0))
    return vx.mean_vector(e, "label", "embedding", mask="mask")


@query("silhouette_sampled", sql="""
SELECT count(*)::BIGINT AS n_points, count(DISTINCT label)::BIGINT AS n_clusters, true AS scored_a_part, true AS within_3_errors
FROM embeddings WHERE embedding IS NOT NULL""")
def silhouette_sampled(spark, sf_dir):
    """A15 with ``sample_size``: 150 points scored against all; the exact value lies within
    three of the stated standard errors."""
    e = table(spark, sf_dir, "embeddings")
    part = vx.silhouette(e, "vec_id", "label", "embedding", sample_size=150)
    exact = vx.silhouette(e, "vec_id", "label", "embedding").select(F.col("silhouette").alias("exact"))
    return part.join(exact, how="left").select(
        "n_points", "n_clusters", (F.col("n_scored") < F.col("n_points")).alias("scored_a_part"),
        (F.abs(F.col("silhouette") - F.col("exact")) <= 3 * F.col("standard_error")).alias("within_3_errors"))
