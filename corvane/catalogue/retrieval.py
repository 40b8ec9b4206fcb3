"""Dense retrieval, blends, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalogue.registry import query, r6
from corvane.functions.text import recall_at
from corvane.functions.vectors import dot, l2_normalize, minmax, pool
from corvane.operators import retrieve
from corvane.operators.graph import ranked_neighbours, synonymy_edges
from corvane.operators.topk import argmax_match, block_topk, scored, top
from corvane.session import table

#: Similarity from which synthetic vectors count as neighbours.
NEAR = 0.30
_S0 = """s AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score
 FROM embeddings)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(v):
    """The stated query set of searches: every vector whose id is divisible by 50."""
    return v.filter("id % 50 = 0")


def first(v):
    return v.filter("id = 0")


@query("dense_topk", f"WITH {_S0} SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def dense_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return top(scored(v, first(v)), 10).select("id", r6("score", "score"))


@query(
    "dense_minmax",
    f"""WITH {_S0}, n AS (SELECT id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS score FROM s)
    SELECT id, round(score, 6) AS score FROM n ORDER BY n.score DESC, id LIMIT 10""",
)
def dense_minmax(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return top(minmax(scored(v, first(v)), "score"), 10).select("id", r6("score", "score"))


_PER_QUERY = """p AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
 a.label AS qlabel, b.label AS label FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM p)"""


@query("dense_topk_per_query", f"WITH {_PER_QUERY} SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM t WHERE rank <= 10")
def dense_topk_per_query(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return block_topk(asked(v), v, 10).select("qid", "id", "rank", r6("score", "score"))


_KNN = f"""e AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r
 FROM e WHERE score >= {NEAR}e0), knn AS (SELECT least(qid, id) AS src, greatest(qid, id) AS dst,
 least(0.999999e0, greatest({NEAR}e0, max(score))) AS weight FROM k WHERE r <= 5 GROUP BY 1, 2)"""


def knn(spark, sf_dir):
    return synonymy_edges(vectors(spark, sf_dir), NEAR, 5)


@query("knn_synonymy_edges", f"WITH {_KNN} SELECT src, dst, round(weight, 6) AS weight FROM knn")
def knn_synonymy_edges(spark, sf_dir):
    return knn(spark, sf_dir).select("src", "dst", r6("weight", "weight"))


@query("argmax_match", f"WITH {_PER_QUERY} SELECT qid, id, round(score, 6) AS score FROM t WHERE rank = 1 AND score >= {NEAR}e0")
def argmax(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return argmax_match(asked(v), v, NEAR).select("qid", "id", r6("score", "score"))


@query("seed_cap", f"WITH {_S0} SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 200")
def seed_cap(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return top(scored(v, first(v)), 200).select("id", r6("score", "score"))


@query(
    "score_floor",
    f"""WITH {_S0}, t AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 10)
    SELECT id, round(score, 6) AS score FROM t WHERE t.score >= {NEAR}e0 AND t.score > 0""",
)
def score_floor(spark, sf_dir):
    """The cut to k comes before the floors, so fewer than k rows may come back."""
    v = vectors(spark, sf_dir)
    return top(scored(v, first(v)), 10).filter((F.col("score") >= NEAR) & (F.col("score") > 0)).select("id", r6("score", "score"))


@query(
    "ablation_parity",
    f"""WITH {_S0}, t AS (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10)
    SELECT system, id, round(score, 6) AS score FROM t CROSS JOIN (VALUES ('dense'), ('graph'), ('paths')) AS x(system)""",
)
def ablation_parity(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return retrieve.ablation(v, first(v), 10).select("system", "id", r6("score", "score"))


@query(
    "recall_at_k",
    f"""WITH {_PER_QUERY}, g AS (SELECT a.vec_id AS qid, count(*) FILTER (WHERE b.vec_id IS NOT NULL) AS gold FROM embeddings a
      LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1),
      f AS (SELECT qid, count(*) FILTER (WHERE qlabel = label AND rank <= 2) AS f2, count(*) FILTER (WHERE qlabel = label AND rank <= 5) AS f5,
      count(*) FILTER (WHERE qlabel = label AND rank <= 10) AS f10 FROM t WHERE rank <= 10 GROUP BY qid)
    SELECT g.qid, CASE WHEN gold = 0 THEN 0e0 ELSE round(f2 / gold, 6) END AS recall_2, CASE WHEN gold = 0 THEN 0e0 ELSE round(f5 / gold, 6) END AS recall_5,
      CASE WHEN gold = 0 THEN 0e0 ELSE round(f10 / gold, 6) END AS recall_10 FROM g JOIN f USING (qid)""",
)
def recall_at_k(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = block_topk(asked(v), v, 10).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    gold = asked(v).select(F.col("id").alias("qid"), "label").join(v.select("id", "label"), ["label"]).filter("id <> qid")
    gold = gold.groupBy("qid").agg(F.collect_set("id").alias("gold"))
    both = found.join(gold, ["qid"], "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<long>")))
    return both.select("qid", *[r6(recall_at(F.col("r.id"), F.col("gold"), k), f"recall_{k}") for k in (2, 5, 10)])


@query(
    "l2_normalize",
    """WITH s AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings),
      n AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM s)
    SELECT id, round(list_dot_product(u, u), 6) AS size, round(list_sum(u), 6) AS total FROM n""",
)
def l2(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.transform("vector", lambda x: x.cast("double") * (F.col("label") + 1)).alias("v"))
    u = v.select("id", l2_normalize(F.col("v")).alias("u"))
    return u.select("id", r6(dot(F.col("u"), F.col("u")), "size"), r6(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), "total"))


_PAIR = """p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
 c AS (SELECT p.*, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM p WHERE b IS NOT NULL)"""
_POOLED = """SELECT id, round(list_dot_product(u, q) / greatest(sqrt(list_dot_product(u, u)), 1e-12), 6) AS score FROM m"""
_POOLS = {
    "average": "list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2)",
    "weighted_average": "list_transform(list_zip(a, b), lambda z: z[1] / 3e0 + z[2] * 2e0 / 3e0)",
    "max_pool": "list_transform(list_zip(a, b), lambda z: CASE WHEN abs(z[2]) > abs(z[1]) THEN z[2] ELSE z[1] END)",
    "attention": "list_transform(list_zip(a, b), lambda z: (z[1] * exp(list_dot_product(a, q)) + z[2] * exp(list_dot_product(b, q))) / (exp(list_dot_product(a, q)) + exp(list_dot_product(b, q))))",
}


def _pooled(how):
    def run(spark, sf_dir):
        """Each vector with the next of its label, pooled, against the first vector."""
        v = vectors(spark, sf_dir)
        pairs = retrieve.next_pairs(v)
        q = first(v).select(F.col("vector").alias("q"))
        return pairs.join(F.broadcast(q)).select("id", r6(dot(pool(F.array("a", "b"), how, F.col("q")), F.col("q")), "score"))

    return run


for _name, _how in (("pool_average", "average"), ("pool_weighted", "weighted_average"), ("pool_max", "max_pool"), ("pool_attention", "attention")):
    query(_name, f"WITH {_PAIR}, m AS (SELECT id, q, {_POOLS[_how]} AS u FROM c) {_POOLED}")(_pooled(_how))


@query(
    "local_search_blend",
    f"""WITH {_S0}, m AS (SELECT id, score FROM s WHERE score >= 0.2e0 ORDER BY score DESC, id LIMIT 10),
      prov AS (SELECT m.id, e.label AS chunk, m.score FROM m JOIN embeddings e ON e.vec_id = m.id), {_KNN},
      rel AS (SELECT x.chunk FROM prov x JOIN knn ON x.id = knn.src JOIN prov y ON y.id = knn.dst),
      g AS (SELECT chunk, sum(s) AS g FROM (SELECT chunk, score AS s FROM prov UNION ALL SELECT chunk, 0.5e0 FROM rel) GROUP BY chunk),
      d AS (SELECT e.label AS chunk, max(s.score) AS d FROM s JOIN embeddings e ON e.vec_id = s.id GROUP BY 1),
      b AS (SELECT d.chunk, coalesce(g.g, 0e0) AS g, d.d FROM d LEFT JOIN g USING (chunk)),
      n AS (SELECT chunk, CASE WHEN max(g) OVER () - min(g) OVER () < 1e-12 THEN 0e0 ELSE (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) END
        + 0.5e0 * CASE WHEN max(d) OVER () - min(d) OVER () < 1e-12 THEN 0e0 ELSE (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) END AS score FROM b)
    SELECT chunk, round(score, 6) AS score FROM n ORDER BY n.score DESC, chunk LIMIT 10""",
)
def local_search_blend(spark, sf_dir):
    v = vectors(spark, sf_dir)
    sims = scored(v, first(v))
    provenance = v.select("id", F.array("label").alias("chunks"))
    relations = knn(spark, sf_dir).join(v.select(F.col("id").alias("src"), F.array("label").alias("chunks")), ["src"]).select("src", "dst", "chunks")
    dense = sims.join(v.select("id", "label"), ["id"]).groupBy(F.col("label").alias("chunk")).agg(F.max("score").alias("dense"))
    found = retrieve.local_search(sims, provenance, relations, dense, floor=0.2)
    return found.select("chunk", r6("score", "score"))


@query(
    "ranked_neighbours",
    f"""WITH {_KNN}, b AS (SELECT src AS id, dst AS other, weight FROM knn UNION ALL SELECT dst, src, weight FROM knn),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, other) AS INTEGER) AS rank FROM b)
    SELECT id, other, round(weight, 6) AS weight, rank FROM r WHERE rank <= 3""",
)
def neighbours(spark, sf_dir):
    return ranked_neighbours(knn(spark, sf_dir), 3).select("id", "other", r6("weight", "weight"), "rank")
