"""Metric tables and stratified samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalogue.registry import query, r6
from corvane.operators import evaluate
from corvane.session import table

_RES = "r AS (SELECT d.source AS system, d.lang AS qtype, l.quality::DOUBLE AS em, l.toxic::DOUBLE AS f1, d.n_chars::DOUBLE AS latency FROM documents d LEFT JOIN labels l USING (doc_id))"


def results(spark, sf_dir):
    """Labelled documents stand for scored answers; documents without labels miss their scores."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    both = d.join(lab, ["doc_id"], "left")
    return both.select(
        F.col("source").alias("system"), F.col("lang").alias("qtype"), F.col("quality").cast("double").alias("em"), F.col("toxic").cast("double").alias("f1"),
        F.col("n_chars").cast("double").alias("latency"),
    )


_MEANS = "CAST(count(*) AS BIGINT) AS n, round(avg(coalesce(em, 0)), 6) AS em, round(avg(coalesce(f1, 0)), 6) AS f1"


@query("system_metrics", f"WITH {_RES} SELECT system, {_MEANS}, round(avg(latency), 6) AS latency FROM r GROUP BY 1")
def system_metrics(spark, sf_dir):
    m = evaluate.system_metrics(results(spark, sf_dir), "system")
    return m.select("system", "n", r6("em", "em"), r6("f1", "f1"), r6("latency", "latency"))


@query("metrics_by_type", f"WITH {_RES} SELECT system, qtype, {_MEANS} FROM r GROUP BY GROUPING SETS ((system), (system, qtype))")
def metrics_by_type(spark, sf_dir):
    return evaluate.metrics_both(results(spark, sf_dir)).select("system", "qtype", "n", r6("em", "em"), r6("f1", "f1"))


@query(
    "type_pivot",
    f"""WITH {_RES} SELECT qtype, {", ".join(f"coalesce(printf('%.3f', avg(coalesce(em, 0)) FILTER (WHERE system = 'src{k}')), '-') AS src{k}" for k in range(3))} FROM r GROUP BY 1""",
)
def type_pivot(spark, sf_dir):
    r = results(spark, sf_dir).withColumn("em", F.coalesce("em", F.lit(0.0)))
    names = [f"src{k}" for k in range(3)]
    p = r.groupBy("qtype").pivot("system", names).agg(F.avg("em"))
    return p.select("qtype", *[F.when(F.col(n).isNull(), "-").otherwise(F.format_string("%.3f", n)).alias(n) for n in names])


@query("type_counts", "SELECT o_orderpriority AS type, CAST(count(*) AS BIGINT) AS n, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority)::BIGINT AS place FROM orders GROUP BY 1")
def type_counts(spark, sf_dir):
    order = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("type")).agg(F.count("*").alias("n"))
    return n.select("type", "n", F.nullif(F.array_position(order, F.col("type")), F.lit(0)).alias("place"))


_ALLOC = """c AS (SELECT lang AS type, count(*) AS count FROM documents GROUP BY 1), b AS (SELECT type, count, floor(count * 50e0 / (SELECT sum(count) FROM c) + 1e-9)::BIGINT AS base, count * 50e0 / (SELECT sum(count) FROM c) AS raw FROM c),
 a AS (SELECT type, count, least(base + CASE WHEN row_number() OVER (ORDER BY round(raw - base, 9) DESC, type) <= 50 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END, count) AS alloc FROM b)"""


def strata(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"))


@query("stratified_alloc", f"WITH {_ALLOC} SELECT type, CAST(count AS BIGINT) AS count, CAST(alloc AS BIGINT) AS alloc FROM a")
def stratified_alloc(spark, sf_dir):
    return evaluate.allocate(strata(spark, sf_dir).groupBy("type").count(), 50)


def _pick(rows: str, alloc: str, seed: int) -> str:
    return f"(SELECT r.id, r.type FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY md5('{seed}|' || id), id) AS k FROM {rows}) r JOIN {alloc} x USING (type) WHERE k <= alloc)"


_ROWS = "d AS (SELECT doc_id AS id, lang AS type FROM documents)"


@query("stratified_sample", f"WITH {_ALLOC}, {_ROWS} SELECT id, type FROM {_pick('d', 'a', 42)}")
def stratified_sample(spark, sf_dir):
    return evaluate.stratified_sample(strata(spark, sf_dir), 50, 42).select("id", "type")


@query(
    "pilot_subset",
    f"""WITH {_ALLOC}, {_ROWS}, s AS MATERIALIZED {_pick("d", "a", 42)}, c2 AS (SELECT type, count(*) AS count FROM s GROUP BY 1),
      b2 AS (SELECT type, count, floor(count * 10e0 / (SELECT sum(count) FROM c2) + 1e-9)::BIGINT AS base, count * 10e0 / (SELECT sum(count) FROM c2) AS raw FROM c2),
      a2 AS (SELECT type, least(base + CASE WHEN row_number() OVER (ORDER BY round(raw - base, 9) DESC, type) <= 10 - (SELECT sum(base) FROM b2) THEN 1 ELSE 0 END, count) AS alloc FROM b2)
    SELECT id, type FROM {_pick("s", "a2", 43)}""",
)
def pilot_subset(spark, sf_dir):
    """A sample of the sample, so the pilot lies inside it."""
    return evaluate.stratified_sample(evaluate.stratified_sample(strata(spark, sf_dir), 50, 42), 10, 43).select("id", "type")
