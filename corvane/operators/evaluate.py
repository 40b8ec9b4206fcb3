"""Evaluation: exact match, token F1, recall, metric tables, stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import normalize_answer


def bag_f1(pairs: DataFrame, *, id_col: str = "id", predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """(id, f1): F1 of word bags by counting words, so that long texts need no nested scans."""
    keyed = pairs.select(F.col(id_col).alias("id"), *[F.split(normalize_answer(F.col(c)), " ").alias(k) for c, k in ((predicted, "p"), (gold, "g"))])
    both = keyed.select("id", F.explode("p").alias("w"), F.lit(1).alias("np"), F.lit(0).alias("ng")).unionByName(
        keyed.select("id", F.explode("g").alias("w"), F.lit(0).alias("np"), F.lit(1).alias("ng"))
    )
    words = both.groupBy("id", "w").agg(F.sum("np").alias("np"), F.sum("ng").alias("ng"))
    shared = F.when(F.col("w") != "", F.least("np", "ng")).otherwise(0)
    sums = words.groupBy("id").agg(F.sum(shared).alias("same"), F.sum("np").alias("np"), F.sum("ng").alias("ng"))
    return sums.select("id", F.when(F.col("same") == 0, 0.0).otherwise(2.0 * F.col("same") / (F.col("np") + F.col("ng"))).alias("f1"))


def system_metrics(results: DataFrame, *by: str) -> DataFrame:
    """n, em, f1 and latency means per group; missing values count as 0."""
    mean = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    return results.groupBy(*by).agg(F.count("*").alias("n"), mean("em"), mean("f1"), mean("latency"))


def full_metrics(results: DataFrame, *by: str, ks: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """Means per group of all that a run records: scores, recall at every k, latencies, tokens and calls a question.

    ``results``: em, f1, recall (map by ``recall@k``), retrieval_latency_s, qa_latency_s, usage (map); what is missing counts as 0.
    """
    mean = lambda c, name: F.avg(F.coalesce(c.cast("double"), F.lit(0.0))).alias(name)
    use = {"query_prompt_tokens": "chat_prompt_tokens", "query_completion_tokens": "chat_completion_tokens", "chat_calls_per_q": "chat_calls"}
    return results.groupBy(*by).agg(
        F.count("*").alias("n"), mean(F.col("em"), "em"), mean(F.col("f1"), "f1"), *[mean(F.col("recall")[f"recall@{k}"], f"recall_{k}") for k in ks],
        mean(F.col("retrieval_latency_s"), "retrieval_latency_s"), mean(F.col("qa_latency_s"), "qa_latency_s"),
        *[mean(F.col("usage")[key], name) for name, key in use.items()],
    )


def metrics_both(results: DataFrame) -> DataFrame:
    """Per system and per (system, qtype) in one pass; qtype is null in the former."""
    mean = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c)
    return results.groupingSets([["system"], ["system", "qtype"]], "system", "qtype").agg(F.count("*").alias("n"), mean("em"), mean("f1"))


def allocate(counts: DataFrame, n: int, *, key: str = "type") -> DataFrame:
    """(key, count, alloc): largest remainders, ties by key; a stratum never gives more than it has.

    A shortfall after clamping goes round in key order. The strata are few, so windows over them are too.
    """
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    raw = counts.join(F.broadcast(total)).withColumn("raw", F.when(F.col("total") > 0, F.col("count") * F.lit(float(max(n, 0))) / F.col("total")).otherwise(0.0))
    base = raw.withColumn("base", F.floor(F.col("raw") + 1e-9).cast("long")).withColumn("rest", F.round(F.col("raw") - F.col("base"), 9))
    one = Window.partitionBy(F.lit(1))
    base = base.withColumn("left", F.when(F.col("total") > 0, F.lit(max(n, 0))).otherwise(0) - F.sum("base").over(one)).withColumn("r", F.row_number().over(one.orderBy(F.col("rest").desc(), key)))
    out = base.withColumn("alloc", F.least(F.col("base") + (F.col("r") <= F.col("left")).cast("long"), F.col("count")))
    room = F.col("count") - F.col("alloc")
    short = F.when(F.col("total") > 0, F.least(F.lit(max(n, 0)).cast("long"), F.col("total"))).otherwise(0) - F.sum("alloc").over(one)
    before = F.coalesce(F.sum("room").over(one.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("room", room).withColumn("short", short).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("room"), F.col("short") - before)))
    return out.select(key, "count", (F.col("alloc") + F.col("extra")).cast("long").alias("alloc"))


def stratified_sample(rows: DataFrame, n: int, seed: int = 42, *, key: str = "type", id_col: str = "id") -> DataFrame:
    """Rows of a reproducible sample: in each stratum those with the smallest hash of seed and id."""
    counts = rows.groupBy(key).count()
    alloc = allocate(counts, n, key=key).select(key, "alloc")
    order = Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string"))), id_col)
    return rows.withColumn("_r", F.row_number().over(order)).join(F.broadcast(alloc), [key]).filter("_r <= alloc").drop("_r", "alloc")
