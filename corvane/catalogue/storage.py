"""Stores, caches, latest-wins views, round trips, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.catalogue.registry import query, r6
from corvane.functions.text import words
from corvane.operators.graph import passage_edges
from corvane.session import shared_folder, table
from corvane.sources import stores


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text", "source", "lang")


@query("content_hash_dedupe", "SELECT 'chunk-' || md5(text) AS id, CAST(min(doc_id) AS BIGINT) AS ord FROM documents GROUP BY 1")
def content_hash_dedupe(spark, sf_dir):
    return stores.first_text(texts(spark, sf_dir), "chunk-").select("id", "ord")


@query(
    "incremental_insert",
    "SELECT 'chunk-' || md5(text) AS id, CAST(min(doc_id) AS BIGINT) AS ord FROM documents WHERE source <> 'src0' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0') GROUP BY 1",
)
def incremental_insert(spark, sf_dir):
    """Documents of one source are in the store already; those of the others come in."""
    t = texts(spark, sf_dir)
    store = stores.first_text(t.filter("source = 'src0'"), "chunk-")
    return stores.insert_texts(t.filter("source <> 'src0'"), store, "chunk-").select("id", "ord")


@query("coverage_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_missing(spark, sf_dir):
    return stores.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("latest_wins", "SELECT user_id, event_type, CAST(max(event_id) AS BIGINT) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2")
def latest_wins(spark, sf_dir):
    return stores.latest(table(spark, sf_dir, "events"), "user_id", "event_type", order="event_id").select("user_id", "event_type", "event_id", r6("value", "value"))


@query(
    "pending_pairs",
    "SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type AND e.value > 30)",
)
def pending_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    done = e.filter("value > 30").select("user_id", "event_type").distinct()
    return stores.pending(e.select("user_id").distinct(), e.select("event_type").distinct(), done)


@query("title_lookup", "SELECT l.doc_id, d.source AS title, CAST(l.quality AS INTEGER) AS quality FROM labels l JOIN documents d USING (doc_id)")
def title_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"))
    return table(spark, sf_dir, "labels").join(d, ["doc_id"]).select("doc_id", "title", "quality")


@query(
    "corpus_semi",
    "SELECT d.source AS title, md5(arg_min(text, doc_id)) AS text FROM documents d WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY 1",
)
def corpus_semi(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1")
    asked = d.join(toxic, ["doc_id"], "left_semi").select(F.array("source").alias("context_titles"), F.array("source").alias("gold_titles"))
    found = stores.corpus(d.select(F.col("doc_id").alias("ord"), F.col("source").alias("title"), "text"), asked)
    return found.select("title", F.md5("text").alias("text"))


@query("title_union", "SELECT source AS title FROM documents UNION SELECT lang FROM documents")
def title_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(F.array_union(F.array("source"), F.array("lang"))).alias("title")).distinct()


@query("cache_lookup", "SELECT l.doc_id AS key, coalesce(d.n_chars, -1) AS value FROM labels l LEFT JOIN (SELECT doc_id, n_chars FROM documents WHERE lang = 'en') d USING (doc_id)")
def cache_lookup(spark, sf_dir):
    cache = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("value"))
    found = stores.lookup_many(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")), cache)
    return found.select("key", F.coalesce("value", F.lit(-1)).alias("value"))  # -1: a miss


@query("upsert_tombstone", "SELECT user_id, CAST(max(event_id) AS BIGINT) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def upsert_tombstone(spark, sf_dir):
    e = stores.latest(table(spark, sf_dir, "events"), "user_id", order="event_id", deleted="event_type = 'error'")
    return e.select("user_id", "event_id", "event_type")


@query("store_roundtrip", "SELECT DISTINCT l_partkey AS src, l_orderkey AS dst, 1e0 AS weight FROM lineitem")
def store_roundtrip(spark, sf_dir):
    edges = passage_edges(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("passage"), F.col("l_partkey").alias("entity")))
    edges = edges.select(F.col("entity").alias("src"), F.col("passage").alias("dst"), "weight")
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    stores.write_graph(edges.select(F.col("src").alias("id")).distinct(), edges, path)
    return stores.read_graph(spark, path)[1]


@query("jsonl_roundtrip", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def jsonl_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    stores.write_jsonl(e, path)
    return stores.read_jsonl(spark, path, e.schema).select("event_id", "user_id", "event_type", r6("value", "value"))


_WORDS = r"w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM documents), b AS (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM benchmark)"


@query("gold_intersection", f"WITH {_WORDS} SELECT doc_id, CAST(count(DISTINCT w.w) AS BIGINT) AS shared FROM w JOIN (SELECT DISTINCT w FROM b) b USING (w) GROUP BY 1")
def gold_intersection(spark, sf_dir):
    """Distinct words that a document shares with the benchmark."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    b = table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("w")).distinct()
    return w.join(b, ["w"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


@query(
    "multiset_intersection",
    f"WITH {_WORDS}, c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2), g AS (SELECT w, count(*) AS n FROM b GROUP BY 1) SELECT doc_id, CAST(sum(least(c.n, g.n)) AS BIGINT) AS shared FROM c JOIN g USING (w) GROUP BY 1",
)
def multiset_intersection(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.explode(words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "benchmark").select(F.explode(words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("m"))
    return w.join(b, ["w"]).groupBy("doc_id").agg(F.sum(F.least("n", "m")).alias("shared"))


@query("work_done", "SELECT CAST(count(*) FILTER (WHERE l.doc_id IS NULL) = 0 AS BOOLEAN) AS subset, CAST(count(*) AS BIGINT) AS n FROM labels a LEFT JOIN documents l USING (doc_id)")
def work_done(spark, sf_dir):
    """Whether every labelled document exists: a subset test as one row."""
    have = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("have"))
    return table(spark, sf_dir, "labels").join(have, ["doc_id"], "left").agg((F.count_if(F.col("have").isNull()) == 0).alias("subset"), F.count("*").alias("n"))
