"""Model calls, extraction rounds, community reports, run reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.catalogue.registry import query, r6
from corvane.functions import text as T
from corvane.operators import evaluate, model
from corvane.session import cut, shared_folder, table
from corvane.sources import reports

_PROMPT = "role || ': ' || text"


def digest(prompt: str) -> str:
    """A model that answers with a digest, and fails on system prompts."""
    import hashlib

    if prompt.startswith("system"):
        raise ValueError("refused")
    return hashlib.md5(prompt.encode()).hexdigest()


def shout(prompt: str) -> str:
    return prompt + "!"


@query(
    "model_calls",
    f"""WITH r AS (SELECT conv_id, turn, {_PROMPT} AS prompt, CASE turn % 3 WHEN 2 THEN 'none' WHEN 1 THEN 'shout' ELSE 'digest' END AS model FROM conversations),
      k AS (SELECT *, sha256(model || '|' || prompt) AS key FROM r), c AS (SELECT DISTINCT key FROM k WHERE turn = 0),
      v AS (SELECT k.*, c.key IS NOT NULL AS hit, CASE WHEN c.key IS NOT NULL THEN 'kept' WHEN model = 'shout' THEN prompt || '!' WHEN model = 'digest' AND NOT starts_with(prompt, 'system') THEN md5(prompt) END AS value
        FROM k LEFT JOIN c USING (key))
    SELECT conv_id, turn, md5(value) AS value, hit, CASE WHEN model = 'none' AND NOT hit THEN 'LookupError' WHEN value IS NULL THEN 'ValueError' END AS error,
      CAST(CASE WHEN hit THEN 0 ELSE len(list_filter(string_split_regex(prompt, '\\s+'), lambda w: w <> '')) END AS BIGINT) AS prompt_tokens FROM v""",
)
def model_calls(spark, sf_dir):
    """Three models by name, one unknown; first turns are in the cache."""
    c = table(spark, sf_dir, "conversations")
    name = F.when(F.col("turn") % 3 == 2, "none").when(F.col("turn") % 3 == 1, "shout").otherwise("digest")
    r = c.select(F.struct("conv_id", "turn").alias("id"), F.concat("role", F.lit(": "), "text").alias("prompt"), name.alias("model"))
    kept = r.filter("id.turn = 0").select(T.cache_key(F.col("model"), F.col("prompt")).alias("key"), F.lit("kept").alias("value"))
    got = model.model_calls(r, {"digest": digest, "shout": shout}, cache=kept, tries=2)
    return got.select(
        "id.conv_id", "id.turn", F.md5("value").alias("value"), F.col("cache_hit").alias("hit"), F.get(F.split("error", ":"), F.lit(0)).alias("error"), "prompt_tokens"
    )


def extractor(prompt: str) -> str:
    """Whole, repairable and hopeless output, by the chunk's last digit."""
    last = prompt.rstrip()[-1]
    found = '{"entities": [{"name": "%s", "type": "kind", "description": "d"}], "relationships": [{"source": "a", "target": "b", "description": "d", "strength": 2'
    if prompt.startswith("Add"):
        return '{"entities": [{"name": "more", "type": "kind", "description": "d"}]}'
    if prompt.startswith("Correct"):
        return found % "mended" if last == "1" else "no"
    return found % "whole" if last == "0" else f"garbage {last}"


@query(
    "extraction_rounds",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'whole,more' WHEN 1 THEN 'mended,more' ELSE 'more' END AS entities,
      CASE event_id % 3 WHEN 2 THEN 0e0 ELSE 2e0 END AS strength, event_id % 3 = 2 AS failed FROM events""",
)
def extraction_rounds(spark, sf_dir):
    """One extraction, one repair of unreadable output, one further round."""
    chunks = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.col("event_id"), F.col("event_id") % 3).alias("text"))
    x = model.extraction_rounds(chunks, extractor)
    strength = F.aggregate(F.coalesce("relations.strength", F.array().cast("array<double>")), F.lit(0.0), lambda a, s: a + s)
    return x.select(F.col("id").alias("event_id"), F.array_join("entities.name", ",").alias("entities"), strength.alias("strength"), "failed")


def reporter(prompt: str) -> str:
    """Reports where the name of the first member is odd; elsewhere no JSON."""
    first = prompt.split("\n")[1].split(" (")[0]
    return '{"title": "About %s", "rating": 7}' % first if int(first[-1]) % 2 else "sorry"


@query(
    "community_reports",
    """WITH m AS (SELECT c_nationkey AS community, c_custkey AS id, c_name AS name, c_name || ' (' || c_mktsegment || '): in nation ' || c_nationkey AS line FROM customer),
      r AS (SELECT c_nationkey AS community, c_name || ' -> ' || o_orderkey || ': ' || o_orderpriority || ' (w=1)' AS line, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey),
      a AS (SELECT community, string_agg(line, chr(10) ORDER BY id) AS ents, arg_min(name, id) AS first, array_to_string(list(name ORDER BY id)[1:3], ', ') AS names FROM m GROUP BY 1),
      b AS (SELECT community, string_agg(line, chr(10)) AS rels FROM r GROUP BY 1),
      c AS (SELECT a.*, CASE WHEN length(ents) + coalesce(length(rels), 0) > 8000 THEN substr(ents, 1, 4000) ELSE ents END AS cut, right(first, 1)::INTEGER % 2 = 1 AS odd FROM a LEFT JOIN b USING (community))
    SELECT community, CASE WHEN odd THEN 'About ' || first ELSE names END AS title, CASE WHEN odd THEN '' ELSE substr(cut, 1, 400) END AS summary,
      CASE WHEN odd THEN 7e0 ELSE 0e0 END AS rating, NOT odd AS parse_failed FROM c""",
)
def community_reports(spark, sf_dir):
    """Nations as communities of customers; their orders as relations."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    members = c.select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.concat(F.lit("in nation "), "c_nationkey").alias("description"))
    r = c.join(o, c["c_custkey"] == o["o_custkey"])
    rels = r.select(F.col("c_nationkey").alias("community"), F.col("c_name").alias("source"), F.col("o_orderkey").cast("string").alias("target"), F.col("o_orderpriority").alias("description"), F.lit(1).alias("weight"))
    return model.community_reports(members, rels, reporter).select("community", "title", "summary", "rating", "parse_failed")


_RUN = """r AS (SELECT d.source AS system, l.quality::DOUBLE AS em, l.toxic::DOUBLE AS f1, d.n_chars::DOUBLE AS latency, d.doc_id % 2 AS r2, d.doc_id % 3 AS r5, length(d.lang) AS calls FROM documents d LEFT JOIN labels l USING (doc_id)),
 m AS (SELECT system, CAST(count(*) AS BIGINT) AS n, avg(coalesce(em, 0)) AS em, avg(coalesce(f1, 0)) AS f1, avg(r2) AS recall_2, avg(r5) AS recall_5, 0e0 AS recall_10, avg(latency) AS retrieval_latency_s,
  0e0 AS qa_latency_s, avg(latency) AS query_prompt_tokens, 0e0 AS query_completion_tokens, avg(coalesce(calls, 0)) AS chat_calls_per_q FROM r GROUP BY 1)"""
_MEANS = ("em", "f1", "recall_2", "recall_5", "recall_10", "retrieval_latency_s", "qa_latency_s", "query_prompt_tokens", "query_completion_tokens", "chat_calls_per_q")


def run_metrics(spark, sf_dir):
    """Documents stand for answered questions; labels give the scores of some."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), ["doc_id"], "left")
    recall = F.create_map(F.lit("recall@2"), (F.col("doc_id") % 2).cast("double"), F.lit("recall@5"), (F.col("doc_id") % 3).cast("double"))
    used = F.create_map(F.lit("chat_prompt_tokens"), F.col("n_chars").cast("double"), F.lit("chat_calls"), F.length("lang").cast("double"))
    rows = d.select(
        F.col("source").alias("system"), F.col("quality").alias("em"), F.col("toxic").alias("f1"), recall.alias("recall"), F.col("n_chars").alias("retrieval_latency_s"),
        F.lit(None).cast("double").alias("qa_latency_s"), used.alias("usage"),
    )
    return evaluate.full_metrics(rows, "system")


@query("full_metrics", f"WITH {_RUN} SELECT system, n, {', '.join(f'round({c}, 6) AS {c}' for c in _MEANS)} FROM m")
def full_metrics(spark, sf_dir):
    return run_metrics(spark, sf_dir).select("system", "n", *[r6(c, c) for c in _MEANS])


@query(
    "run_report",
    f"""WITH {_RUN}, t AS (SELECT 2 AS part, system, '| ' || system || ' | ' || n || ' | ' || printf('%.3f', em) || ' | ' || printf('%.3f', f1) || ' | ' || printf('%.3f', recall_2) || ' | ' ||
        printf('%.3f', recall_5) || ' | ' || printf('%.3f', recall_10) || ' |' AS line FROM m
      UNION ALL VALUES (0, '', '| System | n | EM | F1 | R@2 | R@5 | R@10 |'), (1, '', '|---|---|---|---|---|---|---|'))
    SELECT CAST(row_number() OVER (ORDER BY part, system) - 1 AS BIGINT) AS ord, line FROM t""",
)
def run_report(spark, sf_dir):
    """The report as it is read back from its file."""
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    reports.write_report(cut(run_metrics(spark, sf_dir)), path)
    lines = spark.read.text(f"{path}/report", wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    return lines.filter("line <> ''").select(F.col("ord").cast("long").alias("ord"), "line")


@query(
    "run_manifest",
    """SELECT sha1(string_agg(item_id::VARCHAR, '|' ORDER BY item_id::VARCHAR)) AS subset, CAST(count(*) AS BIGINT) AS n, (SELECT CAST(count(*) AS BIGINT) FROM events) AS calls,
      (SELECT round(sum(value), 4) FROM events) AS tokens, 'paths' AS system FROM benchmark""",
)
def run_manifest(spark, sf_dir):
    """Usage of two parts of a run merged; the guard lets the same subset go on."""
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    u = table(spark, sf_dir, "events").groupBy(F.col("event_id") % 2).agg(F.count("*").alias("calls"), F.sum("value").alias("tokens")).select("calls", "tokens")
    m = cut(reports.manifest(ids, u, {"system": "paths"}))
    reports.guard_subset(m, ids)
    return m.select("subset", "n", "usage.calls", F.round("usage.tokens", 4).alias("tokens"), F.col("settings")["system"].alias("system"))


@query("corpora", "SELECT lang AS corpus, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def corpora(spark, sf_dir):
    """Corpora stored one beside the other, listed with their sizes."""
    path = f"{shared_folder(spark)}/corpora-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").filter("lang is not null")
    d.withColumn("corpus", F.col("lang")).select("doc_id", "corpus").write.partitionBy("corpus").parquet(f"{path}/all")
    for name in sorted(r[0] for r in d.select("lang").distinct().collect()):  # a few languages
        spark.read.parquet(f"{path}/all/corpus={name}").write.parquet(f"{path}/each/{name}/chunks")
    return reports.corpora(spark, f"{path}/each")
