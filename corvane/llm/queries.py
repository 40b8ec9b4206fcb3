"""The thin queries over the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import crc_of_id, table
from corvane.llm.decontamination import contaminated
from corvane.llm.exact_topk import exact_topk
from corvane.llm.html_text import extract
from corvane.llm.jaccard_join import jaccard_components
from corvane.llm.language_id import identify
from corvane.llm.masked_lm import score_documents
from corvane.llm.packing import pack
from corvane.llm.sharding import shard
from corvane.llm.toxicity import score_toxicity
from corvane.llm.url_filter import url_filter

#: host, path, verdict
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector."""
    return exact_topk(table(spark, sf_dir, "embeddings"), 20, is_query=F.col("id") % 20 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from two thirds of the labels."""
    held_out = crc_of_id(F.col("doc_id")) % 3 == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_pred").alias("predicted"),
        F.col("tox_evidence").alias("evidence"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked pseudo-likelihood of every document under a model trained on all of them."""
    return score_documents(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away, word for word or with other values in its slots."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    held_out = crc_of_id(F.col("doc_id")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy components of all documents at a Jaccard similarity of 0.8 over 5-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"), 80)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_exact_topk": op2_exact_topk,
    "op3_toxicity": op3_toxicity,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_filter": op10_url_filter,
}

ORACLES = {
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                END AS grams
            FROM w
        ), g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        link AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach(x, y) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
        )
        SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, min(reach.y) AS component_id
        FROM s JOIN reach ON s.doc_id = reach.x
        GROUP BY s.doc_id, len(s.grams)
    """,
    "op10_url_filter": """
        WITH u AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), h AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
        ), p AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
            FROM h
        ), r(rhost, rpath, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                   ('org', '/fr/', 'allow')
        ), m AS (
            SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS k
            FROM p LEFT JOIN r
              ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
    """,
}
