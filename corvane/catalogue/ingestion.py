"""Line cleaning, paragraphs, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalogue.registry import query
from corvane.functions.text import words
from corvane.operators import ingest
from corvane.session import table

_LINES = "l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), t AS (SELECT doc, line_no, trim(raw) AS line FROM l)"


@query(
    "page_number_filter",
    f"WITH {_LINES} SELECT doc, CAST(count(*) AS BIGINT) AS kept, CAST(sum(length(line)) AS BIGINT) AS chars FROM t WHERE NOT regexp_matches(line, '^[-–— ]*[0-9]{{1,4}}[-–— ]*$|^[ivxlcdmIVXLCDM]{{1,6}}$') GROUP BY 1",
)
def page_number_filter(spark, sf_dir):
    kept = ingest.without_page_numbers(ingest.lines(table(spark, sf_dir, "documents")))
    return kept.groupBy("doc").agg(F.count("*").alias("kept"), F.sum(F.length("line")).alias("chars"))


@query(
    "header_footer_lines",
    """WITH p AS (SELECT source AS doc, doc_id AS page, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM documents),
      n AS (SELECT source AS doc, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 4),
      f AS (SELECT doc, line, count(DISTINCT page) AS pages FROM p WHERE line <> '' AND length(line) < 120 GROUP BY 1, 2)
    SELECT doc, line, CAST(pages AS BIGINT) AS pages FROM f JOIN n USING (doc) WHERE pages >= greatest(2, floor(0.05e0 * n))""",
)
def header_footer_lines(spark, sf_dir):
    """Lines on a twentieth of a source's documents; the synthetic sources repeat none on half of them."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return ingest.running_lines(pages, 0.05)


@query(
    "paragraph_join",
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10)), '[ \t\r]+\n', chr(10), 'g'), '\n[ \t\r]+', chr(10), 'g'), '\n{2,}'),
      lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> '') AS p FROM documents)
    SELECT doc_id, CAST(len(p) AS BIGINT) AS n, md5(array_to_string(p, chr(10))) AS paragraphs FROM p""",
)
def paragraph_join(spark, sf_dir):
    """Sentences stand for paragraphs: every full stop is followed by a blank line first."""
    d = table(spark, sf_dir, "documents").select("doc_id", ingest.paragraphs(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))).alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "\n")).alias("paragraphs"))


@query(
    "token_stride_chunks",
    r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS t FROM documents),
      c AS (SELECT doc_id, t, unnest(range(0, greatest(0, CAST(ceil((len(t) - 128) / 96.0) AS BIGINT)) + 1)) AS idx FROM t)
    SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(len(t[idx * 96 + 1:idx * 96 + 128]) AS INTEGER) AS tokens, md5(array_to_string(t[idx * 96 + 1:idx * 96 + 128], ' ')) AS chunk FROM c""",
)
def token_stride_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("t"))
    c = d.select("doc_id", F.posexplode(ingest.stride_chunks(F.col("t"), 128, 32)).alias("idx", "c"))
    return c.select("doc_id", "idx", F.size("c").alias("tokens"), F.md5(F.array_join("c", " ")).alias("chunk"))


@query("greedy_chunks")
def greedy_chunks(spark, sf_dir):
    """A fold with carry in document order; held against a plain loop in the tests."""
    found = ingest.greedy_chunks(table(spark, sf_dir, "documents"), 128, 32, title_col="source")
    return found.select("doc", "idx", "tokens", F.md5("text").alias("chunk"))
