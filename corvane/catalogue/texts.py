"""Text functions, model output, prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.catalogue.registry import query, r6
from corvane.functions import text as T
from corvane.functions.vectors import dot, hash_embedding
from corvane.operators import extract, retrieve
from corvane.session import table

_PUNCT = T.PUNCTUATION.replace("'", "''")


def norm_sql(x: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(translate(lower({x}), '{_PUNCT}', ''), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@query("normalize_answer", f"SELECT item_id, {norm_sql('text')} AS answer FROM benchmark")
def normalize_answer(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalize_answer(F.col("text")).alias("answer"))


def turn_pairs(spark, sf_dir):
    """Every turn with the next one of its conversation as the answer wanted."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").withColumn("gold", after).filter("gold is not null")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("predicted"), "gold")


_TURNS = "t AS (SELECT conv_id || '-' || turn AS id, text AS predicted, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations), p AS (SELECT * FROM t WHERE gold IS NOT NULL)"


@query("exact_match", f"WITH {_TURNS} SELECT id, CAST({norm_sql('predicted')} = {norm_sql('gold')} AS DOUBLE) AS em FROM p")
def exact_match(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("id", T.exact_match(F.col("predicted"), F.array("gold")).alias("em"))


@query(
    "token_f1",
    f"""WITH {_TURNS}, w AS (SELECT id, unnest(string_split({norm_sql("predicted")}, ' ')) AS w, 1 AS np, 0 AS ng FROM p
      UNION ALL SELECT id, unnest(string_split({norm_sql("gold")}, ' ')), 0, 1 FROM p), c AS (SELECT id, w, sum(np) AS np, sum(ng) AS ng FROM w GROUP BY 1, 2),
      s AS (SELECT id, sum(CASE WHEN w <> '' THEN least(np, ng) ELSE 0 END) AS same, sum(np) AS np, sum(ng) AS ng FROM c GROUP BY 1)
    SELECT id, CASE WHEN same = 0 THEN 0e0 ELSE round(2e0 * same / (np + ng), 6) END AS f1 FROM s""",
)
def token_f1(spark, sf_dir):
    from corvane.operators.evaluate import bag_f1

    return bag_f1(turn_pairs(spark, sf_dir)).select("id", r6("f1", "f1"))


_RAW = "r AS (SELECT conv_id, turn, 'Because. Answer: x' || chr(10) || 'Answer:  ' || chr(10) || ' \"' || text || '\".' AS raw FROM conversations)"


def raw_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "text", F.concat(F.lit('Because. Answer: x\nAnswer:  \n "'), "text", F.lit('".')).alias("raw"))


@query(
    "extract_answer",
    f"""WITH {_RAW}, l AS (SELECT conv_id, turn, list_filter(string_split(string_split(raw, 'Answer:')[-1], chr(10)), lambda x: trim(x) <> '')[1] AS line,
      raw, strpos(raw, 'Answer:') AS pos FROM r)
    SELECT conv_id, turn, coalesce(nullif(regexp_replace(trim(line), '^[\"''. ]+|[\"''. ]+$', '', 'g'), ''), 'unknown') AS answer, trim(substr(raw, pos + 7)) AS first_answer FROM l""",
)
def extract_answer(spark, sf_dir):
    r = raw_answers(spark, sf_dir)
    return r.select("conv_id", "turn", T.extract_answer(F.col("raw")).alias("answer"), T.extract_first_answer(F.col("raw")).alias("first_answer"))


@query(
    "strip_reasoning",
    r"""SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 'The word assistantfinal is a marker. ' || text ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS final FROM conversations""",
)
def strip_reasoning(spark, sf_dir):
    wrapped = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<|channel|>analysis<|message|>so<|end|><|channel|>final<|message|>"), "text", F.lit("<|return|>")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("analysis so assistantfinal"), "text"))
        .otherwise(F.concat(F.lit("The word assistantfinal is a marker. "), "text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_reasoning(wrapped).alias("final"))


@query("json_parse_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("raw"))
    return e.select("event_id", F.from_json(T.unfence(F.col("raw")), "k long")["k"].alias("k"))


_OUT = """o AS (SELECT event_id, event_type, user_id FROM events)"""


@query(
    "json_salvage",
    """SELECT event_id, event_type || ',' || 'u' || user_id AS entities, 'p{1,2}' || user_id AS proposition, event_type AS first_entity,
      CAST(CASE WHEN event_id % 2 = 0 THEN 7 ELSE 5 END AS DOUBLE) AS strength, event_type || '/kind/about "' || user_id || '"' AS typed FROM events""",
)
def json_salvage(spark, sf_dir):
    """Model output that breaks off: everything comes from the salvage patterns."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("u"))
    ents = F.format_string('```json\n{"entities": ["%s", "u%s", "%s"], "more": [', "event_type", "u", "event_type")
    props = F.format_string('{"propositions": [{"text": "p{1,2}%s", "entities": ["%s"]}, {"text": "half', "u", "event_type")
    whole = F.format_string('{"relationships": [{"source": "a", "target": "%s", "description": "d{", "strength": ', "event_type")
    rels = F.concat(whole, F.when(F.col("event_id") % 2 == 0, '7').otherwise('"x"}, {"sou'))
    typed = F.format_string('{"entities": [{"name": "%s", "type": "kind", "description": "about \\"%s\\""', "event_type", "u")
    p, t = T.parse_propositions(props), F.get(T.parse_typed_entities(typed), F.lit(0))
    return e.select(
        "event_id", F.array_join(T.parse_entities(ents), ",").alias("entities"), F.get(p, F.lit(0))["text"].alias("proposition"),
        F.get(F.get(p, F.lit(0))["entities"], F.lit(0)).alias("first_entity"), F.get(T.parse_relations(rels), F.lit(0))["strength"].alias("strength"),
        F.concat_ws("/", t["name"], t["type"], t["description"]).alias("typed"),
    )


@query("rewrite_parse", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ' ' || user_id WHEN 1 THEN event_type ELSE props END AS question FROM events")
def rewrite_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.format_string('```json\n{"query": "%s %d"}\n```', "event_type", "user_id")).when(
        F.col("event_id") % 3 == 1, F.format_string('so "query": "%s" and', "event_type")
    ).otherwise(F.lit("no idea"))
    return e.select("event_id", T.parse_rewrite(raw, F.col("props")).alias("question"))


@query(
    "vocab_constrain",
    """WITH v AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS w FROM benchmark) WHERE w <> ''),
      d AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents)
    SELECT doc_id, CAST(count(v.w) AS BIGINT) AS kept, CAST(count(DISTINCT v.w) AS BIGINT) AS kinds FROM d LEFT JOIN v USING (w) GROUP BY 1""",
)
def vocab_constrain(spark, sf_dir):
    """Words of each document that are in the benchmark's vocabulary, with and without repeats."""
    vocabulary = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.lower("text"))).alias("w")).distinct().withColumn("in", F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
    return d.join(vocabulary, ["w"], "left").groupBy("doc_id").agg(F.count("in").alias("kept"), F.countDistinct(F.when(F.col("in") == 1, F.col("w"))).alias("kinds"))


@query(
    "prompt_assemble",
    """WITH s AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') AS system,
      coalesce(string_agg('[Passage ' || n || ']' || chr(10) || line, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS turns
      FROM (SELECT *, CASE WHEN role = 'assistant' THEN 'model' ELSE role END || ': ' || text AS line,
        sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY 1)
    SELECT conv_id, md5(system) AS system, md5(turns) AS turns FROM s""",
)
def prompt_assemble(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    s = m.select("conv_id", T.split_system(F.col("m")).alias("s"))
    return s.select("conv_id", F.md5("s.system").alias("system"), F.md5(T.numbered(F.col("s.turns"))).alias("turns"))


@query(
    "label_ellipsis",
    """SELECT page_id, CASE WHEN length(url) > 30 THEN substr(url, 1, 27) || '...' ELSE url END AS label,
      printf('%02d', page_id) || '_' || substr(trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9 _.-]', '', 'g'), '\\s+', ' ', 'g')), 1, 60) || '.pdf' AS name FROM pages""",
)
def label_ellipsis(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.ellipsis(F.col("url"), 30).alias("label"), T.safe_name(F.col("url"), F.col("page_id")).alias("name"))


@query(
    "chunk_text_keys",
    "SELECT doc_id, md5(source || chr(10) || text) AS chunk, sha256('embed|passage|' || text) AS key FROM documents",
)
def chunk_text_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.content_id(T.chunk_text(F.col("source"), F.col("text"))).alias("chunk"), T.cache_key(F.lit("embed"), F.lit("passage"), F.col("text")).alias("key"))


@query("subset_hash", "SELECT lang, sha1(string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id::VARCHAR)) AS hash, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def subset_hash(spark, sf_dir):
    ids = F.array_sort(F.collect_list(F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(T.subset_hash(ids).alias("hash"), F.count("*").alias("n"))


@query(
    "entity_merge",
    """WITH e AS (SELECT event_id AS ord, ' User' || user_id || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END AS name, CASE WHEN event_type = 'view' THEN 'other' ELSE event_type END AS type, props AS d, event_id % 7 AS chunk FROM events)
    SELECT lower(trim(name)) AS key, arg_min(name, ord) AS name, coalesce(arg_min(type, ord) FILTER (WHERE type <> 'other'), 'other') AS type, CAST(count(*) AS BIGINT) AS n,
      md5(string_agg(d, ' ' ORDER BY ord)) AS descriptions, array_to_string(list_sort(list(DISTINCT chunk)), ',') AS chunks FROM e GROUP BY 1""",
)
def entity_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, " ").otherwise("")).alias("name"),
        F.when(F.col("event_type") == "view", "other").otherwise(F.col("event_type")).alias("type"), F.col("props").alias("description"), (F.col("event_id") % 7).alias("chunk"),
    )
    m = extract.merge_entities(e)
    return m.select("key", "name", "type", F.size("descriptions").cast("long").alias("n"), F.md5(F.array_join("descriptions", " ")).alias("descriptions"), F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"))


@query(
    "relation_merge",
    """WITH e AS (SELECT 'U' || user_id AS a, event_type AS b, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 0 ELSE event_id % 9 + 1 END AS s FROM events)
    SELECT least(lower(a), lower(b)) AS src, greatest(lower(a), lower(b)) AS dst, CAST(sum(CASE WHEN s IS NULL OR s = 0 THEN 5 ELSE s END) AS DOUBLE) AS weight, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1, 2""",
)
def relation_merge(spark, sf_dir):
    s = F.when(F.col("event_id") % 3 == 0, F.lit("x")).when(F.col("event_id") % 3 == 1, F.lit("0")).otherwise((F.col("event_id") % 9 + 1).cast("string"))
    ends = (F.concat(F.lit("U"), F.col("user_id").cast("string")), F.col("event_type"))
    flip = F.col("event_id") % 2 == 0  # the pair is unordered
    e = table(spark, sf_dir, "events").select(
        F.when(flip, ends[0]).otherwise(ends[1]).alias("source"), F.when(flip, ends[1]).otherwise(ends[0]).alias("target"), s.alias("strength"), (F.col("event_id") % 7).alias("chunk")
    )
    return extract.merge_relations(e).select("src", "dst", "weight", "n")


@query(
    "desc_truncate",
    """WITH d AS (SELECT source, list(text ORDER BY doc_id) AS l FROM documents GROUP BY 1), u AS (SELECT source, len(l) AS n, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]), ' ') AS j FROM d)
    SELECT source, md5(CASE WHEN n > 1 AND length(j) > 800 THEN substr(j, 1, 800) ELSE j END) AS summary, md5(substr(trim(source || ': ' || j), 1, 512)) AS embed FROM u""",
)
def desc_truncate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]).alias("l"))
    joined = T.merged_description(F.lit(""), F.col("l"))
    return d.select("source", F.md5(extract.summarised(F.col("l"))).alias("summary"), F.md5(F.substring(F.trim(F.concat("source", F.lit(": "), joined)), 1, 512)).alias("embed"))


@query(
    "qa_context_budget",
    """WITH r AS (SELECT conv_id AS qid, turn AS id, length(text) AS w, text FROM conversations),
      a AS (SELECT qid, 0 AS k, row_number() OVER (PARTITION BY qid ORDER BY w DESC, id) AS n, 'report' AS kind, text FROM r QUALIFY n <= 2),
      l AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY id DESC, id) AS n, text FROM r QUALIFY n <= 10),
      b AS (SELECT qid, 1 AS k, 1 AS n, 'relations' AS kind, string_agg(text, chr(10) ORDER BY n) AS text FROM l GROUP BY 1),
      c AS (SELECT qid, 2 AS k, row_number() OVER (PARTITION BY qid ORDER BY w, id) AS n, 'chunk' AS kind, text FROM r QUALIFY n <= 5),
      u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
    SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY k, n) AS INTEGER) AS ord, kind, md5(text) AS text FROM u QUALIFY ord <= 5""",
)
def qa_context_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("id"), F.length("text").alias("w"), "text")
    found = retrieve.assemble_context(c.withColumn("rating", F.col("w")), c.withColumn("weight", F.col("id")), c.withColumn("score", -F.col("w")))
    return found.select("qid", "ord", "kind", F.md5("text").alias("text"))


@query("embed_hash")
def embed_hash(spark, sf_dir):
    """The deterministic stand-in embedder over all benchmark texts; unit length."""
    b = table(spark, sf_dir, "benchmark").select("item_id", hash_embedding(F.col("text")).alias("v"))
    return b.select("item_id", r6(dot(F.col("v"), F.col("v")), "size"))


@query("extract_udf")
def extract_udf(spark, sf_dir):
    """Propositions of all documents by the offline extractor, counted."""
    found = extract.extract_propositions(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), "text"))
    return found.groupBy("chunk").agg(F.count("text").alias("propositions"), F.sum(F.size("entities")).alias("entities"))


@query("error_rows", "SELECT doc_id AS id, CASE WHEN lang = 'de' THEN NULL ELSE md5(text) END AS value, CASE WHEN lang = 'de' THEN 'ValueError: marker' END AS error FROM documents")
def error_rows(spark, sf_dir):
    """A function that fails on marked rows fails on these alone."""

    def hashed(t: str) -> str:
        import hashlib

        if t.startswith("de|"):
            raise ValueError("marker")
        return hashlib.md5(t.partition("|")[2].encode()).hexdigest()

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("lang", F.lit("|"), "text").alias("text"))
    return extract.guarded(d, hashed)
