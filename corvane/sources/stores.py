"""Stores: deduplicating appends, caches, latest-wins views, JSON, GraphML, documents, settings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import content_id
from corvane.session import prepare

#: Questions as their files hold them; only the first element of inner lists is read.
QUESTIONS = "_id string, type string, question string, answer string, supporting_facts array<array<string>>, context array<array<string>>"


def first_text(rows: DataFrame, prefix: str, *, text_col: str = "text", order: str = "ord") -> DataFrame:
    """(id, text, ord): distinct texts by content id; the first occurrence gives the order."""
    return rows.groupBy(content_id(F.col(text_col), prefix).alias("id")).agg(F.min_by(text_col, order).alias("text"), F.min(order).alias("ord"))


def missing(rows: DataFrame, store: DataFrame, *keys: str) -> DataFrame:
    return rows.join(store.select(*keys).distinct(), list(keys), "left_anti")


def insert_texts(rows: DataFrame, store: DataFrame, prefix: str, *, text_col: str = "text", order: str = "ord") -> DataFrame:
    """What an idempotent append adds: distinct new texts."""
    return missing(first_text(rows, prefix, text_col=text_col, order=order), store, "id")


def append_texts(rows: DataFrame, path: str, prefix: str, **names: str) -> int:
    """Append the new texts to the Parquet store at ``path``; returns how many they are."""
    spark = rows.sparkSession
    try:
        store = spark.read.parquet(path)
    except Exception as e:  # the store does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        store = spark.createDataFrame([], "id string")
    from corvane.session import cut

    new = cut(insert_texts(rows, store, prefix, **names))
    new.write.mode("append").parquet(path)
    return new.count()


def lookup_many(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests with their cached value, null where there is none."""
    return requests.join(cache, [key], "left")


def latest(log: DataFrame, *keys: str, order: str = "ord", deleted: str | None = None) -> DataFrame:
    """The last row of every key; keys whose last row satisfies ``deleted`` are gone."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    out = log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return out.filter(f"not ({deleted})") if deleted else out


def pending(left: DataFrame, right: DataFrame, done: DataFrame) -> DataFrame:
    """All pairs of the two small work lists that are not done yet."""
    return left.crossJoin(right).join(done, left.columns + right.columns, "left_anti")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """qid, qtype, question, answer, gold_titles, context_titles, titles distinct in order."""
    q = spark.read.schema(QUESTIONS).json(path, multiLine=True)
    firsts = lambda c: F.array_distinct(F.transform(c, lambda x: x[0]))
    return q.select(
        F.col("_id").alias("qid"), F.col("type").alias("qtype"), "question", "answer",
        firsts(F.coalesce("supporting_facts", F.array().cast("array<array<string>>"))).alias("gold_titles"), firsts(F.coalesce("context", F.array().cast("array<array<string>>"))).alias("context_titles"),
    )


def corpus(texts: DataFrame, questions: DataFrame) -> DataFrame:
    """(title, text) of the titles that questions need; ``texts``: ord, title, text, the first title wins."""
    needed = questions.select(F.explode(F.array_union("context_titles", "gold_titles")).alias("title")).distinct()
    return texts.groupBy("title").agg(F.min_by("text", "ord").alias("text")).join(needed, ["title"], "left_semi")


def assert_covered(corpus_: DataFrame, questions: DataFrame) -> None:
    """Raise with the first three titles that questions need and the corpus lacks."""
    needed = questions.select(F.explode(F.array_union("context_titles", "gold_titles")).alias("title")).distinct()
    gone = [r[0] for r in needed.join(corpus_, ["title"], "left_anti").orderBy("title").limit(3).collect()]
    if gone:
        raise ValueError(f"titles missing from the corpus: {gone}")


def write_jsonl(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def read_jsonl(spark: SparkSession, path: str, schema, strict: bool = True) -> DataFrame:
    """Strict: a bad line fails the read. Tolerant: bad lines and error rows are left out."""
    rows = spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")
    return rows if strict or "error" not in rows.columns else rows.filter("error is null")


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices(id), edges(src, dst, weight)) of a GraphML file; the first data value of an edge is its weight."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string").load(path)
    kind = "_source string, _target string, data array<struct<_VALUE:string,_key:string>>"
    edges = spark.read.format("xml").option("rowTag", "edge").schema(kind).load(path)
    weight = F.coalesce(F.get("data", F.lit(0))["_VALUE"].cast("double"), F.lit(1.0))
    return nodes.select(F.col("_id").alias("id")), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), weight.alias("weight"))


def read_documents(spark: SparkSession, path: str, parse=None) -> DataFrame:
    """(title, text, source, num_pages) of whole files; ``parse``: bytes to (title or None, page texts), plain text by default.

    Pages are parted by form feeds in plain text; a file without a title is named by its stem.
    """
    import pandas as pd

    prepare(spark)

    def plain(raw: bytes):
        return None, raw.decode("utf-8", "replace").split("\f")

    reader = parse or plain

    def run(batches):
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["content"], strict=True):
                title, pages = reader(raw)
                stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows.append(((title or "").strip() or stem, "\n".join(pages), p, len(pages)))
            yield pd.DataFrame(rows, columns=["title", "text", "source", "num_pages"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "title string, text string, source string, num_pages int")


def settings(text: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """Assignments of a settings file: the first definition of a name stays, the environment goes before the file."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        name, mark, value = line.strip().removeprefix("export ").partition("=")
        if mark and not name.startswith("#"):
            out.setdefault(name.strip(), value.strip().strip("'\""))
    over = os.environ if environment is None else environment
    return {k: over.get(k, v) for k, v in out.items()}
