"""Whole pipelines: build an index from texts, ask it, compare systems, evaluate a batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import content_id, numbered
from corvane.functions.vectors import hash_embedding
from corvane.operators import extract, graph, retrieve
from corvane.operators.beam import BeamSpec
from corvane.operators.topk import block_topk
from corvane.session import cut


@dataclass
class Index:
    """Tables of one corpus; vertex ids of chunks and entities are disjoint integers."""

    chunks: DataFrame  # id, chunk_id, text, vector
    propositions: DataFrame  # id, text, vector, passage
    entities: DataFrame  # id, entity_id, name, vector
    mentions: DataFrame  # prop, ord, entity
    links: DataFrame  # entity, passage
    synonyms: DataFrame  # src, dst, weight
    edges: DataFrame  # src, dst, weight, kind

    def write(self, path: str) -> None:
        for name, df in vars(self).items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark, path: str) -> Index:
        return Index(**{name: spark.read.parquet(f"{path}/{name}") for name in Index.__dataclass_fields__})


def number(text):
    """A 62-bit id from a content id; entities and passages take different halves by their prefix."""
    return F.shiftright(F.xxhash64(text), 2)


def build(texts: DataFrame, *, extractor: Callable = extract.sentences_and_names, embed: Callable = hash_embedding, threshold: float = 0.8, k: int = 100) -> Index:
    """Index of texts (ord, text): chunks, propositions, entities and the graph between them."""
    chunks = texts.select(content_id(F.col("text"), "chunk-").alias("chunk_id"), "text", "ord").groupBy("chunk_id").agg(F.min_by("text", "ord").alias("text"))
    chunks = cut(chunks.select((number(F.col("chunk_id")) * 2).alias("id"), "chunk_id", "text", embed(F.col("text")).alias("vector")))
    found = cut(extract.extract_propositions(chunks.select(F.col("id").alias("chunk"), "text"), extractor).filter("error is null"))
    prop_id = content_id(F.col("text"), "proposition-")
    own = found.select(number(prop_id).alias("prop"), "chunk", "ord", "text", "entities")
    propositions = own.groupBy("prop").agg(F.first("text").alias("text"), F.min("chunk").alias("passage"))
    propositions = cut(propositions.select(F.col("prop").alias("id"), "text", embed(F.col("text")).alias("vector"), "passage"))
    spread = own.select("prop", "chunk", F.posexplode("entities").alias("e_ord", "name")).filter("trim(name) <> ''")
    spread = cut(spread.withColumn("entity", number(content_id(F.trim("name"), "entity-")) * 2 + 1))
    entities = spread.groupBy("entity").agg(F.min(F.trim("name")).alias("name"))
    entities = cut(entities.select(F.col("entity").alias("id"), content_id(F.col("name"), "entity-").alias("entity_id"), "name", embed(F.col("name")).alias("vector")))
    mentions = spread.groupBy("prop", "entity").agg(F.min("e_ord").alias("ord")).select("prop", "ord", "entity")
    links = graph.passage_edges(spread.select(F.col("chunk").alias("passage"), "entity")).select("entity", "passage", "weight")
    cooc = graph.cooccurrence_edges(spread)
    synonyms = cut(graph.synonymy_edges(entities, threshold, k))
    passage = links.select(*graph.canonical(F.col("entity"), F.col("passage")), "weight")
    edges = cut(graph.assemble(cooc, passage, synonyms))
    return Index(chunks, propositions, entities, cut(mentions), cut(links.drop("weight")), synonyms, edges)


def ask(index: Index, question: DataFrame, *, system: str = "paths", k: int = 10, rounds: int = 20, spec: BeamSpec | None = None) -> DataFrame:
    """(id, score, text) of the passages that a system finds for one question (one row with text and vector)."""
    passages = index.chunks.select("id", "vector")
    if system == "dense":
        found = retrieve.dense(passages, question, k)
    elif system == "graph":
        near = _entities(index, question, 5, 0.6)
        dense = _dense(passages, question)
        found = retrieve.graph_expansion(near.select("id"), index.edges.filter("kind <> 'passage'"), index.links, dense, k=k).withColumnRenamed("chunk", "id")
    elif system == "local":
        near = cut(_entities(index, question, 10, 0.5))
        held = index.links.join(near.select(F.col("id").alias("entity")), ["entity"], "left_semi").select("entity", "passage")
        other = held.withColumnRenamed("entity", "dst")  # relations between found entities, by the passages that name both
        cited = held.join(other, ["passage"]).filter("entity < dst").select(F.col("entity").alias("src"), "dst", F.array("passage").alias("chunks"))
        named = held.select(F.col("entity").alias("id"), F.array("passage").alias("chunks"))
        found = retrieve.local_search(near.select("id", "score"), named, cited, _dense(passages, question), k=k).withColumnRenamed("chunk", "id")
    else:
        found = retrieve.two_stage(
            question, passages, index.propositions, index.mentions, index.synonyms, index.links, index.edges.select("src", "dst", "weight"), k=k, rounds=rounds, spec=spec
        )
    return found.join(index.chunks.select("id", "text"), ["id"]).orderBy(F.col("score").desc(), "id")


def _entities(index: Index, question: DataFrame, k: int, floor: float) -> DataFrame:
    """The entities nearest to the question."""
    return block_topk(question.select(F.lit(0).cast("long").alias("id"), "vector").limit(1), index.entities, k, floor=floor, self_match=True)


def _dense(passages: DataFrame, question: DataFrame) -> DataFrame:
    """(chunk, dense) of all passages."""
    one = question.select(F.col("vector").alias("q")).limit(1)
    return passages.join(F.broadcast(one)).select(F.col("id").alias("chunk"), _dot("vector", "q").alias("dense"))


def _dot(a: str, b: str):
    from corvane.functions.vectors import dot

    return dot(F.col(a), F.col(b))


def compare(index: Index, question: DataFrame, *, k: int = 10, ablation: bool = False, **options) -> DataFrame:
    """(system, id, score, text, error): every system's passages; a failing system gives one error row."""
    spark = index.chunks.sparkSession
    out = None
    for name in (*retrieve.SYSTEMS, "local"):
        try:
            rows = cut(ask(index, question, system="dense" if ablation else name, k=k, **options)).select(F.lit(name).alias("system"), "id", "score", "text", F.lit(None).cast("string").alias("error"))
        except Exception as e:  # one system must not take the others down
            rows = spark.createDataFrame([(name, None, None, None, f"{type(e).__name__}: {e}")], "system string, id long, score double, text string, error string")
        out = rows if out is None else out.unionByName(rows)
    return out


def prompt(passages: DataFrame, question: str) -> DataFrame:
    """One row: the question under its numbered passages."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "text"))), lambda x: x["text"])
    return passages.agg(F.concat(numbered(texts), F.lit(f"\n\nQuestion: {question}\nAnswer:")).alias("prompt"))
