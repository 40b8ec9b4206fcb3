"""Retrieval compositions: dense, graph expansion, local search, two stages, context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import minmax
from corvane.operators import graph
from corvane.operators.beam import BeamSpec, beam_search, entity_scores
from corvane.operators.topk import scored, top

#: Labels of the three systems.
SYSTEMS = ("dense", "graph", "paths")


def dense(passages: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """(id, score): raw inner products, the best k."""
    return top(scored(passages, query), k)


def ablation(passages: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """The dense result under the label of every system."""
    found = dense(passages, query, k)
    return found.select(F.explode(F.array(*map(F.lit, SYSTEMS))).alias("system"), "id", "score")


def next_pairs(vectors: DataFrame) -> DataFrame:
    """(id, a, b): each vector with the next of its label by id."""
    after = F.lead("vector").over(Window.partitionBy("label").orderBy("id"))
    return vectors.select("id", F.col("vector").alias("a"), after.alias("b")).filter("b is not null")


def blend(main: DataFrame, second: DataFrame, share: float = 0.5, *, key: str = "chunk") -> DataFrame:
    """(key, score): min-max of ``main`` (0 where missing) plus ``share`` times min-max of ``second``."""
    both = second.select(key, F.col("dense").alias("d")).join(main.select(key, "g"), [key], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    ends = both.agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    norm = lambda x: F.when(F.col(f"{x}1") - F.col(f"{x}0") < 1e-12, 0.0).otherwise((F.col(x) - F.col(f"{x}0")) / (F.col(f"{x}1") - F.col(f"{x}0")))
    return both.join(F.broadcast(ends)).select(key, (norm("g") + F.lit(share) * norm("d")).alias("score"))


def local_search(sims: DataFrame, provenance: DataFrame, relations: DataFrame, dense_scores: DataFrame, *, k: int = 10, most: int = 10, floor: float = 0.5) -> DataFrame:
    """(chunk, score): chunks of the matched entities by summed similarity, half a point for every relation between
    two of them that cites the chunk, blended with dense scores.

    ``sims``: id, score of entities; ``provenance``: id, chunks; ``relations``: src, dst, chunks;
    ``dense_scores``: chunk, dense. Without a match the dense scores alone decide.
    """
    matched = sims.filter(F.col("score") >= floor).orderBy(F.col("score").desc(), "id").limit(most)
    held = matched.join(provenance, ["id"]).select(F.explode("chunks").alias("chunk"), F.col("score").alias("g"))
    ends = matched.select("id")
    pairs = relations.join(ends.withColumnRenamed("id", "src"), ["src"]).join(ends.withColumnRenamed("id", "dst"), ["dst"])
    cited = pairs.select(F.explode("chunks").alias("chunk"), F.lit(0.5).alias("g"))
    found = held.union(cited).groupBy("chunk").agg(F.sum("g").alias("g"))
    return blend(found, dense_scores).orderBy(F.col("score").desc(), "chunk").limit(k)


def graph_expansion(seeds: DataFrame, edges: DataFrame, links: DataFrame, dense_scores: DataFrame, *, k: int = 10) -> DataFrame:
    """(chunk, score): passages linked to the seeds (1.0) and their neighbours (0.4), blended with dense scores.

    Seeds that lead nowhere leave the dense scores alone to decide. The drop of scores that are not above 0
    comes after the cut to k.
    """
    overlap = graph.overlap_scores(graph.expand(seeds, edges), links).select(F.col("passage").alias("chunk"), F.col("overlap").alias("g"))
    return blend(overlap, dense_scores).orderBy(F.col("score").desc(), "chunk").limit(k).filter("score > 0")


def reset_weights(entities: DataFrame, passages: DataFrame, passage_weight: float = 0.05) -> DataFrame:
    """(id, p): min-maxed entity weights and ``passage_weight`` times min-maxed passage scores."""
    e = minmax(entities.select("id", F.col("weight").alias("w")), "w", name="p").select("id", "p")
    d = minmax(passages.select("id", F.col("score").alias("w")), "w", name="p").select("id", (F.lit(passage_weight) * F.col("p")).alias("p"))
    return e.unionByName(d).groupBy("id").agg(F.sum("p").alias("p"))


def merge_stages(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, score): second-stage ranks where there are any, else the first's times half the least second-stage rank."""
    floor = second.agg((0.5 * F.min("rank")).alias("floor"))
    return (
        first.select("id", F.col("rank").alias("r1")).join(second.select("id", F.col("rank").alias("r2")), ["id"], "left").join(F.broadcast(floor))
        .select("id", F.coalesce("r2", F.col("r1") * F.coalesce("floor", F.lit(1.0))).alias("score"))
    )


def two_stage(
    query: DataFrame, passages: DataFrame, propositions: DataFrame, mentions: DataFrame, synonyms: DataFrame, links: DataFrame, edges: DataFrame,
    *, k: int = 10, focus: int = 50, rounds: int = 20, spec: BeamSpec | None = None,
) -> DataFrame:
    """(id, score): path search, personalised PageRank, then both again on the subgraph of the best passages.

    ``passages``, ``propositions``: id, vector (propositions also passage); ``mentions``: prop, ord, entity;
    ``synonyms``: src, dst, weight; ``links``: entity, passage; ``edges``: the whole graph. Vertex ids of entities and
    passages must differ. Falls back to dense scores without reset mass, and to the first stage without a
    second.
    """
    spec = spec or BeamSpec()
    dpr = minmax(scored(passages, query), "score")
    vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(passages.select("id")).distinct()
    paths = beam_search(query, propositions, mentions, synonyms, spec).filter("final_rank <= 20")
    found = top(entity_scores(paths, mentions).select(F.col("entity").alias("id"), F.col("total").alias("score")), 40)
    weights = vertices.join(passages.select("id"), ["id"], "left_anti").join(found.select("id", F.lit(1.0).alias("w")), ["id"], "left")
    reset = reset_weights(weights.select("id", F.coalesce("w", F.lit(0.0)).alias("weight")), dpr)
    ranks = graph.pagerank(vertices, edges, reset, 0.75, rounds)
    if ranks is None:
        return top(dpr, k)
    doc1 = ranks.join(passages.select("id"), ["id"], "left_semi")
    best = doc1.orderBy(F.col("rank").desc(), "id").limit(focus)
    inside = best.select("id").union(links.join(best.select(F.col("id").alias("passage")), ["passage"]).select("entity")).distinct()
    sub = graph.induced(edges, inside)
    chosen = propositions.join(best.select(F.col("id").alias("passage")), ["passage"], "left_semi")
    if chosen.isEmpty() or sub.isEmpty():
        return top(doc1.select("id", F.col("rank").alias("score")), k)
    paths2 = beam_search(query, chosen, mentions, synonyms, spec).filter("final_rank <= 5")
    found2 = entity_scores(paths2, mentions).orderBy(F.col("total").desc(), "entity").limit(5)
    weights2 = inside.join(passages.select("id"), ["id"], "left_anti").join(found2.select(F.col("entity").alias("id"), F.col("best").alias("w")), ["id"], "left")
    reset2 = reset_weights(weights2.select("id", F.coalesce("w", F.lit(0.0)).alias("weight")), dpr.join(inside, ["id"], "left_semi"))
    ranks2 = graph.pagerank(inside, sub, reset2, 0.45, rounds)
    if ranks2 is None:
        return top(doc1.select("id", F.col("rank").alias("score")), k)
    return top(merge_stages(doc1, ranks2.join(passages.select("id"), ["id"], "left_semi")), k)


def assemble_context(reports: DataFrame, relations: DataFrame, chunks: DataFrame, *, budget: int = 5, most_reports: int = 2, most_lines: int = 10) -> DataFrame:
    """(qid, ord, kind, text): up to two reports by rating, one block of relation lines, then chunks, within the budget."""
    by_rating = Window.partitionBy("qid").orderBy(F.col("rating").desc(), "id")
    r = reports.withColumn("n", F.row_number().over(by_rating)).filter(F.col("n") <= most_reports).select("qid", F.lit(0).alias("k"), "n", F.lit("report").alias("kind"), "text")
    by_weight = Window.partitionBy("qid").orderBy(F.col("weight").desc(), "id")
    lines = relations.withColumn("n", F.row_number().over(by_weight)).filter(F.col("n") <= most_lines)
    block = lines.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("text"))
    b = block.select("qid", F.lit(1).alias("k"), F.lit(1).alias("n"), F.lit("relations").alias("kind"), "text")
    by_rank = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    c = chunks.withColumn("n", F.row_number().over(by_rank)).filter(F.col("n") <= budget).select("qid", F.lit(2).alias("k"), "n", F.lit("chunk").alias("kind"), "text")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("k", "n"))
    return r.unionByName(b).unionByName(c).withColumn("ord", place).filter(F.col("ord") <= budget).select("qid", "ord", "kind", "text")
