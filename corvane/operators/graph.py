"""Knowledge-graph operators: edges, assembly, expansion, personalised PageRank, communities, neighbourhoods.

Edges are canonical (src < dst) with a weight and a kind (cooc, passage, syn).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.topk import block_topk
from corvane.session import cut

LOW, HIGH = 0.8, 0.999999


def canonical(a, b):
    return F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def cooccurrence_edges(mentions: DataFrame, *, group: str = "prop", entity: str = "entity") -> DataFrame:
    """(src, dst, weight): pairs of occurrences of two different entities in one proposition, counted.

    Repeats are folded first, so a proposition gives one row for each pair of its entities.
    """
    m = mentions.groupBy(F.col(group).alias("g"), F.col(entity).alias("e")).agg(F.count("*").alias("n"))
    a, b = (m.select("g", F.col("e").alias(f"e{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    pairs = a.join(b, ["g"]).filter("ea < eb")
    return pairs.groupBy(F.col("ea").alias("src"), F.col("eb").alias("dst")).agg(F.sum(F.col("na") * F.col("nb")).cast("double").alias("weight"))


def passage_edges(mentions: DataFrame, *, passage: str = "passage", entity: str = "entity") -> DataFrame:
    """(entity, passage, weight 1.0), each pair once."""
    return mentions.select(F.col(entity).alias("entity"), F.col(passage).alias("passage")).distinct().withColumn("weight", F.lit(1.0))


def clamp(score, low: float = LOW, high: float = HIGH):
    return F.least(F.lit(high), F.greatest(F.lit(low), score))


def synonymy_edges(entities: DataFrame, threshold: float = LOW, k: int = 100) -> DataFrame:
    """(src, dst, weight): each entity's k nearest others at ``threshold`` or more, weights clamped."""
    near = block_topk(entities, entities, k, floor=threshold)
    pairs = near.select(*canonical(F.col("qid"), F.col("id")), "score")
    return pairs.groupBy("src", "dst").agg(clamp(F.max("score"), threshold).alias("weight"))


def assemble(cooc: DataFrame, passages: DataFrame, synonyms: DataFrame) -> DataFrame:
    """All edges with their kind; a synonymy edge never replaces a pair that has an edge already."""
    first = cooc.withColumn("kind", F.lit("cooc")).unionByName(passages.withColumn("kind", F.lit("passage"))).filter("src <> dst")
    added = synonyms.join(cooc.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("kind", F.lit("syn"))
    return first.unionByName(added.filter("src <> dst"))


def valid_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices and no loops."""
    v = vertices.select("id")
    return (
        edges.filter("src <> dst").join(v.withColumnRenamed("id", "src"), ["src"], "left_semi").join(v.withColumnRenamed("id", "dst"), ["dst"], "left_semi")
    )


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return valid_edges(edges, ids)


def expand(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, hop): the seeds at 0 and their neighbours at 1."""
    near = both_ways(edges.select("src", "dst")).join(seeds.select(F.col("id").alias("src")), ["src"]).select(F.col("dst").alias("id"), F.lit(1).alias("hop"))
    return seeds.select("id", F.lit(0).alias("hop")).union(near).groupBy("id").agg(F.min("hop").alias("hop"))


def overlap_scores(expanded: DataFrame, links: DataFrame, hop_weight: float = 0.4) -> DataFrame:
    """(passage, overlap): 1 for every linked seed and ``hop_weight`` for every linked neighbour."""
    weight = F.when(F.col("hop") == 0, 1.0).otherwise(hop_weight)
    return links.join(expanded.withColumnRenamed("id", "entity"), ["entity"]).groupBy("passage").agg(F.sum(weight).alias("overlap"))


def sanitized(reset):
    """A reset weight that is null, NaN or negative is 0."""
    return F.when(reset.isNull() | F.isnan(reset) | (reset < 0), 0.0).otherwise(reset)


def pagerank(vertices: DataFrame, edges: DataFrame, reset: DataFrame, damping: float = 0.75, rounds: int = 50) -> DataFrame | None:
    """(id, rank): personalised PageRank of the undirected weighted graph after fixed rounds of power iteration.

    ``reset``: id, p. What flows out of vertices without edges returns by the reset weights, so ranks always
    sum to 1. None if no reset weight is left. Edges stay partitioned by their source and reset weights by their id
    for all rounds; a round moves what the vertices hold once, and is written as a checkpoint.
    """
    p = vertices.select("id").join(reset.select("id", sanitized(F.col("p")).alias("p")), ["id"], "left").select("id", F.coalesce("p", F.lit(0.0)).alias("p"))
    mass = p.agg(F.sum("p")).first()[0] or 0.0
    if mass <= 0:
        return None
    p = cut(p.select("id", (F.col("p") / F.lit(float(mass))).alias("p"))).repartition("id").persist()
    both = both_ways(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    total = both.groupBy("src").agg(F.sum("weight").alias("all"))
    flow = cut(both.join(total, ["src"]).select(F.col("src").alias("id"), "dst", (F.col("weight") / F.col("all")).alias("share"))).repartition("id").persist()
    held = p.select("id", F.col("p").alias("rank"))
    for turn in range(rounds + 1):
        if turn == rounds:
            out = cut(held)
            break
        got = held.join(flow, ["id"]).groupBy(F.col("dst").alias("id")).agg((F.lit(damping) * F.sum(F.col("rank") * F.col("share"))).alias("got"))
        got = cut(got)
        rest = got.agg((F.lit(1.0) - F.coalesce(F.sum("got"), F.lit(0.0))).alias("rest"))  # all that did not flow along edges
        held = p.join(got, ["id"], "left").join(F.broadcast(rest)).select("id", (F.coalesce("got", F.lit(0.0)) + F.col("rest") * F.col("p")).alias("rank"))
    p.unpersist()
    flow.unpersist()
    return out


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community) by synchronous weighted label propagation.

    Every vertex takes the label with the largest summed edge weight around it, ties to the smaller label,
    for a fixed number of rounds; weights of 0 or less count as 1; a vertex without edges keeps its own.
    A deterministic stand-in for a modularity method, not the same partition.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    both = cut(both_ways(edges.filter("src <> dst").select("src", "dst", weight.alias("weight"))))
    labels = vertices.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("id", "dst"), ["dst"]).groupBy(F.col("src").alias("id"), "community").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = seen.groupBy("id").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("new"))
        labels = cut(labels.join(best, ["id"], "left").select("id", F.coalesce("new", "community").alias("community")))
    return labels


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: weighted modularity of a partition."""
    c = labels.select("id", "community")
    e = edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("c1")), ["src"]).join(c.select(F.col("id").alias("dst"), F.col("community").alias("c2")), ["dst"])
    inside = e.filter("c1 = c2").groupBy(F.col("c1").alias("c")).agg(F.sum("weight").alias("inside"))
    degree = e.select(F.col("c1").alias("c"), "weight").union(e.select("c2", "weight")).groupBy("c").agg(F.sum("weight").alias("degree"))
    both = degree.join(inside, ["c"], "left").select(F.coalesce("inside", F.lit(0.0)).alias("i"), F.col("degree").alias("d"))
    m2 = degree.agg(F.sum("degree").alias("m2"))
    return both.join(F.broadcast(m2)).agg(F.sum(2 * F.col("i") / F.col("m2") - (F.col("d") / F.col("m2")) ** 2).alias("modularity"))


def neighbourhood(edges: DataFrame, start, hops: int = 2, most: int = 60) -> DataFrame:
    """(id, dist): vertices within ``hops`` of ``start``, the ``most`` nearest by distance and id."""
    spark = edges.sparkSession
    both = both_ways(edges.select("src", "dst"))
    seen = spark.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("dist"))
    edge_of = seen
    for d in range(1, hops + 1):
        near = both.join(edge_of.select(F.col("id").alias("src")), ["src"]).select(F.col("dst").alias("id")).distinct()
        edge_of = cut(near.join(seen, ["id"], "left_anti").withColumn("dist", F.lit(d)))
        seen = seen.unionByName(edge_of)
    return seen.orderBy("dist", "id").limit(most)


def components_within(labels: DataFrame, least: int = 2) -> DataFrame:
    """(community, size, members): communities of ``least`` members or more; members by id."""
    w = labels.groupBy("community").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("members"))
    return w.filter(F.col("size") >= least)


def intra_edges(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in one community."""
    c1, c2 = (labels.select(F.col("id").alias(k), F.col("community").alias(f"c_{k}")) for k in ("src", "dst"))
    return edges.join(c1, ["src"]).join(c2, ["dst"]).filter("c_src = c_dst").select(F.col("c_src").alias("community"), "src", "dst", "weight")


def lookup(entities: DataFrame, text: str, *, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """The one entity a text names: same content, then same but for case, then one that contains it."""
    name, low = F.col(name_col), text.strip().lower()
    level = F.when(name == text, 0).when(F.lower(name) == low, 1).when(F.lower(name).contains(low), 2)
    return entities.select(F.col(id_col).alias("id"), name.alias("name"), level.alias("level")).filter("level is not null").orderBy("level", "id").limit(1)


def ranked_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(id, other, weight, rank): each vertex's k heaviest edges."""
    w = Window.partitionBy("id").orderBy(F.col("weight").desc(), "other")
    both = both_ways(edges.select("src", "dst", "weight")).select(F.col("src").alias("id"), F.col("dst").alias("other"), "weight")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
