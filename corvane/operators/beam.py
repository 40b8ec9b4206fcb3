"""Beam search over propositions that share entities.

A path is an array of proposition ids. Every step follows entities of the last proposition to others
that hold the same entity or a synonym of it, and jumps to the first seeds. Ordinals carried along fix
which of several equal paths counts as the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import dot, pool
from corvane.operators.topk import scored
from corvane.session import cut


@dataclass(frozen=True)
class BeamSpec:
    width: int = 4
    length: int = 3
    seeds: int = 200
    jumps: int = 3
    pooling: str = "weighted_average"
    synonym_floor: float = 0.75


def connections(lasts: DataFrame, mentions: DataFrame, synonyms: DataFrame, allowed: DataFrame, floor: float) -> DataFrame:
    """(x, y, ord, type, entity1, entity2, similarity, usable): the first connection of each x to each y.

    Exact hops of an entity come before its synonym hops, entities in the proposition's order. A y that is
    x itself or not allowed is not usable, but still counts as visited.
    """
    at = mentions.join(lasts.select(F.col("x").alias("prop")).distinct(), ["prop"]).select(F.col("prop").alias("x"), F.col("ord").alias("e_ord"), F.col("entity").alias("e1"))
    held = mentions.select(F.col("prop").alias("y"), F.col("entity").alias("e2")).distinct()
    exact = at.withColumn("e2", F.col("e1")).withColumn("sim", F.lit(1.0)).withColumn("syn", F.lit(0))
    pairs = synonyms.filter(F.col("weight") >= floor)
    near = pairs.select(F.col("src").alias("e1"), F.col("dst").alias("e2"), F.col("weight").alias("sim")).union(pairs.select("dst", "src", "weight"))
    hops = exact.unionByName(at.join(near, ["e1"]).withColumn("syn", F.lit(1))).join(held, ["e2"])
    order = ("e_ord", "syn", "e2", "y")
    first = Window.partitionBy("x", "y").orderBy(*order)
    got = hops.withColumn("n", F.row_number().over(first)).filter("n = 1").join(allowed.select(F.col("id").alias("y"), F.lit(True).alias("ok")), ["y"], "left")
    return got.select(
        "x", "y", F.struct(*order).alias("ord"), F.when(F.col("syn") == 0, "exact").otherwise("synonym").alias("type"), F.col("e1").alias("entity1"), F.col("e2").alias("entity2"),
        F.col("sim").alias("similarity"), (F.coalesce("ok", F.lit(False)) & (F.col("x") != F.col("y"))).alias("usable"),
    )


def beam_search(query: DataFrame, propositions: DataFrame, mentions: DataFrame, synonyms: DataFrame, spec: BeamSpec = BeamSpec()) -> DataFrame:
    """(path, conns, score, depth, rank, final_rank): the beams of every depth.

    ``query``: one row with vector; ``propositions``: id, vector; ``mentions``: prop, ord, entity; ``synonyms``: src, dst,
    weight. ``conns`` holds one (type, entity1, entity2, similarity) for each step, null for a jump.
    """
    one = query.select(F.col("vector").alias("q")).limit(1)
    conn = "struct<type:string,entity1:bigint,entity2:bigint,similarity:double>"
    by_score = (F.col("score").desc(), F.col("id"))
    seeds = cut(scored(propositions, query).orderBy(*by_score).limit(spec.seeds).withColumn("rank", F.row_number().over(Window.orderBy(*by_score))))
    jump = seeds.filter(F.col("rank") <= spec.jumps).select(F.col("id").alias("y"), F.col("rank").alias("j"))
    beam = seeds.filter(F.col("rank") <= spec.width).select(
        F.array("id").alias("path"), F.array().cast(f"array<{conn}>").alias("conns"), "score", F.lit(1).alias("depth"), "rank"
    )
    out, seen = beam, beam.select(F.array_sort("path").alias("key"))
    for depth in range(2, spec.length + 1):
        last = beam.withColumn("x", F.element_at("path", -1))
        group = last.groupBy("x").agg(F.min("rank").alias("g"))
        conns = cut(connections(last, mentions, synonyms, propositions, spec.synonym_floor))
        real = conns.filter("usable").select(
            "x", "y", F.lit(0).alias("k"), "ord", F.lit(0).alias("j"), F.struct("type", "entity1", "entity2", "similarity").cast(conn).alias("conn")
        )
        jumps = last.select("x").distinct().join(F.broadcast(jump)).filter("x <> y").join(conns.select("x", "y"), ["x", "y"], "left_anti")
        jumped = jumps.select("x", "y", F.lit(1).alias("k"), F.lit(None).cast(conns.schema["ord"].dataType).alias("ord"), "j", F.lit(None).cast(conn).alias("conn"))
        grown = (
            last.join(group, ["x"]).join(real.unionByName(jumped), ["x"]).filter(~F.array_contains("path", F.col("y")))
            .withColumn("made", F.struct("g", "rank", "k", "ord", "j"))
            .select(F.concat("path", F.array("y")).alias("path"), F.concat("conns", F.array("conn")).alias("conns"), "made")
            .withColumn("key", F.array_sort("path"))
        )
        fresh = grown.join(seen, ["key"], "left_anti")
        fresh = fresh.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("made"))).filter("n = 1").drop("n")
        steps = fresh.select("key", F.posexplode("path").alias("pos", "id")).join(propositions.select("id", "vector").dropDuplicates(["id"]), ["id"])
        held = steps.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vector"))), lambda s: s["vector"]).alias("vectors"))
        new = cut(
            fresh.join(held, ["key"]).join(F.broadcast(one)).select("key", "path", "conns", "made", dot(pool(F.col("vectors"), spec.pooling, F.col("q")), F.col("q")).alias("score"))
        )
        if new.isEmpty():
            break
        seen = seen.unionByName(new.select("key"))
        best = new.orderBy(F.round("score", 12).desc(), "made").limit(spec.width)
        place = F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "made"))
        beam = cut(best.withColumn("rank", place).select("path", "conns", "score", F.lit(depth).alias("depth"), "rank"))
        out = out.unionByName(beam)
    return out.withColumn("final_rank", F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "depth", "rank")))


def entity_scores(paths: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity, total, best): every entity of every proposition on a path gets the path's score, a synonym's far end too."""
    own = paths.select(F.explode("path").alias("prop"), "score").join(mentions.select("prop", "entity"), ["prop"]).select("entity", "score")
    far = paths.select(F.explode("conns").alias("c"), "score").filter("c.type = 'synonym'").select(F.col("c.entity2").alias("entity"), "score")
    return own.unionByName(far).groupBy("entity").agg(F.sum("score").alias("total"), F.max("score").alias("best"))


def path_texts(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """(final_rank, texts): the texts of each path in order."""
    steps = paths.select("final_rank", F.posexplode("path").alias("pos", "id")).join(texts.select("id", "text"), ["id"])
    return steps.groupBy("final_rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("texts"))
