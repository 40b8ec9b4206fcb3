"""Model calls as tables: a cache in front, retries, checks, accounting; extraction rounds and community reports on top.

A model is a function from prompt to answer. It runs in Arrow batches, once for every distinct prompt that the cache does
not hold; a prompt that fails gives an error and takes nothing else down.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import cache_key, parse_relations, parse_typed_entities
from corvane.session import cut, prepare

Model = Callable[[str], str]


def tokens_of(text):
    """A count of tokens where the model reports none: pieces between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def model_calls(
    requests: DataFrame, models: Model | Mapping[str, Model], *, cache: DataFrame | None = None, tries: int = 3, check: Callable[[str], bool] | None = None
) -> DataFrame:
    """(id, key, value, error, tries, cache_hit, prompt_tokens, completion_tokens) of requests (id, prompt, and model if there are several).

    ``models``: a function, or functions by name; a name that is none of them is an error. ``cache``: key, value.
    Equal requests are one call. A call is tried up to ``tries`` times, as long as it raises or ``check`` (if given)
    refuses its answer. Cached calls count no tokens. A null prompt is an error of no tries.
    """
    prepare(requests.sparkSession)
    named = models if isinstance(models, Mapping) else {"": models}
    r = requests if isinstance(models, Mapping) else requests.withColumn("model", F.lit(""))
    r = r.select("id", "prompt", "model", cache_key(F.coalesce("model", F.lit("")), F.coalesce("prompt", F.lit(""))).alias("key"))

    def call(function: Model | None, prompt: str | None) -> tuple:
        if function is None or prompt is None:
            return None, "LookupError: no such model" if function is None else "ValueError: no prompt", 0
        error = None
        for turn in range(1, tries + 1):
            try:
                value = function(prompt)
                if check is None or check(value):
                    return value, None, turn
                error = "ValueError: answer refused"
            except Exception as e:  # one prompt must not fail the rest
                error = f"{type(e).__name__}: {e}"
        return None, error, tries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [call(named.get(m), p) for m, p in zip(b["model"], b["prompt"], strict=True)]
            yield pd.DataFrame([(k, *g) for k, g in zip(b["key"], got, strict=True)], columns=["key", "value", "error", "tries"])

    kept = requests.sparkSession.createDataFrame([], "key string, value string") if cache is None else cache.select("key", "value").dropDuplicates(["key"])
    asked = r.dropDuplicates(["key"]).join(kept, ["key"], "left_anti").select("key", "model", "prompt")
    new = cut(asked.mapInPandas(run, "key string, value string, error string, tries int"))  # a call is never made twice
    held = kept.select("key", "value", F.lit(None).cast("string").alias("error"), F.lit(0).alias("tries"), F.lit(True).alias("cache_hit"))
    out = r.join(held.unionByName(new.withColumn("cache_hit", F.lit(False))), ["key"])
    count = lambda c: F.when(F.col("cache_hit"), F.lit(0).cast("long")).otherwise(tokens_of(F.col(c)))
    return out.select("id", "key", "value", "error", "tries", "cache_hit", count("prompt").alias("prompt_tokens"), count("value").alias("completion_tokens"))


def _answers(chunks: DataFrame, prompt, model: Model) -> DataFrame:
    return model_calls(chunks.select("id", prompt.alias("prompt")), model).select("id", "value")


def extraction_rounds(chunks: DataFrame, model: Model, *, rounds: int = 1) -> DataFrame:
    """(id, entities, relations, failed) of chunks (id, text): extraction, one repair of unreadable output, further rounds.

    ``entities``: name, type, description; ``relations``: source, target, description, strength. A further round shows the
    model what was found and adds what it names. ``failed``: the first answer and its repair gave nothing.
    """
    read = lambda c: (parse_typed_entities(F.col(c)), parse_relations(F.col(c)))
    empty = (F.size(F.coalesce("entities", F.array())) == 0) & (F.size(F.coalesce("relations", F.array())) == 0)
    first = _answers(chunks, F.concat(F.lit("Extract entities and relationships as JSON.\n"), "text"), model)
    found = chunks.select("id", "text").join(first, ["id"], "left")
    e, r = read("value")
    found = cut(found.withColumn("entities", e).withColumn("relations", r))
    fixed = _answers(found.filter(empty).withColumn("value", F.coalesce("value", F.lit(""))), F.concat(F.lit("Correct this JSON.\n"), "value"), model)
    e, r = read("fixed")
    found = found.join(fixed.withColumnRenamed("value", "fixed"), ["id"], "left")
    found = found.withColumn("entities", F.when(empty, e).otherwise(F.col("entities"))).withColumn("relations", F.when(F.col("fixed").isNotNull(), r).otherwise(F.col("relations")))
    found = cut(found.withColumn("failed", empty).drop("value", "fixed"))
    e, r = read("value")
    for _ in range(max(0, rounds)):
        seen = F.to_json(F.struct("entities", F.col("relations").alias("relationships")))
        more = _answers(found, F.concat(F.lit("Add what is missing, as JSON.\n"), seen, F.lit("\n"), "text"), model)
        found = found.join(more, ["id"], "left")
        join = lambda old, new: F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array()))
        found = cut(found.withColumn("entities", join(F.col("entities"), e)).withColumn("relations", join(F.col("relations"), r)).drop("value"))
    return found.select("id", "entities", "relations", "failed")


def summarised_entities(entities: DataFrame, model: Model, *, most: int = 800) -> DataFrame:
    """(key, summary) of entities (key, name, descriptions): long ones are summarised by the model, else cut to ``most`` characters."""
    joined = F.array_join(F.array_distinct("descriptions"), " ")
    long = (F.size("descriptions") > 1) & (F.length(joined) > most)
    rows = entities.select("key", "name", joined.alias("joined"), long.alias("long"))
    asked = rows.filter("long").select(F.col("key").alias("id"), F.concat(F.lit("Summarise as JSON.\n"), "name", F.lit("\n"), "joined").alias("prompt"))
    told = model_calls(asked, model).select(F.col("id").alias("key"), F.get_json_object("value", "$.description").alias("told"))
    return rows.join(told, ["key"], "left").select("key", F.when(~F.col("long"), F.lit("")).otherwise(F.coalesce(F.trim("told"), F.substring("joined", 1, most))).alias("summary"))


def community_reports(members: DataFrame, relations: DataFrame, model: Model, *, budget: int = 8000) -> DataFrame:
    """(community, title, summary, rating, findings, parse_failed), one report a community.

    ``members``: community, id, name, type, description; ``relations``: community, source, target, description, weight.
    The model sees the members' lines by id and the relations' by falling weight, each block cut to half of ``budget`` where
    both are longer. Where it fails, or gives no JSON object, a stub names the first three members.
    """

    def block(rows: DataFrame, order, line) -> DataFrame:
        # a line has at least one character, so lines beyond the budget need not be gathered
        n = F.row_number().over(Window.partitionBy("community").orderBy(*order))
        lines = rows.withColumn("n", n).filter(F.col("n") <= budget).withColumn("line", line)
        return lines.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("block"))

    text = F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit("): "), F.col("description"))
    ents = block(members, (F.col("id"),), text).withColumnRenamed("block", "ents")
    arrow = F.concat("source", F.lit(" -> "), "target", F.lit(": "), "description", F.lit(" (w="), F.format_string("%.0f", F.col("weight").cast("double")), F.lit(")"))
    rels = block(relations, (F.col("weight").desc(), F.col("source"), F.col("target")), arrow).withColumnRenamed("block", "rels")
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("id"))).filter("n <= 3")
    titles = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ").alias("names"))
    both = ents.join(rels, ["community"], "left").join(titles, ["community"]).withColumn("rels", F.coalesce("rels", F.lit("")))
    over = F.length("ents") + F.length("rels") > budget
    both = cut(both.select("community", "names", *[F.when(over, F.substring(c, 1, budget // 2)).otherwise(F.col(c)).alias(c) for c in ("ents", "rels")]))
    asked = both.select(F.col("community").alias("id"), F.concat(F.lit("Report on this community as JSON.\n"), "ents", F.lit("\n\n"), "rels").alias("prompt"))
    said = model_calls(asked, model, check=is_object).select(F.col("id").alias("community"), "value")
    kind = "title string, summary string, rating double, findings array<struct<summary:string,explanation:string>>"
    out = both.join(said, ["community"], "left").withColumn("r", F.from_json("value", kind))
    failed = F.col("value").isNull()
    return out.select(
        "community", F.when(failed, F.col("names")).otherwise(F.coalesce("r.title", F.concat(F.lit("Community of "), F.get(F.split("names", ", "), F.lit(0))))).alias("title"),
        F.when(failed, F.substring("ents", 1, 400)).otherwise(F.coalesce("r.summary", F.lit(""))).alias("summary"),
        F.when(failed, 0.0).otherwise(F.coalesce("r.rating", F.lit(0.0))).alias("rating"),
        F.when(failed, F.array().cast("array<struct<summary:string,explanation:string>>")).otherwise(F.coalesce("r.findings", F.array())).alias("findings"),
        failed.alias("parse_failed"),
    )


def is_object(answer: str) -> bool:
    try:
        return isinstance(json.loads(answer), dict)
    except (TypeError, ValueError):
        return False
