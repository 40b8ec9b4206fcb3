"""Entities and relations from model output: merging, descriptions, offline extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import strength
from corvane.session import prepare


def merge_entities(rows: DataFrame) -> DataFrame:
    """(key, name, type, descriptions, chunks) of rows (ord, name, type, description, chunk).

    The key is the trimmed lower-case name; the first spelling and the first type but ``other`` stay.
    """
    r = rows.withColumn("key", F.lower(F.trim("name"))).filter("key <> ''")
    return r.groupBy("key").agg(
        F.min_by("name", "ord").alias("name"),
        F.coalesce(F.min_by(F.when(F.col("type") != "other", F.col("type")), F.when(F.col("type") != "other", F.col("ord"))), F.lit("other")).alias("type"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "description"))), lambda x: x["description"]).alias("descriptions"),
        F.array_sort(F.collect_set("chunk")).alias("chunks"),
    )


def merge_relations(rows: DataFrame) -> DataFrame:
    """(src, dst, weight, n, chunks): unordered pairs with summed strength; unreadable strengths count as 5."""
    a, b = F.lower(F.trim("source")), F.lower(F.trim("target"))
    r = rows.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), strength(F.col("strength")).alias("s"), "chunk").filter("src <> dst")
    return r.groupBy("src", "dst").agg(F.sum("s").alias("weight"), F.count("*").alias("n"), F.array_sort(F.collect_set("chunk")).alias("chunks"))


def summarised(descriptions, most: int = 800):
    """Distinct descriptions joined; cut to ``most`` characters where there is more than one and they are longer."""
    joined = F.array_join(F.array_distinct(descriptions), " ")
    return F.when((F.size(descriptions) > 1) & (F.length(joined) > most), F.substring(joined, 1, most)).otherwise(joined)


def sentences_and_names(text: str | None) -> list[tuple[str, list[str]]]:
    """Offline extractor: sentences, with their capitalised spans as entities."""
    import re

    out = []
    for s in re.split(r"(?<=[.!?])\s+", text or ""):
        if s.strip():
            out.append((s.strip(), list(dict.fromkeys(re.findall(r"[^\W\d_a-zß-ÿ][\w'-]*(?: [^\W\d_a-zß-ÿ][\w'-]*)*", s)))))
    return out


def extract_propositions(chunks: DataFrame, extractor: Callable = sentences_and_names) -> DataFrame:
    """(chunk, ord, text, entities, error): one row per proposition; a chunk whose extractor fails gives one error row."""
    prepare(chunks.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c, t in zip(b["chunk"], b["text"], strict=True):
                try:
                    rows.extend((c, k, s, e, None) for k, (s, e) in enumerate(extractor(t)))
                except Exception as x:  # one failing chunk must not fail the rest
                    rows.append((c, 0, None, [], f"{type(x).__name__}: {x}"))
            yield pd.DataFrame(rows, columns=["chunk", "ord", "text", "entities", "error"])

    kind = f"chunk {dict(chunks.dtypes)['chunk']}, ord int, text string, entities array<string>, error string"
    return chunks.select("chunk", "text").mapInPandas(run, kind)


def guarded(rows: DataFrame, function: Callable[[str], str], *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, value, error) of a function that may fail on some rows."""
    prepare(rows.sparkSession)

    @F.pandas_udf("value string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((function(t), None))
            except Exception as x:
                out.append((None, f"{type(x).__name__}: {x}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return rows.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("r")).select("id", "r.value", "r.error")
