"""Connected components of a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut

#: Up to so many links are solved in one task; more are contracted in rounds first.
LOCAL = 200_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, component) of the links of one partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for x, y in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    ids = list(parent)
    yield pd.DataFrame({"id": np.array(ids, dtype=np.int64), "component": np.array([root(x) for x in ids], dtype=np.int64)})


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every end of a link; the component is its smallest id.

    While there are more than ``LOCAL`` links, rounds of contraction: every node points to its smallest
    neighbour (or itself), pointers are followed once more, and links are renamed to their roots. The few
    that are left then fit one task.
    """
    edges = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    named = None
    while edges.count() > LOCAL:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        further = points.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
        roots = cut(points.join(further, ["to"]).select(F.col("a").alias("id"), F.col("beyond").alias("component")))
        named = roots if named is None else renamed(named, roots)
        ra, rb = (roots.select(F.col("id").alias(x), F.col("component").alias(f"r{x}")) for x in "ab")
        edges = cut(
            edges.join(ra, ["a"]).join(rb, ["b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct()
        )
    last = cut(edges.repartition(1).mapInPandas(_forest, "id long, component long"))
    return last if named is None else renamed(named, last)


def renamed(named: DataFrame, roots: DataFrame) -> DataFrame:
    """``named`` with its components replaced by those that ``roots`` gives them."""
    over = roots.select(F.col("id").alias("component"), F.col("component").alias("root"))
    return cut(named.join(over, ["component"], "left").select("id", F.coalesce("root", "component").alias("component")))
