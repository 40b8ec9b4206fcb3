"""Dense top-k: one query by columns, many queries in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import dot
from corvane.session import prepare

#: Vectors packed into one block of a many-query search.
BLOCK = 2048


def scored(vectors: DataFrame, query: DataFrame, *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, score): inner product of every vector with the one row of ``query``."""
    one = query.select(F.col(vector_col).alias("_q")).limit(1)
    return vectors.join(F.broadcast(one)).select(F.col(id_col).alias("id"), dot(F.col(vector_col), F.col("_q")).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """Best k by score, then smaller id: a heap in each task, no full sort."""
    return scores.orderBy(F.col("score").desc(), "id").limit(k)


def top_per_query(scores: DataFrame, k: int, *, by: str = "qid", name: str = "rank") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "id")
    return scores.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def _packed(df: DataFrame, side: int, mine: str, other: str) -> DataFrame:
    """Blocks of vectors, dealt to a row (or column) of a grid of tasks and copied along it."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), BLOCK):
                part = b.iloc[s : s + BLOCK]
                m = np.stack([np.asarray(v, dtype=np.float64) for v in part["vector"]])
                longest = float(np.sqrt((m * m).sum(1)).max())
                yield pd.DataFrame(
                    {"ids": [part["id"].to_numpy(dtype=np.int64).tobytes()], "m": [m.tobytes()], "n": [len(part)], "dims": [m.shape[1]], "norm": [longest]}
                )

    blocks = df.select(F.col("id").cast("long").alias("id"), "vector").filter("vector is not null").mapInPandas(pack, "ids binary, m binary, n int, dims int, norm double")
    blocks = blocks.withColumn(mine, F.pmod(F.xxhash64("ids"), F.lit(side)).cast("int"))
    return blocks.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(side - 1))))


def block_topk(queries: DataFrame, candidates: DataFrame, k: int, *, floor: float | None = None, self_match: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k best candidates of every query, scored block against block.

    Both inputs have id and vector. Tasks form a square grid: a block of queries is copied along its row and a block
    of candidates along its column, so that a table moves as often as the square root of the tasks, not as often as
    there are tasks. A pair of blocks is one matrix product of which at most k rows for each query leave; it is left
    out where its longest vectors cannot reach ``floor``, the least score that counts. ``self_match``: whether a
    candidate may have the query's id.
    """
    spark = candidates.sparkSession
    prepare(spark)
    side = max(1, math.isqrt(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1) + 1)
    q = _packed(queries, side, "x", "y").select("x", "y", *[F.col(c).alias(f"q_{c}") for c in ("ids", "m", "n", "dims", "norm")])
    met = _packed(candidates, side, "y", "x").join(q, ["x", "y"]).drop("x", "y")
    if floor is not None:
        met = met.filter(F.col("norm") * F.col("q_norm") >= floor - 1e-9)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, qids = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.q_ids, dtype=np.int64)
                c = np.frombuffer(r.m).reshape(r.n, r.dims)
                s = np.frombuffer(r.q_m).reshape(r.q_n, r.q_dims) @ c.T
                order = np.argsort(ids, kind="stable")
                ids, s = ids[order], s[:, order]
                if not self_match:
                    s[qids[:, None] == ids[None, :]] = -np.inf
                if floor is not None:
                    s[s < floor] = -np.inf
                if s.shape[1] > k:
                    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    rows, at = np.nonzero((s >= kth[:, None]) & (s > -np.inf))
                else:
                    rows, at = np.nonzero(s > -np.inf)
                # by query, falling score, rising id; of ties at the end only the first are kept
                sort = np.lexsort((at, -s[rows, at], rows))
                rows, at = rows[sort], at[sort]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, at = rows[place < k], at[place < k]
                yield pd.DataFrame({"qid": qids[rows], "id": ids[at], "score": s[rows, at]})

    return top_per_query(met.mapInPandas(best, "qid long, id long, score double"), k)


def argmax_match(queries: DataFrame, candidates: DataFrame, floor: float = 0.6) -> DataFrame:
    """(qid, id, score): the best candidate of each query, if it reaches ``floor``."""
    return block_topk(queries, candidates, 1, floor=floor).select("qid", "id", "score")
