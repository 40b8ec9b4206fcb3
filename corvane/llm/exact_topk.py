"""Exact top-k inner products over vectors sorted by length.

Candidates are dealt by descending norm and packed into blocks of at most ``BLOCK`` vectors; queries
into blocks of ``QUERY_BLOCK``. A first pass scores every query against one block of the longest vectors
and keeps its k-th best score as a floor. In the second pass a block of candidates meets a block of
queries only if the product of norms reaches the floor of one of the queries. Inside, vectors are
rotated by the singular vectors of a query sample, so that the first coordinates hold most of the
length: partial sums plus the product of the residual norms (Cauchy-Schwarz) bound every score, and only
columns that may still reach a floor are scored in full, in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut, prepare, shuffle_partitions

#: Vectors in a block of candidates, queries in a block, and queries scored at once.
BLOCK, QUERY_BLOCK, STRIP = 4096, 1024, 128
#: The floors come from one block of at most this many of the longest vectors.
SEEDS = 4096
#: Rotated coordinates of the partial sums.
HEAD = 24
_PACKED = "ids binary, vectors binary, n int, dims int, norm double, no long"


def _pack(ids: np.ndarray, m: np.ndarray, no: int) -> dict:
    norm = float(np.sqrt((m.astype(np.float64) ** 2).sum(1)).max()) if len(m) else 0.0
    return {"ids": ids.tobytes(), "vectors": m.tobytes(), "n": len(ids), "dims": m.shape[1], "norm": norm, "no": no}


def _packer(size: int):
    """Packs the rows of a partition, in their order, into blocks."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        no = TaskContext.get().partitionId() << 32
        ids: list = []
        vectors: list = []

        def block() -> pd.DataFrame:
            dims = max(map(len, vectors))
            m = np.zeros((len(vectors), dims), dtype=np.int64)
            for k, v in enumerate(vectors):
                m[k, : len(v)] = v
            return pd.DataFrame([_pack(np.array(ids, dtype=np.int64), m, no)])

        for b in batches:
            for i, v in zip(b["id"], b["vector"], strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield block()
                    no += 1
                    ids, vectors = [], []
        if ids:
            yield block()

    return pack


def _open(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["vectors"], dtype=np.int64).reshape(
        row["n"], row["dims"]
    )


def _wide(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose first columns hold most of the sample's length (right singular vectors)."""
    return np.linalg.svd(sample.astype(np.float64), full_matrices=True)[2].T


def best(qids, q, cids, c, k, floors, turn=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the up to k best candidates of each query that reach its floor.

    ``floors``: a score that at least k candidates are known to reach, or the least integer.
    """
    dims = max(q.shape[1], c.shape[1])
    q, c = _wide(q, dims), _wide(c, dims)
    place = np.argsort(np.argsort(-cids, kind="stable"), kind="stable")  # larger for smaller ids
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    head = min(HEAD, dims)
    rotate = turn is not None and turn.shape[0] == dims and head < dims
    exact = np.abs(q).max(initial=0) * float(np.abs(c).max(initial=0)) * dims < 2**52
    if rotate:
        qr, cr = qf @ turn, cf @ turn
        q_rest, c_rest = np.sqrt((qr[:, head:] ** 2).sum(1)), np.sqrt((cr[:, head:] ** 2).sum(1))
    rows, ids, scores = [], [], []
    for s in range(0, len(q), STRIP):
        part = slice(s, s + STRIP)
        low = floors[part].astype(np.float64)
        live = np.arange(len(c))
        if rotate and np.isfinite(low).all() and low.min() > -(2.0**62):
            bound = qr[part, :head] @ cr[:, :head].T
            bound += q_rest[part, None] * c_rest[None, :]
            live = np.flatnonzero((bound >= low[:, None] * (1 - 1e-9) - 1e-3 - np.abs(low)[:, None] * 1e-9).any(0))
        if not len(live):
            continue
        full = (qf[part] @ cf[live].T).astype(np.int64) if exact else q[part] @ c[live].T
        for r in range(full.shape[0]):
            row = full[r]
            ok = np.flatnonzero((row >= floors[s + r]) & (cids[live] != qids[s + r]))
            if len(ok) > k:
                kth = np.partition(row[ok], len(ok) - k)[len(ok) - k]
                above, tied = ok[row[ok] > kth], ok[row[ok] == kth]
                tied = tied[np.argsort(-place[live[tied]], kind="stable")][: k - len(above)]
                ok = np.concatenate([above, tied])
            rows.append(np.full(len(ok), s + r))
            ids.append(cids[live[ok]])
            scores.append(row[ok])
    if not rows:
        return np.array([], int), np.array([], np.int64), np.array([], np.int64)
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, vector (floor(scale * x) of every component), norm2; only vectors that take part."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return (
        vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & fine)
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("vector"),
        )
        .groupBy("id")
        .agg(F.max("vector").alias("vector"))
        .withColumn("norm2", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    )


def exact_topk(
    vectors: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, is_query=None
) -> DataFrame:
    """The k highest inner products of every query against all vectors but its own.

    Components become floor(``scale`` * x) as 64-bit integers, and scores are exact integers; ties go to
    the smaller id. Returns query_id, rank (from 1), vec_id, score: k rows for a query, or all if fewer.
    ``is_query``: a column condition on ``id`` (all vectors, if not given).

    Vectors that are null or hold null or non-finite components take no part, neither do rows with a null
    id. An id names one vector: rows that repeat an id count once, by the largest vector. Vectors of
    another length are padded with zeros; empty ones score 0. Other columns are left out. An empty table,
    or a single vector, gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    n = shuffle_partitions(spark)
    base = quantised(vectors, id_col, vector_col, scale)
    blocks = cut(
        base.repartitionByRange(n, F.col("norm2").desc(), F.col("id"))
        .sortWithinPartitions(F.col("norm2").desc(), "id")
        .select("id", "vector")
        .mapInPandas(_packer(BLOCK), _PACKED)
    )
    wanted = base.filter(is_query if is_query is not None else F.lit(True))
    asked = cut(
        wanted.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        .repartitionById(n, F.col("deal"))
        .sortWithinPartitions("id")
        .select("id", "vector")
        .mapInPandas(_packer(QUERY_BLOCK), _PACKED)
    )
    out = "query_id long, vec_id long, score long"
    sample = asked.orderBy("no").first()
    if sample is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(_open(sample)[1])
    seed_ids, seeds = [], []
    for r in blocks.orderBy("no").limit(max(1, SEEDS // BLOCK) + 1).collect():  # the longest come first
        i, m = _open(r)
        seed_ids.append(i)
        seeds.append(m)
    width = max(m.shape[1] for m in seeds)
    seed_ids, seeds = np.concatenate(seed_ids)[:SEEDS], np.concatenate([_wide(m, width) for m in seeds])[:SEEDS]
    least = np.iinfo(np.int64).min

    def floored(batches):
        for b in batches:
            floors, reach = [], []
            for _, r in b.iterrows():
                qids, q = _open(r)
                rows, _, scores = best(qids, q, seed_ids, seeds, k, np.full(len(qids), least))
                floor = np.full(len(qids), least)
                got = np.bincount(rows, minlength=len(qids))
                low = np.full(len(qids), np.iinfo(np.int64).max)
                np.minimum.at(low, rows, scores)
                floor[got >= k] = low[got >= k]
                norms = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                floors.append(floor.tobytes())
                # the least norm of a candidate that may still reach a floor
                need = np.where(floor <= 0, -1.0, floor.astype(np.float64) / np.maximum(norms, 1e-300))
                reach.append(float(need.min() * (1 - 1e-9)))
            yield b.assign(floors=floors, reach=reach)

    queries = asked.mapInPandas(floored, f"{_PACKED}, floors binary, reach double")
    spread = max(1, min(n, blocks.count()))
    q = queries.select(
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("n").alias("q_n"),
        F.col("dims").alias("q_dims"), "floors", "reach",
        F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("deal"),
    )
    c = blocks.withColumn("deal", F.pmod(F.xxhash64("no"), F.lit(spread)).cast("int"))
    met = c.join(q, ["deal"]).filter(F.col("norm") >= F.col("reach"))

    def scored(batches):
        for b in batches:
            for _, r in b.iterrows():
                cids, cm = _open(r)
                qids, qm = _open({"ids": r["q_ids"], "vectors": r["q_vectors"], "n": r["q_n"], "dims": r["q_dims"]})
                rows, ids, scores = best(qids, qm, cids, cm, k, np.frombuffer(r["floors"], dtype=np.int64), turn)
                yield pd.DataFrame({"query_id": qids[rows], "vec_id": ids, "score": scores})

    spark_batch = met.select("ids", "vectors", "n", "dims", "q_ids", "q_vectors", "q_n", "q_dims", "floors")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        spark_batch.mapInPandas(scored, out)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
