"""Usage facts: snapshots, deltas, histories, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(calls: DataFrame, *by: str) -> DataFrame:
    """Additive counters by kind of call, and their totals. ``calls``: kind, tokens, cached and the columns of ``by``."""
    chat, embed, hit = F.col("kind") == "chat", F.col("kind") == "embed", F.col("cached")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0.0))
    return calls.groupBy(*by).agg(
        F.count_if(chat).alias("chat_calls"), F.count_if(embed).alias("embed_calls"), F.count_if(hit).alias("cache_hits"),
        total(chat & ~hit).alias("chat_tokens"), total(embed & ~hit).alias("embed_tokens"), total(~hit).alias("all_tokens"),
    )


def delta(before: DataFrame, after: DataFrame, key: str, *fields: str) -> DataFrame:
    """Field by field, after minus before; what is missing counts as 0."""
    b = before.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    zero = F.lit(0)
    return after.join(b, [key], "full_outer").select(key, *[(F.coalesce(f, zero) - F.coalesce(f"_{f}", zero)).alias(f) for f in fields])


def history(turns: DataFrame, most: int = 6, *, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each turn with the up to ``most`` messages before it, oldest first."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-most, -1)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))


def sliding_count(events: DataFrame, seconds: int, *, by: str = "user_id", ts: str = "ts", name: str = "n") -> DataFrame:
    """Events of the same key in the ``seconds`` up to and with each one."""
    s = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(by).orderBy(s).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn(name, F.count("*").over(w))


def admissions(calls: DataFrame, rpm: int, window: float = 60.0, *, by: str = "user_id", at: str = "at", id_col: str = "event_id") -> DataFrame:
    """``admitted``: when a limiter of ``rpm`` calls in ``window`` seconds lets each call pass.

    admit(i) = max(at(i), admit(i - rpm) + window). Calls of one residue class modulo rpm form a chain, on which that
    is a running maximum of at(j) - window * j, so a window function replaces the recursion.
    """
    order = Window.partitionBy(by).orderBy(at, id_col)
    c = calls.withColumn("_i", F.row_number().over(order) - 1)
    c = c.withColumn("_c", F.col("_i") % rpm).withColumn("_k", F.floor(F.col("_i") / rpm))
    chain = Window.partitionBy(by, "_c").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.max(F.col(at) - F.lit(float(window)) * F.col("_k")).over(chain)
    return c.withColumn("admitted", ahead + F.lit(float(window)) * F.col("_k")).drop("_i", "_c", "_k")
