"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions.

Built from DataFrame functions alone. Records are ordered by a key (a 64-bit hash of the text, so equal
texts are neighbours). A sample in which a record's chance is in proportion to its size gives the
splitters of some ``RANGES`` fine ranges; a splitter that is drawn twice is a heavy key and gets a range
of its own. Ranges that still hold too many bytes or rows are subdivided by a hash of the row. Running
totals over the fine ranges, and within each of them over its own records only, place every record
exactly, so that shards differ by little more than one group of equal texts.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut, prepare

#: Fine ranges, and sampled keys for each; both bound what the driver receives.
RANGES, SAMPLES = 1024, 16
#: A range is subdivided if it holds more than this many times its fair share of bytes (its largest
#: record aside), or of rows, ``FEW`` rows at least.
OVERFULL, FEW = 2, 512


def _position(key, cuts: list[int]):
    """Number of ``cuts`` (sorted) that are at most ``key``, by two small scans instead of one long."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    firsts = F.array(*[F.lit(r[0]) for r in rows])
    at = F.size(F.filter(firsts, lambda x: x <= key))
    inner = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    within = F.size(F.filter(F.get(inner, at - 1), lambda x: x <= key))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + within).cast("int")


def shard(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal ``docs`` into ``shards`` ranges of near equal bytes.

    Returns ``id_col``, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot (the place in
    the shard, gapless from 0). A null text counts as an empty one: size 1 and CRC 0. Equal texts stay
    in one shard unless they are too many for that, when they are subdivided. Repeated rows each get
    a slot; a null id is allowed. Other columns are left out. An empty table gives no rows; with fewer
    records than shards, some shards stay empty.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.encode(text, "UTF-8")
    slim = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("crc"),
            F.xxhash64(text).alias("key"),
            F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("dice"),  # equal rows with equal ids part, too
        )
    )
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    names = ("range", "sub")
    if rows:
        rate = min(1.0, RANGES * SAMPLES / total)
        chance = F.shiftrightunsigned("dice", 11) / F.lit(float(1 << 53))
        drawn = sorted(r[0] for r in slim.filter(chance < F.col("size") * rate).select("key").collect())
        at = [drawn[len(drawn) * k // RANGES] for k in range(1, RANGES)] if drawn else []
        heavy = {a for a, b in zip(at, at[1:], strict=False) if a == b}
        cuts = sorted(set(at) | {k + 1 for k in heavy if k < (1 << 63) - 1})
    else:
        cuts = []
    placed = slim.withColumn("range", _position(F.col("key"), cuts))
    fair_bytes, fair_rows = max(1, total // RANGES), max(1, rows // RANGES)
    found = placed.groupBy("range").agg(
        F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("most")
    )
    pieces = {
        r["range"]: max(2, -(-r["b"] // fair_bytes), -(-r["n"] // fair_rows))
        for r in found.collect()
        if r["b"] - r["most"] > OVERFULL * fair_bytes or r["n"] > max(FEW, OVERFULL * fair_rows)
    }
    if pieces:
        by = F.create_map(*[F.lit(x) for kv in sorted(pieces.items()) for x in kv])
        parts = F.coalesce(F.element_at(by, F.col("range")), F.lit(1))
    else:
        parts = F.lit(1)
    placed = placed.withColumn("sub", F.pmod(F.col("dice"), parts.cast("long")).cast("int"))

    units = sorted(placed.groupBy(*names).agg(F.sum("size"), F.count("*")).collect(), key=lambda r: (r[0], r[1]))
    before = [0, *accumulate(u[2] for u in units)]
    ahead = [0, *accumulate(u[3] for u in units)]
    known = spark.createDataFrame(
        [(u[0], u[1], before[i], ahead[i]) for i, u in enumerate(units)], "range int, sub int, bytes_before long, rows_before long"
    )
    own = Window.partitionBy(*names)
    ordered = (
        placed.join(F.broadcast(known), [*names])
        .withColumn("upto", F.sum("size").over(own.orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.col("rows_before") + F.row_number().over(own.orderBy("key", "id", "dice", "crc")) - 1)
        .withColumn("shard", F.expr(f"int(((bytes_before + upto - 1) * {shards}L) div {max(1, total)}L)"))
        .select("id", "size", "crc", "shard", "row")
    )
    ordered = cut(ordered)
    starts = {r[0]: r[1] for r in ordered.groupBy("shard").agg(F.min("row")).collect()}
    first = F.create_map(*[F.lit(x) for kv in sorted(starts.items()) for x in kv]) if starts else None
    slot = F.col("row") - (F.element_at(first, F.col("shard")) if first is not None else 0)
    return ordered.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", slot.cast("long").alias("slot")
    )
