"""URL filters by a sort-merge range join of reversed-host keys.

A host turns into a canonical key: its labels in reverse order, each followed by ``/`` (a character
that no host can hold), so ``m.example.net`` becomes ``net/example/m/``. All hosts that a rule's host
covers (itself and its subdomains) then lie in one interval of the sorted keys: those that start with
the rule's key. Intervals are nested or disjoint. Urls and rules are dealt into ranges of the key
order, a rule into every range that its interval touches, and each range is swept in key order with a
stack of the nested rules that are active. Each stack entry holds a host's path rules by path length.

Ranges come from a bounded key sample. A host with many urls gives several equal splitters; its urls
are then dealt by id over that span of ranges, so that a hot host is no single task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, prepare, shuffle_partitions

#: Sampled keys for each range; with the number of ranges this bounds what the driver receives.
SAMPLES_PER_RANGE = 40


def host_and_path(url):
    """Columns (host, path) of a url: see ``url_filter``."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return ascii_lower(raw), path


def key_of(host):
    """Canonical key: reversed labels, each followed by a slash; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))
    )


def _end(key: str) -> str:
    """The least string above all that start with ``key`` (keys end with a slash)."""
    return key[:-1] + "0"


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by key, rules before urls; the stack holds (key, host length, {path length: {path: rule}})."""
    stack: list[tuple[str, int, dict[int, dict[str, tuple[str, str]]]]] = []
    last, hit = None, (None, None)
    for b in batches:
        ids, hosts, paths, rules, verdicts = [], [], [], [], []
        for key, kind, i, host, path, rule, verdict in zip(
            b["key"], b["kind"], b["id"], b["host"], b["path"], b["rule"], b["verdict"], strict=True
        ):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
                last = None
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, len(host), {}))
                by = stack[-1][2].setdefault(len(path), {})
                if path not in by or verdict == "block":
                    by[path] = (rule, verdict)
                last = None
                continue
            if (key, path) != last:
                best, hit = (-1, -1), (None, None)
                for _, n, by_length in stack:
                    for m, by in by_length.items():
                        if m <= len(path) and (n + m, n) > best and (found := by.get(path[:m])):
                            best, hit = (n + m, n), found
                last = (key, path)
            ids.append(i)
            hosts.append(host)
            paths.append(path)
            rules.append(hit[0])
            verdicts.append(hit[1])
        if not ids:  # rules only
            continue
        yield pd.DataFrame(
            {"id": pd.array(ids, dtype="Int64"), "host": hosts, "path": paths, "rule": rules, "verdict": verdicts}
        )


def url_filter(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Judge every url by the longest rule that fits it.

    ``rules``: host, path, verdict (``block`` or ``allow``). A rule fits its host and all subdomains
    if the url's path starts with the rule's path. The longest host plus path wins, then the longer
    host, then ``block``. Returns ``id_col``, host, path, rule (host and path as text, null if none
    fits) and verdict (``default`` if none fits).

    A null url or one without ``://`` has an empty host and path, which no rule fits. The id is an
    integer; rows that repeat are judged one by one, rows with a null id are kept. Rules with a null
    or empty host take no part; a null path is empty. Other columns are left out, so clashing names
    do no harm. Empty tables give no rows, or the default verdict for each url.
    """
    spark = pages.sparkSession
    prepare(spark)
    n = shuffle_partitions(spark)
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path")).withColumn(
        "key", key_of(F.col("host"))
    )
    texts = rules.select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).filter("host is not null and host <> ''")
    texts = texts.withColumn("key", key_of(F.col("host"))).withColumn("rule", F.concat("host", "path"))

    total = max(1, pages.count())
    share = min(1.0, 2.0 * n * SAMPLES_PER_RANGE / total)
    sampled = sorted(r[0] for r in urls.select("key").sample(share, seed=7).collect())
    cuts = [sampled[len(sampled) * k // n] for k in range(1, n)] if sampled else []

    def dealt(batches):
        for b in batches:
            low = [bisect_left(cuts, k) for k in b["key"]]
            high = [bisect_right(cuts, k) for k in b["key"]]
            b["part"] = [
                lo + (0 if pd.isna(i) else int(i) * 0x9E3779B1 % 0xFFFFFFFB) % (hi - lo + 1)
                for lo, hi, i in zip(low, high, b["id"], strict=True)
            ]
            yield b

    def replicated(batches):
        for b in batches:
            b["parts"] = [
                list(range(bisect_left(cuts, k), bisect_left(cuts, _end(k)) + 1)) for k in b["key"]
            ]
            yield b

    left = urls.mapInPandas(dealt, "id long, host string, path string, key string, part int").select(
        "part", "key", F.lit(1).alias("kind"), "id", "host", "path",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    right = (
        texts.mapInPandas(replicated, "host string, path string, verdict string, key string, rule string, parts array<int>")
        .select(
            F.explode("parts").alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"),
            "host", "path", "rule", "verdict",
        )
    )
    swept = (
        left.unionByName(right)
        .repartitionById(n, F.col("part"))
        .sortWithinPartitions("key", "kind", "path")
        .mapInPandas(_sweep, "id long, host string, path string, rule string, verdict string")
    )
    return swept.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
