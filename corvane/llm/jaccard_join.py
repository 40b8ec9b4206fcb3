"""Near-copy components by an exact metric-space join under Jaccard distance.

Pivots are of two kinds. Distances between most texts are 1, so texts drawn from the whole table as pivots say
nothing about other texts, and the triangle inequality would copy every text to every region (figures in the
README). The outer pivots are therefore single shingles, in one global order, the rarest first. A text of n
shingles is replicated to the cells of its first n - ceil(t n) + 1, a window outside which no text of similarity t
can lie: every linked pair meets in the cell of the first shingle that both hold. There

* the places i and j of that shingle in the two orders bound the symmetric difference (a metric, too) from below,
  so pairs with i + j beyond the radius are left out;
* a pair that shares the shingle before it has met earlier, and is left out as well.

Small cells give their pairs. Large ones first give a star around leaders; the cells whose members these links do
not bring into one component are then joined by inner pivots: texts of the cell create Voronoi regions, boundary
texts are replicated by the triangle inequality's window, and regions are joined recursively, down to pairs that
sizes, places and parity strings do not part. Cells too large for a task are dealt out as pairs of blocks. Only links
between different components leave a task, never all pairs of a group.

Texts with equal sets are one node from the start. The order of shingles comes from their counts in all texts;
the ``RANKED`` most frequent are told apart, the others count as equally rare. Links are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, prepare, shuffle_partitions, sliced
from corvane.llm.components import components
from corvane.llm.shingles import mix, shingle_sets

#: Texts in which a ranked shingle stands at least, and the most shingles that are ranked.
LEAST, RANKED = 3, 500_000
#: Buckets in which all shingles are counted, as a power of two, and shingles that a task counts at once.
BUCKET_BITS, AT_ONCE = 12, 1 << 18
#: Members up to which a cell gives its pairs.
SMALL = 24
#: Members of a region that is joined pair by pair, and pivots of a larger one.
LEAF, PIVOTS = 96, 6
#: Members and bytes of a block of a cell that is too large for one task.
BLOCK, BLOCK_BYTES = 2048, 1 << 25
#: Pairs of one text that a task verifies.
SPLIT = 512
#: Length of the parity strings.
BITS = 1024
#: Rows of ids that a join may broadcast; more are joined by shuffle.
FEW_IDS = 250_000
#: A cell that is expected to have more members than this is split.
WIDE = 1000
_U = np.uint64


def _summed(h: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle once, in order, with the sum of its counts."""
    order = np.argsort(h)
    h, many = h[order], many[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    return h[at], np.add.reduceat(many, at) if len(at) else many


def _counted_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bucket, h, many): the shingles of texts and their counts, a row for each bucket of what a task holds at once."""

    def rows(held: list[np.ndarray]) -> pd.DataFrame:
        h = np.concatenate(held)
        h, many = _summed(h, np.ones(len(h), dtype=np.int64))
        bucket = (h >> _U(64 - BUCKET_BITS)).astype(np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*zip(at, np.append(at[1:], len(h)), strict=True)]
        # a task holds fewer texts at once than 32 bits can count
        parts = {"h": [h[x:y].tobytes() for x, y in ends], "many": [many[x:y].astype(np.uint32).tobytes() for x, y in ends]}
        return pd.DataFrame({"bucket": bucket[at], **parts})

    held, size = [], 0
    for b in sliced(batches):
        sets = shingle_sets(b["text"])
        held += sets
        size += sum(map(len, sets))
        if size >= AT_ONCE:
            yield rows(held)
            held, size = [], 0
    if size:
        yield rows(held)


def _counted_in_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket. Emits (h, count) of the shingles that stand in ``LEAST`` texts or more."""

    def rows(held: list[tuple[bytes, bytes]]) -> pd.DataFrame:
        h = np.frombuffer(b"".join(x for x, _ in held), dtype=np.uint64)
        h, many = _summed(h, np.frombuffer(b"".join(y for _, y in held), dtype=np.uint32).astype(np.int64))
        return pd.DataFrame({"h": _signed(h[many >= LEAST]), "count": many[many >= LEAST]})

    held, size, last = [], 0, None
    for b in batches:
        for bucket, h, many in zip(b["bucket"], b["h"], b["many"], strict=True):
            if size >= AT_ONCE and bucket != last:
                yield rows(held)
                held, size = [], 0
            held.append((h, many))
            size += len(h) // 8
            last = bucket
    if held:
        yield rows(held)


def window_size(n, percent: int):
    """Shingles of a set of n of which a linked set must hold one."""
    return n - (percent * n + 99) // 100 + 1


class Ranks:
    """Frequent shingles with their counts; all others count as rare."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.hashes & _U((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=np.int64)
        maybe = np.flatnonzero(self.bits[(h & _U((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == h[maybe]
            out[maybe[same]] = self.counts[at[same]]
        return out


def parity(h: np.ndarray) -> np.ndarray:
    """``BITS`` bits in words: whether an odd number of the set's hashes falls into each cell.

    The Hamming distance of two such strings is a metric that never exceeds the symmetric difference.
    """
    odd = np.bincount(((h >> _U(7)) & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sets."""
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    both = shared(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def distance(x: np.ndarray, y: np.ndarray) -> float:
    both = shared(x, y)
    return 1.0 - both / (len(x) + len(y) - both)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def near(percent: int, nx, ny, px, py, vx, vy):
    """Whether sizes, places of the shared shingle, and the shingles before it (0: none) leave a pair open."""
    size = percent * np.maximum(nx, ny) <= 100 * np.minimum(nx, ny)
    place = (100 + percent) * (px.astype(np.int64) + py) <= (100 - percent) * (nx.astype(np.int64) + ny)
    return size & place & ((vx != vy) | (vx == 0))


def _pairs_of_cells(percent: int):
    """Rows come sorted by (s, part, n, id). Emits (kind, s, a, b, n, pos, prev).

    kind 0: a pair to verify; 1: a member of a large cell; 2: the first member of a part of a wide cell.
    """
    names = ["s", "part", "id", "n", "pos", "prev"]

    def found(c: dict[str, np.ndarray]) -> pd.DataFrame:
        """Of whole cells."""
        s, part, node, n, pos, prev = (c[k] for k in names)
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (part[1:] != part[:-1])
        cell = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(s)))
        low, high = np.minimum.reduceat(prev, start), np.maximum.reduceat(prev, start)
        dead = (low == high) & (low != 0) & (part[start] < 0)  # all have met before
        small = size <= SMALL
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        inside = np.flatnonzero((small & ~dead & (size > 1))[cell])
        for k in range(1, SMALL):
            x = inside[inside + k < len(s)]
            x = x[cell[x + k] == cell[x]]
            if not len(x):
                break
            ends.append((x, x + k))
            inside = x
        for k in np.flatnonzero(~small & ~dead):  # stars around leaders, a new one where sizes part
            at, stop = start[k], start[k] + size[k]
            while at < stop:
                reach = at + int(np.searchsorted(percent * n[at:stop], 100 * n[at], side="right"))
                ends.append((np.full(reach - at - 1, at), np.arange(at + 1, reach)))
                at = reach
        x, y = (np.concatenate(e) for e in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 2
        keep = near(percent, n[x], n[y], pos[x], pos[y], prev[x], prev[y]) & (node[x] != node[y])
        a, b = node[x[keep]], node[y[keep]]
        pairs = pd.DataFrame({"kind": 0, "s": 0, "a": np.minimum(a, b), "b": np.maximum(a, b), "n": 0, "pos": 0, "prev": 0}).drop_duplicates()
        held = np.flatnonzero(((~small & ~dead) | (part[start] >= 0))[cell])
        first = start[part[start] >= 0]
        rows = [
            pd.DataFrame({"kind": kind, "s": s[at], "a": node[at], "b": 0, "n": n[at], "pos": pos[at], "prev": prev[at]})
            for kind, at in ((1, held), (2, first))
        ]
        return pd.concat([pairs, *rows])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # rows of a cell that may go on
        for b in batches:
            c = {k: b[k].to_numpy(dtype=np.int64) for k in names}
            if kept is not None:
                c = {k: np.concatenate([kept[k], c[k]]) for k in names}
            change = np.flatnonzero((c["s"][1:] != c["s"][:-1]) | (c["part"][1:] != c["part"][:-1]))
            if not len(change):
                kept = c
                continue
            at = int(change[-1]) + 1
            kept = {k: v[at:] for k, v in c.items()}
            yield found({k: v[:at] for k, v in c.items()})
        if kept is not None:
            yield found(kept)

    return scan


def _measured(percent: int):
    """Rows come sorted by (to, salt, role): the texts of ``to``, of role 0, and those to compare with them."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, []
        for b in sliced(batches):
            out = []
            for to, salt, role, id_, x in zip(b["to"], b["salt"], b["role"], b["id"], shingle_sets(b["text"]), strict=True):
                if (to, salt) != at:
                    at, own = (to, salt), []
                if role == 0:
                    if not any(np.array_equal(x, y) for y in own):  # rows may repeat an id
                        own.append(x)
                elif any(linked(x, y, percent) for y in own):
                    out.append((to, id_))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return scan


class Members:
    """The members of a cell in one task, and the links that join their components.

    ``block``: if given, only pairs of members of different blocks are asked for.
    """

    def __init__(self, sets, names, percent: int, n, pos, prev, block=None):
        self.sets, self.percent = sets, percent
        self.n, self.pos, self.prev = (np.asarray(v, dtype=np.int64) for v in (n, pos, prev))
        self.block = None if block is None else np.asarray(block)
        self.parity = np.stack([parity(x) for x in sets])
        _, self.parent = np.unique(np.asarray(names), return_inverse=True)
        self.root = np.arange(int(self.parent.max()) + 1)
        self.links: list[tuple[int, int]] = []

    def component(self, rows: np.ndarray) -> np.ndarray:
        return self.root[self.parent[rows]]

    def link(self, x: int, y: int) -> None:
        self.links.append((x, y))
        a, b = self.root[self.parent[x]], self.root[self.parent[y]]
        self.root[self.root == max(a, b)] = min(a, b)

    def pairwise(self, rows: np.ndarray, native: np.ndarray) -> None:
        for k, x in enumerate(rows[:-1]):
            y = rows[k + 1 :]
            open_ = (native[k] | native[k + 1 :]) & (self.component(y) != self.root[self.parent[x]])
            open_ &= near(self.percent, self.n[x], self.n[y], self.pos[x], self.pos[y], self.prev[x], self.prev[y])
            if self.block is not None:
                open_ &= self.block[y] != self.block[x]
            y = y[open_]
            if not len(y):
                continue
            apart = np.bitwise_count(self.parity[y] ^ self.parity[x]).sum(1, dtype=np.int64)
            for z in y[(100 + self.percent) * apart <= (100 - self.percent) * (self.n[y] + self.n[x])]:
                if self.root[self.parent[z]] != self.root[self.parent[x]] and linked(self.sets[x], self.sets[z], self.percent):
                    self.link(int(x), int(z))

    def join(self, rows: np.ndarray | None = None, native: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Voronoi regions of pivots with the window of the triangle inequality, recursively."""
        if rows is None:
            rows = np.arange(len(self.sets))
        if native is None:
            native = np.ones(len(rows), dtype=bool)
        components_ = self.component(rows)
        if (components_ == components_[0]).all():
            return self.links
        if len(rows) <= LEAF:
            self.pairwise(rows, native)
            return self.links
        pivots = rows[np.linspace(0, len(rows) - 1, PIVOTS).astype(int)]
        far = np.array([[distance(self.sets[x], self.sets[p]) for p in pivots] for x in rows])
        own = far.argmin(1)
        radius = 1 - self.percent / 100
        reached = far <= far.min(1, keepdims=True) + 2 * radius + 1e-9
        if reached.sum() > 2 * len(rows) or reached.sum(0).max() > 0.8 * len(rows):  # the pivots part too little
            self.pairwise(rows, native)
            return self.links
        for p in range(len(pivots)):
            inside = reached[:, p]
            if inside.any():
                self.join(rows[inside], native[inside] & (own[inside] == p))
        return self.links


def jaccard_components(docs: DataFrame, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of texts whose sets of 5-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``id_col``, n_shingles and component_id: the smallest id reachable by links, itself included.
    A set holds the distinct shingles of the whole text (A-Z lower-cased, words split at ASCII white
    space); a text of fewer than five words is one shingle. Null, empty and blank texts have an empty set
    and are linked with nothing. Rows that share an id are one document: what is linked with one of them is
    linked with all (their empty texts aside). Rows with a null id keep a null component and link nothing. Other
    columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = shuffle_partitions(spark)
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    told = texts.filter("id is not null").select("text").mapInPandas(_counted_in_task, "bucket int, h binary, many binary")
    told = told.repartition(parts, "bucket").sortWithinPartitions("bucket")
    counted = scratch.keep(told.mapInPandas(_counted_in_all, "h long, count long"), "ranks")
    del told
    classes = counted.groupBy("count").agg(F.count("*").alias("many")).toPandas().sort_values("count", ascending=False)
    ranked = classes["count"][classes["many"].cumsum() <= RANKED]
    least = int(ranked.min()) if len(ranked) else 1 << 62
    common = counted.filter(F.col("count") >= least).toArrow()  # rows collected one by one would fill the driver
    ranks = spark.sparkContext.broadcast(
        Ranks(common["h"].to_numpy().astype(np.int64).view(np.uint64), common["count"].to_numpy().astype(np.int64))
    )
    del common
    widest = int(classes["count"].max()) if len(classes) else 0
    split = min(4096, max(1, -(-widest // WIDE)))
    wide_from = WIDE if split > 1 else 1 << 62
    scratch.drop("ranks")

    def described(batches):
        rank = ranks.value
        for b in sliced(batches):
            sets = shingle_sets(b["text"])
            rows = []
            freq = rank.of(np.concatenate(sets)) if len(sets) else np.zeros(0, dtype=np.int64)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(int)
            for k, s in enumerate(sets):
                n = len(s)
                if not n:
                    rows.append((0, 0, 0, [], 0, 0))
                    continue
                f = freq[at[k] : at[k + 1]]
                pick = np.lexsort((mix(s), f))[: window_size(n, percent)]
                m, f = mix(s + _U(77)), f[pick]
                sums = _signed(np.array([m.sum(), np.bitwise_xor.reduce(mix(m + _U(5)))]))
                rows.append((n, int(sums[0]), int(sums[1]), _signed(s[pick]), int(np.searchsorted(f, 1)), int(np.searchsorted(f, wide_from))))
            out = pd.DataFrame(rows, columns=["n", "k1", "k2", "s", "ranked", "wide"])
            out.insert(0, "id", b["id"].array)
            yield out

    kind = "id long, n int, k1 long, k2 long, s array<long>, ranked int, wide int"
    sets = scratch.keep(texts.mapInPandas(described, kind).withColumn("row", F.monotonically_increasing_id()), "sets")
    slim = scratch.keep(sets.select("row", "id", "n", "k1", "k2"), "slim")
    filled = slim.filter("n > 0 and id is not null")
    firsts = filled.groupBy("n", "k1", "k2").agg(F.min(F.struct("id", "row")).alias("f"), F.count("*").alias("many"))
    nodes = scratch.keep(firsts.select("n", "k1", "k2", F.col("f.id").alias("rep"), F.col("f.row").alias("first"), "many"), "nodes")
    copies = scratch.keep(filled.join(nodes.filter("many > 1"), ["n", "k1", "k2"]).filter("row <> first").select("row"), "copies")
    # documents that hold several sets, by rows that share an id, link these
    several = filled.groupBy("id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo <> hi").select("id")
    shared_ids = filled.join(several, ["id"]).join(nodes, ["n", "k1", "k2"]).select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    shared_ids = scratch.keep(shared_ids, "shared_ids")

    held = _small(sets.filter("n > 0 and id is not null"), copies, "row", "left_anti")
    place = held.selectExpr("id", "k1", "n", "s as every", "ranked", "wide", "posexplode(s) as (pos, s)").selectExpr(
        "s", f"int(if(pos >= wide, pmod(xxhash64(id, k1), {split}), -1)) as part", "id", "n", "pos",
        "if(pos > 0 and pos >= ranked, every[pos - 1], 0L) as prev",  # rare shingles stand in small cells, which need none
    )
    met = scratch.keep(
        place.repartition(parts, "s", "part")
        .sortWithinPartitions("s", "part", "n", "id")
        .mapInPandas(_pairs_of_cells(percent), "kind int, s long, a long, b long, n long, pos long, prev long"),
        "met",
    )
    del place, held
    scratch.drop("sets", "copies")
    members = met.filter("kind = 1").select("s", F.col("a").alias("id"), "n", "pos", "prev")
    leaders = met.filter("kind = 2").select("s", F.col("a").alias("id"), "n")
    lead = leaders.groupBy("s").agg(F.min(F.struct("n", "id")).alias("lead"))
    across = (
        leaders.join(lead, ["s"])
        .filter(F.col("id") != F.col("lead.id"))
        .filter(F.lit(percent) * F.col("n") <= 100 * F.col("lead.n"))
        .select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))
    )
    pairs = scratch.keep(met.filter("kind = 0").select("a", "b").union(across).distinct(), "pairs")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """The linked ones of the pairs. Texts go to the first ones of their pairs, of which one with many is split."""
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).alias("many"))
        dealt = pairs.join(many, ["a"]).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("many")).cast("int"))
        roles = dealt.select(F.col("b").alias("id"), F.col("a").alias("to"), "salt", F.lit(1).alias("role"))
        roles = roles.union(dealt.select(F.col("a").alias("id"), F.col("a").alias("to"), "salt", F.lit(0).alias("role")).distinct())
        roles = scratch.keep(roles, f"{name}_roles")
        sent = _small(texts.filter("id is not null"), roles, "id", "inner").repartition(parts, "to", "salt").sortWithinPartitions("to", "salt", "role", "id")
        found = scratch.keep(sent.select("to", "salt", "role", "id", "text").mapInPandas(_measured(percent), "a long, b long"), name)
        scratch.drop(f"{name}_roles")
        return found

    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verify(first, "links").union(shared_ids)
    named = scratch.keep(components(links), "named")
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for x in "ab":
        own = named.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        rest = rest.join(own, [x], "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    rest = scratch.keep(rest.filter("ca <> cb").select("a", "b"), "rest")
    if not rest.isEmpty():
        links = links.union(verify(rest, "more_links"))
        named = scratch.keep(components(links), "more_named")

    owned = members.join(named, ["id"], "left").withColumn("component", F.coalesce("component", "id"))
    open_cells = owned.groupBy("s").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), (8 * F.sum("n")).alias("bytes")
    ).filter("lo <> hi")
    blocks = open_cells.select("s", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    owned = scratch.keep(owned.join(blocks, ["s"]), "open")
    if not owned.isEmpty():

        def joined(rows: pd.DataFrame) -> pd.DataFrame:
            sets_ = shingle_sets(rows["text"])
            keep = [k for k, (x, n) in enumerate(zip(sets_, rows["n"], strict=True)) if len(x) == n]  # an id may have texts elsewhere
            if len(keep) < 2:
                return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
            rows, sets_ = rows.iloc[keep], [sets_[k] for k in keep]
            same = bool((rows["lo"] == rows["hi"]).all())
            cell = Members(sets_, rows["component"], percent, rows["n"], rows["pos"], rows["prev"], None if same else rows["block"])
            ids = rows["id"].to_numpy()
            return pd.DataFrame([(ids[x], ids[y]) for x, y in cell.join()], columns=["a", "b"], dtype=np.int64)

        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        dealt = owned.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        dealt = scratch.keep(dealt.select("s", "lo", "hi", "block", "id", "n", "pos", "prev", "component"), "dealt")
        sent = _small(texts.filter("id is not null"), dealt, "id", "inner")
        more = sent.groupBy("s", "lo", "hi").applyInPandas(joined, "a long, b long").distinct()
        links = links.union(scratch.keep(more, "last_links"))
        named = scratch.keep(components(links), "last_named")
        scratch.drop("dealt")
    scratch.drop("met", "open")
    # sets of one document that is linked with none need no table
    named = nodes.join(named.withColumnRenamed("id", "rep"), ["rep"], "left").filter("many > 1 or component is not null")
    named = scratch.keep(named.select("n", "k1", "k2", F.coalesce("component", "rep").alias("component")), "classes")
    out = _small(filled, named, ["n", "k1", "k2"], "left").withColumn("component", F.coalesce("component", "id"))
    out = out.select("id", "n", "component").unionByName(
        slim.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    )
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def _small(rows: DataFrame, other: DataFrame, on, how: str) -> DataFrame:
    """A join with a table that is broadcast if it is known to be small."""
    return rows.join(F.broadcast(other) if other.count() <= FEW_IDS else other, on, how)
