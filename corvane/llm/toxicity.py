"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings (4 to 7 letters) that labelled toxic texts hold far more often than
clean ones, each at three levels: present, repeated, and frequent for the text's length. A text is the
TF-IDF vector of its terms. Labelled examples lie in an inverted index in blocks: a term's list names its blocks
with its largest weight in each, and a block holds its postings. A search adds up the maxima of the query's lists
to a bound for each block, reads blocks by falling bound, and stops when the bound falls below the k-th best cosine, so its result is
exact. The neighbours' votes, weighted by similarity and by how thinly their class was sampled, give a
calibrated score, and the neighbours are its evidence.

The examples are a bounded sample: about ``TOXIC`` toxic and ``CLEAN`` clean labelled rows, drawn by a hash
of the id at a rate that follows the counts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, prepare, unused

TOXIC, CLEAN = 2000, 4000
#: Neighbours of a vote, examples in a block of the index.
K, BLOCK = 15, 64
#: Word beginnings that count as terms.
PREFIXES = (4, 5, 6, 7)
#: A term must stand in so many toxic examples (a number, and a share of them), and there so many times as
#: often as in clean ones.
LEAST, LEAST_SHARE, LIFT, MOST_TERMS = 4, 0.02, 3.0, 2000
#: A repeated term is frequent if it makes up this share of the words.
FREQUENT = 0.004
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def bases(word: str) -> list[str]:
    """The word itself and its beginnings; a beginning has a mark in front."""
    return [word, *["^" + word[:n] for n in PREFIXES if len(word) >= n]]


def levels(base: str, count: int, words: int) -> list[tuple[str, int]]:
    out = [(base, 1)]
    if count >= 2:
        out.append((base, 2))
        if count >= FREQUENT * words:
            out.append((base, 3))
    return out


class Lists:
    """A block-max inverted index: for every term its blocks with its largest weight there, and in every block its postings."""

    def __init__(self, vectors: np.ndarray):
        self.count = len(vectors)
        rows, terms = np.nonzero(vectors)
        weights = vectors[rows, terms].astype(np.float32)
        block = rows // BLOCK
        order = np.lexsort((rows, terms, block))  # in a block by term
        rows, terms, weights, block = rows[order], terms[order], weights[order], block[order]
        self.blocks = -(-self.count // BLOCK)
        starts = np.searchsorted(block, np.arange(self.blocks + 1))
        self.postings = [(terms[a:b], (rows[a:b] % BLOCK).astype(np.int64), weights[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        new = np.ones(len(terms), dtype=bool)
        new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        most = np.maximum.reduceat(weights, first) if len(first) else weights
        by_term = np.argsort(terms[first], kind="stable")
        self.listed = block[first][by_term]
        self.maxima = most[by_term]
        self.at = np.searchsorted(terms[first][by_term], np.arange(vectors.shape[1] + 1))

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """The most that an example of each block can score, from the lists of the query's terms."""
        out = np.zeros(self.blocks, dtype=np.float64)
        for t in np.flatnonzero(v):
            span = slice(self.at[t], self.at[t + 1])
            out[self.listed[span]] += v[t] * self.maxima[span]
        return out

    def scores(self, block: int, v: np.ndarray) -> np.ndarray:
        """Cosines of the examples of a block with the query."""
        terms, rows, weights = self.postings[block]
        own = v[terms]
        hit = np.flatnonzero(own)
        size = min(BLOCK, self.count - block * BLOCK)
        return np.bincount(rows[hit], weights=own[hit].astype(np.float64) * weights[hit], minlength=size)


@dataclass
class Model:
    """Terms, their weights, and the inverted index of the examples."""

    #: base -> {level: column}
    terms: dict[str, dict[int, int]] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lists: Lists = field(default_factory=lambda: Lists(np.zeros((0, 0), dtype=np.float32)))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    #: share of toxic rows among those without any term, and among all
    without: float = 0.0
    prior: float = 0.0


def ranked_terms(hits: list[tuple[str, int, int, int]], toxic: int, clean: int) -> list[tuple[str, int]]:
    """The terms that speak for toxicity, of (base, level, toxic examples with it, clean ones), the best first."""
    ranked = []
    least = max(LEAST, LEAST_SHARE * toxic)
    for base, level, yes, no in hits:
        lift = yes / max(1, toxic) / ((no + 0.5) / (clean + 1))
        if yes >= least and lift >= LIFT:
            ranked.append((-yes * np.log(lift), base, level))
    return [(base, level) for _, base, level in sorted(ranked)[:MOST_TERMS]]


def base_counts(words: list[str]) -> dict[str, int]:
    counts: dict[str, int] = defaultdict(int)
    for w, c in Counter(words).items():
        for b in bases(w):
            counts[b] += c
    return counts


def vector_of(model: Model, words: list[str], known: dict) -> np.ndarray | None:
    """Unit TF-IDF vector, or None if the text holds no term. ``known``: word to its bases, a cache."""
    hits = [b for b in map(known.__getitem__, words) if b]
    if not hits:
        return None
    counts: dict[str, int] = defaultdict(int)
    for found in hits:
        for base in found:
            counts[base] += 1
    v = np.zeros(len(model.idf), dtype=np.float32)
    n = len(words)
    for base, c in counts.items():
        columns = model.terms[base]
        for _, level in levels(base, c, n):
            if (at := columns.get(level)) is not None:
                v[at] = (1 + np.log(c)) * model.idf[at]
    size = np.sqrt((v * v).sum())
    return v / size if size > 0 else None


class Known(dict):
    """Word to those of its bases that are terms; most words have none and share one empty tuple."""

    def __init__(self, terms: dict):
        super().__init__()
        self.terms = terms
        self.heads = {b.lstrip("^")[:4] for b in terms}

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(b for b in bases(word) if b in self.terms) if word[:4] in self.heads else ()
        if len(self) > 500_000:
            self.clear()
        self[word] = found
        return found


def nearest(model: Model, v: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(rows, cosines) of the exact k nearest examples with a cosine above 0; ties go to the earlier row."""
    bounds = model.lists.bounds(v)
    rows = np.zeros(0, dtype=np.int64)
    cosines = np.zeros(0, dtype=np.float64)
    for block in np.argsort(-bounds, kind="stable"):
        if bounds[block] <= 0 or len(rows) >= k and bounds[block] < cosines[k - 1] - 1e-6:
            break
        found = model.lists.scores(block, v)
        some = np.flatnonzero(found > (cosines[k - 1] - 1e-6 if len(rows) >= k else 0))
        rows = np.concatenate([rows, block * BLOCK + some])
        cosines = np.concatenate([cosines, found[some]])
        best = np.lexsort((rows, -np.round(cosines, 6)))[:k]
        rows, cosines = rows[best], cosines[best]
    keep = cosines > 1e-6
    return rows[keep], cosines[keep]


def vote(model: Model, v: np.ndarray | None) -> tuple[float, np.ndarray]:
    """Score from 0 to 1, and the neighbours' rows."""
    if v is None or not model.lists.count:
        return model.without, np.zeros(0, dtype=np.int64)
    rows, cosines = nearest(model, v)
    pull = cosines.astype(np.float64) ** 4 * model.weight[rows]
    doubt = 0.1 * model.weight[~model.toxic].mean() if (~model.toxic).any() else 0.0
    share = (float(pull[model.toxic[rows]].sum()) + doubt * model.prior) / (float(pull.sum()) + doubt)
    return share, rows


def columns_of(terms: list[tuple[str, int]]) -> dict[str, dict[int, int]]:
    columns: dict[str, dict[int, int]] = defaultdict(dict)
    for at, (base, level) in enumerate(terms):
        columns[base][level] = at
    return dict(columns)


def term_weights(counts: dict[str, int], words: int, columns: dict[str, dict[int, int]]) -> dict[int, float]:
    """Column to damped term frequency."""
    return {
        columns[b][level]: 1 + float(np.log(c))
        for b, c in counts.items()
        if b in columns
        for _, level in levels(b, c, words)
        if level in columns[b]
    }


def index(rows: list[tuple[int, bool, dict[int, float]]], columns: dict[str, dict[int, int]], weight: dict[bool, float]) -> Model:
    """Model of the (id, toxic, term weights) examples; ``weight``: rows that one example of a class stands for."""
    if not rows:
        return Model()
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    own = np.array([weight[t] for _, t, _ in rows])
    toxic = np.array([t for _, t, _ in rows])
    width = sum(map(len, columns.values()))
    df = np.bincount([at for *_, hit in rows for at in hit], minlength=width)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    has = np.array([bool(h) for *_, h in rows])
    vectors = np.zeros((int(has.sum()), width), dtype=np.float32)
    for v, hit in zip(vectors, (h for *_, h in rows if h), strict=True):
        for at, tf in hit.items():
            v[at] = tf * idf[at]
    vectors /= np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-12)
    # examples that share their heaviest term lie together, so that the block maxima say more
    order = np.lexsort((np.flatnonzero(has), vectors.argmax(1))) if len(vectors) else np.zeros(0, dtype=np.int64)
    vectors = vectors[order]
    prior = float(own[toxic].sum() / own.sum())
    without = float((own[~has & toxic].sum() + prior) / (own[~has].sum() + 1))
    at = np.flatnonzero(has)[order]
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    return Model(columns, idf, Lists(vectors), toxic[at], own[at], ids[at], without, prior)


def train(
    docs: DataFrame, labels: DataFrame, usable, *, id_col="doc_id", text_col="text", label_col="toxic", toxic: int = TOXIC, clean: int = CLEAN
) -> Model:
    """Index of a bounded sample of the labelled rows for which ``usable`` (a condition on ``id_col``) holds."""
    marks = (
        labels.filter(usable & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.max(label_col) == 1).alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    limit = {True: toxic, False: clean}
    rate = {t: min(1.0, limit[t] / n) for t, n in counts.items()}
    chance = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    drawn = marks.filter(chance < F.when(F.col("toxic"), rate.get(True, 0.0)).otherwise(rate.get(False, 0.0)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = cut(texts.join(drawn, ["id"]).groupBy("id", "toxic").agg(F.max("text").alias("text")))
    drawn_counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
            for text, is_toxic in zip(b["text"], b["toxic"], strict=True):
                words = words_of(text)
                for base, c in base_counts(words).items():
                    for term in levels(base, c, len(words)):
                        found[term][not is_toxic] += 1
            if found:
                yield pd.DataFrame([(*t, *n) for t, n in found.items()], columns=["base", "level", "yes", "no"])

    hits = sample.mapInPandas(counted, "base string, level int, yes long, no long").groupBy("base", "level")
    least = max(LEAST, LEAST_SHARE * drawn_counts.get(True, 0))
    common = hits.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).filter(F.col("yes") >= least).collect()
    columns = columns_of(ranked_terms([tuple(r) for r in common], drawn_counts.get(True, 0), drawn_counts.get(False, 0)))

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [term_weights(base_counts(w), len(w), columns) for w in map(words_of, b["text"])]
            yield pd.DataFrame(
                {"id": b["id"], "toxic": b["toxic"], "columns": [list(h) for h in found], "weights": [list(h.values()) for h in found]}
            )

    rows = sample.mapInPandas(weighed, "id long, toxic boolean, columns array<int>, weights array<double>").collect()
    return index([(r["id"], r["toxic"], dict(zip(r["columns"], r["weights"], strict=True))) for r in rows], columns, {t: 1 / rate[t] for t in rate})


def score_toxicity(
    docs: DataFrame, labels: DataFrame, usable, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7,
    toxic: int = TOXIC, clean: int = CLEAN,
) -> DataFrame:
    """Score every whole text of ``docs`` for toxicity, learning from the labels for which ``usable`` holds.

    Returns all columns of ``docs`` plus tox_score (0 to 1, higher: likelier toxic), tox_pred (1 if the
    score is at least ``threshold``) and tox_evidence (ids of the nearest examples, nearest first). Only
    the text is an input of a score. ``toxic`` and ``clean`` bound the examples drawn of each class. A text without any term, so also a null or empty one, gets the share
    of toxic rows among examples without any. Labels other than 0 and 1 (so also null) teach nothing; of a repeated
    id the highest label counts and one of its texts. Without labelled rows every score is 0. Repeated
    rows get equal scores, null ids are allowed, other columns pass (own result columns are replaced).
    An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    model = train(docs, labels, usable, id_col=id_col, text_col=text_col, label_col=label_col, toxic=toxic, clean=clean)
    docs = docs.drop("tox_score", "tox_pred", "tox_evidence")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample

    @F.pandas_udf("score double, evidence array<long>")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known = Known(model.terms)
        for s in texts:
            got = [vote(model, vector_of(model, words_of(t), known)) for t in s]
            yield pd.DataFrame({"score": [g[0] for g in got], "evidence": [model.ids[g[1]] for g in got]})

    tox = unused(docs, "_tox")
    out = docs.withColumn(tox, scored(F.col(text_col)))
    score = F.col(f"{tox}.score")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns], score.alias("tox_score"), (score >= threshold).cast("int").alias("tox_pred"),
        F.col(f"{tox}.evidence").alias("tox_evidence"),
    )
