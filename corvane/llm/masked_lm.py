"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

Every token of a document is predicted from ``SIDE`` tokens on its left and as many on its right: the
embeddings of the neighbours, by place, add up to a hidden layer, and a softmax gives the conditional
probabilities of the token's class. Tokens are runs of bytes between ASCII white space and punctuation, and punctuation marks;
they are told apart by 64-bit hashes. Frequent words are classes of their own; other words share a class by
their length and ending, and their probability inside it is their share of the class's words in the corpus, by a
count of every word (and one more for each, and for words not seen). The summed conditional log-probabilities score the document.

Counts of all words of all documents are gathered first (they give the vocabulary and the sizes of the
classes). The network is then trained where the documents are, once on every token of every document: the texts
are dealt to ``ROUNDS`` rounds by their hash, each task runs minibatch gradient descent over its documents of the
round, and the tasks' weights are averaged after it.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, prepare, shuffle_partitions
from corvane.llm.shingles import byte_hashes, mix

SIDE, HIDDEN = 2, 24
#: Classes of frequent words, of other words, and one for the place beyond a document's ends.
FREQUENT, TAIL = 95, 32
CLASSES = FREQUENT + TAIL + 1
EDGE = CLASSES - 1
ONES = np.ones(CLASSES, dtype=np.float32)
#: Places of the neighbours, as seen from a token.
PLACES = (*range(-SIDE, 0), *range(1, SIDE + 1))
ROUNDS, MINIBATCH, RATE = 2, 1024, 2.0
#: Words whose counts go along with the model; those of rarer words are joined by shuffle.
HELD = 300_000
#: Distinct words that a task counts before it hands its counts on; tokens scored at once; bytes of text taken at once.
COUNTED, STRIP, CHUNK = 1_000_000, 512, 1 << 18
ONES = np.ones(CLASSES, dtype=np.float32)
#: Places of the neighbours, as seen from a token.
PLACES = (*range(-SIDE, 0), *range(1, SIDE + 1))
#: Bytes that are tokens of their own, and those that part tokens; any other run of bytes is a token.
MARKS = string.punctuation.replace("_", "").encode()
_KIND = np.ones(256, dtype=np.uint8)
_KIND[[*range(33), 127]] = 0
_KIND[list(MARKS)] = 2


@dataclass
class Tokens:
    """The tokens of some documents as hashes, one document after another; their classes as rare words; tokens of each document."""

    hashes: np.ndarray
    tail: np.ndarray
    sizes: np.ndarray


def chunks(texts: Iterable) -> Iterator[list[bytes]]:
    """Lower-cased texts as bytes, some ``CHUNK`` of them at once."""
    raw, size = [], 0
    for t in texts:
        raw.append(t.lower().encode("utf-8", "surrogatepass") if t else b"")
        size += len(raw[-1])
        if size > CHUNK:
            yield raw
            raw, size = [], 0
    if raw:
        yield raw


def tokens(raw: list[bytes]) -> Tokens:
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    kind = _KIND[data]
    word, mark = kind == 1, kind == 2
    starts = np.flatnonzero((word[1:] & ~word[:-1]) | mark[1:]) + 1
    ends = np.flatnonzero((word[:-1] & ~word[1:]) | mark[:-1]) + 1
    hashes = byte_hashes(data, starts, ends)
    length = np.minimum(ends - starts, 12)
    last = data[ends - 1].astype(np.int64) * 131 + np.where(length > 1, data[ends - 2], 0) * 31
    tail = (FREQUENT + (length * 7 + last + (last >> 5)) % TAIL).astype(np.uint8)
    bounds = np.searchsorted(starts, np.concatenate([[0], 1 + np.cumsum([len(r) + 1 for r in raw])]))
    return Tokens(hashes, tail, np.diff(bounds))


class Vocabulary:
    """The words held, by the hashes of their bytes, and the logarithms of their counts and one.

    Frequent words come first and have classes of their own, in order. A word is looked up in the bucket of its hash's
    first bits, which holds few.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        # the last place is that of words not held; EDGE: not frequent
        self.frequent = np.append(np.where(order < FREQUENT, order, EDGE), EDGE).astype(np.uint8)
        self.inside = np.append(np.where(order < FREQUENT, 0.0, np.log1p(counts[order])), 0.0)
        self.shift = np.uint64(64 - max(1, int(len(hashes)).bit_length() + 1))
        edges = np.arange((1 << int(64 - self.shift)), dtype=np.uint64) << self.shift
        self.first = np.append(np.searchsorted(self.hashes, edges), len(hashes)).astype(np.int32)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Of every hash its place among the words held, or their number if it is none."""
        bucket = (h >> self.shift).astype(np.int64)
        at, stop = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(h), len(self.hashes), dtype=np.int32)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            same = self.hashes[at[open_]] == h[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out

    def read(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes with ``SIDE`` edges around each document; the tokens' places in that sequence, and among the words held."""
        known = self.places(t.hashes)
        own = self.frequent[known]
        at = np.arange(len(known)) + SIDE * (1 + np.repeat(np.arange(len(t.sizes)), t.sizes))
        classes = np.full(len(known) + SIDE * (len(t.sizes) + 1), EDGE, dtype=np.uint8)
        classes[at] = np.where(own == EDGE, t.tail, own)
        return classes, at, known


@dataclass
class Network:
    #: (place, class, hidden), (hidden, class), (class,)
    inputs: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(bias: np.ndarray) -> Network:
        rng = np.random.default_rng(4)
        return Network(
            rng.normal(0, 0.2, (2 * SIDE, CLASSES, HIDDEN)).astype(np.float32),
            rng.normal(0, 0.2, (HIDDEN, CLASSES)).astype(np.float32),
            bias.astype(np.float32),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([self.inputs.ravel(), self.out.ravel(), self.bias]).astype(np.float32)

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        a, b = 2 * SIDE * CLASSES * HIDDEN, HIDDEN * CLASSES
        flat = flat.astype(np.float32)
        return Network(flat[:a].reshape(2 * SIDE, CLASSES, HIDDEN), flat[a : a + b].reshape(HIDDEN, CLASSES), flat[a + b :])

    def hidden(self, classes: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """Hidden layer for the places ``at`` of a padded sequence of classes, with a last column of ones for the bias."""
        sides = (
            [classes[at.start + d : at.stop + d] for d in PLACES] if isinstance(at, slice) else [classes[at + d] for d in PLACES]
        )
        h = np.ones((len(sides[0]), HIDDEN + 1), dtype=np.float32)
        v = self.inputs[0].take(sides[0], axis=0, mode="clip")
        for p in range(1, 2 * SIDE):
            v += self.inputs[p].take(sides[p], axis=0, mode="clip")
        np.tanh(v, out=h[:, :HIDDEN])
        return h

    def exponentials(self, h: np.ndarray, target: np.ndarray | None = None):
        """Of the logits, up to a factor for each row; and the logarithms of those of ``target``."""
        weights = np.vstack([self.out, self.bias]).astype(np.float32)
        z = h @ weights
        if np.abs(weights).sum(0).max() > 60:  # else no logit can overflow or vanish
            z -= z.max(1, keepdims=True)
        own = None if target is None else z[np.arange(len(z)), target]
        return np.exp(z, out=z), own

    def log_probabilities(self, classes: np.ndarray) -> np.ndarray:
        """Of every class of a padded sequence, given those at its sides; the first and last ``SIDE`` places are left out."""
        n = len(classes) - 2 * SIDE
        out = np.empty(n, dtype=np.float64)
        for s in range(0, n, STRIP):
            e = min(n, s + STRIP)
            z, own = self.exponentials(self.hidden(classes, slice(SIDE + s, SIDE + e)), classes[SIDE + s : SIDE + e])
            out[s:e] = own - np.log(z @ ONES)
        return out

    def step(self, classes: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean negative log-probability of the places ``at``."""
        h, target = self.hidden(classes, at), classes[at]
        p, _ = self.exponentials(h)
        p *= (np.float32(rate / len(p)) / (p @ ONES))[:, None]
        p[np.arange(len(p)), target] -= np.float32(rate / len(p))
        back = p @ self.out.T
        v = h[:, :HIDDEN]
        back *= 1 - v * v
        change = h.T @ p
        self.out -= change[:HIDDEN]
        self.bias -= change[HIDDEN]
        for k, d in enumerate(PLACES):  # the rows of a class add up
            side = classes[at + d]
            order = side.argsort(kind="stable")
            own = side[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            self.inputs[k][own[first]] -= np.add.reduceat(back[order], first, axis=0)


@dataclass
class LanguageModel:
    vocabulary: Vocabulary
    #: by class, what the counts of its words are divided by, as a logarithm
    mass: np.ndarray
    network: Network

    def score(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its tokens and summed conditional log-probability, without the counts of words not held; the hashes of these, and the texts they stand in."""
        t = tokens(raw)
        classes, at, known = self.vocabulary.read(t)
        told = self.network.log_probabilities(classes)[at - SIDE]
        told += self.vocabulary.inside[known] - self.mass[classes[at]]
        sums = np.concatenate([[0.0], np.cumsum(told)])
        ends = np.concatenate([[0], np.cumsum(t.sizes)])
        rare = np.flatnonzero(known == len(self.vocabulary.hashes))
        return t.sizes, sums[ends[1:]] - sums[ends[:-1]], t.hashes[rare], np.searchsorted(ends, rare, side="right") - 1


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, tail, n) over all texts: the hash of each word, its class as a rare word, its count."""

    def summed(parts: list[tuple]) -> tuple:
        h, k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, first, back = np.unique(h, return_index=True, return_inverse=True)
        return h, k[first], np.bincount(back, weights=n).astype(np.int64)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, waiting = [], 0
        for b in batches:
            for raw in chunks(b["text"]):
                t = tokens(raw)
                h, first, n = np.unique(t.hashes, return_index=True, return_counts=True)
                parts.append((h, t.tail[first], n))
                waiting += len(h)
                if waiting > COUNTED:
                    parts = [summed(parts)]
                    waiting = len(parts[0][0])
                    if waiting > COUNTED // 2:
                        yield pd.DataFrame({"word": parts[0][0].view(np.int64), "tail": parts[0][1].astype(np.int32), "n": parts[0][2]})
                        parts, waiting = [], 0
        if parts:
            h, k, n = summed(parts)
            yield pd.DataFrame({"word": h.view(np.int64), "tail": k.astype(np.int32), "n": n})

    return texts.mapInPandas(counted, "word long, tail int, n long").groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[LanguageModel, DataFrame]:
    """Fit to all documents: counts of all words, and the network on every token once; also (word, n) of the words not held."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = cut(word_counts(texts))
    steps = sorted(words.groupBy(F.floor(F.log2("n") * 16).alias("step")).count().collect(), reverse=True)
    among = np.cumsum([r["count"] for r in steps])  # words of that count step or a higher one
    many = int((among <= FREQUENT + HELD).sum())
    least = steps[many - 1]["step"] if many and (many == len(steps) or among[many - 1] >= FREQUENT) else None
    kept = words.filter(F.floor(F.log2("n") * 16) >= least) if least is not None else words.orderBy(F.col("n").desc(), "word").limit(FREQUENT)
    kept = kept.collect()
    held = sorted(kept, key=lambda r: (-r["n"], r["word"]))
    top = held[:FREQUENT]
    hashes = np.array([r["word"] for r in held], dtype=np.int64)
    vocabulary = Vocabulary(hashes.view(np.uint64), np.array([r["n"] for r in held], dtype=np.float64))
    words_known = spark.sparkContext.broadcast(vocabulary)
    tail = words.filter(~F.col("word").isin([r["word"] for r in top])).groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    counts, types = np.ones(CLASSES), np.ones(CLASSES)
    counts[: len(top)] += [r["n"] for r in top]
    for r in tail.collect():
        counts[r["tail"]] += r["n"]
        types[r["tail"]] += r["types"]  # one more for words not seen
    network = Network.fresh(np.log(counts / counts.sum()))
    dealt = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    groups = max(1, min(16, shuffle_partitions(spark)))
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(network.flat())

        def trained(batches: Iterator[pd.DataFrame], start=start, rate=RATE / (1 + turn)) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            net, known, seen = Network.of(start.value.copy()), words_known.value, 0
            for b in batches:
                for raw in chunks(b["text"]):
                    classes, places, _ = known.read(tokens(raw))
                    mixed = np.random.default_rng(len(places)).permutation(places)
                    for s in range(0, len(mixed), MINIBATCH):
                        net.step(classes, mixed[s : s + MINIBATCH], rate * min(1.0, (len(mixed) - s) / MINIBATCH))
                    seen += len(mixed)
            if seen:
                part = TaskContext.get().partitionId()
                yield pd.DataFrame({"part": [part], "seen": [seen], "flat": [(net.flat().astype(np.float64) * seen).tobytes()]})

        def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen, flat = 0, None
            for b in batches:
                for n, raw in zip(b["seen"], b["flat"], strict=True):
                    v = np.frombuffer(raw, dtype=np.float64)
                    seen, flat = seen + int(n), v if flat is None else flat + v
            if seen:
                yield pd.DataFrame({"part": [0], "seen": [seen], "flat": [flat.tobytes()]})

        kind = "part int, seen long, flat binary"
        # tasks' weights are summed in a few groups, so the driver receives at most ``groups`` of them
        sums = texts.filter(dealt == turn).select("text").mapInPandas(trained, kind).repartition(groups).mapInPandas(summed, kind).collect()
        if total := sum(r["seen"] for r in sums):
            flats = sorted((r["seen"], bytes(r["flat"])) for r in sums)
            network = Network.of(sum(np.frombuffer(f, dtype=np.float64) for _, f in flats) / total)
    mass = np.where(np.arange(CLASSES) < FREQUENT, 1.0, counts - 1 + types)
    rest = words if least is None else words.filter(F.floor(F.log2("n") * 16) < least)
    return LanguageModel(vocabulary, np.log(mass), network), rest


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: tuple[LanguageModel, DataFrame] | None = None) -> DataFrame:
    """Score every whole text by its masked pseudo-likelihood.

    Returns ``id_col``, n_tokens, log_likelihood (the summed conditional log-probabilities) and
    mean_log_likelihood (per token). A null, empty or blank text has no tokens and scores 0 in both. Repeated
    rows are scored each, and count each in training; null ids are allowed; other columns are left out. An
    empty table gives no rows. ``model``: one trained before (else trained on ``docs``).
    """
    spark = docs.sparkSession
    prepare(spark)
    model = train(docs, id_col=id_col, text_col=text_col) if model is None else model
    model, counts = model
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            parts, at = [], 0
            for raw in chunks(b["text"]):
                n, total, words, owner = own.score(raw)
                part = b.iloc[at : at + len(raw)]
                at += len(raw)
                # every text has a row of its own, with a word of no count; its sum stands there
                row, ids = part["row"].to_numpy(dtype=np.int64), part["id"].array
                frame = pd.DataFrame({"row": row, "id": ids, "n": n, "total": total, "word": mix(row.view(np.uint64)).view(np.int64), "times": 0})
                seen = pd.DataFrame({"row": row[owner], "id": ids[owner], "n": 0, "total": 0.0, "word": words.view(np.int64), "times": 1})
                parts += [frame, seen]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["row", "id", "n", "total", "word", "times"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = source.mapInPandas(scored, f"row long, id {kind}, n long, total double, word long, times int")
    sums = rows.join(counts.select("word", F.col("n").alias("counted")), ["word"], "left").groupBy("row").agg(
        F.max("id").alias(id_col), F.max("n").alias("n_tokens"),
        F.sum(F.col("total") + F.col("times") * F.log1p(F.coalesce("counted", F.lit(0)))).alias("log_likelihood"),
    )
    return sums.select(id_col, "n_tokens", "log_likelihood", (F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1))).alias("mean_log_likelihood"))
