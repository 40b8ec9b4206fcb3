"""Language identification by string kernels.

A text is the set of its character n-grams of 1 to ``ORDER`` letters (a blended spectrum, presence only),
hashed into ``BUCKETS`` cells. The kernel of two texts is the number of shared cells over the geometric
mean of their own. Landmark texts (Nystroem) turn kernel values into coordinates, and one-versus-rest
kernel ridge regression learns a score for each language. As the kernel is linear in the presence of
cells, the product of landmarks and weights folds into one matrix, and a batch of texts is scored by one
matrix product.

The model is fitted on a bounded sample: about ``PER_CLASS`` labelled texts of each language, drawn by a
hash of the id at a rate that follows the language's count, and ``LANDMARKS`` of them as landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import prepare, unused

ORDER, BUCKETS = 3, 1 << 14
PER_CLASS, LANDMARKS = 500, 256
RIDGE = 1e-2
#: Texts in a matrix product.
BATCH = 256
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint64)


def cells(text: str) -> np.ndarray:
    """Cells of the n-grams of a text, with repeats; case is folded and digits count as white space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    c = np.where((c <= 64) | ((c >= 91) & (c <= 96)) | ((c >= 123) & (c <= 127)), np.uint64(32), c)
    h = c * _MIX[0]
    out = [h]
    for n in range(1, ORDER):
        if len(c) <= n:
            break
        h = h[:-1] * np.uint64(31) + c[n:] * _MIX[n % 3]
        out.append(h)
    h = np.concatenate(out)
    return ((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D) >> np.uint64(12)) & np.uint64(BUCKETS - 1)


def presence(texts) -> np.ndarray:
    """One row of zeros and ones for each text."""
    x = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for row, text in zip(x, texts, strict=True):
        if text:
            row[cells(text).astype(np.int64)] = 1
    return x


def has_letter(text) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(x: np.ndarray, y: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """(languages, matrix of cells by languages): kernel ridge regression in Nystroem coordinates, folded."""
    names = sorted(set(y))
    x = x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    place = np.array([names.index(v) for v in y])
    order = np.argsort(place, kind="stable")
    picked = order[np.unique(np.linspace(0, len(order) - 1, min(landmarks, len(order))).astype(int))]
    z = x[picked]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_zz to the power -1/2
    phi = (x @ z.T).astype(np.float64) @ root
    target = np.where(place[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1.0 / np.bincount(place)[place]  # every language weighs the same
    a = phi.T @ (phi * share[:, None]) + ridge / len(names) * np.eye(phi.shape[1]) / 10
    w = np.linalg.solve(a, phi.T @ (target * share[:, None]))
    return names, np.ascontiguousarray((z.T @ (root @ w)).astype(np.float32))


def predict(texts: list, names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """The language of each text and its share of the votes, from 0 to 1."""
    langs: list[str] = []
    scores: list[float] = []
    for at in range(0, len(texts), BATCH):
        part = texts[at : at + BATCH]
        x = presence(part)
        s = (x @ matrix) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        e = np.exp(4.0 * (s - s.max(1, keepdims=True)))
        p = e / e.sum(1, keepdims=True)
        top = p.argmax(1)
        for k, text in enumerate(part):
            known = has_letter(text)
            langs.append(names[top[k]] if known else "und")
            scores.append(float(p[k, top[k]]) if known else 0.0)
    return langs, scores


def train(docs: DataFrame, usable, *, id_col="doc_id", text_col="text", lang_col="lang", per_class: int = PER_CLASS):
    """Fit on a sample of the rows of ``docs`` for which the condition ``usable`` holds."""
    rows = docs.filter(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    rate = F.create_map(*[F.lit(v) for k in sorted(counts) for v in (k, min(1.0, per_class / counts[k]))])
    chance = F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / F.lit(float(1 << 53))  # ids may be null or repeat

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = [np.packbits(presence([t])[0].astype(bool)).tobytes() for t in b["text"]]
            yield pd.DataFrame({"id": b["id"].astype("string"), "lang": b["lang"], "bits": bits})

    drawn = rows.filter(chance < F.element_at(rate, F.col("lang"))).dropDuplicates(["id", "text", "lang"])
    sample = drawn.mapInPandas(packed, "id string, lang string, bits binary")
    got = sorted(sample.collect(), key=lambda r: (r["lang"], str(r["id"]), bytes(r["bits"])))
    if not got:  # chance drew none of a handful: take them all
        got = sorted(rows.mapInPandas(packed, "id string, lang string, bits binary").collect(), key=lambda r: (r["lang"], str(r["id"])))
    x = np.stack([np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)) for r in got]).astype(np.float32)
    return fit(x, [r["lang"] for r in got])


def identify(docs: DataFrame, usable, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """Predict the language of every text; learn from the rows for which ``usable`` (a column) holds.

    Returns all columns of ``docs`` plus lang_pred and lang_score (0 to 1). Only text is an input of a
    prediction. About ``per_class`` rows of each language are drawn to learn from; equal rows count once. A null text, or one without any letter, is ``und`` with score 0. Rows that repeat get the
    same answer; nulls in other columns and clashing names of other columns do no harm (an own lang_pred
    or lang_score is replaced). With nothing to learn from, every row is ``und``. An empty table gives no
    rows. Texts are read whole.
    """
    prepare(docs.sparkSession)
    names, matrix = train(docs, usable, id_col=id_col, text_col=text_col, lang_col=lang_col, per_class=per_class)
    docs = docs.drop("lang_pred", "lang_score")

    @F.pandas_udf("lang string, score double")
    def voted(texts: pd.Series) -> pd.DataFrame:
        if not names:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": [0.0] * len(texts)})
        langs, scores = predict(list(texts), names, matrix)
        return pd.DataFrame({"lang": langs, "score": scores})

    vote = unused(docs, "_vote")
    out = docs.withColumn(vote, voted(F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{vote}.lang").alias("lang_pred"), F.col(f"{vote}.score").alias("lang_score"))
