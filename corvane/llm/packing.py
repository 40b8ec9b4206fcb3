"""Best-fit packing of token sequences by patterns and non-negative least squares.

Only the histogram of piece lengths (at most ``size`` numbers) reaches the driver. There, patterns of a
few lengths that nearly fill a sequence are enumerated, non-negative least squares fits how often each
is to be repeated so that together they use up the histogram, the counts are rounded down, and a
run-length best-fit packs what is left. The plan is a short list of runs: pieces number a to b of one
length go to sequences c to d at an offset. Pieces are numbered within their length in salted parts, so
that a length that many documents share is no single task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut, prepare

SIZE = 2048
#: Parts in which the pieces of one length are numbered.
SALTS = 64
#: Fillers tried for each length, the part of a sequence (one in so many tokens) that a pattern may waste, rounds
#: of the solver.
FILLERS, WASTE, ROUNDS = 6, 85, 300
#: Words whose ids a worker remembers.
REMEMBERED = 300_000

_LETTERS = "a-zªµºÀ-ÖØ-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
#: The pre-tokens of word_bpe_49k over Latin text, as its file describes them.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: How a tokenizer file describes lower-cased words in pre-tokens of letters, single digits and the rest. For
#: such files words are encoded one by one; texts for any other go through the tokenizer as a whole.
WORDLY_STEPS = ["NFC", "Replace", "Lowercase"]
WORDLY_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that split words in one library only; texts with them, with characters beyond Latin, or with a
#: special token's beginning go through the tokenizer as a whole.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "<|")
_BEYOND = re.compile("[^\x00-\u017f]")


def plain(text: str) -> bool:
    if any(x in text for x in _ODD):
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _BEYOND.search(text)
    return True


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def wordly(description: dict) -> bool:
    """Whether a tokenizer's file describes words that can be encoded one by one as ``WordIds`` does."""
    steps = (description.get("normalizer") or {}).get("normalizers", [])
    parts = (description.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [n["type"] for n in steps] == WORDLY_STEPS
        and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"] == {"Regex": WORDLY_PATTERN}
        and not parts[1]["add_prefix_space"]
        and not parts[1].get("use_regex", True)
        and description["model"]["type"] == "BPE"
        and not any(a["content"] for a in description["added_tokens"] if not a["content"].startswith("<|"))
    )


class WordIds(dict):
    """White-space word to its ids, as little-endian 32-bit bytes; equal words are encoded once.

    No pre-token spans white space, so a word is its pre-tokens one after another, and these are
    remembered too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.wordly = wordly(json.load(f))
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        out = b""
        for part in _WORD.findall(word):
            ids = self.parts.get(part)
            if ids is None:
                shown = part.encode().decode("latin-1").translate(self.letters)
                ids = self.parts[part] = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))
            out += ids
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, the same that the tokenizer gives for it."""
        if not self.wordly or not plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


_tokenizers: dict[str, WordIds] = {}


def _cutter(path: str, size: int, with_ids: bool):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from corvane.llm import packing as own

        if path not in own._tokenizers:
            own._tokenizers[path] = WordIds(path)
        encode = own._tokenizers[path].encode
        for b in batches:
            rows = []
            for i, text in zip(b["id"], b["text"], strict=True):
                ids = (encode(text) if text else b"") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "crc", *["ids"] * with_ids]).astype(
                {"id": "Int64"}
            )

    return pieces


def patterns(lengths: list[int], size: int) -> list[tuple[int, ...]]:
    """Up to four lengths of the histogram that nearly fill a sequence."""
    have, out, waste = sorted(lengths), set(), size // WASTE

    def below(room: int, many: int) -> list[int]:
        at = bisect_right(have, room)
        return have[max(0, at - many) : at]

    for a in have:
        if size - a <= waste:
            out.add((a,))
        for b in below(size - a, FILLERS):
            if size - a - b <= waste:
                out.add(tuple(sorted((a, b))))
        for share in (0.5, 0.25, 0.75):
            for b in below(int((size - a) * share), FILLERS // 2):
                for c in below(size - a - b, 2):
                    if size - a - b - c <= waste:
                        out.add(tuple(sorted((a, b, c))))
        third = (size - a) // 3
        for b in below(third, 2):
            for c in below((size - a - b) // 2, 2):
                for d in below(size - a - b - c, 1):
                    if size - a - b - c - d <= waste:
                        out.add(tuple(sorted((a, b, c, d))))
    return sorted(out)


def least_squares(found: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - counts|, A's columns being the patterns (accelerated projected gradient)."""
    width = max(map(len, found))
    at = np.array([p + (0,) * (width - len(p)) for p in found])  # counts[0] is a dummy
    scale = max(1.0, float(counts.max()))
    h = counts / scale
    n = len(counts)

    def forward(x):
        y = np.bincount(at.ravel(), np.repeat(x, width), n)
        y[0] = 0
        return y

    def back(r):
        return r[at].sum(1)

    v = np.ones(len(found))
    for _ in range(20):  # largest eigenvalue of A'A
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - back(forward(y) - h) / top)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(histogram: dict[int, int], size: int) -> tuple[np.ndarray, int]:
    """Runs (length, first number, count, first sequence, per sequence, offset) and the number of sequences.

    Where the fitted patterns happen to need more sequences than best fit alone, they are left out.
    """
    return min((_plan(histogram, size, patterns([x for x in histogram if x < size], size)), _plan(histogram, size, [])), key=lambda p: p[1])


def _plan(histogram: dict[int, int], size: int, found: list[tuple[int, ...]]) -> tuple[np.ndarray, int]:
    left = dict(histogram)
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, ...]] = []
    sequences = 0

    def take(parts: dict[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length in sorted(parts, reverse=True):
            m = parts[length]
            runs.append((length, used[length], m * times, sequences, m, offset))
            used[length] += m * times
            left[length] -= m * times
            offset += m * length
        sequences += times

    if found:
        counts = np.zeros(size + 1)
        for length, n in left.items():
            counts[length] = n if length < size else 0
        x = least_squares(found, counts)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            parts: dict[int, int] = {}
            for length in found[k]:
                parts[length] = parts.get(length, 0) + 1
            if times := min(int(x[k]), *(left[a] // m for a, m in parts.items())):
                take(parts, times)
    have: list[int] = []
    for length, n in left.items():
        if n:
            insort(have, length)
    while have:  # best fit, longest first, the same filling as often as it goes
        parts, room, top = {}, size, len(have)
        while room and (at := bisect_right(have, room, 0, top)):
            length = have[at - 1]
            m = min(room // length, left[length])
            parts[length] = m
            room -= m * length
            top = at - 1
        take(parts, min(left[a] // m for a, m in parts.items()))
        have = [a for a in have if left[a]]
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 6), sequences


def pack(
    docs: DataFrame, tokenizer: str, size: int = SIZE, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pack the token ids of all documents into few sequences of at most ``size`` tokens.

    A document is its ids by the tokenizer file at ``tokenizer`` (no special tokens added), then id 0.
    Longer ones are cut into pieces of ``size`` tokens, the last may be shorter; shorter ones stay whole.
    Returns per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``with_ids`` the ids themselves as little-endian 32-bit bytes.

    A null text counts as empty: one piece of the id 0 alone. Ids need not differ; repeated rows are
    packed each. A null id is allowed. Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    ids = ", ids binary" if with_ids else ""
    kept = ["ids"] if with_ids else []
    pieces = cut(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInPandas(_cutter(tokenizer, size, with_ids), f"id long, piece int, start long, length long, crc long{ids}")
        .withColumn("salt", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(SALTS)))
    )
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    found = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    runs, _ = plan(found, size)
    shift = int(max(found.values(), default=0)).bit_length() + 1
    keys = (runs[:, 0] << shift) + runs[:, 1]

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, number = b["length"].to_numpy(), b["number"].to_numpy()
            run = runs[np.searchsorted(keys, (length << shift) + number, side="right") - 1]
            nth = number - run[:, 1]
            b["sequence_id"] = run[:, 3] + nth // run[:, 4]
            b["offset"] = run[:, 5] + nth % run[:, 4] * length
            yield b.drop(columns="number")

    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.withColumn("ahead", F.coalesce(before, F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "crc"))
    out = f"id long, piece int, start long, length long, crc long{ids}, sequence_id long, offset long"
    return (
        pieces.withColumn("place", place)
        .join(ahead, ["length", "salt"])
        .select("id", "piece", "start", "length", "crc", *kept, (F.col("ahead") + F.col("place") - 1).alias("number"))
        .mapInPandas(placed, out)
        .select(
            F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", *kept
        )
    )
