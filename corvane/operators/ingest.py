"""Ingestion: line cleaning, paragraphs, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import prepare

#: Lines that are page numbers, arabic of up to four digits or roman of up to six letters.
PAGE_NUMBER = r"^[-–— ]*[0-9]{1,4}[-–— ]*$|^[ivxlcdmIVXLCDM]{1,6}$"
#: Window and overlap of chunks in tokens.
MAX_TOKENS, OVERLAP = 512, 96


def lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line_no, line): stripped lines."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "raw")).select("doc", "line_no", F.trim("raw").alias("line"))


def without_page_numbers(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("line").rlike(PAGE_NUMBER))


def running_lines(pages: DataFrame, fraction: float = 0.5, longest: int = 120, least_pages: int = 4) -> DataFrame:
    """(doc, line, pages): lines that stand on so many pages of a document that they are headers or footers.

    ``pages``: doc, page, text.
    """
    distinct = pages.select("doc", "page", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("line")).filter("line <> ''")
    found = distinct.filter(F.length("line") < longest).groupBy("doc", "line").agg(F.countDistinct("page").alias("pages"))
    many = pages.groupBy("doc").agg(F.countDistinct("page").alias("n")).filter(F.col("n") >= least_pages)
    return found.join(many, ["doc"]).filter(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.lit(fraction) * F.col("n")))).select("doc", "line", "pages")


def paragraphs(text):
    """Array of paragraphs: runs of lines that are not blank, joined by a space."""
    runs = F.split(F.regexp_replace(text, r"[ \t\r]+(?=\n)|(?<=\n)[ \t\r]+", ""), "\n{2,}")
    return F.filter(F.transform(runs, lambda p: F.trim(F.regexp_replace(p, "\n", " "))), lambda p: p != "")


def stride_chunks(tokens, most: int = MAX_TOKENS, overlap: int = OVERLAP):
    """Array of token windows of ``most`` with ``overlap`` in common; the last one reaches the end."""
    step = max(1, most - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - most) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(tokens, k * step + 1, most))


def fold(counts: list[int], most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[list[int]]:
    """Groups of paragraph numbers: whole paragraphs up to ``most`` tokens, then a carry of the last ones up to ``overlap``.

    A paragraph that alone exceeds ``most`` is a group of its own, in document order.
    """
    out: list[list[int]] = []
    held: list[int] = []
    size = carried = 0
    for k, n in enumerate(counts):
        if n > most:
            if len(held) > carried:
                out.append(held)
            out.append([k])
            held, size, carried = [], 0, 0
            continue
        if held and size + n > most:
            if len(held) > carried:
                out.append(held)
            keep: list[int] = []
            total = 0
            for j in reversed(held):
                if total + counts[j] > overlap:
                    break
                keep.insert(0, j)
                total += counts[j]
            held, size, carried = keep, total, len(keep)
        held.append(k)
        size += n
    if len(held) > carried:
        out.append(held)
    return out


def greedy_chunks(docs: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP, *, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(doc, idx, text, tokens): token-window chunks of whole paragraphs; long paragraphs are cut by stride."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, title, parts in zip(b["doc"], b["title"], b["parts"], strict=True):
                split = [p.split() for p in parts]
                counts = [len(t) for t in split]
                head = f"{title}\n" if title else ""
                idx = 0
                for group in fold(counts, most, overlap):
                    if counts[group[0]] > most:
                        t = split[group[0]]
                        step = max(1, most - overlap)
                        bodies = [t[s : s + most] for s in range(0, max(1, len(t) - overlap), step)]
                        texts = [" ".join(x) for x in bodies]
                    else:
                        texts = ["\n".join(parts[k] for k in group)]
                    for body in texts:
                        rows.append((doc, idx, head + body, len(body.split())))
                        idx += 1
            yield pd.DataFrame(rows, columns=["doc", "idx", "text", "tokens"])

    source = docs.select(F.col(id_col).alias("doc"), (F.col(title_col) if title_col else F.lit(None).cast("string")).alias("title"), paragraphs(F.col(text_col)).alias("parts"))
    return source.mapInPandas(run, f"doc {dict(docs.dtypes)[id_col]}, idx int, text string, tokens int")
