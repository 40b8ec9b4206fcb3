"""The corpus pipeline: toxicity, language, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns what goes on to the next one: documents in the columns
they came with, and at last the packed pieces. A stage works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, table
from corvane.llm.decontamination import contaminated
from corvane.llm.jaccard_join import jaccard_components
from corvane.llm.language_id import identify
from corvane.llm.packing import pack
from corvane.llm.queries import tokenizer_path
from corvane.llm.toxicity import score_toxicity

#: Scores from which a document counts as toxic, and below which its language counts as unknown.
TOXIC, UNSURE = 0.7, 0.3
#: Column of a row's own name, and so many names may be broadcast.
KEY, FEW_IDS = "_corvane_row", 1_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """With a name for each row by its id and text: ids may be null or repeat. Rows that agree in both are one."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``_keyed`` documents whose name is not among ``keys``; these are broadcast if known to be few."""
    return docs.join(F.broadcast(keys) if keys.count() <= FEW_IDS else keys, [KEY], "left_anti").drop(KEY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``; all labels teach.

    A null or empty text gets the score of texts that say nothing and stays where that is low. Repeated rows fare alike,
    null ids and extra columns pass, an empty table gives no rows.
    """
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True), threshold=TOXIC)
    return scored.filter("tox_pred = 0").select(docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in them whose language is told with a score of ``UNSURE`` or more.

    Null, empty and letterless texts go. Repeated rows fare alike, null ids and extra columns pass, an empty table
    gives no rows.
    """
    told = identify(docs, F.lit(True))
    return told.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= UNSURE)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id (a null id comes first).

    Rows that repeat both id and text count once; rows that share an id but not the text are judged each. Null and empty
    texts are copies of nothing. Extra columns pass, an empty table gives no rows.
    """
    scratch = Scratch(spark, "copies")
    keyed = _keyed(docs)
    names = keyed.groupBy(KEY).agg(F.min("doc_id").alias("id"), F.count("*").alias("many"))
    found = jaccard_components(keyed.select(KEY, "text"), id_col=KEY).groupBy(KEY).agg(F.min("component_id").alias("component"))
    found = scratch.keep(found.join(names, [KEY]), "found")
    first = found.groupBy("component").agg(F.min(F.struct("id", KEY))[KEY].alias(KEY))
    copies = scratch.keep(found.select(KEY).join(first.select(KEY), [KEY], "left_anti"), "copies")
    again = scratch.keep(found.filter("many > 1").select(KEY), "again")
    kept = _without(keyed, copies.union(again))
    if again.isEmpty():
        return kept
    twice = keyed.join(again, [KEY], "left_semi").join(copies, [KEY], "left_anti")
    return kept.unionByName(twice.dropDuplicates(["doc_id", "text"]).drop(KEY))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away.

    Every row is judged by its own text, also where its id is null or repeats. Null and empty texts give nothing away.
    Extra columns pass, an empty table gives no rows.
    """
    keyed = _keyed(docs)
    leaks = contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=KEY).select(KEY).distinct()
    return _without(keyed, Scratch(spark, "leaks").keep(leaks, "leaks"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens.

    A null text counts as an empty one, which is a piece of one token. Repeated rows are packed each, null ids pass;
    an empty table gives no rows.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_documents),
]

#: No SQL can express the learned stages; ``tests/llm`` holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written as Parquet in the shared folder and read again.

    What a stage left is removed once its successor's result is written.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
