"""What a run leaves behind: its manifest, merged usage, metric files, a report in Markdown; stored corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import subset_hash

#: Columns of the report's main table: heading, column, format.
COLUMNS = (
    ("System", "system", "%s"), ("n", "n", "%d"), ("EM", "em", "%.3f"), ("F1", "f1", "%.3f"), ("R@2", "recall_2", "%.3f"),
    ("R@5", "recall_5", "%.3f"), ("R@10", "recall_10", "%.3f"),
)


def manifest(ids: DataFrame, usage: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """One row: hash and number of the subset's ids (column id; a chosen, small set), summed usage, settings.

    ``usage``: rows of number columns, such as those of several parts of a run, which are merged.
    """
    names = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in usage.columns]
    one = ids.agg(subset_hash(F.array_sort(F.collect_list(F.col("id").cast("string")))).alias("subset"), F.count("*").alias("n"))
    given = F.create_map(*[F.lit(x) for kv in sorted((settings or {}).items()) for x in kv]).cast("map<string,string>")
    return one.join(F.broadcast(usage.agg(F.struct(*names).alias("usage")))).withColumn("settings", given)


def guard_subset(found: DataFrame, ids: DataFrame) -> None:
    """Refuse to go on with a run whose manifest was made for another subset."""
    now = ids.agg(subset_hash(F.array_sort(F.collect_list(F.col("id").cast("string"))))).first()[0]
    then = found.select("subset").first()
    if then is None or then[0] != now:
        raise ValueError(f"the run belongs to another subset: {then and then[0]} is not {now}")


def report_lines(metrics: DataFrame) -> DataFrame:
    """(ord, line): a Markdown table of the metrics by system, in the order of their names."""
    spark = metrics.sparkSession
    cells = [F.when(F.col(c).isNull(), "-").otherwise(F.format_string(f, F.col(c))) for _, c, f in COLUMNS]
    body = metrics.select(F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |")).alias("line"), F.col("system").alias("key"), F.lit(2).alias("part"))
    head = [("| " + " | ".join(h for h, *_ in COLUMNS) + " |", "", 0), ("|" + "---|" * len(COLUMNS), "", 1)]
    rows = spark.createDataFrame(head, "line string, key string, part int").unionByName(body)
    return rows.orderBy("part", "key").select(F.monotonically_increasing_id().alias("ord"), "line")


def write_report(metrics: DataFrame, path: str) -> None:
    """The metrics as JSON lines under ``path``/metrics and the Markdown report under ``path``/report; both are a row a system."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    report_lines(metrics).coalesce(1).sortWithinPartitions("ord").select("line").write.mode("overwrite").text(f"{path}/report")


def corpora(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, n) of the corpora stored under ``path``, each a folder with a Parquet table ``chunks``."""
    files = spark.read.option("basePath", path).parquet(f"{path}/*/chunks")
    name = F.regexp_extract(F.input_file_name(), r"/([^/]+)/chunks/[^/]*$", 1)
    return files.select(name.alias("corpus")).groupBy("corpus").agg(F.count("*").alias("n"))
