"""Session helpers: checkpoints in the shared folder, table access, worker imports."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers and reliable checkpoints possible.

    The checkpoint folder is the one named by ``spark.checkpoint.dir``; only where that is unset, as in
    local tests, a temporary folder is used.
    """
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corvane-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    prepare(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder; the result has a short lineage and survives lost executors."""
    spark = df.sparkSession
    prepare(spark)
    done = df.checkpoint(eager=True)._jdf
    # Plans of checkpoints keep size estimates, and joins multiply them: in a loop they would grow without end.
    # Over the same rows, a frame without them starts anew, and adaptive execution measures what there is.
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("corvane")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return b.config(map=settings).getOrCreate()
