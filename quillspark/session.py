"""Sessions, and the package on the executors."""

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, unless they find it by their path. Once for each context."""
    context = spark.sparkContext
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.path.realpath(os.getcwd())}
    if str(ROOT) in paths or getattr(context, "_quillspark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quillspark-")
    context.addPyFile(shutil.make_archive(f"{folder}/quillspark", "zip", ROOT, "quillspark"))
    context._quillspark_shipped = True


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a new folder and read again: steps that need them more than once don't make them anew."""
    path = working_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables of this run, below spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="quillspark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
