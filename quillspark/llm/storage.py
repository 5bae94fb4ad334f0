"""Intermediate tables in the folder that the driver and all executors share."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_BYTES = 16 << 20  #: of a table of numbers that is broadcast
BATCH_ROWS = "1000"  #: of texts that Spark hands to Python at once, unless the session says otherwise
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts are large rows: Spark's own number of them for a batch would be hundreds of MB."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def as_rows(docs: DataFrame, **beside: Column) -> DataFrame:
    """The columns of each row as one struct `row`, so that no name can clash with the columns beside it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in beside.items()))


def of_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """What as_rows was made of."""
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))


class Stash:
    """Tables written once and read again, which cuts lineage: a lost executor costs no more than the tasks since.

    drop() removes those that later steps no longer read; what a returned DataFrame reads stays.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quillspark-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, *by: str) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        (df.repartition(*by) if by else df).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stashed_at = path
        return out

    def small(self, df: DataFrame, row_bytes: int | Column = 0) -> DataFrame:
        """The table, written; marked for broadcast if its rows take few enough bytes, else left to a shuffled join.

        row_bytes: of a row, by default 8 for each column; a column where rows hold lists.
        """
        kept = self.put(df)
        each = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes or 8 * len(df.columns))
        return F.broadcast(kept) if (kept.agg(F.sum(each)).first()[0] or 0) <= SMALL_BYTES else kept

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = vars(df).pop("stashed_at", "")
            if path.startswith(f"{self.root}/"):
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
