"""Versions of tables in one folder: a version is written whole, then made the current one by one rename."""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Versions:
    """root/data-*: folders of versions; root/versions/<number>: a file for each version in turn, which holds its folder's name.

    A marker is written under another name and renamed to the next free number, which file systems do at once: a reader
    sees the version before or the one after, and a crash between steps leaves the one before.
    """

    spark: SparkSession
    root: str

    def __post_init__(self):
        self.root = self.root.rstrip("/")
        self.path = self.spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def new_folder(self) -> str:
        return f"{self.root}/data-{uuid.uuid4().hex}"

    def numbers(self) -> list[int]:
        at = self.path(f"{self.root}/versions")
        if not self.files.exists(at):
            return []
        names = (s.getPath().getName() for s in self.files.listStatus(at))
        return sorted(int(n) for n in names if n.isdigit())

    def folder(self, number: int) -> str:
        stream = self.files.open(self.path(f"{self.root}/versions/{number}"))
        try:
            return f"{self.root}/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def current(self) -> str | None:
        """The current version's folder; None where nothing was published."""
        found = self.numbers()
        return self.folder(found[-1]) if found else None

    def publish(self, folder: str) -> int:
        """Makes a folder of this root the current version; of two that publish at once both get a number."""
        name = folder.rsplit("/", 1)[-1]
        draft = self.path(f"{self.root}/versions/.{name}")
        self.files.mkdirs(self.path(f"{self.root}/versions"))
        stream = self.files.create(draft, True)
        stream.write(name.encode())
        stream.close()
        number = (self.numbers() or [0])[-1] + 1
        while self.files.exists(self.path(f"{self.root}/versions/{number}")) or not self.files.rename(draft, self.path(f"{self.root}/versions/{number}")):
            number += 1
        return number

    def prune(self, keep: int = 2) -> list[str]:
        """Removes all but the last `keep` versions, for readers that are through with them; gives the removed folders."""
        gone = []
        for number in self.numbers()[: -max(1, keep)]:
            gone.append(self.folder(number))
            self.files.delete(self.path(f"{self.root}/versions/{number}"), False)
            self.files.delete(self.path(gone[-1]), True)
        return gone

    def write(self, df: DataFrame, *by: str) -> int:
        """A table as a new version, in folders by the given columns."""
        folder = self.new_folder()
        (df.write.partitionBy(*by) if by else df.write).parquet(folder)
        return self.publish(folder)

    def read(self) -> DataFrame | None:
        folder = self.current()
        return self.spark.read.parquet(folder) if folder else None
