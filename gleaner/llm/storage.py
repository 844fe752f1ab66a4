"""Tables between the steps of an operator, in the folder that all executors share.

A step that several later steps read, or whose shuffle files should go before the
next shuffle begins, is written as Parquet. Written tables survive lost executors.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from gleaner.session import prepare, shared_dir

SETTINGS = {
    # Shuffle files of a finished action are never read again: all reuse goes through written tables.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Long texts make batches of a fixed number of rows unbounded.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
}

# Rows of some MB each, compressed already. By default a page and a row group are closed after 100 rows at the
# earliest, so that a task would hold hundreds of MB of them, in the heap and in the buffers of the codec, and
# again when it reads them; here sizes are looked at after each row.
WIDE_ROWS = {
    "compression": "uncompressed",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}


_shipped: set[str] = set()


def ship_code(context: SparkContext) -> None:
    """Send this package to the executors, whose Python workers import it; once an application."""
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / "gleaner_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that these operators rely on, and the code on its executors."""
    prepare(spark)
    ship_code(spark.sparkContext)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as the session's Hadoop settings give them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Shelf:
    """Named tables of one call of an operator; the folder goes when the application ends."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = prepared(spark)
        self.folder = f"{shared_dir(spark).rstrip('/')}/gleaner-{operator}-{uuid.uuid4().hex}"
        path, files = hadoop_path(spark, self.folder)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def put(self, name: str, df: DataFrame, wide: bool = False) -> DataFrame:
        """Write a table and read it back without its lineage. wide: its rows have some MB each."""
        df.write.options(**(WIDE_ROWS if wide else {})).mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that no unfinished step reads."""
        for name in names:
            path, files = hadoop_path(self.spark, f"{self.folder}/{name}")
            files.delete(path, True)
