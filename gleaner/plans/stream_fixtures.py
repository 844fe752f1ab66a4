"""The fixture views over tables read as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleaner.plans.fixtures import Fixtures

STREAMED = ["events", "lineitem"]


def streamed_table(fx: Fixtures, name: str) -> DataFrame:
    """One of the given tables, a file or a folder of parts, as a file stream.

    The pattern names just this table; a stream takes files by a pattern only.
    """
    schema = fx.spark.read.parquet(f"{fx.folder}/{name}.parquet").schema
    stream = fx.spark.readStream.schema(schema).parquet(f"{fx.folder}/{name}.parque[t]")
    naive = [field.name for field in schema if isinstance(field.dataType, T.TimestampNTZType)]
    return stream.withColumns({column: stream[column].cast("timestamp") for column in naive})


class StreamFixtures(Fixtures):
    """Reads the event-like tables as file streams; small dictionaries stay static."""

    def table(self, name: str) -> DataFrame:
        if name not in STREAMED:
            return super().table(name)
        return streamed_table(self, name)
