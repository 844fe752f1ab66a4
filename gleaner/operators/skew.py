"""Join helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import settled

BLOCK_ROWS = 1_000_000
BROADCAST_BYTES = 16 << 20


def _salted(many: DataFrame, few: DataFrame, key: str, spread_by: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a _salt; rows of ``few`` are repeated once per block of their key."""
    counts = many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    blocks = settled(counts)
    left = many.join(blocks, key).withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.col("_blocks")).cast("int"))
    right = few.join(blocks, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return left.drop("_blocks"), right.drop("_blocks")


def salted_join(
    many: DataFrame,
    few: DataFrame,
    key: str,
    spread_by: str,
    block_rows: int = BLOCK_ROWS,
    dealt: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """Inner join in which a hot key of ``many`` is cut into blocks of ``block_rows``.

    An ordinary key costs nothing extra and a hot one is worked on by many tasks.
    ``dealt`` deals both sides by columns, for joins that make many rows of few.
    """
    left, right = _salted(many, few, key, spread_by, block_rows)
    if dealt:
        left, right = dealt(left, key, "_salt"), dealt(right, key, "_salt")
    return left.join(right, [key, "_salt"]).drop("_salt")


def checked_join(many: DataFrame, few: DataFrame, key: str, spread_by: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join that leaves the rows of ``many``, and their texts, where they are.

    ``few`` has a row per key. Its size is measured: up to ``most_bytes`` it goes to
    the tasks, beyond that the keys of ``many`` alone meet it, and what they find
    comes back by ``spread_by``, a unique column, so that no key is one task.
    """
    few = settled(few)
    size = few.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()["bytes"] or 0
    if size <= most_bytes:
        return many.join(F.broadcast(few), key, "left")
    found = salted_join(many.select(spread_by, key).filter(F.col(key).isNotNull()), few, key, spread_by)
    return many.join(found.drop(key), spread_by, "left")


def with_last(rows: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the last non-null value of the rows before, within a group, without gathering a group in one task.

    Rows are sorted in ranges of (group, order), so a hot group spans many tasks. Looking
    back stays inside a range, and takes what the group's ranges before leave off with
    where it finds nothing; of those there is one row a range. Pass narrow rows.
    """
    keys = [F.col(group).asc(), *order]
    ranged = settled(
        settled(rows)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    known = F.when(F.col(value).isNotNull(), F.struct("_row", value))
    edges = ranged.groupBy(group, "_part").agg(F.max(known).alias("_last"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(group, "_part", F.last("_last", ignorenulls=True).over(earlier)[value].alias("_before"))
    before = Window.partitionBy(group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    looked = ranged.withColumn("_inside", F.last(value, ignorenulls=True).over(before)).join(edges, [group, "_part"], "left")
    return looked.withColumn(name, F.coalesce("_inside", "_before")).drop("_part", "_row", "_inside", "_before")
