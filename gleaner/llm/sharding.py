"""Shards of near-equal size by minimax contiguous partition, in DataFrame functions only.

Rows with equal texts are one atomic group and stay together. Groups are ordered by
a 64-bit hash of their text. The smallest feasible capacity is found by binary search:
a check walks the ordered sizes greedily and closes a shard before it would overflow.
A group larger than the capacity has a shard to itself, so one huge group of copies
does not leave the other shards empty. The cuts are those of the smallest capacity.

The walk needs running sums of all groups, which no one task should hold. So sizes
are summed over ranges of the hash, 65,536 at first, and only the sums reach the
driver. They bound the capacity from both sides: from below as if a range could be cut
anywhere, from above as if it were one group. Only ranges in which a cut may fall
between the two bounds, or that may hold a group above capacity, are split further,
until what is left to decide is single groups. Each round asks for at most RANGES
further sums, whatever the input.

Rows then find their shard by comparing their hash with the cuts. Slots are row numbers
inside (shard, part) plus the rows of the parts before, so that no shard is one task.

Defined results: a null text is a group of its own of size 1 a row. Null or repeated
ids are rows like others. With fewer groups than shards, shards stay empty.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gleaner.llm.storage import Shelf

SHARDS = 16
LAW = "bytes"
RANGES = 1 << 16
ROWS_PER_PART = 5_000
_BITS = 64


@dataclass(frozen=True)
class Range:
    """Groups whose hash begins with these bits. low: the least hash of the range."""

    low: int
    bits: int
    groups: int
    bytes: int
    largest: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1


def _prefix(bits: int) -> Column:
    """The leading bits of the hash in unsigned order, as a signed number that sorts alike."""
    return F.shiftright("spot", _BITS - bits)


def _sums(groups: DataFrame, bits: int, within: list[Range] | None = None) -> list[Range]:
    if within is not None:
        wanted = [r.low >> (_BITS - within[0].bits) for r in within]
        groups = groups.filter(_prefix(within[0].bits).isin(wanted))
    rows = (
        groups.groupBy(_prefix(bits).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("groups"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
        .collect()  # RANGES rows at most
    )
    return [Range(row["prefix"] << (_BITS - bits), bits, row["groups"], row["bytes"], row["largest"]) for row in rows]


class Walk:
    """Greedy walks over the ordered ranges. Positions are bytes from the start."""

    def __init__(self, ranges: list[Range]):
        self.ranges = sorted(ranges, key=lambda r: r.low)
        self.ends: list[int] = []
        for r in self.ranges:
            self.ends.append((self.ends[-1] if self.ends else 0) + r.bytes)
        self.total = self.ends[-1] if self.ends else 0

    def cuts(self, capacity: int, shards: int, whole: bool) -> list[int] | None:
        """Where each shard ends, or None if there are too few shards.

        whole: ranges are not cut; else those of several groups are cut anywhere.
        """
        out: list[int] = []
        at = 0
        while at < self.total:
            if len(out) == shards:
                return None
            limit = at + capacity
            k = bisect.bisect_right(self.ends, limit)  # ranges before k fit
            if k == len(self.ranges):
                at = self.total
            else:
                start = self.ends[k - 1] if k else 0
                cuttable = not whole and not self.ranges[k].atomic
                if cuttable:
                    at = limit
                elif start > at:
                    at = start
                else:
                    at = self.ends[k]  # alone in its shard
            out.append(at)
        return out

    def least_capacity(self, shards: int, whole: bool) -> int:
        low, high = 1, max(1, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, whole) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def undecided(self, shards: int) -> list[Range]:
        """Ranges of several groups in which a cut may fall, or that may hold a group above capacity."""
        low, high = self.least_capacity(shards, False), self.least_capacity(shards, True)
        found = {r for r in self.ranges if not r.atomic and r.largest > low}
        if low < high:
            early = self.cuts(low, len(self.ranges), True) or []
            late = self.cuts(high, len(self.ranges), False) or []
            for k in range(min(shards, len(late)) - 1):
                first = bisect.bisect_left(self.ends, early[k] if k < len(early) else self.total)
                last = bisect.bisect_left(self.ends, late[k])
                found |= {r for r in self.ranges[first : last + 1] if not r.atomic}
        return sorted(found, key=lambda r: (-r.largest, r.low))


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """Least hash of every shard but the first; groups: (spot, bytes)."""
    bits = RANGES.bit_length() - 1
    ranges = _sums(groups, bits)
    while True:
        walk = Walk(ranges)
        open_ranges = walk.undecided(shards)
        if not open_ranges:
            break
        level = open_ranges[0].bits
        batch = [r for r in open_ranges if r.bits == level][: RANGES // 16]
        step = max(4, (RANGES // len(batch)).bit_length() - 1)
        finer = _sums(groups, min(_BITS, level + step), batch)
        ranges = [r for r in walk.ranges if r not in set(batch)] + finer
    ends = walk.cuts(walk.least_capacity(shards, True), shards, True) or []
    return [walk.ranges[bisect.bisect_right(walk.ends, end)].low for end in ends[:-1]]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs`` (doc_id, text)."""
    shelf = Shelf(docs.sparkSession, "sharding")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    checksum = F.coalesce(F.crc32("text"), F.lit(0)).cast("long")
    rows = shelf.put(
        "rows",
        docs.select("doc_id", size.alias("size"), checksum.alias("text_crc32"), F.xxhash64("text").alias("spot")),
    )
    groups = shelf.put("groups", rows.groupBy("spot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    cuts = cut_points(groups, shards)

    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("spot") >= F.lit(cut)).cast("int")
    total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // (shards * ROWS_PER_PART)))
    placed = rows.withColumns({"shard": shard, "part": F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts)).cast("int")})
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(W.partitionBy("shard", "part").orderBy("spot", "doc_id")) - 1
    return (
        placed.withColumn("number", number)
        .join(offsets, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("offset") + F.col("number")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
