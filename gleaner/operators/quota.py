"""Request budgets per platform over windows that open at the first request after expiry.

The rule is sequential, but it only asks for two things that spread well: where
each window opens (a chain of "first request after the window's end", followed
by pointer doubling) and which requests come first in a window (a top-k). No
task ever holds a platform's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.skew import with_last
from gleaner.session import settled

# Requests allowed per window and the window's minutes.
BUDGETS = {"stack_exchange": (200, 24 * 60), "github": (40, 60)}
MICROS_PER_MINUTE = 60_000_000


def budget_table(spark: SparkSession, budgets: dict[str, tuple[int, int]] = BUDGETS) -> DataFrame:
    """(platform, allowed, minutes) of a dictionary of budgets."""
    return spark.createDataFrame([(name, *budget) for name, budget in budgets.items()], "platform string, allowed bigint, minutes bigint")


def _next_after_expiry(times: DataFrame) -> DataFrame:
    """(platform, at, next): the first time strictly later than ``at`` plus the window.

    Times and expiries stand in one descending order, in which the last time before an
    expiry is its next one; ranges of that order are tasks, whatever a platform's share.
    """
    points = times.select("platform", F.col("at").alias("moment"), F.col("at").alias("point"), F.lit(None).cast("bigint").alias("at"))
    probes = times.select("platform", (F.col("at") + F.col("span")).alias("moment"), F.lit(None).cast("bigint").alias("point"), "at")
    order = [F.col("moment").desc(), F.col("point").asc_nulls_first(), F.col("at").asc()]
    found = with_last(points.unionByName(probes), "platform", order, "point", "next")
    return found.filter(F.col("at").isNotNull()).select("platform", "at", "next")


def _window_starts(times: DataFrame) -> DataFrame:
    """(platform, start) of every window, from the first request on, by pointer doubling."""
    jumps = settled(_next_after_expiry(times).filter(F.col("next").isNotNull()))
    reached = settled(times.groupBy("platform").agg(F.min("at").alias("start")))
    while True:
        landed = reached.join(jumps, (reached["platform"] == jumps["platform"]) & (reached["start"] == jumps["at"])).select(
            reached["platform"], F.col("next").alias("start")
        )
        fresh = settled(landed.join(reached, ["platform", "start"], "left_anti").distinct())
        if fresh.isEmpty():
            return reached
        reached = settled(reached.unionByName(fresh))
        further = jumps.select(F.col("platform").alias("p"), F.col("at").alias("middle"), F.col("next").alias("beyond"))
        jumps = settled(
            jumps.join(further, (F.col("platform") == F.col("p")) & (F.col("next") == F.col("middle"))).select(
                "platform", "at", F.col("beyond").alias("next")
            )
        )


def quota_ledger(requests: DataFrame, opened: DataFrame | None = None, budgets: DataFrame | None = None) -> DataFrame:
    """Decide requests (platform, request_id, asked_at, cost), each costing one if there is no cost.

    A request is granted if its cost fits into what its window has left. Returns them
    with window_started_at and granted. ``opened`` (platform, window_started_at, used)
    carries the open windows of earlier requests; ``budgets`` (platform, allowed,
    minutes) has the limits, and platforms without one are left out. A cost below one is
    never granted.

    What a window has used never falls, so once a cost is refused all later requests of
    that cost are: the granted ones are the first of their cost, (allowed / cost) at
    most. Only these candidates of a window meet, and are decided in order.
    """
    limits = budget_table(requests.sparkSession) if budgets is None else budgets
    limits = F.broadcast(limits.select("platform", "allowed", (F.col("minutes") * MICROS_PER_MINUTE).alias("span")))  # a row a platform
    cost = F.coalesce(F.col("cost").cast("bigint"), F.lit(1)) if "cost" in requests.columns else F.lit(1).cast("bigint")
    asked = requests.select("platform", "request_id", "asked_at", F.unix_micros("asked_at").alias("at"), cost.alias("cost"))
    asked = asked.join(limits, "platform")
    times = asked.select("platform", "span", "at").distinct()
    carried = None
    if opened is not None:
        carried = opened.select("platform", F.unix_micros("window_started_at").alias("start"), "used")
        held = carried.join(limits, "platform").select("platform", "span", F.col("start").alias("at"))
        times = times.unionByName(held).distinct()
    starts = _window_starts(times).join(limits.select("platform", "span"), "platform")
    covered = starts.select(
        "platform", "start", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"), F.floor(F.col("start") / F.col("span")).alias("slot")
    ).select("platform", "start", (F.col("slot") + F.col("step")).alias("slot"))
    placed = (
        asked.withColumn("slot", F.floor(F.col("at") / F.col("span")))
        .join(covered, ["platform", "slot"])
        .filter((F.col("at") >= F.col("start")) & (F.col("at") <= F.col("start") + F.col("span")))
        .drop("slot")
    )
    used = F.lit(0).cast("bigint")
    if carried is not None:
        placed = placed.join(carried, ["platform", "start"], "left")
        used = F.coalesce("used", used)
    placed = placed.withColumn("used", used)
    most = limits.agg(F.max("allowed")).first()[0] or 0
    order = F.row_number().over(Window.partitionBy("platform", "start", "cost").orderBy("at", "request_id"))
    first = placed.filter("cost > 0").withColumn("place", order).filter(F.col("place") <= most)
    first = first.filter(F.col("place") * F.col("cost") <= F.col("allowed"))
    queue = F.array_sort(F.collect_list(F.struct("at", "request_id", "cost")))
    windows = first.groupBy("platform", "start", "allowed", "used").agg(queue.alias("queue"))
    kind = requests.schema["request_id"].dataType

    def decided(state: Column, request: Column) -> Column:
        total = state["used"] + request["cost"]
        fits = total <= F.col("allowed")
        return F.struct(
            F.when(fits, total).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["granted"], F.array(request["request_id"]))).otherwise(state["granted"]).alias("granted"),
        )

    begin = F.struct(F.col("used").alias("used"), F.array().cast(T.ArrayType(kind)).alias("granted"))
    granted = windows.select("platform", "start", F.explode(F.aggregate("queue", begin, decided)["granted"]).alias("request_id"))
    granted = granted.withColumn("granted", F.lit(True))
    return placed.join(granted, ["platform", "start", "request_id"], "left").select(
        "platform",
        "request_id",
        "asked_at",
        F.timestamp_micros("start").alias("window_started_at"),
        F.coalesce("granted", F.lit(False)).alias("granted"),
        "cost",
    )


def open_windows(decisions: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """Latest window per platform with what it has used, to carry to the next batch."""
    used = decisions.groupBy("platform", "window_started_at").agg(F.sum(F.when(F.col("granted"), F.col("cost")).otherwise(0)).alias("used"))
    if opened is not None:
        used = used.unionByName(opened).groupBy("platform", "window_started_at").agg(F.sum("used").alias("used"))
    latest = F.max(F.struct("window_started_at", "used")).alias("latest")
    return used.groupBy("platform").agg(latest).select("platform", "latest.window_started_at", "latest.used")
