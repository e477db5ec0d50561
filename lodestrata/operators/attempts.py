"""Attempts of several routes on the same frames: the first that succeeds wins, and what none could do goes on to the next route.

Attempts are rows (instance, frame, priority, route, ok, error) with the pixel profile (components, bits, photometric) of what they made. A frame's attempts meet in
one partial aggregate; nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = ["instance", "frame"]
PROFILE = ("components", "bits", "photometric")


def first_success(planned: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per planned frame: route, profile, and how many attempts failed; route is null where none succeeded, `error` is then the first failure's.

    The lowest priority wins; of equal ones the first route by name. Attempts on frames that are not planned are ignored, a frame planned twice counts once.
    """
    won = F.min(F.when(F.col("ok"), F.struct("priority", "route", *PROFILE)))
    failed = F.min(F.when(~F.col("ok"), F.struct("priority", "route", "error")))
    tried = attempts.withColumn("is_planned", F.lit(False)).select(*FRAME, "is_planned", "priority", "route", "ok", "error", *PROFILE)
    kinds = dict(tried.dtypes)
    asked = planned.select(*FRAME, F.lit(True).alias("is_planned"), *(F.lit(None).cast(kinds[c]).alias(c) for c in tried.columns[3:]))
    found = asked.unionByName(tried).groupBy(*FRAME).agg(F.bool_or("is_planned").alias("is_planned"), won.alias("won"), failed.alias("failed"), F.count_if(~F.col("ok")).alias("failures"))
    return found.where("is_planned").select(*FRAME, "won.route", *(f"won.{c}" for c in PROFILE), "failures", F.when(F.col("won").isNull(), F.col("failed.error")).alias("error"))


def resolve(planned: DataFrame, routes: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Runs routes in order, each on the frames that those before it could not do, and returns `first_success` of all attempts.

    A route takes the planned rows that are left and returns attempts without priority and route. `save` writes a frame as a table and reads it again, so no route
    runs twice and none runs again after an executor is lost.
    """
    left, made = planned, []
    for priority, (name, run) in enumerate(routes):
        got = save(run(left).withColumns({"priority": F.lit(priority), "route": F.lit(name)}), f"attempts-{priority}")
        made.append(got)
        left = left.join(got.where("ok").select(*FRAME).distinct(), FRAME, "left_anti")
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    return first_success(planned, every)


def conflicts(resolved: DataFrame) -> DataFrame:
    """One row per instance: frames, done, misses, and `error` if frames are missing or their pixel profiles are not one."""
    profile = F.when(F.col("route").isNotNull(), F.struct(*PROFILE))
    found = resolved.groupBy("instance").agg(F.count("*").alias("frames"), F.count("route").alias("done"), F.min(profile).alias("least"), F.max(profile).alias("most"), F.min("error").alias("first_error"))
    error = F.when(F.col("done") < F.col("frames"), F.coalesce("first_error", F.lit("no route was tried"))).when(F.col("least") != F.col("most"), "pixel profile changes")
    return found.select("instance", "frames", "done", (F.col("frames") - F.col("done")).alias("misses"), error.alias("error"))
