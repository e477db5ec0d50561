"""Counters of two grains: facts of a frame count once a frame, facts of a batch of frames once a batch, and both merge to one report.

Batch facts come as columns by the name of the counter that they add to. A time may come in nanoseconds, as `..._nanos` for a counter `..._micros`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import metric_names
from lodestrata.operators import metrics

#: Counters of a probe that compared routes, from its columns.
PROBE = ("probe_frames", "probe_gpu_batches", "probe_cpu_nanos", "probe_gpu_nanos", "probe_selected")


def once(reports: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """One row a batch, however many frames carry its report: the largest of each fact, in partial aggregates. Rows without a batch have no report."""
    facts = [c for c in reports.columns if c not in (*keys, batch)]
    return reports.where(F.col(batch).isNotNull()).groupBy(*keys, batch).agg(*(F.max(c).alias(c) for c in facts))


def counters(batches: DataFrame, keys: list[str]) -> DataFrame:
    """The counters that rows of single batches add, by their serialised names; facts of other names are an error."""
    out: dict[str, Column] = {}
    count = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    micros = lambda c: F.coalesce(metrics.reported_micros(F.col(c).cast("bigint")), F.lit(0).cast("bigint"))
    for c in batches.columns:
        if c in keys or c in PROBE:
            continue
        name = c.removesuffix("_nanos") + "_micros" if c.endswith("_nanos") else c
        if name not in metric_names.SUM_NAMES and name not in metric_names.MAXIMUM_NAMES:
            raise ValueError(f"{c} is no fact of a batch")
        out[name] = micros(c) if c.endswith("_nanos") else count(c)
    if set(PROBE) <= set(batches.columns):
        out |= {"auto_route_probe_frames": count("probe_frames"), "auto_route_probe_gpu_batches": count("probe_gpu_batches"), "auto_route_probe_cpu_micros": micros("probe_cpu_nanos"), "auto_route_probe_gpu_micros": micros("probe_gpu_nanos")}
        out["auto_route_probe_selected_gpu_input_frames"] = F.when(F.col("probe_selected"), count("probe_frames")).otherwise(0)
    return batches.select(*keys, *(c.alias(n) for n, c in out.items()))


def two_grains(frames: DataFrame, reports: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """All serialised metrics by keys, from rows of counters a frame (see `metrics.written_frames`) and rows of batch facts, repeated or not."""
    own = [c for c in frames.columns if c in metric_names.SUM_NAMES or c in metric_names.MAXIMUM_NAMES]
    by_batch = counters(once(reports, keys, batch).drop(batch), keys)
    both = frames.select(*keys, *own).unionByName(by_batch, allowMissingColumns=True)
    names = [c for c in both.columns if c not in keys]
    return metrics.serialised(both.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in names)), keys)
