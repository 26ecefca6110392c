"""Statistics: histograms, percentiles, counters, experiment logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ordered


def bucket_limits() -> list[float]:
    """Upper limits of the 154 latency buckets: 1 to 10 by ones, then steps per decade as below, and one without end."""
    # The steps of a decade, as multiples of its power of ten.
    steps = [1.2, 1.4, 1.6, 1.8, 2, 2.5, 3, 3.5, 4, 4.5, 5, 6, 7, 8, 9, 10]
    out = [float(i) for i in range(1, 11)]
    for power in range(1, 10):
        out += [round(s * 10**power, 6) for s in steps]
    return out[:153] + [1e200]


def histogram(values: DataFrame, column: str = "v") -> DataFrame:
    """Per non-empty bucket: bucket, lower, upper, n."""
    limits = bucket_limits()
    bounds = F.array(*map(F.lit, limits))
    # Limits that a value has reached or passed are below its bucket.
    place = ordered.search(F.col(column), limits)
    counted = values.where(F.col(column).isNotNull()).groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))
    lower = F.element_at(F.array(F.lit(0.0), *map(F.lit, limits)), F.col("bucket") + 1)
    return counted.select(F.col("bucket").cast("int").alias("bucket"), lower.alias("lower"), F.element_at(bounds, F.col("bucket") + 1).alias("upper"), "n")


def percentiles(values: DataFrame, wanted: list[float], column: str = "v") -> DataFrame:
    """Per wanted percentile its value, linear within its bucket and no further than the least and greatest value: p, value.

    The running sum is over buckets, of which there are 154 at most.
    """
    h = histogram(values, column)
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = h.withColumn("cum", F.sum("n").over(w))
    edge = values.agg(F.min(column).alias("least"), F.max(column).alias("greatest"), F.count(column).alias("total"))
    ps = values.sparkSession.createDataFrame([(float(p),) for p in wanted], "p double")
    hit = ps.crossJoin(F.broadcast(edge)).join(F.broadcast(summed), F.col("cum") >= F.col("total") * F.col("p") / 100).groupBy("p", "least", "greatest", "total").agg(F.min_by(F.struct("lower", "upper", "n", "cum"), "bucket").alias("b"))
    inside = (F.col("total") * F.col("p") / 100 - (F.col("b.cum") - F.col("b.n"))) / F.col("b.n")
    value = F.col("b.lower") + (F.col("b.upper") - F.col("b.lower")) * inside
    return hit.select("p", F.least(F.greatest(value, F.col("least")), F.col("greatest")).alias("value"))


def summary(values: DataFrame, column: str = "v") -> DataFrame:
    """n, least, greatest, average, population deviation."""
    v = F.col(column)
    return values.agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.avg(v).alias("average"), F.stddev_pop(v).alias("stddev"))


def middle_of_descending(counts: DataFrame, column: str = "n") -> DataFrame:
    """least, greatest and median of counts, the median being element size div 2 of the descending list.

    It is found from the distinct counts and their frequencies.
    """
    by = counts.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("m"))
    w = Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    cum = by.withColumn("cum", F.sum("m").over(w)).crossJoin(F.broadcast(by.agg(F.sum("m").alias("total"))))
    return cum.agg(F.min("x").alias("least"), F.max("x").alias("greatest"), F.max(F.when(F.col("cum") > F.expr("total div 2"), F.col("x"))).alias("median"))


def counter_deltas(events: DataFrame, seconds: int = 10) -> DataFrame:
    """Per tick and type: its running total and what is new since the type's last tick."""
    tick = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds
    n = events.groupBy(tick.cast("bigint").alias("tick"), "event_type").agg(F.count("*").alias("delta"))
    return ordered.running(n, "tick", F.col("delta"), "total", by=["event_type"]).withColumn("total", F.col("total").cast("bigint"))


def group_means(samples: DataFrame, order: str, value: str, g: int) -> DataFrame:
    """The mean of every g successive samples: grp, mean, n.  `order` numbers the samples from 0."""
    return samples.groupBy(F.expr(f"{order} div {g}").alias("grp")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def stall_share(events: DataFrame, seconds: int) -> DataFrame:
    """Intervals between the first and the last event, those without any, and their share."""
    tick = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    busy = events.agg(F.count_distinct(tick).alias("busy"), F.min(tick).alias("lo"), F.max(tick).alias("hi"))
    n = F.col("hi") - F.col("lo") + 1
    return busy.select(n.cast("bigint").alias("intervals"), (n - F.col("busy")).cast("bigint").alias("stalled"), ((n - F.col("busy")) / n).alias("share"))


def paired_durations(events: DataFrame, key: str, order: str, start: Column, end: Column, at: Column) -> DataFrame:
    """Per key and start event, the time to the next event if that is an end: key, order, seconds."""
    marked = events.where(start | end).select(key, order, F.when(start, 1).otherwise(0).alias("s"), at.alias("at"))
    near = ordered.adjacent(marked, order, ["s", "at"], by=[key])
    return near.where((F.col("s") == 1) & (F.col("next.s") == 0)).select(key, order, (F.col("next.at") - F.col("at")).alias("seconds"))


def availability(spark: SparkSession, servers: int, failed: list[int], widths: list[int]) -> DataFrame:
    """The chance that a file scattered over `width` of `servers` is whole when `failed` of them are down: failed, width, available.

    C(servers - width, failed) / C(servers, failed), by logarithms.
    """
    logs = [0.0]
    for i in range(1, servers + 1):
        logs.append(logs[-1] + math.log(i))
    table = F.array(*map(F.lit, logs))
    lf = lambda n: F.element_at(table, (n + 1).cast("int"))
    grid = spark.createDataFrame([(f, w) for f in failed for w in widths], "failed int, width int")
    left = F.lit(servers) - F.col("width")
    chance = F.exp(lf(left) - lf(left - F.col("failed")) - lf(F.lit(servers)) + lf(F.lit(servers) - F.col("failed")))
    return grid.withColumn("available", F.when(F.col("failed") > left, F.lit(0.0)).otherwise(chance))
