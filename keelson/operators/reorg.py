"""Keeping range partitions even as load changes: duplicates of hot points, pushes to neighbours, growth, threads.

Ranges are (id, lower, upper, ninserts), half-open.  All of it runs over metadata,
a row a range, as joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

# How far, in percent of its fair share, a range may be off; the share of such ranges, and the writes, that call for new ranges; the writes below which a range is left alone.
UNFAIR_PERCENT, UNFAIR_SHARE, MAJOR_WRITES, LEAST_WRITES = 20.0, 0.3, 1_000_000, 100


def is_point() -> Column:
    return F.col("upper") - F.col("lower") == 1


def shares(ranges: DataFrame, n: int) -> DataFrame:
    """Adds `share` (of all inserts) and `off` (percent above the fair share 1 / n)."""
    total = ranges.agg(F.sum("ninserts").alias("_t"))
    share = F.when(F.col("_t") > 0, F.col("ninserts") / F.col("_t")).otherwise(F.lit(0.0))
    return ranges.crossJoin(F.broadcast(total)).withColumn("share", share).withColumn("off", (F.col("share") * n - 1) * 100).drop("_t")


def decide(ranges: DataFrame, n: int, least_writes: int = LEAST_WRITES, major_writes: int = MAJOR_WRITES) -> DataFrame:
    """One row: action (major, minor, none), the range for a minor one, and unfair ranges (points never are)."""
    rated = shares(ranges, n)
    wide = ~is_point()
    worst = F.when(wide & (F.col("off") > UNFAIR_PERCENT) & (F.col("ninserts") > least_writes), F.struct("off", -F.col("id")))
    found = rated.agg(F.count("*").alias("ranges"), F.count_if(wide & (F.abs("off") > UNFAIR_PERCENT)).alias("unfair"), F.sum("ninserts").cast("bigint").alias("writes"), F.max(worst).alias("w"))
    major = (F.col("unfair") > F.col("ranges") * UNFAIR_SHARE) & (F.col("writes") >= major_writes)
    action = F.when(major, "major").when(F.col("w").isNotNull(), "minor").otherwise("none")
    return found.select(action.alias("action"), F.when(action == "minor", (-F.col("w.col2")).cast("int")).alias("id"), "unfair", "ranges", F.coalesce("writes", F.lit(0)).alias("writes"))


def create_duplicates(ranges: DataFrame, n: int) -> DataFrame:
    """Point ranges with over 1.5 fair shares become floor(share / fair) copies that share the load: adds `copy`, `copies`."""
    fair = F.col("share") * n
    copies = F.when(is_point() & (fair > 1.5), F.greatest(F.floor(fair), F.lit(1))).otherwise(F.lit(1)).cast("int")
    out = shares(ranges, n).withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.select("id", "copy", "copies", "lower", "upper", (F.col("ninserts") / F.col("copies")).alias("ninserts"))


def destroy_duplicates(copies: DataFrame, n: int) -> DataFrame:
    """Of (id, copy, lower, upper, ninserts), copies with under half a fair share go, and the others of their range take over their load evenly.

    The fullest copy of a range always stays.
    """
    w = Window.partitionBy("id")
    rank = F.row_number().over(w.orderBy(F.desc("ninserts"), "copy"))
    rated = shares(copies, n).withColumn("_n", F.count("*").over(w)).withColumn("_stay", (F.col("_n") == 1) | (F.col("share") * n >= 0.5) | (rank == 1))
    spread = F.sum(F.when(~F.col("_stay"), F.col("ninserts")).otherwise(0)).over(w) / F.count_if(F.col("_stay")).over(w)
    return rated.withColumn("ninserts", F.col("ninserts") + spread).where("_stay").select("id", "copy", "lower", "upper", "ninserts")


def split_tiny(rates: DataFrame, ranges: DataFrame, m: int) -> DataFrame:
    """Each range in `m` tiny ranges of about equal load: range_id, tiny, lower, upper, ninserts.  `rates` (k, rate) already has `range_id`."""
    cum = ordered.running(rates, "k", F.col("rate"), "cum", by=["range_id"], before=True)
    load = ranges.select(F.col("id").alias("range_id"), F.greatest("ninserts", F.lit(1)).alias("_load"))
    tiny = F.least(F.expr(f"coalesce(cum, 0) * {m} div _load"), F.lit(m - 1)).cast("int")
    return cum.join(load, "range_id").groupBy("range_id", tiny.alias("tiny")).agg(F.min("k").alias("lower"), (F.max("k") + 1).alias("upper"), F.sum("rate").cast("bigint").alias("ninserts"))


def push_tiny(ranges: DataFrame, tiny: DataFrame, range_id: int, n: int) -> DataFrame:
    """Where the tiny ranges of an overloaded range go: range_id, tiny, to_range.

    Those at its left edge go to the left neighbour, as long as what went does not
    exceed half of the difference between the two, nor what the range has above
    its fair share; those at its right edge likewise, with what is left to give.
    """
    loads = ranges.select("id", "ninserts").withColumns({"left": F.lag("ninserts").over(Window.orderBy("id")), "right": F.lead("ninserts").over(Window.orderBy("id")), "total": F.sum("ninserts").over(Window.partitionBy())})
    own = loads.where(F.col("id") == range_id).withColumn("surplus", F.greatest(F.col("ninserts") - F.col("total") / n, F.lit(0.0)))
    give = lambda side: F.greatest(F.coalesce(F.least((F.col("_own") - F.col(side)) / 2, F.col("surplus")), F.lit(0.0)), F.lit(0.0))
    rows = tiny.where(F.col("range_id") == range_id).crossJoin(F.broadcast(own.select(F.col("ninserts").alias("_own"), "left", "right", "surplus")))
    rows = rows.withColumn("cl", F.sum("ninserts").over(Window.orderBy("tiny"))).withColumn("cr", F.sum("ninserts").over(Window.orderBy(F.desc("tiny"))))
    rows = rows.withColumn("_l", F.col("cl") <= give("left")).withColumn("_gone", F.coalesce(F.sum(F.when(F.col("_l"), F.col("ninserts"))).over(Window.partitionBy()), F.lit(0)))
    right = ~F.col("_l") & (F.col("cr") <= give("right")) & (F.col("cr") <= F.col("surplus") - F.col("_gone"))
    return rows.select("range_id", "tiny", F.when(F.col("_l"), range_id - 1).when(right, range_id + 1).otherwise(range_id).alias("to_range"))


def grow(ranges: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Ranges that also hold new keys (k), cut until there are `n`: id, lower, upper.

    The first and the last range reach out to the least and greatest key; then the
    ranges with most inserts are cut into equal parts, as many as are wanting.
    """
    edge = keys.agg(F.min("k").alias("_lo"), (F.max("k") + 1).alias("_hi"))
    w = Window.orderBy("id")
    wide = ranges.crossJoin(F.broadcast(edge)).withColumns({"_first": F.row_number().over(w) == 1, "_last": F.row_number().over(Window.orderBy(F.desc("id"))) == 1, "_n": F.count("*").over(Window.partitionBy()), "_r": F.row_number().over(Window.orderBy(F.desc("ninserts"), "id"))})
    lower = F.when(F.col("_first"), F.least("lower", F.coalesce("_lo", "lower"))).otherwise(F.col("lower"))
    upper = F.when(F.col("_last"), F.greatest("upper", F.coalesce("_hi", "upper"))).otherwise(F.col("upper"))
    more = F.expr(f"greatest({n} - _n, 0)")
    parts = F.expr("1 + _more div _n") + F.when(F.col("_r") <= F.col("_more") % F.col("_n"), 1).otherwise(0)
    cut = wide.withColumns({"lower": lower, "upper": upper}).withColumn("_more", more).withColumn("_p", F.greatest(F.least(parts, F.col("upper") - F.col("lower")), F.lit(1)))
    each = cut.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_p").cast("bigint") - 1)))
    ends = each.select("id", "_i", F.expr("lower + (upper - lower) * _i div _p").alias("lower"), F.expr("lower + (upper - lower) * (_i + 1) div _p").alias("upper"))
    return ends.withColumn("id", (F.row_number().over(Window.orderBy("lower")) - 1).cast("int")).drop("_i")


def assign_threads(ranges: DataFrame, threads: int, few_keys: int) -> DataFrame:
    """Ranges (id, keys) with at most `few_keys` keys get a thread each, in order; the others share the rest: id, merges, start_tid, end_tid."""
    small = F.col("keys") <= few_keys
    rank = (F.sum(small.cast("int")).over(Window.orderBy("id")) - 1).cast("int")
    n = F.sum(small.cast("int")).over(Window.partitionBy()).cast("int")
    return ranges.select("id", small.alias("merges"), F.when(small, rank).otherwise(n).alias("start_tid"), F.when(small, rank).otherwise(F.lit(threads - 1)).alias("end_tid"))


def merge_or_flush(log: DataFrame, few_keys: int) -> DataFrame:
    """Per range of buffered records (range_id, k): records, distinct keys, and whether they are merged in memory or flushed."""
    per = log.groupBy("range_id", "k").agg(F.count("*").alias("c")).groupBy("range_id").agg(F.sum("c").cast("bigint").alias("records"), F.count("*").alias("keys"))
    return per.withColumn("action", F.when(F.col("keys") <= few_keys, "merge").otherwise("flush"))
