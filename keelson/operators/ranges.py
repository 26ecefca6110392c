"""Range partitions: splitting, routing, load, overlap and validation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ordered
from .ordered import search

#: More ranges than this are joined instead of being made into an expression.
MAX_INLINE = 1024


def split_uniform(spark: SparkSession, lower: int, upper: int, n: int) -> DataFrame:
    """n half-open ranges of [lower, upper) as equal as can be: id, lower, upper."""
    i, size = F.col("id"), F.lit(upper - lower)
    bound = lambda x: (F.lit(lower) + F.expr(f"({x}) * CAST({upper - lower} AS BIGINT) div {n}")).cast("bigint")
    del size
    return spark.range(n).select(i.cast("int").alias("id"), bound("id").alias("lower"), bound("id + 1").alias("upper"))


def route(rows: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """Adds `range_id`: the id of the half-open range that holds the key, or null.

    `ranges` (id, lower, upper) are disjoint.  Up to MAX_INLINE of them become an
    expression; more are met by bins of the narrowest width that keeps the bin
    table below a few bins a range.
    """
    few = ranges.orderBy("lower").limit(MAX_INLINE + 1).collect()
    if len(few) <= MAX_INLINE:
        few = [r for r in few if r.lower < r.upper]
        if not few:
            return rows.withColumn("range_id", F.lit(None).cast("int"))
        place = search(F.col(key), [r.lower for r in few])
        ids = F.array(F.lit(None).cast("int"), *(F.lit(r.id).cast("int") for r in few))
        ends = F.array(F.lit(None).cast("bigint"), *(F.lit(r.upper).cast("bigint") for r in few))
        return rows.withColumn("_p", place + 1).withColumn("range_id", F.when(F.col(key) < F.element_at(ends, F.col("_p")), F.element_at(ids, F.col("_p")))).drop("_p")
    lo, hi, n = ranges.agg(F.min("lower"), F.max("upper"), F.count("*")).first()
    width = max(1, (hi - lo) // n)
    bins = ranges.select("id", "lower", "upper", F.explode(F.sequence(F.floor(F.col("lower") / width), F.floor((F.col("upper") - 1) / width))).alias("_b"))
    bins = bins.select(F.col("id").alias("range_id"), F.col("lower").alias("_lower"), F.col("upper").alias("_upper"), "_b")
    hit = rows.withColumn("_kb", F.floor(F.col(key) / width)).join(bins, (F.col("_kb") == F.col("_b")) & (F.col(key) >= F.col("_lower")) & (F.col(key) < F.col("_upper")), "left")
    return hit.drop("_lower", "_upper", "_b", "_kb")


def salted(rows: DataFrame, duplicates: Column, by: str = "seq") -> DataFrame:
    """Adds `copy`: which of the copies of a duplicated range takes the row."""
    return rows.withColumn("copy", F.pmod(F.col(by), F.greatest(duplicates, F.lit(1))).cast("int"))


def key_rates(log: DataFrame, ratio: Column | None = None) -> DataFrame:
    """Per key the sum of its samples' rates (a sample counts as 1 without a ratio)."""
    return log.groupBy("k").agg(F.sum(F.lit(1) if ratio is None else ratio).cast("bigint" if ratio is None else "double").alias("rate"))


def split_equi_load(rates: DataFrame, n: int) -> DataFrame:
    """n ranges of about equal load by the running sum of rates: id, lower, upper (half-open), keys, ninserts."""
    total = rates.agg(F.sum("rate")).first()[0] or 0
    cum = ordered.running(rates, "k", F.col("rate"), "cum", before=True)
    placed = cum.withColumn("id", F.least(F.floor(F.coalesce("cum", F.lit(0)) * n / F.lit(max(total, 1))), F.lit(n - 1)).cast("int"))
    return placed.groupBy("id").agg(F.min("k").alias("lower"), (F.max("k") + 1).alias("upper"), F.count("*").alias("keys"), F.sum("rate").cast("bigint").alias("ninserts"))


def construct_ranges(rates: pd.DataFrame, n: int) -> pd.DataFrame:
    """The adaptive equi-load split of a key histogram (k, rate) in memory, in key order.

    A range closes when the next key would take it over its share; the share is
    what is left over the ranges left.  A key with a fair share or more alone is a
    point range with ceil(rate / fair) duplicates.  Returns id, lower, upper
    (inclusive), rate, duplicates.
    """
    rows = sorted(zip(rates["k"].tolist(), rates["rate"].tolist(), strict=True))
    total = float(sum(r for _, r in rows))
    if not rows or n < 1:
        return pd.DataFrame({"id": [], "lower": [], "upper": [], "rate": [], "duplicates": []})
    fair, left_rate, left_ranges = total / n, total, n
    out: list[list] = []
    begin, load = None, 0.0

    def close(end):
        nonlocal begin, load, left_rate, left_ranges
        if begin is not None:
            out.append([begin, end, load, 1])
            left_rate -= load
            left_ranges -= 1
            begin, load = None, 0.0

    for i, (k, rate) in enumerate(rows):
        if rate >= fair:
            close(rows[i - 1][0] if i else k)
            copies = math.ceil(rate / fair)
            out.append([k, k, rate, copies])
            left_rate -= rate
            left_ranges -= copies
            continue
        share = left_rate / max(left_ranges, 1)
        if begin is not None and load + rate > share and left_ranges > 1:
            close(rows[i - 1][0])
        if begin is None:
            begin = k
        load += rate
    close(rows[-1][0])
    return pd.DataFrame([[i, *r] for i, r in enumerate(out)], columns=["id", "lower", "upper", "rate", "duplicates"])


def split_adaptive(rates: DataFrame, n: int) -> DataFrame:
    """construct_ranges() of a histogram (k, rate) of any size, with the same result.

    Running sums stand in for the walk over the keys: the end of each range is one
    aggregate, and there are at most 2n + 1 ranges.  What reaches the driver is
    one row a range.
    """
    spark, kinds = rates.sparkSession, "id bigint, lower bigint, upper bigint, rate double, duplicates bigint"
    rates = rates.where("k is not null").persist()
    cum = ordered.running(rates, "k", F.col("rate"), "before", before=True).withColumn("before", F.coalesce("before", F.lit(0))).persist()
    total = float(cum.agg(F.sum("rate")).first()[0] or 0)
    fair, left_rate, left_ranges = total / max(n, 1), total, n
    first = lambda rows: rows.agg(F.min(F.struct("k", "before", "rate"))).first()[0]
    starts, at = [], first(cum) if n > 0 else None
    while at:
        starts.append(at.k)
        rest = cum.where(F.col("k") > at.k)
        if at.rate >= fair:
            left_rate -= at.rate
            left_ranges -= math.ceil(at.rate / fair)
            at = first(rest)
            continue
        ends = F.col("rate") >= fair
        if left_ranges > 1:
            ends |= F.col("before") + F.col("rate") - at.before > left_rate / left_ranges
        after = first(rest.where(ends))
        left_rate -= (after.before if after else total) - at.before
        left_ranges -= 1
        at = after
    place = search(F.col("k"), starts) if starts else F.lit(0)
    found = cum.groupBy((place - 1).cast("bigint").alias("id")).agg(F.min("k").alias("lower"), F.max("k").alias("upper"), F.sum("rate").cast("double").alias("rate"))
    rows = [(r.id, r.lower, r.upper, r.rate, math.ceil(r.rate / fair) if r.lower == r.upper and r.rate >= fair else 1) for r in found.orderBy("id").collect()] if starts else []
    cum.unpersist()
    rates.unpersist()
    return spark.createDataFrame(rows, kinds)


def hot_keys(rates: DataFrame, n: int, total: int) -> DataFrame:
    """Keys with a fair share of the load or more, and their numbers of duplicates."""
    fair = F.lit(total) / F.lit(n)
    return rates.where(F.col("rate") >= fair).withColumn("duplicates", F.ceil(F.col("rate") / fair).cast("bigint"))


def overlap_pairs(files: DataFrame, key: str = "f") -> DataFrame:
    """Pairs (a, b), a < b, of closed intervals [lo, hi] that meet.

    Intervals are classed by width, in powers of two.  Each has bins as wide as its
    own class, of which it touches two at most, and looks into the bins of all
    wider classes that there are.  So a few wide intervals do not widen the bins of
    the others.  A pair is reported in the bin where the later of both begins.
    """
    size = F.ceil(F.log2((F.col("hi") - F.col("lo") + 1).cast("double"))).cast("int")
    classed = files.select(key, "lo", "hi", F.when(F.col("hi") > F.col("lo"), size).otherwise(0).alias("_c"))
    there = sorted(r[0] for r in classed.select("_c").where("_c is not null").distinct().collect())  # 64 at most
    if not there:
        return files.select(F.col(key).alias("a"), F.col(key).alias("b")).limit(0)
    bin_of = lambda x, c: F.expr(f"floor(({x}) / pow(2.0D, {c}))").cast("bigint")
    spans = lambda c: F.explode(F.sequence(bin_of("lo", c), bin_of("hi", c)))
    own = classed.select(F.col(key).alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), "_c", spans("_c").alias("_b"))
    wider = classed.select("*", F.explode(F.array(*map(F.lit, there))).alias("_w")).where("_w >= _c")
    looks = wider.select(F.col(key).alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.col("_c").alias("_ca"), F.col("_w").alias("_c"), spans("_w").alias("_b"))
    met = looks.join(own, ["_c", "_b"]).where("(_ca < _c or a < b) and a <> b and lo_a <= hi_b and lo_b <= hi_a")
    met = met.where(bin_of("greatest(lo_a, lo_b)", "_c") == F.col("_b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def overlap_counts(files: DataFrame, key: str = "f") -> DataFrame:
    """Per interval how many it meets, itself too."""
    pairs = overlap_pairs(files, key)
    ends = pairs.select(F.col("a").alias(key)).unionAll(pairs.select(F.col("b").alias(key))).unionAll(files.select(key))
    return ends.groupBy(key).agg(F.count("*").alias("n"))


def overlap_components(files: DataFrame, key: str = "f") -> DataFrame:
    """Maximal groups of intervals that meet, one after another: lo, hi, files.

    Two running maxima in the order of (lo, key): the furthest end so far tells
    where a group begins, and the last begin is the group.  `key` is unique and
    intervals are numbered in that order first.
    """
    firsts = files.groupBy("lo").agg(F.max("hi").alias("hi"), F.count("*").alias("n"))
    reach = ordered.running(firsts, "lo", F.col("hi"), "reach", "max", before=True)
    begin = F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach")), F.col("lo"))
    grouped = ordered.running(reach, "lo", begin, "group", "max")
    return grouped.groupBy("group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").cast("bigint").alias("files")).drop("group")


def validate(ranges: DataFrame) -> DataFrame:
    """Ranges (id, lower, upper; half-open) that are empty, or that the next one neither continues nor leaves a gap to: with the fault.  No row: contiguous."""
    near = ordered.adjacent(ranges, "lower", ["id", "lower"])
    fault = F.when(F.col("lower") >= F.col("upper"), "empty").when(F.col("next.lower") < F.col("upper"), "overlap").when(F.col("next.lower") > F.col("upper"), "gap")
    return near.select("id", "lower", "upper", F.col("next.lower").alias("next_lower"), fault.alias("fault")).where("fault is not null")


def load_imbalance(loads: DataFrame, n: int) -> DataFrame:
    """From a column `load` (one row a range): max_share and stdev about the fair share, both in percent of it."""
    total = loads.agg(F.sum("load").alias("_t"))
    share = loads.crossJoin(F.broadcast(total)).select((F.col("load") / F.col("_t")).alias("s"))
    fair = F.lit(1.0 / n)
    return share.agg(((F.max("s") - fair) * 100 * n).alias("max_percent"), (F.sqrt(F.sum(F.pow((F.col("s") - fair) * 100, F.lit(2))) / n) / 100).alias("stdev"))
