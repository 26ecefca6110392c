"""Reads over a multi-version change log (k, seq, op, v).

The newest version of a key wins; a deletion hides the key.  Everything here
reduces with `max_by`, which aggregates on the map side, so that a hot key is one
row a task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def visible(log: DataFrame, as_of: int | None = None) -> DataFrame:
    return log if as_of is None else log.where(F.col("seq") <= F.lit(as_of))


def newest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Per key its newest version, deletions too."""
    rest = [c for c in log.columns if c != "k"]
    return visible(log, as_of).groupBy("k").agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select("k", "_r.*")


def current(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """The live keys: what a snapshot at sequence number `as_of` reads."""
    return newest(log, as_of).where("op = 1").drop("op")


def tombstones(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Keys whose newest version is a deletion."""
    return newest(log, as_of).where("op = 0").select("k", "seq")


def history(log: DataFrame) -> DataFrame:
    """Every version with its number, from when it holds (`seq`) and to when (`valid_to`, null for the newest)."""
    cuts = ordered.bounds_of(log, "seq")
    numbered = ordered.position(log, "seq", "version", by=["k"], cuts=cuts)
    return ordered.adjacent(numbered, "seq", ["seq"], by=["k"], cuts=cuts).withColumn("valid_to", F.col("next.seq")).drop("prev", "next")


def multi_get(log: DataFrame, keys: DataFrame, as_of: int | None = None) -> DataFrame:
    """Per key asked for: found, seq, v.  The log is cut down to the keys before it is reduced."""
    asked = keys.select("k").distinct()
    hits = current(log.join(asked, "k", "left_semi"), as_of)
    return asked.join(hits, "k", "left").withColumn("found", F.col("seq").isNotNull())


def range_scan(log: DataFrame, lower=None, upper=None, as_of: int | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Live keys in [lower, upper), in key order.  The bounds reach the scan, since they are on the key."""
    if lower is not None:
        log = log.where(F.col("k") >= F.lit(lower))
    if upper is not None:
        log = log.where(F.col("k") < F.lit(upper))
    out = current(log, as_of).orderBy(F.col("k").desc() if reverse else F.col("k").asc())
    return out if limit is None else out.limit(limit)


def neighbours(log: DataFrame) -> DataFrame:
    """Live keys with the live keys before and after them."""
    out = ordered.adjacent(current(log).select("k"), "k", ["k"])
    return out.select("k", F.col("prev.k").alias("prev_k"), F.col("next.k").alias("next_k"))


def seek(log: DataFrame, probes: DataFrame, reverse: bool = False) -> DataFrame:
    """Per probe (column p) the first live key at or after it, or with `reverse` the last at or before it."""
    return ordered.seek(current(log).select("k"), probes, reverse=reverse)


def survivors(log: DataFrame, retain_seq: int) -> DataFrame:
    """Versions that compaction keeps while snapshots from `retain_seq` on may be read.

    A version goes if the next newer one of its key is at or below `retain_seq`.
    That keeps every version above it, and the newest of those below.
    """
    return log.where(F.col("seq") > retain_seq).unionByName(newest(log, retain_seq).select(log.columns))


def base_survivors(log: DataFrame, retain_seq: int) -> DataFrame:
    """survivors() where no deeper level holds the key: deletions that all snapshots see go too."""
    return survivors(log, retain_seq).where((F.col("op") != 0) | (F.col("seq") > retain_seq))


def sequenced(batch: DataFrame, base: int, order: str = "ord") -> DataFrame:
    """Give the records of a write batch their sequence numbers: `base` and on, in order."""
    return ordered.position(batch, order, "seq").withColumn("seq", F.col("seq") + F.lit(base - 1))


def merge(*logs: DataFrame) -> DataFrame:
    """Merge sorted runs into one log, ordered by key and, within a key, from the newest."""
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more)
    return out.repartitionByRange("k").sortWithinPartitions(F.col("k").asc(), F.col("seq").desc())


def numeric_key(column: Column) -> Column:
    """The leading decimal digits as a number; 0 if there are none.  20 digits hold 64 unsigned bits."""
    digits = F.regexp_extract(column.cast("string"), "^[0-9]+", 0)
    return F.coalesce(F.try_to_number(F.nullif(digits, F.lit("")), F.lit("9" * 20)), F.lit(0)).cast("decimal(20,0)")
