"""Ordered computations that never sort a whole table, or a hot key, in one task.

Rows are cut into buckets of about `ROWS` rows by quantiles of the order column,
whatever its type and however its values are spread.  Each bucket is a window of
its own, and what must pass from bucket to bucket goes through a summary with one
row a bucket (and group).  A table of few rows is one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket, and the most buckets that a table is cut into.
ROWS, BUCKETS = 1 << 18, 1024
#: Rows that stand for the order column where it has no quantile function.
SAMPLE = 1 << 14


def search(key: Column, bounds: list) -> Column:
    """The number of bounds at or below the key, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def bounds_of(df: DataFrame, order: str, rows: int | None = None) -> list:
    """Values that cut the column into buckets of about `rows` rows; none for a table that has no more."""
    rows = rows or ROWS
    n = df.where(F.col(order).isNotNull()).select(order).count()
    buckets = min(BUCKETS, -(-n // rows))
    if buckets < 2:
        return []
    if isinstance(df.schema[order].dataType, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], max(100, 8 * buckets))).first()[0]
    else:
        # Values with the least hashes are a sample, the same in every run.
        drawn = sorted(bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order), order).limit(SAMPLE).collect())
        cuts = [drawn[i * len(drawn) // buckets] for i in range(1, buckets)]
    return sorted(set(cuts))


def bucketed(df: DataFrame, order: str, rows: int | None = None, cuts: list | None = None) -> tuple[DataFrame, bool]:
    """Adds `_b`, the row's bucket (equal values share one); and whether there are several.  `cuts` are bounds that are known already."""
    cuts = bounds_of(df, order, rows) if cuts is None else cuts
    return df.withColumn("_b", search(F.col(order), cuts)), bool(cuts)


def _join(inner: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    return inner.join(summary, [*by, "_b"]).drop("_b")


def adjacent(df: DataFrame, order: str, carry: list[str], by: list[str] = (), rows: int | None = None, cuts: list | None = None) -> DataFrame:
    """Adds `prev` and `next`: structs of the `carry` columns of the neighbouring rows, null at the ends."""
    by, row = list(by), F.struct(*carry)
    cut, many = bucketed(df, order, rows, cuts)
    w = Window.partitionBy(*by, "_b").orderBy(order)
    inner = cut.withColumns({"prev": F.lag(row).over(w), "next": F.lead(row).over(w)})
    if not many:
        return inner.drop("_b")
    ends = cut.groupBy(*by, "_b").agg(F.min_by(row, order).alias("_first"), F.max_by(row, order).alias("_last"))
    over = Window.partitionBy(*by).orderBy("_b")
    ends = ends.select(*by, "_b", F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"))
    out = _join(inner, ends, by)
    return out.withColumns({"prev": F.coalesce("prev", "_before"), "next": F.coalesce("next", "_after")}).drop("_before", "_after")


def running(df: DataFrame, order: str, value: Column, name: str, kind: str = "sum", by: list[str] = (), rows: int | None = None, before: bool = False, cuts: list | None = None) -> DataFrame:
    """Adds the running sum, max or count of `value` in the given order; with `before`, without the row itself.  `order` is unique."""
    by, agg = list(by), {"sum": F.sum, "max": F.max, "count": F.count}[kind]
    total = F.max if kind == "max" else F.sum
    cut, many = bucketed(df, order, rows, cuts)
    cut = cut.withColumn("_v", value)
    w = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    inner = cut.withColumn(name, agg("_v").over(w))
    if not many:
        return inner.drop("_v", "_b")
    over = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summary = cut.groupBy(*by, "_b").agg(agg("_v").alias("_t"))
    summary = summary.select(*by, "_b", total("_t").over(over).alias("_carry"))
    out = _join(inner, summary, by)
    if kind == "max":
        both = F.greatest(name, "_carry")
    else:
        both = F.when(F.col(name).isNull() & F.col("_carry").isNull(), None).otherwise(F.coalesce(name, F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    return out.withColumn(name, both).drop("_v", "_carry")


def position(df: DataFrame, order: str, name: str, by: list[str] = (), rows: int | None = None, cuts: list | None = None) -> DataFrame:
    """Adds the row number (from 1) in the given order."""
    return running(df, order, F.lit(1), name, "count", by, rows, cuts=cuts).withColumn(name, F.col(name).cast("bigint"))


def _merged(keys: DataFrame, probes: DataFrame, key: str, probe: str, rows: int | None) -> tuple[DataFrame, bool]:
    """Keys (`_k`, `_key`) and probes (`_k`, `_row`) in one table with buckets: each side is read once, and none meets another."""
    kind = keys.schema[key].dataType
    asked = probes.select(F.col(probe).cast(kind).alias("_k"), F.lit(None).cast(kind).alias("_key"), F.struct(*(F.col(f"`{c}`") for c in probes.columns)).alias("_row"))
    both = asked.unionByName(keys.select(F.col(key).alias("_k"), F.col(key).alias("_key")), allowMissingColumns=True)
    return bucketed(both, "_k", rows)


def seek(keys: DataFrame, probes: DataFrame, key: str = "k", probe: str = "p", rows: int | None = None, reverse: bool = False) -> DataFrame:
    """Adds to each probe the least key at or after it (`reverse`: the greatest at or before it), or null, as column `found`.

    One sort of keys and probes together: the answer is the last key on the way.
    """
    both, many = _merged(keys, probes, key, probe, rows)
    nearest, way = (F.max, F.asc) if reverse else (F.min, F.desc)
    w = Window.partitionBy("_b").orderBy(way("_k")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inner = both.withColumn("_in", nearest("_key").over(w)).where("_row is not null")
    if not many:
        return inner.select("_row.*", F.col("_in").alias("found"))
    over = Window.orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = both.groupBy("_b").agg(nearest("_key").alias("_e")).select("_b", nearest("_e").over(over).alias("_out"))
    return inner.join(F.broadcast(beyond), "_b").select("_row.*", F.coalesce("_in", "_out").alias("found"))


def count_below(keys: DataFrame, probes: DataFrame, key: str = "k", probe: str = "p", rows: int | None = None) -> DataFrame:
    """Adds to each probe how many keys are below it, as column `below`."""
    both, many = _merged(keys, probes, key, probe, rows)
    w = Window.partitionBy("_b").orderBy("_k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("_b", "_k")
    inner = both.withColumn("_in", F.count("_key").over(w) - F.count("_key").over(same)).where("_row is not null")
    if not many:
        return inner.select("_row.*", F.col("_in").cast("bigint").alias("below"))
    over = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    beyond = both.groupBy("_b").agg(F.count("_key").alias("_e")).select("_b", F.coalesce(F.sum("_e").over(over), F.lit(0)).alias("_out"))
    return inner.join(F.broadcast(beyond), "_b").select("_row.*", (F.col("_in") + F.col("_out")).cast("bigint").alias("below"))
