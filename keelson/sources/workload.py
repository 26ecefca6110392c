"""Workloads: bulk load and its check, and skewed key streams from spark.range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import fnv64
from ..operators.ordered import search


def load_value(key: Column, size: int) -> Column:
    """The letter of key % 10, `size` times."""
    return F.repeat(F.chr(F.lit(97) + F.pmod(key, F.lit(10))), size)


def bulk_load(spark: SparkSession, start: int, end: int, value_size: int) -> DataFrame:
    """Records (k, v) for keys in [start, end)."""
    return spark.range(start, end).select(F.col("id").alias("k"), load_value(F.col("id"), value_size).alias("v"))


def verify_load(stored: DataFrame, start: int, end: int, value_size: int) -> DataFrame:
    """Expected records that `stored` (k, v) lacks or holds otherwise; no row: all is well."""
    want = bulk_load(stored.sparkSession, start, end, value_size)
    return want.join(stored.select("k", F.col("v").alias("got")), "k", "left").where(~F.col("v").eqNullSafe(F.col("got"))).select("k", "v", "got")


def zeta(n: int, theta: float) -> float:
    """The sum of i^-theta for i from 1 to n; beyond a million terms by Euler-Maclaurin."""
    top = min(n, 1_000_000)
    total = math.fsum(i**-theta for i in range(1, top + 1))
    if n > top:
        total += (n ** (1 - theta) - top ** (1 - theta)) / (1 - theta) + (n**-theta - top**-theta) / 2
    return total


def zipfian(u: Column, items: int, theta: float = 0.99, base: int = 0) -> Column:
    """The item of a column of uniform numbers in [0, 1), by Gray's inverse.  As known, the first two items leave `base` out."""
    zn, z2 = zeta(items, theta), zeta(2, theta)
    alpha, eta = 1 / (1 - theta), (1 - (2 / items) ** (1 - theta)) / (1 - z2 / zn)
    uz = u * zn
    return F.when(uz < 1, F.lit(0)).when(uz < 1 + 0.5**theta, F.lit(1)).otherwise(F.lit(base) + F.floor(F.lit(items) * F.pow(F.lit(eta) * u - eta + 1, F.lit(alpha)))).cast("bigint")


def uniform(draw: Column, seed: int = 1) -> Column:
    """A number in [0, 1) for each draw: 52 bits of a hash, so that it does not depend on how rows are dealt out."""
    return F.conv(F.substring(F.md5(F.concat_ws(" ", draw.cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def zipf_keys(spark: SparkSession, n: int, items: int, theta: float = 0.99, seed: int = 1) -> DataFrame:
    return spark.range(n).withColumn("u", uniform(F.col("id"), seed)).select("id", zipfian(F.col("u"), items, theta).alias("k"))


def scrambled_zipf_keys(spark: SparkSession, n: int, items: int, theta: float = 0.99, seed: int = 1) -> DataFrame:
    """Zipfian popularity spread over the key space by a hash."""
    return zipf_keys(spark, n, items, theta, seed).withColumn("k", fnv64(F.col("k"), items))


def latest_keys(spark: SparkSession, n: int, last: int, theta: float = 0.99, seed: int = 1) -> DataFrame:
    """The newest keys are the most popular."""
    return zipf_keys(spark, n, last, theta, seed).withColumn("k", F.lit(last) - F.col("k"))


def uniform_keys(spark: SparkSession, n: int, lower: int, upper: int, seed: int = 1) -> DataFrame:
    """Keys in [lower, upper], all as likely."""
    return spark.range(n).select("id", (F.lit(lower) + F.floor(uniform(F.col("id"), seed) * (upper - lower + 1))).cast("bigint").alias("k"))


def counter_keys(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    return spark.range(start, start + n).select((F.col("id") - start).alias("id"), F.col("id").alias("k"))


def discrete(u: Column, weights: dict[str, float]) -> Column:
    """The value whose share of the weights a uniform number falls into."""
    total, bounds, acc = sum(weights.values()), [], 0.0
    for w in weights.values():
        acc += w / total
        bounds.append(acc)
    return F.element_at(F.array(*map(F.lit, weights)), F.least(search(u, bounds) + 1, F.lit(len(weights))))
