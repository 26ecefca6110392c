"""The classic key-value benchmark phases, as whole-table jobs on a store.

Each phase returns (operations, seconds).  A phase is one job over all its
operations, so that the figure is throughput, not the latency of one call.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import crc32c
from ..operators import mvcc
from ..store import Options, Store


@dataclass
class Bench:
    """A store of `n` records with 16-digit text keys and values of `value_size` bytes, half of which compress."""

    spark: SparkSession
    path: str
    n: int = 1_000_000
    value_size: int = 100
    options: Options = field(default_factory=lambda: Options(key_type="string", value_type="string"))

    def __post_init__(self):
        self.store = Store(self.spark, self.path, self.options)

    def keys(self, ids: DataFrame) -> DataFrame:
        return ids.select(F.col("id"), F.lpad(F.col("id").cast("string"), 16, "0").alias("k"))

    def records(self, ids: DataFrame, size: int | None = None) -> DataFrame:
        half = (size or self.value_size) // 2
        noise = F.substring(F.repeat(F.md5((F.col("id") * 31).cast("string")), half // 32 + 1), 1, half)
        return self.keys(ids).select("k", F.concat(noise, F.repeat(F.lit("v"), half)).alias("v"))

    def some(self, n: int, seed: int, limit: int | None = None) -> DataFrame:
        return self.spark.range(n).select(F.floor(F.rand(seed) * (limit or self.n)).cast("bigint").alias("id"))

    def fresh(self) -> None:
        self.store.destroy()
        self.store = Store(self.spark, self.path, self.options)

    def fillseq(self) -> int:
        self.fresh()
        self.store.put(self.records(self.spark.range(self.n)))
        return self.n

    def fillrandom(self) -> int:
        self.fresh()
        return self.overwrite()

    def overwrite(self) -> int:
        self.store.put(self.records(self.some(self.n, 1)))
        return self.n

    def fillsync(self) -> int:
        """Small commits, each durable before the next."""
        for i in range(10):
            self.store.put(self.records(self.spark.range(i * 100, i * 100 + 100)))
        return 1000

    def fill100k(self) -> int:
        n = max(1, self.n // 1000)
        self.fresh()
        self.store.put(self.records(self.spark.range(n), 100_000))
        return n

    def deleteseq(self) -> int:
        self.store.delete(self.keys(self.spark.range(self.n)).select("k"))
        return self.n

    def deleterandom(self) -> int:
        self.store.delete(self.keys(self.some(self.n, 2)).select("k"))
        return self.n

    def _drain(self, rows: DataFrame) -> None:
        rows.write.format("noop").mode("overwrite").save()

    def readseq(self) -> int:
        self._drain(mvcc.current(self.store.log()))
        return self.n

    def readreverse(self) -> int:
        self._drain(self.store.scan(reverse=True))
        return self.n

    def readrandom(self) -> int:
        self._drain(self.store.multi_get(self.keys(self.some(self.n, 3)).select("k")))
        return self.n

    def readmissing(self) -> int:
        missing = self.keys(self.some(self.n, 4)).select(F.concat("k", F.lit(".")).alias("k"))
        self._drain(self.store.multi_get(missing))
        return self.n

    def readhot(self) -> int:
        self._drain(self.store.multi_get(self.keys(self.some(self.n, 5, max(1, self.n // 100))).select("k")))
        return self.n

    def seekrandom(self) -> int:
        """Seeks by key number, since text keys here are numbers."""
        live = self.store.log().withColumn("k", F.col("k").cast("bigint"))
        probes = self.some(self.n // 10, 6).select(F.col("id").alias("p")).distinct()
        self._drain(mvcc.seek(live, probes))
        return self.n // 10

    def open(self) -> int:
        for _ in range(20):
            Store(self.spark, self.path, self.options)
        return 20

    def crc32c(self) -> int:
        n = 2000
        blocks = self.spark.range(n).select(crc32c(F.repeat(F.lit("x"), 4096).cast("binary")).alias("c"))
        self._drain(blocks)
        return n

    def compact(self) -> int:
        self.store.compact()
        return self.n

    def stats(self) -> int:
        self.store.property("stats")
        return 1

    def sstables(self) -> int:
        self.store.property("sstables")
        return 1

    PHASES = ("fillseq", "fillsync", "fillrandom", "overwrite", "compact", "readseq", "readreverse", "readrandom", "readmissing", "readhot", "seekrandom", "open", "stats", "sstables", "crc32c", "deleterandom", "deleteseq", "fill100k")

    def run(self, phases: tuple[str, ...] = PHASES) -> dict[str, tuple[int, float]]:
        out = {}
        for name in phases:
            phase: Callable[[], int] = getattr(self, name)
            began = time.perf_counter()
            n = phase()
            out[name] = (n, time.perf_counter() - began)
        return out
