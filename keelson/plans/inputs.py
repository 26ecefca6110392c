"""Change logs, file metadata and partitions derived from the star-schema tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered, ranges

#: Servers of the placement queries, and ranges of the load queries.
SERVERS, PARTS = 10, 16


class Inputs:
    """The derived inputs of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def log_e(self) -> DataFrame:
        """A change log of users: an error is a deletion."""
        return self.table("events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("op"), F.col("value").alias("v"))

    def events(self) -> int:
        return self.table("events").count()

    def log_l(self) -> DataFrame:
        """A larger log of order lines, numbered by ship date and then by all else.

        The number is the rows of earlier days and the place within the day, so
        that no task sorts more than a day.
        """
        from pyspark.sql import Window

        rest = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
        lines = self.table("lineitem").withColumn("day", F.unix_date(F.col("l_shipdate").cast("date")))
        days = ordered.running(lines.groupBy("day").agg(F.count("*").alias("n")), "day", F.col("n"), "before", before=True).select("day", "before")
        w = Window.partitionBy("day").orderBy("l_shipdate", *rest)
        seq = (F.coalesce("before", F.lit(0)) + F.row_number().over(w)).cast("bigint")
        return lines.join(days, "day").select(F.col("l_orderkey").alias("k"), seq.alias("seq"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("op"), F.col("l_extendedprice").alias("v"))

    def files_o(self) -> DataFrame:
        """Key intervals of sorted runs, one run for each ten order keys."""
        o = self.table("orders").groupBy(F.expr("o_orderkey div 10 * 10").alias("f"))
        o = o.agg(F.min("o_orderkey").alias("lo"), F.sum("o_custkey").cast("bigint").alias("o_custkey"))
        return o.select("f", "lo", (F.col("lo") + (F.col("o_custkey") * 7919) % 25).alias("hi"), "o_custkey")

    def files_meta(self) -> DataFrame:
        """Runs with a level and a size."""
        size = 1 + (F.col("o_custkey") * 1048576) % 67108864
        return self.files_o().select("f", "lo", "hi", F.expr("cast((f div 10) % 3 as int)").alias("level"), size.cast("bigint").alias("file_size"), F.col("f").alias("number"))

    def keys(self) -> int:
        return self.table("orders").count()

    def fragments(self, n: int = PARTS) -> DataFrame:
        """Equal fragments of the order keys: id, lower, upper."""
        return ranges.split_uniform(self.spark, 0, self.keys(), n)

    def dranges(self, n: int = PARTS) -> DataFrame:
        """Ranges of about equal load: id, lower, upper (the next range's lower), ninserts."""
        split = ranges.split_equi_load(ranges.key_rates(self.log_l().select("k")), n)
        near = ordered.adjacent(split, "id", ["lower"])
        return near.select("id", "lower", F.coalesce(F.col("next.lower"), F.col("upper")).alias("upper"), "keys", "ninserts")

    def replicas(self) -> DataFrame:
        """Three replicas of each run."""
        r = self.files_meta().select("number", F.col("file_size").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("replica"))
        return r.withColumn("server", F.expr(f"cast((number div 10 + replica) % {SERVERS} as int)"))

    def queue(self) -> DataFrame:
        """Queue depths of servers."""
        return self.table("supplier").groupBy((F.col("s_suppkey") % SERVERS).cast("int").alias("server")).agg(F.sum(F.col("s_nationkey") % 7).cast("bigint").alias("depth"))


# The same in DuckDB's SQL, as common table expressions.
LOG_E = "log_e AS (SELECT user_id AS k, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, value AS v FROM events)"
LOG_L = """log_l AS (SELECT l_orderkey AS k, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS op, l_extendedprice AS v FROM lineitem)"""
FILES_O = """runs AS (SELECT o_orderkey // 10 * 10 AS f, min(o_orderkey) AS lo, CAST(sum(o_custkey) AS BIGINT) AS o_custkey FROM orders GROUP BY 1),
files_o AS (SELECT f, lo, lo + (o_custkey * 7919) % 25 AS hi, o_custkey FROM runs)"""
FILES_META = FILES_O + ", files_meta AS (SELECT f, lo, hi, CAST((f // 10) % 3 AS INTEGER) AS level, 1 + (o_custkey * 1048576) % 67108864 AS file_size, f AS number FROM files_o)"
FRAGMENTS = f"""frag AS (SELECT CAST(i AS INTEGER) AS id, i * n // {PARTS} AS lower, (i + 1) * n // {PARTS} AS upper
  FROM range({PARTS}) r(i), (SELECT count(*) AS n FROM orders) c)"""
RATES = "rates AS (SELECT l_orderkey AS k, count(*) AS rate FROM lineitem GROUP BY 1)"
EQUI = (
    RATES
    + f""", cum AS (SELECT k, rate, sum(rate) OVER (ORDER BY k) - rate AS before, sum(rate) OVER () AS total FROM rates),
split AS (SELECT CAST(least(CAST(before AS BIGINT) * {PARTS} // CAST(total AS BIGINT), {PARTS - 1}) AS INTEGER) AS id, min(k) AS lower, max(k) + 1 AS last, count(*) AS keys, CAST(sum(rate) AS BIGINT) AS ninserts FROM cum GROUP BY 1),
drange AS (SELECT id, lower, coalesce(lead(lower) OVER (ORDER BY id), last) AS upper, keys, ninserts FROM split)"""
)
REPLICAS = FILES_META + f", replicas AS (SELECT number, file_size AS size, CAST(j AS INTEGER) AS replica, CAST((number // 10 + j) % {SERVERS} AS INTEGER) AS server FROM files_meta, range(3) r(j))"
QUEUE = f"queue AS (SELECT CAST(s_suppkey % {SERVERS} AS INTEGER) AS server, CAST(sum(s_nationkey % 7) AS BIGINT) AS depth FROM supplier GROUP BY 1)"
LATEST = LOG_E + ", latest AS (SELECT k, seq, op, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log_e) WHERE rn = 1), cur AS (SELECT k, seq, v FROM latest WHERE op = 1)"
