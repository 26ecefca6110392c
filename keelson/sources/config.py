"""Cluster configuration files: one or more epochs of servers and fragments, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Fragments of all epochs: cfg_id, ltc_ids, stoc_ids, start_time, key_start, key_end, server_id, dbid, log_replicas.

    An epoch is a line `config-N`, two lines of server ids, a start time, and a line
    `start,end,server,dbid[,log replica..]` for each fragment.  Raises ValueError if
    the first line doesn't begin an epoch.  The file is metadata and read as one
    partition, which keeps its lines in order.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    lines = lines.withColumn("text", F.trim("text")).where("text <> ''")
    head = F.col("text").startswith("config")
    first = lines.orderBy("line").limit(1).select(head).first()
    if first is not None and not first[0]:
        raise ValueError(f"{path} does not begin with a config line")
    w = Window.orderBy("line")
    numbered = lines.withColumn("epoch", F.sum(head.cast("int")).over(w))
    at = numbered.withColumn("i", F.row_number().over(Window.partitionBy("epoch").orderBy("line")))
    ints = lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x).cast("int"))
    heads = at.where("i <= 4").groupBy("epoch").agg(*(F.max(F.when(F.col("i") == i, F.col("text"))).alias(n) for i, n in ((2, "ltc"), (3, "stoc"), (4, "start"))))
    heads = heads.select((F.col("epoch") - 1).cast("int").alias("cfg_id"), ints("ltc").alias("ltc_ids"), ints("stoc").alias("stoc_ids"), F.col("start").cast("bigint").alias("start_time"))
    parts = at.where("i > 4").select((F.col("epoch") - 1).cast("int").alias("cfg_id"), F.split("text", ",").alias("p"))
    rows = parts.select("cfg_id", *(F.trim(F.col("p")[i]).cast(t).alias(n) for i, (n, t) in enumerate((("key_start", "bigint"), ("key_end", "bigint"), ("server_id", "int"), ("dbid", "int")))), F.transform(F.slice("p", 5, 1 << 20), lambda x: F.trim(x).cast("int")).alias("log_replicas"))
    return rows.join(F.broadcast(heads), "cfg_id")
