"""Where blocks and replicas go, and what is lost with a server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workload import uniform


def power_of_d(requests: DataFrame, queue: DataFrame, servers: int, width: int, start: Column, d: int = 2) -> DataFrame:
    """Per request the `width` least queued of d * width servers in a row from `start`: request, server, rank.

    `queue` (server, depth) has one row a server, `servers` at most.
    Ties go to the smaller server.
    """
    tries = min(d * width, servers)
    # One row with all queues: a request looks its servers up and sorts them in place, and nothing is shuffled.
    depths = queue.agg(F.map_from_entries(F.collect_list(F.struct("server", "depth"))).alias("_q"))
    asked = requests.select("request", F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda j: F.pmod(start + j, F.lit(servers)).cast("int")).alias("_s"))
    tried = F.filter(F.transform("_s", lambda s: F.struct(F.element_at("_q", s).alias("depth"), s.alias("server"))), lambda x: x["depth"].isNotNull())
    best = asked.crossJoin(F.broadcast(depths)).select("request", F.posexplode(F.slice(F.array_sort(tried), 1, width)).alias("_i", "x"))
    return best.select("request", F.col("x.server").alias("server"), (F.col("_i") + 1).alias("rank"))


def round_robin(requests: DataFrame, number: str, servers: int, start: int = 0) -> DataFrame:
    """Adds `server`: the servers in turn by the request's number."""
    return requests.withColumn("server", F.pmod(F.col(number) + start, F.lit(servers)).cast("int"))


def random_server(requests: DataFrame, number: str, servers: int, seed: int = 1) -> DataFrame:
    """Adds `server`: one drawn for each request, by a hash of its number."""
    return requests.withColumn("server", F.floor(uniform(F.col(number), seed) * servers).cast("int"))


def scatter(blocks: DataFrame, queue: DataFrame, servers: int, width: int, start: Column) -> DataFrame:
    """Blocks (request, block) of files over the `width` least queued servers of each file, in groups of equal size: request, block, server."""
    n = F.max("block").over(Window.partitionBy("request")) + 1
    group = F.least(F.expr(f"block * {width} div _n"), F.lit(width - 1)).cast("int")
    files = blocks.select("request", start.alias("_start")).distinct()
    chosen = power_of_d(files, queue, servers, width, F.col("_start")).select("request", (F.col("rank") - 1).alias("_g"), "server")
    return blocks.withColumn("_n", n).withColumn("_g", group).join(chosen, ["request", "_g"]).select("request", "block", "server")


def log_replicas(fragments: DataFrame, servers: int, replicas: int) -> DataFrame:
    """Per fragment (id) and replica its server, round robin."""
    j = F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))
    return fragments.select("id", j.alias("replica")).withColumn("server", F.pmod(F.col("id") * replicas + F.col("replica"), F.lit(servers)).cast("int"))


def validate_replicas(replicas: DataFrame) -> DataFrame:
    """Per file (number): replicas, servers, and whether all are on servers of their own and of one size."""
    return replicas.groupBy("number").agg(
        F.count("*").alias("replicas"), F.count_distinct("server").alias("servers"), ((F.count_distinct("server") == F.count("*")) & (F.count_distinct("size") <= 1)).alias("valid")
    )


def repairs(replicas: DataFrame, failed: list[int], servers: int) -> DataFrame:
    """For each replica on a failed server: the file, the lost replica, a source and a destination.

    Source is the live replica with the least number.  Destinations are the live
    servers without a replica of the file, by number; the i-th lost replica of a
    file takes the i-th.  Lost beyond these have a null destination.
    """
    down = F.array(*map(F.lit, failed)).cast("array<int>")
    everyone = F.array(*map(F.lit, range(servers))).cast("array<int>")
    per = replicas.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("replica", "server"))).alias("all"))
    lost = F.filter("all", lambda x: F.array_contains(down, x["server"]))
    live = F.filter("all", lambda x: ~F.array_contains(down, x["server"]))
    free = F.array_sort(F.array_except(F.array_except(everyone, down), F.transform("all", lambda x: x["server"].cast("int"))))
    rows = per.select("number", F.posexplode(lost).alias("i", "x"), live.alias("live"), free.alias("free"))
    return rows.select("number", F.col("x.replica").alias("replica"), F.col("x.server").alias("failed_server"), F.try_element_at("live", F.lit(1))["server"].alias("source"), F.get("free", F.col("i")).alias("destination"))


def parity(fragments: DataFrame, by: list[str]) -> DataFrame:
    """Bytes (by.., pos, b) XORed over fragments; short fragments count as zeros: by.., pos, parity."""
    return fragments.groupBy(*by, "pos").agg(F.bit_xor("b").alias("parity"))


def parity_of(blocks: DataFrame, by: list[str], data: str) -> DataFrame:
    """parity() of whole binary columns."""
    bytes_ = blocks.select(*by, F.posexplode(F.split(F.hex(data), "(?<=\\G..)")).alias("pos", "h")).where("h <> ''")
    return parity(bytes_.select(*by, "pos", F.conv("h", 16, 10).cast("int").alias("b")), by)


def epoch_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fragments (key_start, key_end, server) of two configurations: what was moved, added, removed or unchanged."""
    a, b = before.select("key_start", "key_end", F.col("server").alias("old_server")), after.select("key_start", "key_end", F.col("server").alias("new_server"))
    change = F.when(F.col("old_server").isNull(), "added").when(F.col("new_server").isNull(), "removed").when(F.col("old_server") == F.col("new_server"), "unchanged").otherwise("moved")
    return a.join(b, ["key_start", "key_end"], "full_outer").withColumn("change", change)


def scan_reach(fragments: DataFrame) -> DataFrame:
    """Adds `run`: the first key of the fragments (key_start, key_end, server) that a local scan can go through, one after another on one server."""
    w = Window.orderBy("key_start")
    new = F.when((F.lag("key_end").over(w) == F.col("key_start")) & (F.lag("server").over(w) == F.col("server")), None).otherwise(F.col("key_start"))
    return fragments.withColumn("_n", new).withColumn("run", F.max("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")
