"""The query catalogue: each operator over derived inputs, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashes import CASTAGNOLI, FNV_BASIS, FNV_PRIME, PRIME64, crc32c, crc_table, fnv64, mul_hash
from ..functions.text import is_true, key_text, log_file_db, log_file_name, name_params, parse_key_text, split_fields
from ..operators import manifest, mvcc, ordered, placement, ranges, reorg, stats
from ..sources import logfile, resources, workload
from . import inputs as I
from .inputs import PARTS, SERVERS, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query of Inputs under its name, with its SQL."""

    def register(f: Callable[[Inputs], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Versioned reads.


@query(f"WITH {I.LATEST} SELECT k, seq, v FROM cur")
def kv_latest(i: Inputs):
    return mvcc.current(i.log_e())


@query(f"WITH {I.LATEST} SELECT k, seq FROM latest WHERE op = 0")
def kv_tombstones(i: Inputs):
    return mvcc.tombstones(i.log_e())


@query(
    f"""WITH {I.LOG_E}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log_e WHERE seq <= (SELECT count(*) // 2 FROM events))
SELECT k, seq, v FROM r WHERE rn = 1 AND op = 1"""
)
def kv_snapshot_as_of(i: Inputs):
    return mvcc.current(i.log_e(), i.events() // 2)


@query(f"WITH {I.LOG_E} SELECT k, seq, op, v, row_number() OVER w AS version, lead(seq) OVER w AS valid_to FROM log_e WINDOW w AS (PARTITION BY k ORDER BY seq)")
def kv_history(i: Inputs):
    return mvcc.history(i.log_e())


@query(
    f"""WITH {I.LOG_L}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log_l), cur AS (SELECT k, seq, v FROM r WHERE rn = 1 AND op = 1),
asked AS (SELECT DISTINCT o_orderkey * 3 AS k FROM orders) SELECT asked.k, seq, v, seq IS NOT NULL AS found FROM asked LEFT JOIN cur USING (k)"""
)
def kv_multi_get(i: Inputs):
    asked = i.table("orders").select((F.col("o_orderkey") * 3).alias("k"))
    return mvcc.multi_get(i.log_l(), asked)


@query(f"WITH {I.LATEST} SELECT k, seq, v FROM cur WHERE k = 7")
def kv_get(i: Inputs):
    return mvcc.current(i.log_e().where("k = 7"))


@query(f"WITH {I.LATEST} SELECT k, seq, v FROM cur WHERE k >= 5 AND k < 90")
def kv_range_scan(i: Inputs):
    return mvcc.range_scan(i.log_e(), 5, 90)


@query(f"WITH {I.LATEST} SELECT k, seq, v FROM cur WHERE k >= 5 ORDER BY k LIMIT 20")
def kv_scan_n(i: Inputs):
    return mvcc.range_scan(i.log_e(), 5, None, limit=20)


@query(f"WITH {I.LATEST} SELECT k, seq, v FROM cur WHERE k < 100 ORDER BY k DESC LIMIT 20")
def kv_reverse_scan(i: Inputs):
    return mvcc.range_scan(i.log_e(), None, 100, reverse=True, limit=20)


def _probes(i: Inputs) -> DataFrame:
    return i.table("customer").select((F.col("c_custkey") * 3 % 2000 - 20).alias("p")).distinct()


_PROBES = "probes AS (SELECT DISTINCT c_custkey * 3 % 2000 - 20 AS p FROM customer)"


@query(f"WITH {I.LATEST}, {_PROBES} SELECT p, (SELECT min(k) FROM cur WHERE k >= p) AS found FROM probes")
def kv_seek(i: Inputs):
    return mvcc.seek(i.log_e(), _probes(i))


@query(f"WITH {I.LATEST}, {_PROBES} SELECT p, (SELECT max(k) FROM cur WHERE k <= p) AS found FROM probes")
def kv_seek_for_prev(i: Inputs):
    return mvcc.seek(i.log_e(), _probes(i), reverse=True)


@query(f"WITH {I.LATEST} SELECT k, lag(k) OVER (ORDER BY k) AS prev_k, lead(k) OVER (ORDER BY k) AS next_k FROM cur")
def kv_next_prev(i: Inputs):
    return mvcc.neighbours(i.log_e())


@query(f"WITH {I.LATEST} SELECT min(k) AS first_k, arg_min(v, k) AS first_v, max(k) AS last_k, arg_max(v, k) AS last_v FROM cur")
def kv_first_last(i: Inputs):
    return mvcc.current(i.log_e()).agg(F.min("k").alias("first_k"), F.min_by("v", "k").alias("first_v"), F.max("k").alias("last_k"), F.max_by("v", "k").alias("last_v"))


@query(
    f"""WITH {I.LATEST}, {I.FRAGMENTS}, f AS (SELECT *, id // 4 AS server FROM frag), start AS (SELECT * FROM f WHERE lower <= 40 AND 40 < upper),
stop AS (SELECT max(f.upper) AS hi FROM f, start WHERE f.server = start.server) SELECT k, seq, v FROM cur, stop WHERE k >= 40 AND k < hi ORDER BY k LIMIT 50"""
)
def kv_scan_local(i: Inputs):
    f = i.fragments().select("id", F.col("lower").alias("key_start"), F.col("upper").alias("key_end"), F.expr("id div 4").alias("server"))
    runs = placement.scan_reach(f)
    start = runs.where("key_start <= 40 and 40 < key_end").select("run")
    hi = runs.join(start, "run").agg(F.max("key_end")).first()[0]
    return mvcc.range_scan(i.log_e(), 40, hi, limit=50)


@query(f"WITH {I.LOG_E} SELECT k, count(*) AS versions, CAST(sum(1 - op) AS BIGINT) AS deletions, max(seq) AS newest FROM log_e GROUP BY k")
def kv_version_counts(i: Inputs):
    return i.log_e().groupBy("k").agg(F.count("*").alias("versions"), F.sum(1 - F.col("op")).cast("bigint").alias("deletions"), F.max("seq").alias("newest"))


@query(f"WITH {I.LATEST} SELECT count(*) AS sampled, CAST(sum(k) AS BIGINT) AS keys FROM cur WHERE k * 7919 % 100 < 10")
def kv_sampling_scan(i: Inputs):
    return mvcc.current(i.log_e()).where("k * 7919 % 100 < 10").agg(F.count("*").alias("sampled"), F.sum("k").cast("bigint").alias("keys"))


@query(f"WITH {I.LOG_E}, m AS (SELECT * FROM log_e WHERE seq % 3 = 0 UNION ALL SELECT * FROM log_e WHERE seq % 3 = 1 UNION ALL SELECT * FROM log_e WHERE seq % 3 = 2) SELECT k, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM m GROUP BY k")
def kv_merge_runs(i: Inputs):
    log = i.log_e()
    return mvcc.merge(*(log.where(f"seq % 3 = {r}") for r in range(3))).groupBy("k").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


# Writes and compaction.

_RETAIN = "(SELECT count(*) * 3 // 5 FROM events)"
_SURVIVORS = f"{I.LOG_E}, newer AS (SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS up FROM log_e), kept AS (SELECT k, seq, op, v FROM newer WHERE up IS NULL OR up > {_RETAIN})"


@query(f"WITH {_SURVIVORS} SELECT * FROM kept")
def compaction_survivors(i: Inputs):
    return mvcc.survivors(i.log_e(), i.events() * 3 // 5)


@query(f"WITH {_SURVIVORS} SELECT * FROM kept WHERE op <> 0 OR seq > {_RETAIN}")
def compaction_drop_base_tombstones(i: Inputs):
    return mvcc.base_survivors(i.log_e(), i.events() * 3 // 5)


@query(f"WITH {_SURVIVORS} SELECT (SELECT count(*) FROM log_e) AS versions, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM log_e) - (SELECT count(*) FROM kept) AS dropped")
def compaction_obsolete(i: Inputs):
    log = i.log_e()
    kept = mvcc.survivors(log, i.events() * 3 // 5).agg(F.count("*").alias("kept"))
    return log.agg(F.count("*").alias("versions")).crossJoin(kept).select("versions", "kept", (F.col("versions") - F.col("kept")).alias("dropped"))


@query(f"WITH {I.LOG_L}, {I.EQUI}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log_l) SELECT id AS range_id, count(*) AS rows FROM r JOIN drange ON k >= lower AND k < upper WHERE rn = 1 GROUP BY 1")
def compaction_split_by_range(i: Inputs):
    routed = ranges.route(mvcc.newest(i.log_l()), "k", i.dranges())
    return routed.where("range_id is not null").groupBy("range_id").agg(F.count("*").alias("rows"))


@query("SELECT o_orderkey AS ord, 1000 + row_number() OVER (ORDER BY o_orderkey) - 1 AS seq, o_custkey AS k FROM orders")
def batch_expand_seq(i: Inputs):
    return mvcc.sequenced(i.table("orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("k")), 1000)


@query("SELECT CAST(count(*) AS BIGINT) AS records, CAST(sum(12 + strlen(c_name)) AS BIGINT) AS bytes FROM customer")
def batch_approximate_size(i: Inputs):
    return i.table("customer").agg(F.count("*").alias("records"), F.sum(12 + F.octet_length("c_name")).cast("bigint").alias("bytes"))


@query("SELECT k, v FROM (SELECT CAST(i AS BIGINT) AS k, repeat(chr(CAST(97 + i % 10 AS INTEGER)), 16) AS v FROM range(1000, 3000) r(i))")
def bulk_load(i: Inputs):
    return workload.bulk_load(i.spark, 1000, 3000, 16)


@query("SELECT CAST(i AS BIGINT) AS k, repeat(chr(CAST(97 + i % 10 AS INTEGER)), 16) AS v, CASE WHEN i % 11 = 0 THEN NULL ELSE 'x' END AS got FROM range(1000, 3000) r(i) WHERE i % 11 = 0 OR i % 13 = 0")
def verify_load(i: Inputs):
    good = workload.bulk_load(i.spark, 1000, 3000, 16)
    stored = good.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 13 == 0, "x").otherwise(F.col("v")))
    return workload.verify_load(stored, 1000, 3000, 16)


# Keys.


@query("SELECT c_custkey, CAST(c_custkey * 37 % 1000 AS VARCHAR) || '!' || c_name AS raw, c_custkey * 37 % 1000 AS num, row_number() OVER (ORDER BY c_custkey * 37 % 1000, c_custkey) AS place FROM customer")
def numeric_key_order(i: Inputs):
    raw = i.table("customer").select("c_custkey", F.concat(F.expr("c_custkey * 37 % 1000").cast("string"), F.lit("!"), F.col("c_name")).alias("raw"))
    num = raw.withColumn("num", mvcc.numeric_key(F.col("raw")).cast("bigint"))
    top = num.agg(F.max("c_custkey")).first()[0] or 0
    placed = ordered.position(num.withColumn("_o", F.col("num") * (top + 1) + F.col("c_custkey")), "_o", "place")
    return placed.drop("_o")


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) || '!' AS key_text, p_partkey AS parsed, length(CAST(p_partkey AS VARCHAR)) + 1 AS consumed FROM part")
def key_text_round_trip(i: Inputs):
    t = i.table("part").select("p_partkey", key_text(F.col("p_partkey")).alias("key_text")).withColumn("x", parse_key_text(F.col("key_text")))
    return t.select("p_partkey", "key_text", F.col("x.value").cast("bigint").alias("parsed"), F.col("x.consumed").cast("bigint").alias("consumed"))


@query("SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey AS VARCHAR) AS log_name, s_nationkey AS dbid, s_nationkey % 2 = 1 AS flag FROM supplier")
def log_names(i: Inputs):
    s = i.table("supplier").withColumn("log_name", log_file_name(F.col("s_nationkey"), F.col("s_suppkey")))
    text = F.when(F.col("s_nationkey") % 2 == 1, " True ").otherwise("no")
    return s.select("s_suppkey", "log_name", log_file_db(F.col("log_name")).alias("dbid"), is_true(text).alias("flag"))


# Ranges.


@query(f"WITH {I.FRAGMENTS} SELECT o_orderkey, id AS range_id FROM orders JOIN frag ON o_orderkey >= lower AND o_orderkey < upper")
def route_fragment(i: Inputs):
    return ranges.route(i.table("orders").select("o_orderkey"), "o_orderkey", i.fragments())


@query(f"WITH {I.FRAGMENTS} SELECT id AS range_id, count(*) AS rows, CAST(round(sum(l_quantity)) AS BIGINT) AS quantity FROM lineitem JOIN frag ON l_orderkey >= lower AND l_orderkey < upper GROUP BY 1")
def fragment_load(i: Inputs):
    routed = ranges.route(i.table("lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", i.fragments())
    return routed.where("range_id is not null").groupBy("range_id").agg(F.count("*").alias("rows"), F.round(F.sum("l_quantity")).cast("bigint").alias("quantity"))


@query(f"WITH {I.LOG_L}, {I.EQUI} SELECT id AS range_id, CAST(seq % 3 AS INTEGER) AS copy, count(*) AS rows FROM log_l JOIN drange ON k >= lower AND k < upper GROUP BY 1, 2")
def route_drange_salted(i: Inputs):
    routed = ranges.route(i.log_l().select("k", "seq"), "k", i.dranges())
    return ranges.salted(routed, F.lit(3)).groupBy("range_id", "copy").agg(F.count("*").alias("rows"))


@query(f"WITH {I.FRAGMENTS} SELECT * FROM frag")
def split_uniform(i: Inputs):
    return i.fragments()


@query(f"WITH {I.EQUI} SELECT * FROM drange")
def split_equi_load(i: Inputs):
    return i.dranges()


@query(f"WITH {I.RATES}, t AS (SELECT sum(rate) AS total FROM rates) SELECT k, rate, CAST(ceil(rate / (total / 5000.0)) AS BIGINT) AS duplicates FROM rates, t WHERE rate >= total / 5000.0")
def hot_keys(i: Inputs):
    rates = ranges.key_rates(i.table("lineitem").select(F.col("l_orderkey").alias("k")))
    total = i.table("lineitem").count()
    return ranges.hot_keys(rates, 5000, total)


@query(f"WITH {I.FRAGMENTS}, l AS (SELECT id, count(l_orderkey) AS load FROM frag LEFT JOIN lineitem ON l_orderkey >= lower AND l_orderkey < upper GROUP BY 1), s AS (SELECT load / (SELECT sum(load) FROM l) AS s FROM l) SELECT round((max(s) - 1.0 / {PARTS}) * 100 * {PARTS}, 6) AS max_percent, round(sqrt(sum(pow((s - 1.0 / {PARTS}) * 100, 2)) / {PARTS}) / 100, 8) AS stdev FROM s")
def load_imbalance(i: Inputs):
    routed = ranges.route(i.table("lineitem").select("l_orderkey"), "l_orderkey", i.fragments()).where("range_id is not null")
    out = ranges.load_imbalance(routed.groupBy("range_id").agg(F.count("*").alias("load")), PARTS)
    return out.select(F.round("max_percent", 6).alias("max_percent"), F.round("stdev", 8).alias("stdev"))


@query(f"WITH {I.EQUI}, c AS (SELECT id, 1 + id % 3 AS copies, ninserts FROM drange) SELECT id, CAST(j AS INTEGER) AS copy, ninserts // copies AS load FROM c, range(3) r(j) WHERE j < copies")
def load_by_range(i: Inputs):
    c = i.dranges().withColumn("copies", 1 + F.col("id") % 3)
    return c.select("id", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.expr("ninserts div copies").alias("load"))


@query(f"WITH {I.FILES_O} SELECT a.f AS a, b.f AS b FROM files_o a JOIN files_o b ON a.f < b.f AND a.lo <= b.hi AND b.lo <= a.hi")
def overlap_pairs(i: Inputs):
    return ranges.overlap_pairs(i.files_o())


_COUNTS = f"{I.FILES_O}, counts AS (SELECT a.f, count(*) AS n FROM files_o a JOIN files_o b ON a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1)"


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def overlap_counts(i: Inputs):
    return ranges.overlap_counts(i.files_o())


@query(f"WITH {_COUNTS}, d AS (SELECT n, row_number() OVER (ORDER BY n DESC) - 1 AS i, count(*) OVER () AS t FROM counts) SELECT min(n) AS least, max(n) AS greatest, max(n) FILTER (WHERE i = t // 2) AS median FROM d")
def overlap_summary(i: Inputs):
    return stats.middle_of_descending(ranges.overlap_counts(i.files_o()))


_ISLANDS = "seen AS (SELECT *, max(hi) OVER (ORDER BY lo, hi, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {0}), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi, f) AS grp FROM seen)"


@query(f"WITH {I.FILES_O}, {_ISLANDS.format('files_o')} SELECT min(lo) AS lo, max(hi) AS hi, count(*) AS files FROM g GROUP BY grp")
def overlap_components(i: Inputs):
    return ranges.overlap_components(i.files_o())


@query(f"WITH {I.EQUI}, v AS (SELECT id, lower, CASE WHEN id % 5 = 2 THEN upper - 1 WHEN id % 5 = 4 THEN upper + 1 ELSE upper END AS upper FROM drange), n AS (SELECT *, lead(lower) OVER (ORDER BY lower) AS next_lower FROM v), f AS (SELECT *, CASE WHEN lower >= upper THEN 'empty' WHEN next_lower < upper THEN 'overlap' WHEN next_lower > upper THEN 'gap' END AS fault FROM n) SELECT * FROM f WHERE fault IS NOT NULL")
def range_validate(i: Inputs):
    spoiled = i.dranges().select("id", "lower", F.when(F.col("id") % 5 == 2, F.col("upper") - 1).when(F.col("id") % 5 == 4, F.col("upper") + 1).otherwise(F.col("upper")).alias("upper"))
    return ranges.validate(spoiled)


@query()
def construct_ranges(i: Inputs):
    """The adaptive split of the histogram of all keys."""
    return ranges.split_adaptive(ranges.key_rates(i.table("lineitem").select(F.col("l_orderkey").alias("k"))), PARTS)


# File metadata.


@query(f"WITH {I.FILES_META} SELECT level, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes, min(lo) AS smallest, max(hi) AS largest FROM files_meta GROUP BY 1")
def level_stats(i: Inputs):
    return manifest.level_stats(i.files_meta())


@query(f"WITH {I.FILES_META} SELECT level, CAST(sum(file_size) AS BIGINT) AS bytes, round(sum(file_size) / (268435456.0 * pow(3.2, level)), 8) AS score FROM files_meta GROUP BY 1")
def level_scores(i: Inputs):
    return manifest.level_scores(i.files_meta(), 256 << 20).withColumn("score", F.round("score", 8))


@query(f"WITH {I.FILES_META}, s AS (SELECT level, sum(file_size) / (268435456.0 * pow(3.2, level)) AS score FROM files_meta GROUP BY 1) SELECT arg_max(level, score) AS level, round(max(score), 8) AS score FROM s")
def compaction_pick_level(i: Inputs):
    return manifest.level_scores(i.files_meta(), 256 << 20).agg(F.max_by("level", "score").alias("level"), F.round(F.max("score"), 8).alias("score"))


@query(f"WITH {I.FILES_META} SELECT file_size // 1048576 AS mb, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS bytes FROM files_meta GROUP BY 1")
def size_histogram(i: Inputs):
    return manifest.size_histogram(i.files_meta())


@query(f"WITH {I.FILES_META}, {I.FRAGMENTS} SELECT id, CAST(greatest(0, coalesce(sum(file_size) FILTER (WHERE hi < upper), 0) - coalesce(sum(file_size) FILTER (WHERE hi < lower), 0)) AS BIGINT) AS bytes FROM frag, files_meta GROUP BY id")
def approx_sizes(i: Inputs):
    return manifest.approximate_sizes(i.files_meta(), i.fragments())


@query(f"WITH {I.FILES_META}, p AS (SELECT DISTINCT c_custkey * 11 % 20000 AS p FROM customer) SELECT p, (SELECT min(hi) FROM files_meta WHERE hi >= p) AS found FROM p")
def find_file(i: Inputs):
    return manifest.find_file(i.files_meta(), i.table("customer").select((F.col("c_custkey") * 11 % 20000).alias("p")).distinct())


@query(f"WITH {I.FILES_META} SELECT number, level, lo, hi FROM files_meta WHERE hi >= 300 AND lo <= 700")
def files_in_range(i: Inputs):
    return manifest.meeting(i.files_meta(), 300, 700).select("number", "level", "lo", "hi")


@query(f"WITH {I.FILES_META} SELECT n.number, n.level, n.file_size FROM files_meta n WHERE NOT EXISTS (SELECT 1 FROM files_meta o WHERE o.number = n.number AND o.number % 30 <> 0)")
def new_files_since(i: Inputs):
    now = i.files_meta().select("number", "level", "file_size")
    return now.join(now.where("number % 30 <> 0").select("number"), "number", "left_anti")


@query(f"WITH {I.FILES_META} SELECT number, CASE WHEN number % 40 = 10 THEN 1 ELSE level END AS level, file_size FROM files_meta WHERE number % 20 <> 0")
def manifest_fold(i: Inputs):
    files = i.files_meta().select("number", "level", "file_size")
    moved = files.where("number % 40 = 10").withColumn("level", F.lit(1))
    gone = files.where("number % 20 = 0 or number % 40 = 10").select("number")
    return manifest.fold(files, files.limit(0), gone).unionByName(moved)


@query(f"WITH {I.FILES_META} SELECT f, level FROM files_meta a WHERE level < 2 AND NOT EXISTS (SELECT 1 FROM files_meta b WHERE b.level = a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi)")
def trivial_moves(i: Inputs):
    return manifest.trivial_moves(i.files_meta(), 2)


@query(f"WITH {I.FILES_META} SELECT a.f AS upper, b.f AS lower, a.level FROM files_meta a JOIN files_meta b ON b.level = a.level + 1 AND a.lo <= b.hi AND b.lo <= a.hi")
def compaction_inputs(i: Inputs):
    return manifest.between_levels(i.files_meta())


@query(
    f"""WITH {I.FILES_META}, two AS (SELECT * FROM files_meta WHERE level < 2), {_ISLANDS.format('two')},
s AS (SELECT min(lo) AS lo, max(hi) AS hi, count(*) FILTER (WHERE level = 0) AS upper_files, count(*) FILTER (WHERE level = 1) AS lower_files, CAST(sum(file_size) AS BIGINT) AS bytes FROM g GROUP BY grp)
SELECT * FROM s WHERE upper_files > 0 ORDER BY upper_files DESC, lo LIMIT 32"""
)
def disjoint_sets(i: Inputs):
    return manifest.disjoint_sets(i.files_meta(), 0, 32)


@query(f"WITH {I.FILES_META}, {I.FRAGMENTS} SELECT id, CASE WHEN count(*) FILTER (WHERE level = 0 AND f % 100 < 50) > 30 THEN 10000 ELSE 0 END AS needs_compaction FROM frag LEFT JOIN files_meta ON lo >= lower AND lo < upper GROUP BY id")
def needs_compaction(i: Inputs):
    routed = ranges.route(i.files_meta(), "lo", i.fragments()).where("range_id is not null")
    n = routed.groupBy(F.col("range_id").alias("id")).agg(F.count_if((F.col("level") == 0) & (F.col("f") % 100 < 50)).alias("n"))
    return i.fragments().select("id").join(n, "id", "left").select("id", F.when(F.col("n") > 30, 10000).otherwise(0).alias("needs_compaction"))


# Statistics.

_LIMITS = "limits AS (SELECT unnest([{0}]) AS upper, generate_subscripts([{0}], 1) - 1 AS bucket)".format(", ".join(f"{x!r}::DOUBLE" for x in stats.bucket_limits()))
_HISTOGRAM = f"""{_LIMITS}, b AS (SELECT bucket, upper, coalesce(lag(upper) OVER (ORDER BY bucket), 0) AS lower FROM limits),
hist AS (SELECT CAST(bucket AS INTEGER) AS bucket, lower, upper, count(*) AS n FROM events JOIN b ON (value >= lower OR bucket = 0) AND value < upper GROUP BY 1, 2, 3)"""


@query(f"WITH {_HISTOGRAM} SELECT * FROM hist")
def latency_histogram(i: Inputs):
    return stats.histogram(i.table("events"), "value")


@query(
    f"""WITH {_HISTOGRAM}, c AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS cum FROM hist), e AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS t FROM events),
p AS (SELECT unnest([50.0, 90.0, 95.0, 99.0, 99.9])::DOUBLE AS p), h AS (SELECT p, lo, hi, t, min(bucket) AS bucket FROM p, e, c WHERE cum >= t * p / 100 GROUP BY ALL)
SELECT p, round(least(greatest(lower + (upper - lower) * ((t * p / 100 - (cum - n)) / n), lo), hi), 6) AS value FROM h JOIN c USING (bucket)"""
)
def latency_percentiles(i: Inputs):
    return stats.percentiles(i.table("events"), [50, 90, 95, 99, 99.9], "value").withColumn("value", F.round("value", 6))


@query("SELECT count(value) AS n, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS average, round(stddev_pop(value), 6) AS stddev FROM events")
def latency_summary(i: Inputs):
    return stats.summary(i.table("events"), "value").withColumns({"average": F.round("average", 6), "stddev": F.round("stddev", 6)})


@query("WITH t AS (SELECT CAST(floor(epoch(ts) / 10) * 10 AS BIGINT) AS tick, event_type, count(*) AS delta FROM events GROUP BY 1, 2) SELECT tick, event_type, delta, CAST(sum(delta) OVER (PARTITION BY event_type ORDER BY tick) AS BIGINT) AS total FROM t")
def counter_deltas(i: Inputs):
    return stats.counter_deltas(i.table("events"), 10)


@query("SELECT event_id // 50 AS grp, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def group_mean_every_g(i: Inputs):
    return stats.group_means(i.table("events"), "event_id", "value", 50).withColumn("mean", F.round("mean", 6))


@query("WITH t AS (SELECT floor(epoch(ts) / 10) AS x FROM events), s AS (SELECT CAST(max(x) - min(x) + 1 AS BIGINT) AS intervals, CAST(max(x) - min(x) + 1 - count(DISTINCT x) AS BIGINT) AS stalled FROM t) SELECT intervals, stalled, round(stalled / intervals, 8) AS share FROM s")
def stall_ratio(i: Inputs):
    return stats.stall_share(i.table("events"), 10).withColumn("share", F.round("share", 8))


@query("WITH m AS (SELECT user_id, event_id, event_type = 'signup' AS s, epoch(ts) AS t FROM events WHERE event_type IN ('signup', 'purchase')), n AS (SELECT *, lead(s) OVER w AS ns, lead(t) OVER w AS nt FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, round(nt - t, 3) AS seconds FROM n WHERE s AND NOT ns")
def paired_durations(i: Inputs):
    e = i.table("events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    out = stats.paired_durations(e, "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase", at)
    return out.withColumn("seconds", F.round("seconds", 3))


@query("SELECT event_type, count(*) AS ops, round(avg(value), 6) AS average, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY 1")
def client_log_rollup(i: Inputs):
    q = lambda p: F.round(F.expr(f"percentile(value, {p})"), 6)
    return i.table("events").groupBy("event_type").agg(F.count("*").alias("ops"), F.round(F.avg("value"), 6).alias("average"), q(0.9).alias("p90"), q(0.99).alias("p99"), q(0.999).alias("p999"))


@query("SELECT user_id % 8 AS experiment, round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 4) AS click, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS purchase, round(coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0), 4) AS view FROM events GROUP BY 1")
def experiment_pivot(i: Inputs):
    p = i.table("events").groupBy((F.col("user_id") % 8).alias("experiment")).pivot("event_type", ["click", "purchase", "view"]).agg(F.sum("value"))
    return p.select("experiment", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("click", "purchase", "view")))


@query(f"SELECT CAST(f AS INTEGER) AS failed, CAST(w AS INTEGER) AS width, round(CASE WHEN f > {SERVERS} - w THEN 0 ELSE list_product([({SERVERS} - w - x)::DOUBLE / ({SERVERS} - x) FOR x IN range(f)]) END, 9) AS available FROM (VALUES (1), (2), (3)) a(f), (VALUES (1), (3), (9)) b(w)")
def availability_model(i: Inputs):
    return stats.availability(i.spark, SERVERS, [1, 2, 3], [1, 3, 9]).withColumn("available", F.round("available", 9))


# Placement.


@query(
    f"""WITH {I.QUEUE}, c AS (SELECT o_orderkey AS request, CAST((o_custkey + j) % {SERVERS} AS INTEGER) AS server FROM orders, range(6) r(j)),
r AS (SELECT request, c.server, row_number() OVER (PARTITION BY request ORDER BY depth, c.server) AS rank FROM c JOIN queue USING (server)) SELECT request, server, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def place_power_of_d(i: Inputs):
    return placement.power_of_d(i.table("orders").select(F.col("o_orderkey").alias("request"), "o_custkey").withColumn("_s", F.col("o_custkey")), i.queue(), SERVERS, 3, F.col("o_custkey"))


@query(f"SELECT o_orderkey, CAST((o_orderkey + 3) % {SERVERS} AS INTEGER) AS server FROM orders")
def place_round_robin(i: Inputs):
    return placement.round_robin(i.table("orders").select("o_orderkey"), "o_orderkey", SERVERS, 3)


@query(f"WITH {I.FRAGMENTS} SELECT id, CAST(j AS INTEGER) AS replica, CAST((id * 3 + j) % {SERVERS} AS INTEGER) AS server FROM frag, range(3) r(j)")
def log_replica_map(i: Inputs):
    return placement.log_replicas(i.fragments(), SERVERS, 3)


@query(f"WITH {I.REPLICAS} SELECT number, count(*) AS replicas, count(DISTINCT server) AS servers, count(DISTINCT server) = count(*) AND count(DISTINCT size) <= 1 AS valid FROM replicas GROUP BY 1")
def replica_validate(i: Inputs):
    return placement.validate_replicas(i.replicas())


@query(
    f"""WITH {I.REPLICAS}, lost AS (SELECT number, replica, server, row_number() OVER (PARTITION BY number ORDER BY replica) AS i FROM replicas WHERE server IN (2, 5)),
src AS (SELECT number, arg_min(server, replica) AS source FROM replicas WHERE server NOT IN (2, 5) GROUP BY 1),
cand AS (SELECT n.number, CAST(s AS INTEGER) AS server, row_number() OVER (PARTITION BY n.number ORDER BY s) AS i FROM (SELECT DISTINCT number FROM lost) n, range({SERVERS}) r(s)
  WHERE s NOT IN (2, 5) AND NOT EXISTS (SELECT 1 FROM replicas x WHERE x.number = n.number AND x.server = s))
SELECT lost.number, lost.replica, lost.server AS failed_server, source, cand.server AS destination FROM lost LEFT JOIN src USING (number) LEFT JOIN cand ON cand.number = lost.number AND cand.i = lost.i"""
)
def replica_repair(i: Inputs):
    return placement.repairs(i.replicas(), [2, 5], SERVERS)


_EPOCHS = f"{I.FRAGMENTS}, a AS (SELECT lower AS key_start, upper AS key_end, id % 4 AS old_server FROM frag), b AS (SELECT lower AS key_start, upper AS key_end, CASE WHEN id % 5 = 0 THEN (id + 1) % 4 ELSE id % 4 END AS new_server FROM frag WHERE id <> 7)"


@query(f"WITH {_EPOCHS} SELECT key_start, key_end, old_server, new_server, CASE WHEN old_server IS NULL THEN 'added' WHEN new_server IS NULL THEN 'removed' WHEN old_server = new_server THEN 'unchanged' ELSE 'moved' END AS change FROM a FULL JOIN b USING (key_start, key_end)")
def epoch_diff(i: Inputs):
    f = i.fragments().select("id", F.col("lower").alias("key_start"), F.col("upper").alias("key_end"))
    after = f.where("id <> 7").withColumn("server", F.when(F.col("id") % 5 == 0, (F.col("id") + 1) % 4).otherwise(F.col("id") % 4))
    return placement.epoch_diff(f.withColumn("server", F.col("id") % 4), after)


@query("WITH x AS (SELECT o_orderkey // 4 AS stripe, CAST(p AS INTEGER) AS pos, CAST((o_custkey * (p + 3) + o_orderkey) % 256 AS INTEGER) AS b FROM orders, range(8) r(p) WHERE p < 4 + o_orderkey % 5) SELECT stripe, pos, bit_xor(b) AS parity FROM x GROUP BY 1, 2")
def xor_parity(i: Inputs):
    o = i.table("orders").select("o_custkey", "o_orderkey", F.explode(F.sequence(F.lit(0), F.least(F.lit(7), (F.lit(3) + F.col("o_orderkey") % 5).cast("int")))).alias("pos"))
    return placement.parity(o.select(F.expr("o_orderkey div 4").alias("stripe"), "pos", F.expr("cast((o_custkey * (pos + 3) + o_orderkey) % 256 as int)").alias("b")), ["stripe"])


# Range management.

#: Loads that differ from fragment to fragment.
_LOADS = f"{I.FRAGMENTS}, loads AS (SELECT id, lower, upper, count(l_orderkey) AS ninserts FROM frag LEFT JOIN lineitem ON l_orderkey >= lower AND l_orderkey < upper AND l_quantity < 5 * (id % 8) + 5 GROUP BY ALL)"


def _routed(i: Inputs) -> DataFrame:
    routed = ranges.route(i.table("lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", i.fragments())
    return routed.where(F.col("l_quantity") < 5 * (F.col("range_id") % 8) + 5)


def _loads(i: Inputs) -> DataFrame:
    n = _routed(i).groupBy(F.col("range_id").alias("id")).agg(F.count("*").alias("ninserts"))
    return i.fragments().join(n, "id", "left").withColumn("ninserts", F.coalesce("ninserts", F.lit(0)))


_DECIDE = f"""WITH {_LOADS}, r AS (SELECT *, (ninserts / (SELECT sum(ninserts) FROM loads) * {PARTS} - 1) * 100 AS off, upper - lower <> 1 AS wide FROM loads),
d AS (SELECT count(*) AS ranges, count(*) FILTER (WHERE wide AND abs(off) > 20) AS unfair, CAST(sum(ninserts) AS BIGINT) AS writes, (SELECT id FROM r WHERE wide AND off > 20 AND ninserts > 10 ORDER BY off DESC, id LIMIT 1) AS worst FROM r),
a AS (SELECT *, CASE WHEN unfair > ranges * 0.3 AND writes >= {{0}} THEN 'major' WHEN worst IS NOT NULL THEN 'minor' ELSE 'none' END AS action FROM d)
SELECT action, CASE WHEN action = 'minor' THEN CAST(worst AS INTEGER) END AS id, unfair, ranges, writes FROM a"""


@query(_DECIDE.format(1000))
def reorg_major(i: Inputs):
    return reorg.decide(_loads(i), PARTS, 10, 1000)


@query(_DECIDE.format(10**12))
def reorg_minor(i: Inputs):
    return reorg.decide(_loads(i), PARTS, 10, 10**12)


_POINTS = "points AS (SELECT CAST(floor(sqrt(user_id % 100)) AS INTEGER) AS id, CAST(floor(sqrt(user_id % 100)) AS BIGINT) AS lower, CAST(floor(sqrt(user_id % 100)) AS BIGINT) + 1 AS upper, count(*) AS ninserts FROM events GROUP BY ALL)"


@query(f"WITH {_POINTS}, c AS (SELECT *, CASE WHEN ninserts / (SELECT sum(ninserts) FROM points) * {PARTS} > 1.5 THEN CAST(floor(ninserts / (SELECT sum(ninserts) FROM points) * {PARTS}) AS INTEGER) ELSE 1 END AS copies FROM points) SELECT id, CAST(j AS INTEGER) AS copy, copies, lower, upper, round(ninserts / copies, 6) AS ninserts FROM c, range({PARTS}) r(j) WHERE j < copies")
def duplicates_created(i: Inputs):
    k = F.floor(F.sqrt(F.col("user_id") % 100)).cast("bigint")
    points = i.table("events").groupBy(k.alias("lower")).agg(F.count("*").alias("ninserts")).select(F.col("lower").cast("int").alias("id"), "lower", (F.col("lower") + 1).alias("upper"), "ninserts")
    return reorg.create_duplicates(points, PARTS).withColumn("ninserts", F.round("ninserts", 6))


@query(
    f"""WITH c AS (SELECT CAST(o_orderkey % 6 AS INTEGER) AS id, CAST(o_custkey % 4 AS INTEGER) AS copy, count(*) FILTER (WHERE o_orderkey % 11 < o_custkey % 4 * 4) AS ninserts FROM orders GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, ninserts / (SELECT sum(ninserts) FROM c) * {PARTS} AS fair, row_number() OVER (PARTITION BY id ORDER BY ninserts DESC, copy) AS rank FROM c), s AS (SELECT *, n = 1 OR fair >= 0.5 OR rank = 1 AS stay FROM r),
t AS (SELECT *, coalesce(sum(ninserts) FILTER (WHERE NOT stay) OVER (PARTITION BY id), 0) / count(*) FILTER (WHERE stay) OVER (PARTITION BY id) AS more FROM s)
SELECT id, copy, CAST(id AS BIGINT) AS lower, CAST(id + 1 AS BIGINT) AS upper, round(ninserts + more, 6) AS ninserts FROM t WHERE stay"""
)
def duplicates_destroyed(i: Inputs):
    o = i.table("orders").groupBy((F.col("o_orderkey") % 6).cast("int").alias("id"), (F.col("o_custkey") % 4).cast("int").alias("copy")).agg(F.count_if(F.col("o_orderkey") % 11 < F.col("o_custkey") % 4 * 4).alias("ninserts"))
    copies = o.withColumns({"lower": F.col("id").cast("bigint"), "upper": (F.col("id") + 1).cast("bigint")})
    return reorg.destroy_duplicates(copies, PARTS).withColumn("ninserts", F.round("ninserts", 6))


_TINY = f"""{_LOADS}, kr AS (SELECT id AS range_id, l_orderkey AS k, count(*) AS rate FROM frag JOIN lineitem ON l_orderkey >= lower AND l_orderkey < upper AND l_quantity < 5 * (id % 8) + 5 GROUP BY 1, 2),
tc AS (SELECT kr.*, CAST(sum(rate) OVER (PARTITION BY range_id ORDER BY k) - rate AS BIGINT) AS cum, ninserts FROM kr JOIN loads ON loads.id = range_id),
tiny AS (SELECT range_id, CAST(least(cum * 8 // greatest(ninserts, 1), 7) AS INTEGER) AS tiny, min(k) AS lower, max(k) + 1 AS upper, CAST(sum(rate) AS BIGINT) AS ninserts FROM tc GROUP BY 1, 2)"""


def _tiny(i: Inputs) -> DataFrame:
    rates = _routed(i).groupBy("range_id", F.col("l_orderkey").alias("k")).agg(F.count("*").alias("rate"))
    return reorg.split_tiny(rates, _loads(i), 8)


@query(f"WITH {_TINY} SELECT * FROM tiny")
def tiny_ranges(i: Inputs):
    return _tiny(i)


@query(
    f"""WITH {_TINY}, nb AS (SELECT id, ninserts AS own, lag(ninserts) OVER (ORDER BY id) AS l, lead(ninserts) OVER (ORDER BY id) AS r, greatest(ninserts - sum(ninserts) OVER () / {PARTS}, 0) AS surplus FROM loads),
g AS (SELECT tiny.*, own, surplus, greatest(coalesce(least((own - l) / 2, surplus), 0), 0) AS gl, greatest(coalesce(least((own - r) / 2, surplus), 0), 0) AS gr, sum(ninserts) OVER (ORDER BY tiny) AS cl, sum(ninserts) OVER (ORDER BY tiny DESC) AS cr FROM tiny JOIN nb ON nb.id = range_id WHERE range_id = 7),
h AS (SELECT *, cl <= gl AS goes, coalesce(sum(ninserts) FILTER (WHERE cl <= gl) OVER (), 0) AS gone FROM g)
SELECT range_id, tiny, CASE WHEN goes THEN 6 WHEN cr <= gr AND cr <= surplus - gone THEN 8 ELSE 7 END AS to_range FROM h"""
)
def tiny_ranges_pushed(i: Inputs):
    return reorg.push_tiny(_loads(i), _tiny(i), 7, PARTS)


@query(
    f"""WITH {_LOADS}, e AS (SELECT min(l_orderkey - 50) AS lo, max(l_orderkey * 2) + 1 AS hi FROM lineitem),
w AS (SELECT id, CASE WHEN id = 0 THEN least(lower, lo) ELSE lower END AS lower, CASE WHEN id = {PARTS - 1} THEN greatest(upper, hi) ELSE upper END AS upper, row_number() OVER (ORDER BY ninserts DESC, id) AS rank FROM loads, e),
p AS (SELECT *, greatest(least(1 + 24 // {PARTS} + CASE WHEN rank <= 24 % {PARTS} THEN 1 ELSE 0 END, upper - lower), 1) AS p FROM w),
x AS (SELECT lower + (upper - lower) * j // p AS lower, lower + (upper - lower) * (j + 1) // p AS upper FROM p, range(40) r(j) WHERE j < p)
SELECT CAST(row_number() OVER (ORDER BY lower) - 1 AS INTEGER) AS id, lower, upper FROM x"""
)
def ranges_grown(i: Inputs):
    keys = i.table("lineitem").select((F.col("l_orderkey") - 50).alias("k")).unionByName(i.table("lineitem").select((F.col("l_orderkey") * 2).alias("k")))
    return reorg.grow(_loads(i), keys, 40)


@query(f"WITH {_LOADS}, k AS (SELECT id, ninserts AS keys, ninserts <= (SELECT avg(ninserts) FROM loads) AS merges FROM loads) SELECT id, merges, CASE WHEN merges THEN CAST(sum(CAST(merges AS INTEGER)) OVER (ORDER BY id) - 1 AS INTEGER) ELSE (SELECT CAST(count(*) AS INTEGER) FROM k WHERE merges) END AS start_tid, CASE WHEN merges THEN CAST(sum(CAST(merges AS INTEGER)) OVER (ORDER BY id) - 1 AS INTEGER) ELSE 63 END AS end_tid FROM k")
def thread_assignment(i: Inputs):
    loads = _loads(i).select("id", F.col("ninserts").alias("keys"))
    return reorg.assign_threads(loads, 64, int(loads.agg(F.floor(F.avg("keys"))).first()[0]))


@query("WITH x AS (SELECT l_suppkey % 32 AS range_id, l_partkey AS k FROM lineitem WHERE l_partkey % (l_suppkey % 32 + 1) = 0), s AS (SELECT range_id, count(*) AS records, count(DISTINCT k) AS keys FROM x GROUP BY 1) SELECT *, CASE WHEN keys <= 20 THEN 'merge' ELSE 'flush' END AS action FROM s")
def buffers_merged(i: Inputs):
    x = i.table("lineitem").select((F.col("l_suppkey") % 32).alias("range_id"), F.col("l_partkey").alias("k")).where("k % (range_id + 1) = 0")
    return reorg.merge_or_flush(x, 20)


@query(f"WITH {I.FILES_O}, b AS (SELECT f, lo, hi, f // 10 % 5 AS generation FROM files_o) SELECT f, NOT EXISTS (SELECT 1 FROM b o WHERE o.generation < b.generation AND o.lo <= b.hi AND b.lo <= o.hi) AS safe FROM b")
def flush_order(i: Inputs):
    return manifest.safe_to_flush(i.files_o().select("f", "lo", "hi", F.expr("f div 10 % 5").alias("generation")))


@query(f"WITH {I.FILES_O}, {I.FRAGMENTS} SELECT id, f FROM frag JOIN files_o ON lo < upper AND hi >= lower")
def range_file_index(i: Inputs):
    return manifest.range_index(i.fragments(), i.files_o()).select("id", F.explode("files").alias("f"))


@query(f"WITH {I.LATEST} SELECT k, seq // 1000 AS file FROM latest")
def kv_lookup_index(i: Inputs):
    return manifest.lookup_index(i.log_e().withColumn("file", F.expr("seq div 1000")))


@query(f"WITH {I.LATEST} SELECT k, seq, v FROM cur WHERE k IN (SELECT c_custkey FROM customer)")
def kv_get_by_lookup_index(i: Inputs):
    log = i.log_e().withColumn("file", F.expr("seq div 1000"))
    return manifest.get_with_lookup_index(log, manifest.lookup_index(log), i.table("customer").select(F.col("c_custkey").alias("k")))


_SETS = "sets AS (SELECT f // 400 AS set_id, f, lo, hi FROM files_o UNION ALL SELECT f // 400 + 1, f, lo, hi FROM files_o WHERE f % 700 = 0)"


@query(
    f"""WITH {I.FILES_O}, {_SETS}, spans AS (SELECT set_id, count(*) AS n, min(lo) AS lo, max(hi) AS hi FROM sets GROUP BY 1)
SELECT 'too many files' AS fault, set_id AS a, n AS b FROM spans WHERE n > 40 UNION ALL SELECT 'file in two sets', f, count(DISTINCT set_id) FROM sets GROUP BY f HAVING count(DISTINCT set_id) > 1
UNION ALL SELECT 'sets meet', x.set_id, y.set_id FROM spans x JOIN spans y ON x.set_id < y.set_id AND x.lo <= y.hi AND y.lo <= x.hi"""
)
def set_faults(i: Inputs):
    files = i.files_o().select(F.expr("f div 400").alias("set_id"), "f", "lo", "hi")
    return manifest.set_faults(files.unionByName(files.where("f % 700 = 0").withColumn("set_id", F.col("set_id") + 1)), 40)


@query(f"WITH {I.FILES_META}, g AS (SELECT hi FROM files_meta WHERE level = 2), b AS (SELECT o_orderkey AS k, (SELECT count(*) FROM g WHERE hi < o_orderkey) AS below FROM orders), o AS (SELECT k, CAST((below - (SELECT min(below) FROM b)) // greatest(1, least(5, (SELECT count(*) FROM g) // 4)) AS INTEGER) AS output FROM b) SELECT output, count(*) AS rows, min(k) AS lo, max(k) AS hi FROM o GROUP BY 1")
def compaction_split_by_grandparents(i: Inputs):
    cut = manifest.cut_by_grandparents(i.table("orders").select(F.col("o_orderkey").alias("k")), i.files_meta().where("level = 2").select("hi"))
    return cut.groupBy("output").agg(F.count("*").alias("rows"), F.min("k").alias("lo"), F.max("k").alias("hi"))


@query(f"WITH {I.FILES_META} SELECT level, CAST(sum(file_size) AS BIGINT) AS bytes, round(CASE WHEN level = 0 AND count(*) > 30 THEN 99999 ELSE sum(file_size) / (268435456.0 * pow(3.2, level)) END, 8) AS score FROM files_meta GROUP BY 1")
def level_scores_by_count(i: Inputs):
    return manifest.level_scores(i.files_meta(), 256 << 20, 30).withColumn("score", F.round("score", 8))


@query("WITH r AS (SELECT user_id AS log, event_id AS pos, CASE WHEN event_id % 97 = 13 THEN 0 ELSE 1 END AS marker, event_id AS seq FROM events) SELECT log, count(*) AS records, max(seq) AS last_seq FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.log = r.log AND x.marker <> 1 AND x.pos <= r.pos) GROUP BY 1")
def log_replay(i: Inputs):
    records = i.table("events").select(F.col("user_id").alias("log"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 97 == 13, 0).otherwise(1).alias("marker"), F.col("event_id").alias("seq"))
    return logfile.replay(records).groupBy("log").agg(F.count("*").alias("records"), F.max("seq").alias("last_seq"))


# Placement by draw, logs of resources and experiments.

_U = "(CAST('0x' || substr(md5(CAST({0} AS VARCHAR) || ' 1'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query(f"SELECT o_orderkey, CAST(floor({_U.format('o_orderkey')} * {SERVERS}) AS INTEGER) AS server FROM orders")
def place_random(i: Inputs):
    return placement.random_server(i.table("orders").select("o_orderkey"), "o_orderkey", SERVERS)


@query(
    f"""WITH {I.QUEUE}, c AS (SELECT o_orderkey AS request, CAST((o_custkey + j) % {SERVERS} AS INTEGER) AS server FROM orders, range(6) r(j)),
r AS (SELECT request, c.server, row_number() OVER (PARTITION BY request ORDER BY depth, c.server) AS rank FROM c JOIN queue USING (server)) SELECT request, CAST(b AS INTEGER) AS block, server FROM r, range(7) x(b) WHERE b * 3 // 7 = rank - 1"""
)
def scatter_blocks(i: Inputs):
    blocks = i.table("orders").select(F.col("o_orderkey").alias("request"), "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("block"))
    return placement.scatter(blocks, i.queue(), SERVERS, 3, F.col("o_custkey"))


@query("SELECT s_nationkey AS node, sample, c AS name, round(CASE c WHEN 'key' THEN s_suppkey ELSE s_suppkey * 1000 * 8192 / 56e9 END, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS sample FROM supplier) s, (VALUES ('key'), ('[IB]InGbps')) v(c)")
def resource_samples(i: Inputs):
    s = i.table("supplier").select(F.col("s_nationkey").alias("node"), "s_suppkey")
    titles = s.select("node").distinct().select("node", F.posexplode(F.array(F.lit("title"), F.lit("key [IB]InKB"))).alias("n", "line"))
    lines = s.select("node", (F.row_number().over(Window.partitionBy("node").orderBy("s_suppkey")) + 1).alias("n"), F.concat_ws(" ", "s_suppkey", F.col("s_suppkey") * 1000).alias("line"))
    return resources.samples(titles.unionByName(lines)).select("node", F.col("sample").cast("bigint").alias("sample"), "name", F.round("value", 9).alias("value"))


@query("WITH x AS (SELECT string_split(o_orderstatus || '-' || o_orderpriority || '-', '-') AS p, o_totalprice FROM orders) SELECT p[1] AS status, p[2] AS rank, count(*) AS runs, round(avg(o_totalprice), 4) AS mean FROM x GROUP BY 1, 2")
def experiment_params(i: Inputs):
    o = i.table("orders").withColumn("name", F.concat("o_orderstatus", F.lit("-"), "o_orderpriority", F.lit("-")))
    return o.select(*name_params(F.col("name"), ["status", "rank"]), "o_totalprice").groupBy("status", "rank").agg(F.count("*").alias("runs"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS parts, CAST(p_partkey AS VARCHAR) AS first_part, CASE WHEN p_partkey % 2 = 0 THEN 'end' ELSE '' END AS last_part FROM part")
def fields_split(i: Inputs):
    text = F.concat(F.col("p_partkey").cast("string"), F.lit(".."), F.lit(".."), F.when(F.col("p_partkey") % 2 == 0, "end").otherwise(""))
    parts = i.table("part").select("p_partkey", split_fields(text, "..").alias("x"))
    return parts.select("p_partkey", F.size("x").alias("parts"), F.element_at("x", 1).alias("first_part"), F.element_at("x", -1).alias("last_part"))


# Workloads and hashes.

_ZIPF = workload.zeta(1000, 0.99)
_ETA = (1 - (2 / 1000) ** 0.01) / (1 - workload.zeta(2, 0.99) / _ZIPF)
_DRAWN = f"u AS (SELECT i, {_U.format('i')} AS u FROM range(20000) r(i)), z AS (SELECT i, CASE WHEN u * {_ZIPF!r}::DOUBLE < 1 THEN 0 WHEN u * {_ZIPF!r}::DOUBLE < {1 + 0.5**0.99!r}::DOUBLE THEN 1 ELSE CAST(floor(1000 * pow({_ETA!r}::DOUBLE * u - {_ETA!r}::DOUBLE + 1, {1 / (1 - 0.99)!r}::DOUBLE)) AS BIGINT) END AS k FROM u)"
_FNV = "list_reduce(list_prepend(CAST({basis} AS HUGEINT), list_transform(range(8), lambda x: CAST(({0} >> (8 * x)) & 255 AS HUGEINT))), lambda h, b: (xor(h, b) * {prime}) % 18446744073709551616)".replace("{basis}", str(FNV_BASIS)).replace("{prime}", str(FNV_PRIME))
_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN {0} - 18446744073709551616 ELSE {0} END AS BIGINT)"


@query(f"WITH {_DRAWN} SELECT CAST(k AS BIGINT) AS k, count(*) AS n FROM z GROUP BY 1")
def zipf_keys(i: Inputs):
    return workload.zipf_keys(i.spark, 20_000, 1000).groupBy("k").agg(F.count("*").alias("n"))


@query(f"WITH {_DRAWN} SELECT CAST({_FNV.format('k')} % 1000 AS BIGINT) AS k, count(*) AS n FROM z GROUP BY 1")
def scrambled_zipf_keys(i: Inputs):
    return workload.scrambled_zipf_keys(i.spark, 20_000, 1000).groupBy("k").agg(F.count("*").alias("n"))


@query(f"WITH {_DRAWN} SELECT CAST(1000 - k AS BIGINT) AS k, count(*) AS n FROM z GROUP BY 1")
def latest_keys(i: Inputs):
    return workload.latest_keys(i.spark, 20_000, 1000).groupBy("k").agg(F.count("*").alias("n"))


@query(f"WITH {_DRAWN} SELECT CAST(5 + floor(u * 10) AS BIGINT) AS k, count(*) AS n FROM u GROUP BY 1")
def uniform_keys(i: Inputs):
    return workload.uniform_keys(i.spark, 20_000, 5, 14).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT i AS id, i + 7 AS k FROM range(500) r(i)")
def counter_keys(i: Inputs):
    return workload.counter_keys(i.spark, 500, 7)


@query(f"WITH {_DRAWN} SELECT CASE WHEN u < 0.5 THEN 'read' WHEN u < 0.75 THEN 'update' ELSE 'scan' END AS op, count(*) AS n FROM u GROUP BY 1")
def discrete_ops(i: Inputs):
    op = workload.discrete(workload.uniform(F.col("id")), {"read": 2, "update": 1, "scan": 1})
    return i.spark.range(20_000).groupBy(op.alias("op")).agg(F.count("*").alias("n"))


@query(
    f"SELECT c_custkey, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c_name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, list_extract([{', '.join(map(str, crc_table(CASTAGNOLI)))}]::BIGINT[], CAST(xor(c, b) & 255 AS INTEGER) + 1))), 4294967295::BIGINT) AS crc FROM customer"
)
def crc32c_checksums(i: Inputs):
    return i.table("customer").select("c_custkey", crc32c(F.col("c_name").cast("binary")).alias("crc"))


@query(f"WITH h AS (SELECT o_orderkey, {_FNV.format('o_orderkey')} AS h FROM orders) SELECT o_orderkey, {_SIGNED.format('h')} AS h FROM h")
def fnv64_hashes(i: Inputs):
    return i.table("orders").select("o_orderkey", fnv64(F.col("o_orderkey")).alias("h"))


@query(f"WITH h AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * {PRIME64} % 18446744073709551616 AS h FROM orders) SELECT o_orderkey, {_SIGNED.format('h')} AS h FROM h")
def mul_hashes(i: Inputs):
    return i.table("orders").select("o_orderkey", mul_hash(F.col("o_orderkey")).alias("h"))


@query()
def bloom_false_positives(i: Inputs):
    """Per bucket of customers a Bloom filter of their names, probed with all names of the bucket and as many others."""
    import pandas as pd

    from ..functions.bloom import Bloom

    def probe(p: pd.DataFrame) -> pd.DataFrame:
        bloom, keys = Bloom(10), [n.encode() for n in p["c_name"]]
        made = bloom.create(keys)
        wrong = sum(bloom.may_match(k + b"?", made) for k in keys)
        return pd.DataFrame({"bucket": [p["bucket"].iloc[0]], "keys": [len(keys)], "missed": [sum(not bloom.may_match(k, made) for k in keys)], "false_positives": [wrong]})

    c = i.table("customer").select(F.expr("c_custkey div 500").alias("bucket"), "c_name")
    return c.groupBy("bucket").applyInPandas(probe, "bucket bigint, keys bigint, missed bigint, false_positives bigint")


# The store and streams.


def _folder(i: Inputs) -> str:
    import tempfile
    import uuid

    shared = i.spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not i.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="keelson-")
    return f"{shared}/store-{uuid.uuid4().hex}"


@query(f"WITH {I.LATEST} SELECT k, seq + 1 AS seq, v FROM cur")
def store_round_trip(i: Inputs):
    """The log in two commits, compacted, and read back."""
    from ..store import Options, Store

    half = i.events() // 2
    store = Store(i.spark, _folder(i), Options(value_type="double"))
    log = i.log_e().withColumnRenamed("seq", "ord")
    store.write(log.where(F.col("ord") < half))
    store.write(log.where(F.col("ord") >= half))
    store.compact()
    return store.scan()


@query(f"WITH {I.LATEST} SELECT k, seq + 1 AS seq, v FROM cur")
def stream_latest(i: Inputs):
    """The log as a stream, committed batch by batch, and the newest versions."""
    from ..store import Options, Store
    from ..streaming.changes import read_changes, upsert

    folder, path = _folder(i), f"{i.dir}/events*.parquet"
    stream = read_changes(i.spark, path, i.table("events").schema)
    changes = stream.select(F.col("event_id").alias("ord"), F.col("user_id").alias("k"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("op"), F.col("value").alias("v"))
    store = Store(i.spark, f"{folder}/store", Options(value_type="double"))
    upsert(changes, store, f"{folder}/checkpoint").awaitTermination()
    return store.scan()


@query("WITH t AS (SELECT time_bucket(INTERVAL 10 SECONDS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT CAST(epoch(start) AS BIGINT) AS start, event_type, n FROM t WHERE start + INTERVAL 10 SECONDS <= (SELECT max(ts) - INTERVAL 60 SECONDS FROM events)")
def stream_counters(i: Inputs):
    """Tumbling windows that the watermark has closed."""
    from ..streaming.changes import collect_stream, counters, read_changes

    folder = _folder(i)
    stream = counters(read_changes(i.spark, f"{i.dir}/events*.parquet", i.table("events").schema), "ts", "event_type")
    collect_stream(stream, f"{folder}/out", f"{folder}/checkpoint")
    done = i.spark.read.schema("start timestamp, event_type string, n bigint").parquet(f"{folder}/out")
    return done.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
