"""File metadata as queries: version folds, level statistics, and choosing compactions.

The fold and the set selection run over metadata (one row a file).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered, ranges

#: Each level may hold so many times the bytes of the one above it.
LEVEL_FACTOR = 3.2


def fold(base: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """The next version's files: base and added, without deleted (column number)."""
    return base.unionByName(added).join(deleted.select("number"), "number", "left_anti")


def level_stats(files: DataFrame) -> DataFrame:
    """Per level: files, bytes, smallest, largest."""
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").cast("bigint").alias("bytes"), F.min("lo").alias("smallest"), F.max("hi").alias("largest"))


#: The score of a first level with too many files: above any other.
URGENT = 99999.0


def level_scores(files: DataFrame, trigger: int, l0_files: int | None = None) -> DataFrame:
    """Per level its score, bytes over trigger * 3.2^level; the highest wants compaction first.

    With `l0_files`, a first level of more files than that is urgent whatever its bytes.
    """
    stats = files.groupBy("level").agg(F.sum("file_size").cast("bigint").alias("bytes"), F.count("*").alias("_n"))
    score = F.col("bytes") / (F.lit(float(trigger)) * F.pow(F.lit(LEVEL_FACTOR), F.col("level")))
    if l0_files is not None:
        score = F.when((F.col("level") == 0) & (F.col("_n") > l0_files), F.lit(URGENT)).otherwise(score)
    return stats.withColumn("score", score).drop("_n")


def size_histogram(files: DataFrame) -> DataFrame:
    """Files by whole megabytes."""
    return files.groupBy(F.floor(F.col("file_size") / (1 << 20)).alias("mb")).agg(F.count("*").alias("files"), F.sum("file_size").cast("bigint").alias("bytes"))


def approximate_sizes(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per range (id, lower, upper): bytes of files wholly before upper, less those wholly before lower, 0 at least.

    A running sum over files in the order of their ends answers each bound, so
    that no range meets every file.
    """
    ends = files.groupBy("hi").agg(F.sum("file_size").alias("b"))
    cum = ordered.running(ends, "hi", F.col("b"), "cum").select("hi", "cum")
    bounds = wanted.select((F.col("lower") - 1).alias("p")).unionByName(wanted.select((F.col("upper") - 1).alias("p"))).distinct()
    at = ordered.seek(cum, bounds, key="hi", reverse=True).join(cum, F.col("found") == F.col("hi"), "left").select("p", F.coalesce("cum", F.lit(0)).alias("before"))
    low, high = at.select(F.col("p").alias("pl"), F.col("before").alias("bl")), at.select(F.col("p").alias("ph"), F.col("before").alias("bh"))
    out = wanted.join(low, F.col("lower") - 1 == F.col("pl")).join(high, F.col("upper") - 1 == F.col("ph"))
    return out.select("id", F.greatest(F.col("bh") - F.col("bl"), F.lit(0)).cast("bigint").alias("bytes"))


def find_file(files: DataFrame, probes: DataFrame) -> DataFrame:
    """Per probe (p): the first file end (largest key) at or after it, or null."""
    return ordered.seek(files.select("hi").distinct(), probes, key="hi")


def meeting(files: DataFrame, lower=None, upper=None) -> DataFrame:
    """Files whose closed interval meets [lower, upper]; a null bound is infinite."""
    out = files if lower is None else files.where(F.col("hi") >= lower)
    return out if upper is None else out.where(F.col("lo") <= upper)


def between_levels(files: DataFrame, level: Column | None = None) -> DataFrame:
    """Pairs (upper, lower) of files of one level and the next that meet."""
    pairs = ranges.overlap_pairs(files)
    levels = files.select("f", "level")
    both = pairs.join(levels.select(F.col("f").alias("a"), F.col("level").alias("la")), "a").join(levels.select(F.col("f").alias("b"), F.col("level").alias("lb")), "b")
    up = F.col("la") < F.col("lb")
    out = both.where(F.abs(F.col("la") - F.col("lb")) == 1).select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("upper"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("lower"), F.least("la", "lb").alias("level"))
    return out if level is None else out.where(F.col("level") == level)


def trivial_moves(files: DataFrame, deepest: int) -> DataFrame:
    """Files that meet none of the next level: a compaction can move them as they are."""
    busy = between_levels(files).select(F.col("upper").alias("f")).distinct()
    return files.where(F.col("level") < deepest).join(busy, "f", "left_anti").select("f", "level")


def disjoint_sets(files: DataFrame, level: int, parallelism: int) -> DataFrame:
    """Groups of files of `level` and `level` + 1 that meet transitively, with most files of `level` first; the first `parallelism` that have any."""
    both = files.where(F.col("level").isin(level, level + 1))
    islands = ranges.overlap_components(both)
    placed = ordered.seek(islands.select("lo"), both.select("lo").distinct().withColumnRenamed("lo", "p"), key="lo", reverse=True)
    member = both.join(placed, both["lo"] == F.col("p")).select(F.col("found").alias("lo"), F.col("level"), "file_size")
    sets = member.groupBy("lo").agg(F.count_if(F.col("level") == level).alias("upper_files"), F.count_if(F.col("level") == level + 1).alias("lower_files"), F.sum("file_size").cast("bigint").alias("bytes"))
    return sets.where("upper_files > 0").orderBy(F.desc("upper_files"), "lo").limit(parallelism).join(islands.select("lo", "hi"), "lo")


def set_faults(sets: DataFrame, max_files: int) -> DataFrame:
    """Faults of compaction sets (set_id, f, lo, hi): too many files, a file in two sets, sets whose key spans meet.  No row: all is well."""
    spans = sets.groupBy("set_id").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    large = spans.where(F.col("n") > max_files).select(F.lit("too many files").alias("fault"), F.col("set_id").cast("bigint").alias("a"), F.col("n").alias("b"))
    twice = sets.groupBy("f").agg(F.count_distinct("set_id").alias("n")).where("n > 1").select(F.lit("file in two sets").alias("fault"), F.col("f").cast("bigint").alias("a"), F.col("n").alias("b"))
    meet = ranges.overlap_pairs(spans, "set_id").select(F.lit("sets meet").alias("fault"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    return large.unionByName(twice).unionByName(meet)


def cut_by_grandparents(rows: DataFrame, grandparents: DataFrame) -> DataFrame:
    """Adds `output`: the number of the output file of rows (k) when a new one begins each time so many grandparent files lie behind.

    So many is a quarter of the grandparents, from 1 to 5.  Files that end before
    the first key do not count.
    """
    n = grandparents.count()
    limit = max(1, min(5, n // 4))
    counted = ordered.count_below(grandparents, rows, key="hi", probe="k")
    first = counted.agg(F.min("below").alias("_0"))
    return counted.crossJoin(F.broadcast(first)).withColumn("output", F.expr(f"(below - _0) div {limit}").cast("int")).drop("below", "_0")


def lookup_index(log: DataFrame) -> DataFrame:
    """Per key the file (column `file`) that holds its newest version."""
    return log.groupBy("k").agg(F.max_by("file", "seq").alias("file"))


def get_with_lookup_index(log: DataFrame, index: DataFrame, keys: DataFrame) -> DataFrame:
    """Live versions of keys (k), from the one file that the index names for each."""
    asked = keys.select("k").distinct().join(index, "k")
    return log.join(asked, ["k", "file"], "left_semi").groupBy("k").agg(F.max_by(F.struct("seq", "op", "v"), "seq").alias("_r")).where("_r.op = 1").select("k", "_r.seq", "_r.v")


def range_index(parts: DataFrame, files: DataFrame) -> DataFrame:
    """Per range (id, lower, upper; few, in order, without gaps) the files that meet it, by number: id, files.  Ranges without any have an empty list."""
    bounds = [(r.id, r.lower) for r in parts.orderBy("lower").collect()]
    place = lambda c: F.greatest(ordered.search(F.col(c), [b for _, b in bounds]) - 1, F.lit(0))
    ids = F.array(*(F.lit(i) for i, _ in bounds))
    last = parts.agg(F.max("upper").alias("_u"), F.min("lower").alias("_l"))
    inside = files.crossJoin(F.broadcast(last)).where("lo < _u and hi >= _l")
    hit = inside.select("f", F.explode(F.slice(ids, place("lo") + 1, place("hi") - place("lo") + 1)).alias("id"))
    return parts.select("id").join(hit.groupBy("id").agg(F.array_sort(F.collect_list("f")).alias("files")), "id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<bigint>")))


def safe_to_flush(buffers: DataFrame) -> DataFrame:
    """Of unflushed buffers (f, lo, hi, generation), those whose key range no buffer of an older generation meets: f, safe."""
    age = buffers.select("f", "generation")
    pairs = ranges.overlap_pairs(buffers).join(age.select(F.col("f").alias("a"), F.col("generation").alias("ga")), "a").join(age.select(F.col("f").alias("b"), F.col("generation").alias("gb")), "b")
    waits = pairs.where("ga <> gb").select(F.when(F.col("ga") > F.col("gb"), F.col("a")).otherwise(F.col("b")).alias("f")).distinct()
    return buffers.select("f").join(waits.withColumn("_w", F.lit(True)), "f", "left").select("f", F.col("_w").isNull().alias("safe"))


@dataclass(frozen=True)
class File:
    number: int
    smallest: int
    largest: int

    def meets(self, other: File) -> bool:
        return self.smallest <= other.largest and other.smallest <= self.largest


def choose_sets(upper: list[File], lower: list[File], max_files: int, parallelism: int) -> list[tuple[list[File], list[File]]]:
    """Disjoint compaction sets (files of a level, files of the next), none with over `max_files` files.

    From the first free file the set grows to all that it meets, level by level,
    until nothing changes.  A set that is too large shrinks to its first file and
    what this meets below; if that is still too large, it is left to a compaction
    within the level.  Sets never share a file or meet each other's files.
    """
    taken: list[tuple[list[File], list[File]]] = []
    free = sorted(upper, key=lambda f: (f.smallest, f.number))
    below = sorted(lower, key=lambda f: (f.smallest, f.number))
    while free:
        ups, downs = [free[0]], []
        while True:
            more_downs = [f for f in below if f not in downs and any(f.meets(u) for u in ups)]
            downs += more_downs
            more_ups = [f for f in free if f not in ups and any(f.meets(x) for x in downs + ups)]
            ups += more_ups
            if not (more_downs or more_ups):
                break
        if len(ups) + len(downs) > max_files:
            ups = [free[0]]
            downs = [f for f in below if f.meets(free[0])]
            if 1 + len(downs) > max_files:
                ups, downs = [f for f in free if f.meets(free[0])][:max_files], []
        if not any(a.meets(b) for s in taken for a in s[0] + s[1] for b in ups + downs):
            taken.append((ups, downs))
        free = [f for f in free if f not in ups]
        below = [f for f in below if f not in downs]
    return sorted(taken, key=lambda s: -len(s[0]))[:parallelism]
