"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of `[\x20\x09-\x0D]`, which is also what bytes.split() cuts at.
WHITESPACE = " \t\n\x0b\f\r"
_SPACE = re.compile(r"[ \t\n\x0b\f\r]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what `spark.checkpoint.dir` names.  Only where that is unset on a single
    machine (tests) a temporary folder takes its place.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="keelson-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keelson/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for path in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            if "/keelson/" in folder.toString():
                folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release_memory() -> None:
    """Give freed memory back to the system; a worker lives on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow, after which a task's worker gives its memory back."""

    def tidy(rows):
        try:
            yield from run(rows)
        finally:
            release_memory()

    return df.mapInArrow(tidy, schema)


#: Bits of a bitmap of ids: as words of 64 bits, 4 MB at most, whatever the number of ids.
BITMAP = 1 << 24


def bitmap(ids: DataFrame, column: str) -> DataFrame:
    """The ids as a bitmap of their hashes: (word, bits), at most BITMAP / 64 rows."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITMAP))
    return ids.select(F.expr("1L").alias("one"), bit.alias("bit")).groupBy(F.expr("bit div 64").alias("_kl_word")).agg(F.expr("bit_or(shiftleft(one, cast(bit % 64 as int)))").alias("_kl_bits"))


def perhaps_in(rows: DataFrame, column: str, ids: DataFrame, ids_column: str) -> DataFrame:
    """`rows` with a column `_kl_perhaps`: false only if `ids` lacks the row's id.

    It spares most rows a shuffle where few are wanted.  What is broadcast has a
    fixed bound; as the bitmap fills up, more rows pass in vain.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(BITMAP))
    cut = rows.withColumn("_kl_bit", bit).withColumn("_kl_word", F.expr("_kl_bit div 64"))
    hit = F.expr("coalesce(getbit(_kl_bits, cast(_kl_bit % 64 as int)), 0) = 1")
    return cut.join(F.broadcast(bitmap(ids, ids_column)), "_kl_word", "left").withColumn("_kl_perhaps", hit).drop("_kl_word", "_kl_bits", "_kl_bit")


def row_key(id_col: str, text_col: str) -> Column:
    """A row's identity: its id and a 128-bit hash of its text.  In order of ids; a null id comes last."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("hash"))


def without(rows: DataFrame, key: Column, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """`rows` without those whose key is among `gone` (one column), and with one row of each key among `repeated`.  Most rows that stay are not shuffled."""

    def split(rows: DataFrame, keys: DataFrame):
        marked = perhaps_in(rows, "_kl_key", keys, "_kl_of")
        own = F.col("_kl_key").eqNullSafe(F.col("_kl_of"))
        maybe = marked.where("_kl_perhaps").drop("_kl_perhaps")
        return marked.where("not _kl_perhaps").drop("_kl_perhaps").unionByName(maybe.join(keys, own, "left_anti")), maybe.join(keys, own, "left_semi")

    # The row's own columns are out of the way in a struct, whatever their names.
    packed = rows.select(key.alias("_kl_key"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_kl_row"))
    left = split(packed, materialize(gone.toDF("_kl_of").distinct(), "gone"))[0]
    if repeated is not None:
        repeated = materialize(repeated.toDF("_kl_of").distinct(), "repeated")
        if not repeated.isEmpty():
            once, again = split(left, repeated)
            left = once.unionByName(again.dropDuplicates(["_kl_key"]))
    return left.select("_kl_row.*")


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the column as text, modulo n."""
    return F.crc32(column.cast("string")) % F.lit(n)


def pieces(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """Cut a text at white space into pieces of about `limit` characters; no word is cut."""
    start, size = 0, len(text)
    while size - start > limit:
        found = _SPACE.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def batches(texts: Iterable[str], limit: int = 1 << 21) -> Iterator[list[tuple[int, str]]]:
    """Group (document number, piece of text) so that a group has about `limit` characters."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text, limit):
            group.append((i, piece))
            size += len(piece)
            if size >= limit:
                yield group
                group, size = [], 0
    if group:
        yield group
