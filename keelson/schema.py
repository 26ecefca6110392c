"""The data model: change logs, file metadata, fragments and ranges as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

#: `op` of a log row.
DELETION, VALUE = 0, 1
#: Sequence numbers have 56 bits.
MAX_SEQUENCE = (1 << 56) - 1


def log_schema(key: T.DataType | None = None, value: T.DataType | None = None) -> T.StructType:
    """A change log: key, sequence number, operation, value.  Keys are bigint and values binary unless given."""
    return T.StructType(
        [
            T.StructField("k", key or T.LongType(), False),
            T.StructField("seq", T.LongType(), False),
            T.StructField("op", T.IntegerType(), False),
            T.StructField("v", value or T.BinaryType(), True),
        ]
    )


HANDLE = T.StructType([T.StructField("server_id", T.LongType()), T.StructField("file_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())])

FILES = T.StructType(
    [
        T.StructField("number", T.LongType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("smallest", T.LongType()),
        T.StructField("largest", T.LongType()),
        T.StructField("flush_timestamp", T.LongType()),
        T.StructField("replicas", T.ArrayType(T.StructType([T.StructField("meta", HANDLE), T.StructField("data", T.ArrayType(HANDLE))]))),
        T.StructField("parity", HANDLE),
    ]
)

FRAGMENTS = T.StructType(
    [
        T.StructField("cfg_id", T.IntegerType()),
        T.StructField("key_start", T.LongType()),
        T.StructField("key_end", T.LongType()),
        T.StructField("server_id", T.IntegerType()),
        T.StructField("dbid", T.IntegerType()),
        T.StructField("log_replicas", T.ArrayType(T.IntegerType())),
    ]
)

RANGES = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("lower", T.LongType()), T.StructField("upper", T.LongType()), T.StructField("duplicates", T.IntegerType()), T.StructField("ninserts", T.DoubleType())])
