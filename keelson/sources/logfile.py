"""Record logs in blocks of 32 KB, and their replay.

A record is one fragment (FULL) or several (FIRST, MIDDLE, LAST), none of which
crosses a block.  A fragment is: masked crc32c of type and payload (4 bytes),
length (2), type (1), payload.  A block's last bytes, if under 7, are zeros.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import crc32c_bytes, mask_crc, unmask_crc

# Block and header size, and the types of fragments.
BLOCK, HEADER = 32768, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def write_log(records: Iterable[bytes]) -> bytes:
    out = bytearray()
    for record in records:
        at, begin = 0, True
        while begin or at < len(record):
            room = BLOCK - len(out) % BLOCK
            if room < HEADER:
                out += bytes(room)
                room = BLOCK
            part = record[at : at + room - HEADER]
            at += len(part)
            end = at == len(record)
            kind = FULL if begin and end else FIRST if begin else LAST if end else MIDDLE
            out += mask_crc(crc32c_bytes(bytes([kind]) + part)).to_bytes(4, "little") + len(part).to_bytes(2, "little") + bytes([kind]) + part
            begin = False
    return bytes(out)


def read_log(data: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """(record, None), and (None, fault) where something is wrong; reading goes on at the next block or record."""
    whole, at = None, 0
    while at + HEADER <= len(data):
        room = BLOCK - at % BLOCK
        if room < HEADER:
            at += room
            continue
        size, kind = int.from_bytes(data[at + 4 : at + 6], "little"), data[at + 6]
        part = data[at + HEADER : at + HEADER + size]
        if kind == 0 and size == 0:  # room made ahead of writing
            at += room
            continue
        if HEADER + size > room or len(part) < size:
            if at + room >= len(data):  # the writer died in this fragment
                return
            yield None, "bad length"
            whole, at = None, at + room
            continue
        if unmask_crc(int.from_bytes(data[at : at + 4], "little")) != crc32c_bytes(bytes([kind]) + part):
            yield None, "checksum"
            whole, at = None, at + room
            continue
        at += HEADER + size
        if kind in (FULL, FIRST) and whole is not None:
            yield None, "record without end"
        if kind == FULL:
            yield part, None
            whole = None
        elif kind == FIRST:
            whole = part
        elif kind in (MIDDLE, LAST):
            if whole is None:
                yield None, "record without beginning"
            elif kind == MIDDLE:
                whole += part
            else:
                yield whole + part, None
                whole = None
        else:
            yield None, "unknown type"
            whole = None


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files as (path, pos, record, fault), a file a row group: they are read side by side."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in parts:
            for name, data in zip(files["path"], files["content"], strict=True):
                got = list(read_log(bytes(data)))
                yield pd.DataFrame({"path": name, "pos": range(len(got)), "record": [r for r, _ in got], "fault": [f for _, f in got]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, pos bigint, record binary, fault string")


def replay(records: DataFrame, by: str = "log") -> DataFrame:
    """Records (`by`, pos, marker, seq, ..) before the first of their log whose marker is not 1: what a crash has left whole."""
    ends = records.where("marker is null or marker <> 1").groupBy(by).agg(F.min("pos").alias("_end"))
    return records.join(ends, by, "left").where("_end is null or pos < _end").drop("_end")
