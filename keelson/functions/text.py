"""Keys, names and encodings as text and bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortest_separator(start: bytes, limit: bytes) -> bytes:
    """A short string in [start, limit), else start."""
    common = 0
    while common < min(len(start), len(limit)) and start[common] == limit[common]:
        common += 1
    if common < min(len(start), len(limit)) and start[common] < 0xFF and start[common] + 1 < limit[common]:
        return start[:common] + bytes([start[common] + 1])
    return start


def short_successor(key: bytes) -> bytes:
    """A short string at or after the key; a key of 0xFF bytes is its own."""
    for i, b in enumerate(key):
        if b != 0xFF:
            return key[:i] + bytes([b + 1])
    return key


def put_varint(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def get_varint(data: bytes, bits: int = 64) -> tuple[int, bytes]:
    """The value and the rest; ValueError if it is cut off or too long."""
    value = 0
    for i, b in enumerate(data[: -(-bits // 7)]):
        value |= (b & 0x7F) << 7 * i
        if not b & 0x80:
            return value, data[i + 1 :]
    raise ValueError("varint is cut off or too long")


def put_fixed(value: int, bits: int) -> bytes:
    return value.to_bytes(bits // 8, "little")


def get_fixed(data: bytes, bits: int) -> tuple[int, bytes]:
    if len(data) < bits // 8:
        raise ValueError("too few bytes")
    return int.from_bytes(data[: bits // 8], "little"), data[bits // 8 :]


def put_string(value: bytes) -> bytes:
    return put_varint(len(value)) + value


def get_string(data: bytes) -> tuple[bytes, bytes]:
    n, rest = get_varint(data, 32)
    if len(rest) < n:
        raise ValueError("string is cut off")
    return rest[:n], rest[n:]


def escaped(data: bytes) -> str:
    """Printable ASCII as it is, other bytes as \\xNN."""
    return "".join(chr(b) if 32 <= b <= 126 else f"\\x{b:02x}" for b in data)


def consume_decimal(text: str) -> tuple[int, str] | None:
    """Leading digits as a 64-bit number and the rest; None without digits or on overflow."""
    m = re.match(r"[0-9]+", text)
    if not m or int(m[0]) >= 1 << 64:
        return None
    return int(m[0]), text[m.end() :]


def file_name(db: str, number: int, kind: str) -> str:
    """Names of a database's files: log, table, temp, descriptor, current, lock, info."""
    return f"{db}/" + {"log": f"{number:06d}.log", "table": f"{number:06d}.ldb", "temp": f"{number:06d}.dbtmp", "descriptor": f"MANIFEST-{number:06d}", "current": "CURRENT", "lock": "LOCK", "info": "LOG"}[kind]


def parse_file_name(name: str) -> tuple[str, int] | None:
    """(kind, number) of a file name without its folder, or None."""
    fixed = {"CURRENT": "current", "LOCK": "lock", "LOG": "info", "LOG.old": "info"}
    if name in fixed:
        return fixed[name], 0
    if (m := re.fullmatch(r"MANIFEST-([0-9]+)", name)) and int(m[1]) < 1 << 64:
        return "descriptor", int(m[1])
    if (m := re.fullmatch(r"([0-9]+)\.(log|ldb|sst|dbtmp)", name)) and int(m[1]) < 1 << 64:
        return {"log": "log", "ldb": "table", "sst": "table", "dbtmp": "temp"}[m[2]], int(m[1])
    return None


def log_file_name(dbid: Column, memtable: Column) -> Column:
    return F.concat_ws("-", dbid.cast("string"), memtable.cast("string"))


def log_file_db(name: Column) -> Column:
    return F.split(name, "-")[0].cast("int")


def key_text(key: Column) -> Column:
    """A number as text with its end mark."""
    return F.concat(key.cast("string"), F.lit("!"))


def parse_key_text(text: Column) -> Column:
    """struct(value, consumed): digits up to the first other character, and their number and one more."""
    digits = F.regexp_extract(text, "^[0-9]*", 0)
    return F.struct(F.coalesce(F.nullif(digits, F.lit("")).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("value"), (F.length(digits) + 1).alias("consumed"))


def is_true(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "1", "yes")


def split_fields(text: Column, delimiter: str) -> Column:
    """The parts between delimiters; an empty part at the end is none."""
    parts = F.split(text, "\\Q" + delimiter + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_ints(text: Column, delimiter: str) -> Column:
    return F.transform(split_fields(text, delimiter), lambda x: x.cast("int"))


def name_params(name: Column, names: list[str], delimiter: str = "-") -> list[Column]:
    """Columns for the parameters that a directory name states in order; null beyond its end."""
    parts = split_fields(name, delimiter)
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]
