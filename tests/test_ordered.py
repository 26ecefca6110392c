"""Ordered computations over buckets, against plain Python; any key type, and keys far apart."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import ordered, ranges

rng = random.Random(3)
NUMBERS = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(400)})
KEYS = {"bigint": NUMBERS, "string": sorted(f"k{x}" for x in NUMBERS), "binary": sorted(str(x).encode() for x in NUMBERS), "double": [float(i) / 7 for i in range(400)]}


@pytest.mark.parametrize("kind", sorted(KEYS))
@pytest.mark.parametrize("rows", [30, 10_000])
def test_against_python(spark, kind, rows):
    keys = KEYS[kind]
    df = spark.createDataFrame([(k, i % 3, i) for i, k in enumerate(keys)], f"k {kind}, g int, v int").repartition(4)
    plain = lambda x: bytes(x) if isinstance(x, bytearray) else x
    got = {plain(r.k): r for r in ordered.running(df, "k", F.col("v"), "s", rows=rows, before=True).collect()}
    assert all(got[k].s == (sum(range(i)) if i else None) for i, k in enumerate(keys))
    near = {plain(r.k): r for r in ordered.adjacent(df, "k", ["v"], by=["g"], rows=rows).collect()}
    assert all((near[k].prev and near[k].prev.v) == (i - 3 if i > 2 else None) and (near[k].next and near[k].next.v) == (i + 3 if i < 397 else None) for i, k in enumerate(keys))
    assert sorted(r.n for r in ordered.position(df, "k", "n", rows=rows).collect()) == list(range(1, 401))
    probes = keys[::7] + ([k + 1 for k in keys[::11]] if kind == "bigint" else [])
    asked = spark.createDataFrame([(p, j) for j, p in enumerate(probes)], f"p {kind}, j int")
    up = {r.j: plain(r.found) for r in ordered.seek(df, asked, rows=rows).collect()}
    down = {r.j: plain(r.found) for r in ordered.seek(df, asked, rows=rows, reverse=True).collect()}
    below = {r.j: r.below for r in ordered.count_below(df, asked, rows=rows).collect()}
    for j, p in enumerate(probes):
        at = bisect.bisect_left(keys, p)
        assert up[j] == (keys[at] if at < 400 else None) and below[j] == at
        after = bisect.bisect_right(keys, p)
        assert down[j] == (keys[after - 1] if after else None)


def test_hashed_keys_fill_few_buckets(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("k"))
    sizes = [r["count"] for r in ordered.bucketed(df, "k", 500)[0].groupBy("_b").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 700
    assert ordered.bounds_of(df.limit(0), "k") == []


def test_overlaps_with_wide_and_empty_intervals(spark):
    rows = [(i, x, x + rng.choice([0, 1, 3, 40])) for i, x in enumerate(rng.choices(range(-300, 300), k=150))] + [(900, -500, 500), (901, 0, 2000), (902, 7, 7)]
    got = sorted(map(tuple, ranges.overlap_pairs(spark.createDataFrame(rows, "f bigint, lo bigint, hi bigint")).collect()))
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2])
    assert ranges.overlap_pairs(spark.createDataFrame([], "f bigint, lo bigint, hi bigint")).collect() == []
