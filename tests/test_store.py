"""The store's behaviour: versions, snapshots, compaction, conflicts, faults, and a model test."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import manifest, mvcc, ranges
from keelson.store import CommitConflict, Options, Store, StoreError

TEXT = Options(key_type="string", value_type="string")


def rows(spark, *records):
    """Records (k, v); v None deletes."""
    return spark.createDataFrame([(i, k, int(v is not None), v) for i, (k, v) in enumerate(records)], "ord bigint, k string, op int, v string")


def test_empty_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    assert s.get("foo") is None and s.scan().collect() == [] and s.first() is None and s.compact() == 0
    assert s.verify().collect() == []


def test_put_delete_get_and_empty_values(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, ("foo", "v1"), ("foo", "v2"), ("", "empty key"), ("e", "")))
    assert s.get("foo") == "v2" and s.get("") == "empty key" and s.get("e") == ""
    s.delete(spark.createDataFrame([("foo",), ("never",)], "k string"))
    assert s.get("foo") is None and s.get("never") is None
    assert [r.k for r in s.scan().collect()] == ["", "e"]


def test_snapshots(spark, tmp_path):
    s, snaps = Store(spark, str(tmp_path / "s"), TEXT), []
    for i in range(1, 5):
        s.write(rows(spark, ("foo", f"v{i}")))
        snaps.append(s.snapshot())
    assert [s.get("foo", x) for x in snaps] == ["v1", "v2", "v3", "v4"] and s.get("foo") == "v4"
    snaps[0].release()
    s.compact()
    assert [s.get("foo", x) for x in snaps[1:]] == ["v2", "v3", "v4"]


def test_iteration_with_deletes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, ("a", "va"), ("b", "vb"), ("c", "vc"), ("b", None)))
    assert s.get("b") is None and s.seek("b").k == "c" and s.seek("b", reverse=True).k == "a"
    assert s.first().k == "a" and s.last().k == "c"
    assert [r.k for r in s.scan(reverse=True).collect()] == ["c", "a"]
    assert [r.k for r in s.scan("b", None, limit=1).collect()] == ["c"]


def versions(s, key):
    return [(r.op, r.v) for r in s.log().where(F.col("k") == key).orderBy(F.desc("seq")).collect()]


def test_hidden_values_go_with_compaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, ("foo", "big")))
    snap = s.snapshot()
    s.write(rows(spark, ("foo", "tiny")))
    s.compact()
    assert versions(s, "foo") == [(1, "tiny"), (1, "big")] and s.get("foo", snap) == "big"
    snap.release()
    s.compact()
    assert versions(s, "foo") == [(1, "tiny")]


def test_deletion_markers(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, ("foo", "v1"), ("a", "begin"), ("z", "end")))
    s.compact(into=2)
    s.write(rows(spark, ("foo", None)))
    s.write(rows(spark, ("foo", "v2")))
    assert versions(s, "foo") == [(1, "v2"), (0, None), (1, "v1")]
    s.compact(into=1)
    assert versions(s, "foo") == [(1, "v2"), (1, "v1")]
    s.compact(into=2)
    assert versions(s, "foo") == [(1, "v2")]
    s.write(rows(spark, ("foo", None)))
    s.compact(into=1)
    assert versions(s, "foo") == [(0, None), (1, "v2")] and s.get("foo") is None  # a deeper level still holds the key
    s.compact(into=2)
    assert versions(s, "foo") == []


def test_conflict(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s"), TEXT) for _ in range(2))
    base = a.version()
    b.write(rows(spark, ("k", "b")))
    with pytest.raises(CommitConflict):
        a._commit(base, {"add": [], "remove": [], "last_seq": 0})
    a.write(rows(spark, ("k", "a")))
    assert a.get("k") == "a"


def test_files_without_a_commit_are_not_read(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, ("k", "v")))
    lost = rows(spark, ("k", "lost")).withColumn("seq", F.lit(99).cast("bigint")).select("k", "seq", "op", "v")
    s._write_files(lost, 0, 50)  # the writer dies before its commit
    assert s.get("k") == "v" and s.vacuum() == 1 and s.get("k") == "v"


def test_repair_finds_files(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, ("k", "v")))
    for f in (tmp_path / "s/manifest").iterdir():
        if "000002" in f.name:
            f.unlink()
    s = Store(spark, str(tmp_path / "s"), TEXT)
    assert s.get("k") is None and s.repair() == 1 and s.get("k") == "v" and s.version().last_seq == 1


def test_open_options(spark, tmp_path):
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "no"), Options(create_if_missing=False))
    s = Store(spark, str(tmp_path / "s"))
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "s"), Options(error_if_exists=True))
    s.destroy()
    assert not (tmp_path / "s").exists()


def test_properties_sizes_and_bloom(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(bloom_keys=1000))
    s.put(spark.range(100).select(F.col("id").alias("k"), F.lit(b"x" * 50).alias("v")).coalesce(1))
    s.put(spark.range(200, 300).select(F.col("id").alias("k"), F.lit(b"y").alias("v")))
    assert int(s.property("num-files-at-level0")) >= 2 and s.property("num-files-at-level1") == "0"
    assert s.property("nonsense") is None and s.property("stats") and s.property("sstables") and s.property("approximate-memory-usage")
    a, b, c = s.approximate_sizes([(0, 150), (0, 1000), (400, 500)])
    assert 0 < a < b and c == 0
    assert s.get(250) == b"y" and s.files().count() >= 2 and not s.compaction_due()
    assert s.compact(0, 50) >= 1 and int(s.property("num-files-at-level0")) >= 1 and s.get(7) == b"x" * 50
    assert s.verify().collect() == [] and s.flush() == 0


def test_old_versions_stay_readable(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, ("k", "1")))
    n = s.version().number
    s.write(rows(spark, ("k", "2")))
    s.compact()
    assert mvcc.current(s.log(version=n)).first().v == "1"


def test_model(spark, tmp_path):
    """Random batches against an ordered map, with snapshots and compactions in between."""
    rng, model, kept = random.Random(7), {}, []
    s = Store(spark, str(tmp_path / "s"), TEXT)
    for step in range(8):
        batch = [(f"k{rng.randrange(40):02d}", None if rng.random() < 0.3 else f"{step}-{i}") for i in range(rng.randrange(1, 30))]
        s.write(rows(spark, *batch))
        for k, v in batch:
            model.pop(k, None) if v is None else model.__setitem__(k, v)
        if step in (2, 5):
            kept.append((s.snapshot(), dict(model)))
        if step in (3, 6):
            s.compact(into=1 if step == 3 else 2)
        assert [(r.k, r.v) for r in s.scan().collect()] == sorted(model.items())
    for snap, old in kept:
        assert [(r.k, r.v) for r in s.scan(snapshot=snap, reverse=True).collect()] == sorted(old.items(), reverse=True)
    keys = spark.createDataFrame([(f"k{i:02d}",) for i in range(45)], "k string")
    assert {r.k: r.v for r in s.multi_get(keys).where("found").collect()} == model


def test_streamed_batches_commit_once(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, ("k", "1")), ("stream", 0))
    s.write(rows(spark, ("k", "again")), ("stream", 0))
    assert s.get("k") == "1" and s.version().last_seq == 1


def test_running_counts_stream(spark, tmp_path):
    from keelson.streaming.changes import read_changes, running_counts

    spark.range(30).select((F.col("id") % 3).alias("u")).write.parquet(str(tmp_path / "in"))
    q = running_counts(read_changes(spark, str(tmp_path / "in"), "u bigint"), "u").writeStream.outputMode("update").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.total) for r in spark.sql("SELECT * FROM running").collect()} == {("0", 10), ("1", 10), ("2", 10)}


def test_compaction_sets():
    up = [manifest.File(1, 0, 8), manifest.File(2, 10, 15)]
    low = [manifest.File(3, 4, 5), manifest.File(4, 5, 9), manifest.File(5, 9, 12), manifest.File(6, 12, 18)]
    sets = manifest.choose_sets(up, low, 3, 2)
    assert sets and len(sets) <= 2 and all(1 <= len(a) + len(b) <= 3 for a, b in sets)
    files = [f.number for a, b in sets for f in a + b]
    assert len(files) == len(set(files))
    for i, x in enumerate(sets):
        for y in sets[i + 1 :]:
            assert not any(f.meets(g) for f in x[0] + x[1] for g in y[0] + y[1])
    assert manifest.choose_sets([manifest.File(1, 0, 1)], [], 3, 2) == [([manifest.File(1, 0, 1)], [])]


def test_adaptive_split_duplicates_hot_keys():
    import pandas as pd

    rates = pd.DataFrame({"k": range(100), "rate": [1.0] * 99 + [101.0]})
    out = ranges.construct_ranges(rates, 10)
    hot = out[out.lower == 99].iloc[0]
    assert hot.upper == 99 and hot.duplicates == 6
    assert out.rate.sum() == rates.rate.sum() and (out.upper >= out.lower).all()
    assert ranges.construct_ranges(rates.head(0), 4).empty


def test_adaptive_split_takes_every_key(spark):
    """More keys than the 10,000 of the former sample, and hot keys, against the walk over all of them."""
    import pandas as pd

    rng = random.Random(12)
    rates = pd.DataFrame({"k": [3 * k for k in range(12_000)], "rate": [40_000 if k in (5, 6, 9_000) else rng.randrange(1, 9) for k in range(12_000)]})
    for some, n in ((rates, 16), (rates, 3), (rates.iloc[:7], 16), (rates.iloc[:1], 4), (rates.iloc[:0], 4)):
        got = sorted(map(tuple, ranges.split_adaptive(spark.createDataFrame(some.values.tolist(), "k bigint, rate bigint"), n).collect()))
        assert got == [tuple(r) for r in ranges.construct_ranges(some, n).values.tolist()]


def test_routing_of_many_ranges(spark):
    many = ranges.split_uniform(spark, 0, 10_000, 2000)
    got = ranges.route(spark.range(-5, 10_005).withColumnRenamed("id", "k"), "k", many)
    bad = got.where(~F.col("range_id").eqNullSafe(F.when((F.col("k") >= 0) & (F.col("k") < 10_000), F.floor(F.col("k") / 5).cast("int"))))
    assert got.count() == 10_010 and bad.collect() == []


def test_bytewise_order(spark):
    keys = [b"", b"\x00", b"\x7f", b"\x80", b"a", b"ab", b"\xff"]
    assert [bytes(r.k) for r in spark.createDataFrame([(k,) for k in reversed(keys)], "k binary").orderBy("k").collect()] == sorted(keys)


def test_parity_restores_a_fragment(spark):
    from keelson.operators.placement import parity_of

    parts = [b"hello", b"wor", b"parity!!"]
    got = parity_of(spark.createDataFrame([(1, p) for p in parts], "s int, d binary"), ["s"], "d").orderBy("pos").collect()
    xor = bytes(r.parity for r in got)
    assert len(xor) == 8 and bytes(a ^ b ^ c for a, b, c in zip(xor, parts[1].ljust(8, b"\0"), parts[2], strict=True)).rstrip(b"\0") == parts[0]


def test_benchmark_phases(spark, tmp_path):
    from keelson.plans.db_bench import Bench

    b = Bench(spark, str(tmp_path / "s"), 2000)
    got = b.run(("fillseq", "readseq", "readrandom", "readmissing", "readhot", "seekrandom", "stats", "sstables", "compact", "deleteseq"))
    assert got["fillseq"][0] == 2000 and all(t > 0 for _, t in got.values())
    assert b.store.scan().count() == 0
    b.fill100k()
    assert b.store.scan().selectExpr("length(v) as n").first().n == 100_000


def test_manifest_checkpoints(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    for i in range(18):
        s._commit(s.version(), {"add": [{"number": i, "level": 0}], "remove": [i - 1] if i % 2 else [], "last_seq": i, "batch": ["b", i]})
    assert any(f.name.endswith(".fold") for f in (tmp_path / "s/manifest").iterdir())
    for f in (tmp_path / "s/manifest").iterdir():
        if f.name.startswith("00000000000") and f.name.endswith(".json") and int(f.name[:12]) < 16:
            f.unlink()  # what the fold holds is not read again
    v = s.version()
    assert (v.number, v.last_seq, v.batches, sorted(v.files)) == (19, 17, {"b": 17}, [1, 3, 5, 7, 9, 11, 13, 15, 17]) and s.version(17).last_seq == 15


def test_lone_files_move(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, ("a", "1"), ("b", "2"), ("c", "3")).coalesce(1))
    before = [f["path"] for f in s.version().files.values()]
    if len(before) == 1:
        assert s.compact(rewrite=False) == 1 and [(f["path"], f["level"]) for f in s.version().files.values()] == [(before[0], 1)]
    assert s.get("b") == "2"


def test_outputs_are_cut(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, *((f"k{i:02d}", str(i)) for i in range(40))))
    s.write(rows(spark, *((f"k{i:02d}", "new") for i in range(10))))
    s.compact(cuts=["k07", "k20"], partitions=2)
    spans = [(f["smallest"], f["largest"]) for f in s.version().files.values()]
    assert all(not lo < c <= hi for lo, hi in spans for c in ("k07", "k20")) and len(spans) >= 3
    assert s.get("k05") == "new" and s.get("k30") == "30" and s.scan().count() == 40 and s.vacuum() == 2 and s.scan().count() == 40


def test_cursor_goes_both_ways(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), TEXT)
    s.write(rows(spark, ("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")))
    snap = s.snapshot()
    s.write(rows(spark, ("b", None), ("f", "6")))
    c = s.cursor(batch=2)
    seen = []
    c.seek_to_first()
    while c.valid:
        seen.append((c.key, c.value))
        c.next()
    assert seen == [("a", "1"), ("c", "3"), ("d", "4"), ("e", "5"), ("f", "6")]
    c.seek("b")
    assert c.key == "c" and c.prev().key == "a" and not c.prev().valid
    assert c.seek_for_prev("cc").key == "c" and c.next().key == "d" and c.seek_to_last().key == "f"
    assert s.cursor(snap).seek("b").key == "b"


def test_migration_and_dump(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / n), TEXT) for n in "ab")
    a.write(rows(spark, ("a", "1"), ("m", "2"), ("z", "3")))
    a.write(rows(spark, ("m", "new"), ("n", None)))
    assert a.migrate(b, "b", "x") >= 1
    assert [(r.k, r.v) for r in b.scan().collect()] == [("m", "new")] and b.version().last_seq == 5
    assert sorted((r.k, r.seq) for n in b.version().files for r in b.dump(n).collect()) == [("m", 2), ("m", 4), ("n", 5)]


def test_put_numbers_rows_that_are_written_down(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), Options(value_type="double"))
    s.put(spark.range(1000).select((F.col("id") % 300).alias("k"), F.rand().alias("v")).repartition(7))
    log = s.log()
    assert log.count() == 1000 and log.select("seq").distinct().count() == 1000 and s.version().last_seq == 1000
    assert s.scan().count() == 300 and not any("staging" in str(p) and p.is_file() for p in (tmp_path / "s").rglob("*"))
