"""Hashes, filters, codecs, names and batches against fixed values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import bloom, hashes, text
from keelson.sources.batch import Corruption, WriteBatch
from keelson.sources.config import read_config


def test_crc32c_fixed_values():
    values = [bytes(32), b"\xff" * 32, bytes(range(32)), bytes(range(31, -1, -1))]
    want = [0x8A9136AA, 0x62A8AB43, 0x46DD794E, 0x113FDB5C]
    assert [hashes.crc32c_bytes(v) for v in values] == want
    assert hashes.crc32c_many([*values, b"", b"a"]).tolist() == [*want, 0, hashes.crc32c_bytes(b"a")]
    assert hashes.crc32c_bytes(b"world", hashes.crc32c_bytes(b"hello ")) == hashes.crc32c_bytes(b"hello world")


def test_masked_crc():
    crc = hashes.crc32c_bytes(b"foo")
    assert hashes.mask_crc(crc) != crc and hashes.unmask_crc(hashes.mask_crc(crc)) == crc
    assert hashes.unmask_crc(hashes.unmask_crc(hashes.mask_crc(hashes.mask_crc(crc)))) == crc


def test_hash_fixed_values():
    # The 32-bit hash of these bytes.
    assert hashes.murmur_like(b"", 0xBC9F1D34) == 0xBC9F1D34
    assert hashes.murmur_like(b"\x62", 0xBC9F1D34) == 0xEF1345C4
    assert hashes.murmur_like(b"\xc3\x97", 0xBC9F1D34) == 0x5B663814
    assert hashes.murmur_like(b"\xe2\x99\xa5", 0xBC9F1D34) == 0x323C078F
    assert hashes.murmur_like(b"\xe1\x80\xb9\x32", 0xBC9F1D34) == 0xED21633A


def test_fnv_matches_plain_arithmetic(spark):
    def plain(v):
        h = hashes.FNV_BASIS
        for _ in range(8):
            h = ((h ^ (v & 0xFF)) * hashes.FNV_PRIME) % (1 << 64)
            v >>= 8
        return h

    values = [0, 1, 255, 256, 12345678901234, (1 << 62) + 7]
    assert hashes.fnv64_many(np.array(values)).tolist() == [plain(v) for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "k bigint").select("k", hashes.fnv64(F.col("k"), 1000).alias("m")).collect()
    assert all(r.m == plain(r.k) % 1000 for r in rows)


def test_crc_column_handles_null(spark):
    rows = spark.createDataFrame([(1, b"a"), (2, None), (3, b"")], "i int, b binary").select("i", hashes.crc32c(F.col("b")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {1: hashes.crc32c_bytes(b"a"), 2: None, 3: 0}


def test_bloom_small():
    b = bloom.Bloom(10)
    f = b.create([b"hello", b"world"])
    assert b.may_match(b"hello", f) and b.may_match(b"world", f)
    assert not b.may_match(b"x", f) and not b.may_match(b"foo", f)
    assert not b.may_match(b"hello", b"") and not b.may_match(b"hello", b.create([]))


@pytest.mark.parametrize("n", [1, 10, 100, 1000, 10_000])
def test_bloom_rates(n):
    b, keys = bloom.Bloom(10), [i.to_bytes(4, "little") for i in range(n)]
    f = b.create(keys)
    assert len(f) <= n * 10 / 8 + 40
    assert all(b.may_match(k, f) for k in keys)
    assert sum(b.may_match((i + 1_000_000_000).to_bytes(4, "little"), f) for i in range(10_000)) <= 200


def test_filter_block():
    block = bloom.FilterBlock({0: [b"foo"], 2000: [b"bar"], 3100: [b"box"], 9000: [b"box", b"hello"]})
    assert block.may_match(0, b"foo") and block.may_match(2000, b"bar") and block.may_match(3100, b"box") and block.may_match(9000, b"hello")
    assert not block.may_match(0, b"box") and not block.may_match(3100, b"foo") and not block.may_match(4100, b"foo") and not block.may_match(9000, b"foo")
    assert block.may_match(100_000, b"foo")


def test_separators():
    assert text.shortest_separator(b"foo", b"hello") == b"g"
    assert text.shortest_separator(b"foo", b"foobar") == b"foo" and text.shortest_separator(b"foobar", b"foo") == b"foobar"
    assert text.short_successor(b"foo") == b"g" and text.short_successor(b"\xff\xff") == b"\xff\xff"


def test_codecs():
    rng = random.Random(1)
    for bits in (0, 1, 7, 8, 14, 31, 32, 63):
        v = (1 << bits) - rng.randrange(2)
        assert text.get_varint(text.put_varint(v) + b"x") == (v, b"x")
        assert text.get_fixed(text.put_fixed(v, 64), 64) == (v, b"")
    for cut in range(3):
        with pytest.raises(ValueError):
            text.get_varint(text.put_varint(1 << 20)[:cut])
    assert text.get_string(text.put_string(b"") + text.put_string(b"foo")) == (b"", text.put_string(b"foo"))
    assert text.escaped(b"a\x00\xff") == "a\\x00\\xff"
    assert text.consume_decimal("18446744073709551615abc") == ((1 << 64) - 1, "abc")
    assert text.consume_decimal("18446744073709551616") is None and text.consume_decimal("abc") is None


def test_file_names():
    good = {"100.log": ("log", 100), "0.ldb": ("table", 0), "0.sst": ("table", 0), "CURRENT": ("current", 0), "LOCK": ("lock", 0), "MANIFEST-2": ("descriptor", 2), "LOG": ("info", 0), "LOG.old": ("info", 0), "18446744073709551615.log": ("log", (1 << 64) - 1)}
    assert {n: text.parse_file_name(n) for n in good} == good
    for bad in ("", "foo", "foo-dx-100.log", ".log", "manifest", "CURREN", "MANIFEST", "MANIFEST-", "XMANIFEST-3", "18446744073709551616.log", "100", "100."):
        assert text.parse_file_name(bad) is None, bad
    for kind, number in (("log", 192), ("table", 200), ("descriptor", 100), ("temp", 999), ("current", 0), ("lock", 0)):
        assert text.parse_file_name(text.file_name("db", number, kind).split("/")[1]) == (kind, number)


def test_write_batch_order_and_append():
    b = WriteBatch().put(b"foo", b"bar").delete(b"box").put(b"baz", b"boo")
    assert b.sequenced(100) == [(100, 1, b"foo", b"bar"), (101, 0, b"box", None), (102, 1, b"baz", b"boo")]
    base, back = WriteBatch.decode(b.encode(100))
    assert base == 100 and back.records == b.records
    one = WriteBatch().put(b"a", b"va")
    one.append(WriteBatch().put(b"b", b"vb")).append(WriteBatch().put(b"b", b"vb2").delete(b"foo"))
    assert [r[0] for r in one.sequenced(200)] == [200, 201, 202, 203]
    small = one.approximate_size()
    assert one.put(b"key", b"value").approximate_size() > small
    one.clear()
    assert one.records == []


def test_truncated_batch_keeps_first_records():
    with pytest.raises(Corruption) as e:
        WriteBatch.decode(WriteBatch().put(b"foo", b"bar").delete(b"box").encode(200)[:-1])
    assert e.value.records == [(200, 1, b"foo", b"bar")]


def test_config(spark, tmp_path):
    path = tmp_path / "config"
    path.write_text("config-0\n0\n1\n0\n0,10000000,0,0\nconfig-1\n0,1\n2,3\n60\n0,5,0,0,1,2\n5,10,1,0\n")
    rows = sorted(read_config(spark, str(path)).collect(), key=lambda r: (r.cfg_id, r.key_start))
    assert [(r.cfg_id, r.key_start, r.key_end, r.server_id, r.dbid, r.log_replicas) for r in rows] == [(0, 0, 10_000_000, 0, 0, []), (1, 0, 5, 0, 0, [1, 2]), (1, 5, 10, 1, 0, [])]
    assert rows[0].ltc_ids == [0] and rows[0].stoc_ids == [1] and rows[1].ltc_ids == [0, 1] and rows[1].start_time == 60
    path.write_text("0,100000,0,0,0\n")
    with pytest.raises(ValueError):
        read_config(spark, str(path))


def test_public_hashes():
    from keelson.functions import hashes

    assert [hashes.murmur3(x) for x in (b"", b"hello", b"hello, world")] == [0, 0x248BFA47, 0x149BBB7F]
    assert hashes.murmur3(b"", 1) == 0x514E28B7
    assert [hashes.one_at_a_time(x) for x in (b"", b"a", b"The quick brown fox jumps over the lazy dog")] == [0, 0xCA2E9442, 0x519E91F5]


def test_text_hash_and_fields(spark):
    from pyspark.sql import functions as F

    from keelson.functions import hashes, text

    df = spark.createDataFrame([("hello",), (None,), ("hello",)], "s string")
    assert [r.h for r in df.select(hashes.text_hash(F.col("s")).alias("h")).collect()] == [0x248BFA47, None, 0x248BFA47]
    got = spark.sql("SELECT explode(array('1,2,3', '4,', '', 'a.b')) AS s").select(text.split_fields(F.col("s"), ",").alias("x")).collect()
    assert [r.x for r in got] == [["1", "2", "3"], ["4"], [], ["a.b"]]
    assert spark.sql("SELECT '1.2.3' AS s").select(text.split_ints(F.col("s"), ".").alias("x")).first().x == [1, 2, 3]


def test_log_files(spark, tmp_path):
    import random

    from keelson.sources import logfile

    rng = random.Random(1)
    records = [rng.randbytes(rng.choice([0, 1, 5, 100, 32754, 32761, 32768, 100_000])) for _ in range(60)]
    data = logfile.write_log(records)
    assert [r for r, _ in logfile.read_log(data)] == records
    assert [r for r, _ in logfile.read_log(data[:-1])] == records[:-1]  # the writer died in the last one
    spoiled = bytearray(logfile.write_log([b"x" * 20_000] * 8))
    spoiled[100] ^= 1
    got = list(logfile.read_log(bytes(spoiled)))
    assert [f for _, f in got if f] == ["checksum", "record without beginning"] and [r for r, _ in got if r] == [b"x" * 20_000] * 6
    for name, rs in (("a.log", records[:30]), ("b.log", records[30:])):
        (tmp_path / name).write_bytes(logfile.write_log(rs))
    rows = sorted(logfile.read_logs(spark, str(tmp_path)).collect(), key=lambda r: (r.path, r.pos))
    assert [bytes(r.record) for r in rows] == records and not any(r.fault for r in rows)
