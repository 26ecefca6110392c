"""A versioned key-value store on Parquet files and an append-only manifest.

A commit writes its records as Parquet files of level 0, then one manifest entry
that names them.  The entry is a file that only one writer can create, which
makes commits atomic and conflicts visible; files without an entry are never
read.  Readers fold the manifest into a list of files, drop those whose key
bounds can't match, and reduce what is left to the newest versions.

The manifest has one small entry a commit, and its fold every few; both are read
on the driver and hold metadata alone.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import mvcc, ordered
from .schema import DELETION, VALUE, log_schema


#: So many manifest entries have one fold that spares reading them.
CHECKPOINT = 16


class StoreError(Exception):
    """The store can't do what was asked."""


class CommitConflict(StoreError):
    """Another writer committed first; read again and retry."""


@dataclass(frozen=True)
class Options:
    create_if_missing: bool = True
    error_if_exists: bool = False
    key_type: str = "bigint"
    value_type: str = "binary"
    #: Keys of a Bloom filter in each Parquet file, 0 for none.
    bloom_keys: int = 0
    compression: str = "snappy"
    #: Level 0 files from which compact() is due, and bytes that level 1 may hold.
    l0_trigger: int = 8
    level_bytes: int = 256 << 20
    #: Attempts of a commit that meets other writers.
    retries: int = 0


@dataclass
class Version:
    """What the manifest says after some commit."""

    number: int = 0
    last_seq: int = 0
    files: dict[int, dict] = field(default_factory=dict)
    next_file: int = 1
    batches: dict[str, int] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


class Snapshot:
    """A sequence number to read at; release it when done, so that compaction may drop what it sees."""

    def __init__(self, store: Store, seq: int):
        self.store, self.seq = store, seq

    def release(self) -> None:
        self.store._snapshots.discard(self)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class Store:
    """Open with Store(spark, path, options)."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self._snapshots: set[Snapshot] = set()
        self._staging: str | None = None
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        exists = self._fs.exists(self._Path(f"{self.path}/manifest"))
        if exists and self.options.error_if_exists:
            raise StoreError(f"{path} exists")
        if not exists:
            if not self.options.create_if_missing:
                raise StoreError(f"{path} does not exist")
            self._commit(Version(), {"meta": {"key_type": self.options.key_type, "value_type": self.options.value_type}, "add": [], "remove": [], "last_seq": 0})
        meta = self.version().meta
        self.schema = log_schema(T._parse_datatype_string(meta["key_type"]), T._parse_datatype_string(meta["value_type"]))

    # Manifest.

    def _read(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def version(self, number: int | None = None) -> Version:
        """The fold of all manifest entries, or of those up to a number: from the last checkpoint on."""
        names = {s.getPath().getName(): s.getPath() for s in self._fs.listStatus(self._Path(f"{self.path}/manifest"))}
        wanted = lambda ending: sorted((int(n.removesuffix(ending)), p) for n, p in names.items() if n.endswith(ending) and (number is None or int(n.removesuffix(ending)) <= number))
        out = Version()
        for n, p in wanted(".fold")[-1:]:
            kept = json.loads(self._read(p))
            out = Version(n, kept["last_seq"], {f["number"]: f for f in kept["files"]}, kept["next_file"], kept["batches"], kept["meta"])
        for n, p in wanted(".json"):
            if n <= out.number:
                continue
            edit = json.loads(self._read(p))
            for f in edit["remove"]:
                out.files.pop(f, None)
            for f in edit["add"]:
                out.files[f["number"]] = f
                out.next_file = max(out.next_file, f["number"] + 1)
            out.number, out.last_seq = n, max(out.last_seq, edit["last_seq"])
            out.meta |= edit.get("meta", {})
            if "batch" in edit:
                out.batches[edit["batch"][0]] = edit["batch"][1]
        return out

    def _put_file(self, name: str, content: dict) -> None:
        """Create a manifest file; an error if it is there."""
        stream = self._fs.create(self._Path(f"{self.path}/manifest/{name}"), False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()

    def _commit(self, base: Version, edit: dict) -> None:
        """Create entry `base.number` + 1; whoever comes second fails.  Each `CHECKPOINT` entries the fold is kept, too."""
        number = base.number + 1
        try:
            self._put_file(f"{number:012d}.json", edit | {"at": time.time()})
        except Exception as e:
            raise CommitConflict(f"version {number} is there already") from e
        if number % CHECKPOINT == 0:
            v = self.version(number)
            try:
                self._put_file(f"{number:012d}.fold", {"last_seq": v.last_seq, "next_file": v.next_file, "files": list(v.files.values()), "batches": v.batches, "meta": v.meta})
            except Exception:  # noqa: S110  another writer has kept it, or a later one will: the entries say it all
                pass

    def _write_files(self, rows: DataFrame, level: int, first: int, by: str | None = None) -> list[dict]:
        """Write sorted files, with `by` none for two of its values, and describe each: path, rows, bounds, bytes."""
        folder = f"{self.path}/data/L{level}/{uuid.uuid4().hex}"
        writer = rows.write.option("compression", self.options.compression)
        if self.options.bloom_keys:
            writer = writer.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.expected.ndv#k", str(self.options.bloom_keys))
        (writer.partitionBy(by) if by else writer).parquet(folder)
        back = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(folder)
        within = F.substring_index("_metadata.file_path", folder.rsplit("/", 1)[1] + "/", -1)
        per = back.groupBy(within.alias("name"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("seq").alias("s0"), F.max("seq").alias("s1"))
        plain = lambda v: v.hex() if isinstance(v, bytes | bytearray) else str(v) if not isinstance(v, int | str | float) else v
        return [{"number": first + i, "level": level, "path": f"{folder}/{r.name}", "size": r["size"], "rows": r.n, "smallest": plain(bytes(r.lo) if isinstance(r.lo, bytearray) else r.lo), "largest": plain(bytes(r.hi) if isinstance(r.hi, bytearray) else r.hi), "min_seq": r.s0, "max_seq": r.s1} for i, r in enumerate(sorted(per.collect(), key=lambda r: r.name))]

    # Writes.

    def write(self, batch: DataFrame, batch_id: tuple[str, int] | None = None) -> int:
        """Commit records (ord, k, op, v) at once, numbered in the order of `ord` (whole numbers, unique).  Returns the last sequence number.

        With `batch_id` (stream, number) a batch that was committed before is skipped.
        """
        for attempt in range(self.options.retries + 1):
            base = self.version()
            if batch_id and base.batches.get(batch_id[0], -1) >= batch_id[1]:
                return base.last_seq
            rows = mvcc.sequenced(batch, base.last_seq + 1).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
            add = self._write_files(rows.repartitionByRange("k").sortWithinPartitions("k", F.desc("seq")), 0, base.next_file)
            last = max([base.last_seq, *(f["max_seq"] for f in add)])
            try:
                self._commit(base, {"add": add, "remove": [], "last_seq": last} | ({"batch": list(batch_id)} if batch_id else {}))
                return last
            except CommitConflict:
                if attempt == self.options.retries:
                    raise
        raise AssertionError

    def put(self, rows: DataFrame, order: str | None = None) -> int:
        """Put records (k, v); without `order` each key comes once, or any of its values wins."""
        try:
            return self.write(self._ordered(rows.withColumn("op", F.lit(VALUE)), order))
        finally:
            self._drop_staging()

    def delete(self, keys: DataFrame) -> int:
        """Write a deletion for each key (k); deleting a key that isn't there is no error."""
        try:
            return self.write(self._ordered(keys.select("k", F.lit(None).cast(self.schema["v"].dataType).alias("v"), F.lit(DELETION).alias("op")), None))
        finally:
            self._drop_staging()

    def _ordered(self, rows: DataFrame, order: str | None) -> DataFrame:
        """Rows with `ord`.  Without an order they are written down first: only then has each row a place that a lost executor does not change."""
        if order:
            return rows.withColumn("ord", F.col(order))
        self._staging = folder = f"{self.path}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._Path(folder)) if s.getPath().getName().endswith(".parquet"))
        at = self.spark.createDataFrame(list(enumerate(names)), "_file bigint, _name string")
        back = self.spark.read.schema(rows.schema).parquet(folder).select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_row"))
        return back.join(F.broadcast(at), "_name").withColumn("ord", F.shiftleft("_file", 40) + F.col("_row")).drop("_name", "_file", "_row")

    def _drop_staging(self) -> None:
        if self._staging:
            self._fs.delete(self._Path(self._staging), True)
            self._staging = None

    def flush(self) -> int:
        """Every commit is on files at once: nothing is outstanding."""
        return 0

    # Reads.

    def snapshot(self) -> Snapshot:
        out = Snapshot(self, self.version().last_seq)
        self._snapshots.add(out)
        return out

    def log(self, lower=None, upper=None, as_of: int | None = None, version: int | None = None) -> DataFrame:
        """All versions with keys in [lower, upper).  Files out of bounds are not opened."""
        files = [f for f in self.version(version).files.values() if (lower is None or self._bound(f["largest"]) >= lower) and (upper is None or self._bound(f["smallest"]) < upper)]
        if not files:
            return self.spark.createDataFrame([], self.schema)
        out = self.spark.read.schema(self.schema).parquet(*(f["path"] for f in files))
        if lower is not None:
            out = out.where(F.col("k") >= F.lit(lower))
        if upper is not None:
            out = out.where(F.col("k") < F.lit(upper))
        return mvcc.visible(out, as_of)

    def _bound(self, value):
        return bytes.fromhex(value) if isinstance(self.schema["k"].dataType, T.BinaryType) else value

    @staticmethod
    def _seq(snapshot: Snapshot | int | None) -> int | None:
        return snapshot.seq if isinstance(snapshot, Snapshot) else snapshot

    def get(self, key, snapshot: Snapshot | int | None = None):
        """The value, or None if the key isn't there (an empty value is a value)."""
        files = [f for f in self.version().files.values() if self._bound(f["smallest"]) <= key <= self._bound(f["largest"])]
        if not files:
            return None
        rows = self.spark.read.schema(self.schema).parquet(*(f["path"] for f in files)).where(F.col("k") == F.lit(key))
        hit = mvcc.current(rows, self._seq(snapshot)).first()
        return None if hit is None else bytes(hit.v) if isinstance(hit.v, bytearray) else hit.v

    def multi_get(self, keys: DataFrame, snapshot: Snapshot | int | None = None) -> DataFrame:
        return mvcc.multi_get(self.log(), keys, self._seq(snapshot))

    def scan(self, lower=None, upper=None, snapshot: Snapshot | int | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
        return mvcc.range_scan(self.log(lower, upper), None, None, self._seq(snapshot), reverse, limit)

    def seek(self, key, snapshot: Snapshot | int | None = None, reverse: bool = False):
        """The first live (k, v) at or after the key; with `reverse`, the last at or before it."""
        seq = self._seq(snapshot)
        rows = mvcc.current(self.log(None if reverse else key, None, seq))
        if reverse:
            rows = rows.where(F.col("k") <= F.lit(key))
        return rows.orderBy(F.desc("k") if reverse else "k").first()

    def first(self, snapshot=None):
        return self.scan(snapshot=snapshot, limit=1).first()

    def last(self, snapshot=None):
        return self.scan(snapshot=snapshot, reverse=True, limit=1).first()

    # Maintenance.

    def files(self, version: int | None = None) -> DataFrame:
        schema = "number bigint, level int, file_size bigint, lo string, hi string, rows bigint, min_seq bigint, max_seq bigint, path string"
        return self.spark.createDataFrame([(f["number"], f["level"], f["size"], str(f["smallest"]), str(f["largest"]), f["rows"], f["min_seq"], f["max_seq"], f["path"]) for f in self.version(version).files.values()], schema)

    def compaction_due(self) -> bool:
        files = self.version().files.values()
        return sum(f["level"] == 0 for f in files) >= self.options.l0_trigger or sum(f["size"] for f in files if f["level"] == 1) > self.options.level_bytes

    def retained(self) -> int:
        """The oldest sequence number that a snapshot may read."""
        return min([s.seq for s in self._snapshots], default=self.version().last_seq)

    def compact(self, lower=None, upper=None, into: int = 1, partitions: int | None = None, retain_seq: int | None = None, rewrite: bool = True, cuts: list | None = None) -> int:
        """Merge the files that meet [lower, upper] and all they meet, up to level `into`, into sorted files there.

        Versions that no snapshot reads go; so do deletions, where no deeper level
        has files that meet.  Without `rewrite`, a file that meets no other moves as
        it is, with all its versions.  No output file crosses any key of `cuts`.
        Returns the number of files it wrote or moved.
        """
        base = self.version()
        files = [f for f in base.files.values() if f["level"] <= into]
        bounds = lambda f: (self._bound(f["smallest"]), self._bound(f["largest"]))
        chosen = [f for f in files if (lower is None or bounds(f)[1] >= lower) and (upper is None or bounds(f)[0] <= upper)]
        if not chosen:
            return 0
        while True:  # all that meets what is chosen
            lo, hi = min(bounds(f)[0] for f in chosen), max(bounds(f)[1] for f in chosen)
            more = [f for f in files if f not in chosen and bounds(f)[1] >= lo and bounds(f)[0] <= hi]
            if not more:
                break
            chosen += more
        if len(chosen) == 1 and chosen[0]["level"] < into and (not rewrite or chosen[0]["min_seq"] == chosen[0]["max_seq"]) and not any(bounds(chosen[0])[0] < c <= bounds(chosen[0])[1] for c in cuts or ()):
            self._commit(base, {"add": [chosen[0] | {"level": into}], "remove": [chosen[0]["number"]], "last_seq": base.last_seq})
            return 1
        deeper = any(f["level"] > into and bounds(f)[1] >= lo and bounds(f)[0] <= hi for f in base.files.values())
        retain = self.retained() if retain_seq is None else retain_seq
        rows = self.spark.read.schema(self.schema).parquet(*(f["path"] for f in chosen))
        kept = mvcc.survivors(rows, retain) if deeper else mvcc.base_survivors(rows, retain)
        kept = kept.repartitionByRange(partitions, "k") if partitions else kept.repartitionByRange("k")
        if cuts:
            kept = kept.withColumn("cut", ordered.search(F.col("k"), sorted(cuts)))
        add = self._write_files(kept.sortWithinPartitions("k", F.desc("seq")), into, base.next_file, by="cut" if cuts else None)
        self._commit(base, {"add": add, "remove": [f["number"] for f in chosen], "last_seq": base.last_seq})
        return len(add)

    def property(self, name: str) -> str | None:
        """num-files-at-level<N>, sstables, stats, approximate-memory-usage; None for another."""
        files = list(self.version().files.values())
        if name.startswith("num-files-at-level") and name[18:].isdigit():
            return str(sum(f["level"] == int(name[18:]) for f in files))
        if name == "sstables":
            return "\n".join(f"{f['number']}:{f['size']}[{f['smallest']} .. {f['largest']}] L{f['level']}" for f in sorted(files, key=lambda f: (f["level"], f["number"])))
        if name == "stats":
            return json.dumps({str(n): {"files": sum(f["level"] == n for f in files), "bytes": sum(f["size"] for f in files if f["level"] == n)} for n in sorted({f["level"] for f in files})})
        if name == "approximate-memory-usage":
            return str(len(json.dumps(files)))
        return None

    def approximate_sizes(self, wanted: list[tuple]) -> list[int]:
        """Per (lower, upper): bytes of the files that end before upper, less those that end before lower."""
        files = self.version().files.values()
        before = lambda k: sum(f["size"] for f in files if self._bound(f["largest"]) < k)
        return [max(0, before(b) - before(a)) for a, b in wanted]

    def verify(self) -> DataFrame:
        """Faults: rows out of (k, seq descending) order in a file, and sequence numbers used twice.  No row: all is well."""
        rows = self.log().select("k", "seq", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i")) if self.version().files else None
        if rows is None:
            return self.spark.createDataFrame([], "fault string, file string, seq bigint")
        near = ordered.adjacent(rows, "i", ["k", "seq"], by=["file"])
        wrong = near.where((F.col("next.k") < F.col("k")) | ((F.col("next.k") == F.col("k")) & (F.col("next.seq") > F.col("seq"))))
        twice = rows.groupBy("seq").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n > 1")
        return wrong.select(F.lit("order").alias("fault"), "file", "seq").unionByName(twice.select(F.lit("sequence number twice").alias("fault"), "file", "seq"))

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete data folders that the last `keep_versions` versions do not name; returns how many."""
        last = self.version().number
        live = {f["path"].split("/data/")[1].split("/")[1] for n in range(max(1, last - keep_versions + 1), last + 1) for f in self.version(n).files.values()}
        gone, root = 0, self._Path(f"{self.path}/data")
        if self._fs.exists(root):
            for level in self._fs.listStatus(root):
                for folder in self._fs.listStatus(level.getPath()):
                    if folder.getPath().getName() not in live:
                        self._fs.delete(folder.getPath(), True)
                        gone += 1
        return gone

    def dump(self, number: int) -> DataFrame:
        """All versions in one file, in order."""
        return self.spark.read.schema(self.schema).parquet(self.version().files[number]["path"]).orderBy("k", F.desc("seq"))

    def migrate(self, target: Store, lower=None, upper=None) -> int:
        """Copy all versions of keys in [lower, upper) into `target`, with their sequence numbers, in one commit; returns the number of files.

        Routing decides which of the two is asked: hand the range over there once this returns.
        """
        rows, base = self.log(lower, upper), target.version()
        add = target._write_files(rows.repartitionByRange("k").sortWithinPartitions("k", F.desc("seq")), 0, base.next_file)
        target._commit(base, {"add": add, "remove": [], "last_seq": max([base.last_seq, *(f["max_seq"] for f in add)])})
        return len(add)

    def cursor(self, snapshot: Snapshot | int | None = None, batch: int = 1000) -> Cursor:
        return Cursor(self, snapshot if snapshot is not None else self.version().last_seq, batch)

    def repair(self) -> int:
        """Rebuild the manifest from the data files there are, as one version; returns the number of files.

        Files of a commit that never reached the manifest come back, too.
        """
        root, paths = self._Path(f"{self.path}/data"), []
        if self._fs.exists(root):
            found = self._fs.listFiles(root, True)
            while found.hasNext():
                p = found.next().getPath().toString()
                if p.endswith(".parquet"):
                    paths.append(p)
        base = self.version()
        known = {f["path"].split("/data/")[1] for f in base.files.values()}
        lost = [p for p in paths if p.split("/data/")[1] not in known]
        add = []
        for i, p in enumerate(sorted(lost)):
            r = self.spark.read.schema(self.schema).parquet(p).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("seq").alias("s0"), F.max("seq").alias("s1")).first()
            if r.n:
                lo, hi = (x.hex() if isinstance(x, bytes | bytearray) else x for x in (r.lo, r.hi))
                add.append({"number": base.next_file + i, "level": 0, "path": p, "size": self._fs.getFileStatus(self._Path(p)).getLen(), "rows": r.n, "smallest": lo, "largest": hi, "min_seq": r.s0, "max_seq": r.s1})
        self._commit(base, {"add": add, "remove": [], "last_seq": max([base.last_seq, *(f["max_seq"] for f in add)])})
        return len(base.files) + len(add)

    def destroy(self) -> None:
        """Delete the store; the manifest goes last."""
        for part in ("data", "manifest", ""):
            self._fs.delete(self._Path(f"{self.path}/{part}"), True)


class Cursor:
    """Goes over the live keys of one snapshot, forward and back; rows come in batches of bounded size."""

    def __init__(self, store: Store, snapshot: Snapshot | int, batch: int):
        self.store, self.seq, self.batch = store, store._seq(snapshot), batch
        self.rows: list = []
        self.at, self.forward = 0, True

    def _fetch(self, key, forward: bool, inclusive: bool) -> None:
        live = mvcc.current(self.store.log(key if forward and key is not None else None, None, self.seq))
        if key is not None:
            k, here = F.col("k"), F.lit(key)
            live = live.where((k >= here if inclusive else k > here) if forward else (k <= here if inclusive else k < here))
        self.rows = live.orderBy("k" if forward else F.desc("k")).limit(self.batch).collect()
        self.at, self.forward = 0, forward

    @property
    def valid(self) -> bool:
        return self.at < len(self.rows)

    @property
    def key(self):
        return self._plain(self.rows[self.at].k)

    @property
    def value(self):
        return self._plain(self.rows[self.at].v)

    @staticmethod
    def _plain(x):
        return bytes(x) if isinstance(x, bytearray) else x

    def seek(self, key) -> Cursor:
        """To the first key at or after this one."""
        self._fetch(key, True, True)
        return self

    def seek_for_prev(self, key) -> Cursor:
        """To the last key at or before this one."""
        self._fetch(key, False, True)
        return self

    def seek_to_first(self) -> Cursor:
        self._fetch(None, True, True)
        return self

    def seek_to_last(self) -> Cursor:
        self._fetch(None, False, True)
        return self

    def _step(self, forward: bool) -> Cursor:
        here = self.key
        if forward == self.forward and self.at + 1 < len(self.rows):
            self.at += 1
        else:
            self._fetch(here, forward, False)
        return self

    def next(self) -> Cursor:
        return self._step(True)

    def prev(self) -> Cursor:
        return self._step(False)
