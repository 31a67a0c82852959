"""Incremental, reversible line deduplication.

A ``LineIndex`` is a list of segments, one for each change, that are written once and never rewritten. A segment has

* ``refs``: the exact references, one row per line key and document that holds it;
* ``fresh``: the exact reference counts (documents, smallest id) of keys that no earlier segment holds, in a folder a shard;
* ``more``: what the segment adds to the counts of keys that earlier ones hold;
* ``filters``: a cuckoo filter for each shard of ``fresh``, one fingerprint per key;
* after a deletion, ``gone`` (the documents) and ``reset`` (new counts of the keys that they held).

A segment has as many shards as its keys need (``SHARD_KEYS`` each). ``insert`` counts a batch's keys (distinct references
first, then per key, both with a map-side combine, so a line that a third of the rows hold arrives as one row per task)
and asks the segments' filters for them. Keys in no filter are new for sure: no exact table is read for them. For the others
the exact counts decide, of which only the shards that a filter named are read. So a batch costs exchanges of its own size and
a scan of the filters (two to four bytes a key); exact tables are appended to. ``lost`` has the lines that the batch took
from documents, its own and earlier ones. ``delete`` recounts the keys that the documents hold and takes the fingerprints of those that no
document holds any more out of the filters. ``compact`` makes one segment of all; it comes by itself after ``MOST_SEGMENTS``.

``drops`` says the same as all ``lost`` tables together, from the exact tables alone, and is right after deletions too:
all but the smallest id lose a line that two documents or more hold. ``remove_lines`` takes lines out of the texts.

Defined results: null or empty texts are one empty line. Rows that repeat an id are one
document: a line of theirs alone is no repetition. Rows with a null id are not
indexed and keep all lines. Keys shorter than ``MIN_POINTS`` code points are never dropped.
An empty table gives an empty result; other columns of the input stay as they are.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Workspace, empty_table, frugal, load, small_table
from .packing import few

MIN_POINTS = 10
#: Keys of a shard on average; a shard's filter is held in memory.
SHARD_KEYS = 1 << 20
#: Segments from which a change is followed by compact().
MOST_SEGMENTS = 16
#: Batches in which line_dedup inserts a corpus.
INCREMENTS = 2
SLOTS, MAX_LOAD, MAX_KICKS = 4, 0.85, 500
KEY = ["k1", "k2"]


def line_key(line: str) -> bytes | None:
    """16 bytes that stand for the line's key; None for short keys."""
    key = line.strip(SPACES)
    if len(key) < MIN_POINTS:
        return None
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; what finds no place after many kicks is kept aside."""

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * MAX_LOAD < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.stored, self.aside = 0, []

    @property
    def room(self) -> float:
        return len(self.table) * SLOTS * MAX_LOAD - self.stored

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        prints = np.maximum(keys >> np.uint64(48), np.uint64(1))
        mask = np.uint64(len(self.table) - 1)
        first = keys & mask
        return first.astype(np.int64), (first ^ (self._spread(prints) & mask)).astype(np.int64), prints.astype(np.uint16)

    @staticmethod
    def _spread(prints):
        with np.errstate(over="ignore"):
            return (prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        a, b, p = self._places(keys)
        out = (self.table[a] == p[:, None]).any(1) | (self.table[b] == p[:, None]).any(1)
        for bucket, fp in self.aside:
            out |= (p == fp) & ((a == bucket) | (b == bucket))
        return out

    def insert(self, keys: np.ndarray) -> None:
        """Keys that are not in yet, each once."""
        a, b, p = self._places(keys)
        self.stored += len(p)
        rest = np.arange(len(p))
        for place in (a, b):
            rest = rest[np.argsort(place[rest], kind="stable")]
            at = place[rest]
            used = (self.table[at] != 0).sum(1)
            slot = used + np.arange(len(at)) - np.searchsorted(at, at)
            fits = slot < SLOTS
            self.table[at[fits], slot[fits]] = p[rest[fits]]
            rest = rest[~fits]
        for i in rest.tolist():
            self._kick(int(b[i]), int(p[i]))

    def _kick(self, bucket: int, fp: int) -> None:
        mask = len(self.table) - 1
        for turn in range(MAX_KICKS):
            row = self.table[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fp
                return
            slot = turn % SLOTS
            fp, row[slot] = int(row[slot]), fp
            bucket ^= int(self._spread(np.uint64(fp))) & mask
        self.aside.append((bucket, fp))

    def delete(self, keys: np.ndarray) -> None:
        """Keys that are in; another key's equal fingerprint in the same buckets stays."""
        for a, b, p in zip(*(x.tolist() for x in self._places(keys))):
            for bucket in (a, b):
                row = self.table[bucket]
                hit = np.flatnonzero(row == p)
                if len(hit):
                    last = np.flatnonzero(row)[-1]
                    row[hit[0]], row[last] = row[last], 0
                    self.stored -= 1
                    break
                if (bucket, p) in self.aside:
                    self.aside.remove((bucket, p))
                    self.stored -= 1
                    break

    def to_bytes(self) -> bytes:
        aside = b"".join(struct.pack("<qH", *x) for x in self.aside)
        return struct.pack("<qqq", len(self.table), self.stored, len(self.aside)) + self.table.tobytes() + aside

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        buckets, stored, aside = struct.unpack_from("<qqq", blob)
        out = cls(0)
        out.table = np.frombuffer(blob, np.uint16, buckets * SLOTS, 24).reshape(buckets, SLOTS).copy()
        out.stored = stored
        out.aside = [struct.unpack_from("<qH", blob, 24 + out.table.nbytes + 10 * i) for i in range(aside)]
        return out


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (k1, k2, doc): which document holds which line key."""

    def kernel(batches):
        for b in few(batches):
            keys, ids = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {k for k in map(line_key, (text or "").split("\n")) if k}
                keys += found
                ids += [doc] * len(found)
            k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.record_batch([pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(ids, pa.int64())], names=["k1", "k2", "doc"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(kernel), REFS).distinct()


REFS = "k1 long, k2 long, doc long"
COUNTS = "k1 long, k2 long, docs long, owner long"
FILTERS = "shard long, blob binary"


def build_kernel(batches):
    """(shard, k1), sorted by shard, to one filter per shard."""
    shard, held = None, []

    def last():
        keys = np.concatenate(held).view(np.uint64)
        made = CuckooFilter(len(keys))
        made.insert(keys)
        return pa.record_batch([pa.array([shard], pa.int64()), pa.array([made.to_bytes()], pa.binary())], names=["shard", "blob"])

    for b in batches:
        if not b.num_rows:
            continue
        shards, keys = (np.asarray(b.column(i)) for i in (0, 1))
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for at, to in zip(cuts, cuts[1:]):
            if shards[at] != shard:
                if held:
                    yield last()
                shard, held = int(shards[at]), []
            held.append(keys[at:to])
    if held:
        yield last()


def asked_kernel(batches):
    """(segment, shard, blob, keys) to the keys that the filter may hold."""
    for b in few(batches, 1):
        keys = b.column(3)[0].values
        k1, k2 = (keys.field(i).to_numpy() for i in (0, 1))
        hit = CuckooFilter.from_bytes(b.column(2)[0].as_py()).contains(k1.view(np.uint64))
        n = int(hit.sum())
        columns = [pa.array(np.full(n, b.column(i)[0].as_py())) for i in (0, 1)]
        yield pa.record_batch([*columns, pa.array(k1[hit]), pa.array(k2[hit])], names=["segment", "shard", *KEY])


def removing_kernel(batches):
    """(shard, blob, keys) to the filters without these keys; null keys take nothing."""
    for b in few(batches, 1):
        blob = b.column(1)[0].as_py()
        if b.column(2)[0].is_valid:
            held = CuckooFilter.from_bytes(blob)
            held.delete(b.column(2)[0].values.to_numpy().view(np.uint64))
            blob = held.to_bytes()
        yield pa.record_batch([b.column(0), pa.array([blob], pa.binary())], names=["shard", "blob"])


class LineIndex:
    """See the module's text. Each change makes a new version; older ones stay readable until ``compact``.

    A version is a list of segments, each {"at": its number, "shards": of fresh and filters (0: none),
    "filters": the number under which its filters are, "gone": whether it is a deletion}. ``open`` finds them again.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, shard_keys: int = SHARD_KEYS, segments: list[dict] | None = None, version: int = 0, changed: int = 0):
        self.spark, self.shard_keys, self.segments, self.version = spark, shard_keys, segments or [], version
        self.changed = changed or version  # the version that the last change made; compact() makes another
        self.root = root or Workspace(spark).path("lines")

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int, shard_keys: int = SHARD_KEYS) -> LineIndex:
        segments = json.loads(spark.read.text(f"{root}/{version}/segments").first()[0])
        return cls(spark, root, shard_keys, segments, version)

    # tables

    def _read(self, at: int, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{at}/{name}")

    def _all(self, name: str, schema: str, segments: list[dict]) -> DataFrame:
        """A table of several segments, with the number of each row's."""
        parts = [self._read(s["at"], name, schema).withColumn("at", F.lit(s["at"]).cast("long")) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else empty_table(self.spark, f"{schema}, at long")

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        where, writer = f"{self.root}/{self.next}/{name}", df.write
        (writer.partitionBy(by) if by else writer).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    @property
    def inserted(self) -> list[dict]:
        return [s for s in self.segments if not s["gone"]]

    @property
    def deleted(self) -> list[dict]:
        return [s for s in self.segments if s["gone"]]

    @property
    def refs(self) -> DataFrame:
        """All references (k1, k2, doc) of documents that are not deleted since."""
        rows = self._all("refs", REFS, self.inserted)
        if self.deleted:
            gone = self._all("gone", "doc long", self.deleted).groupBy("doc").agg(F.max("at").alias("until"))
            rows = rows.join(gone, "doc", "left").filter("until is null or until < at")
        return rows.select(*KEY, "doc")

    def state(self, keys: DataFrame | None = None, shards: dict[int, list[int]] | None = None) -> DataFrame:
        """(k1, k2, docs, owner, at): current counts of all keys, or of these, at the segment that last held them as fresh.

        shards names, for each segment, the shards of fresh to read.
        """
        parts = []
        for s in self.inserted:
            for name in ("fresh", "more"):
                rows = self._read(s["at"], name, COUNTS + (", shard long" if name == "fresh" else ""))
                if name == "fresh" and shards is not None:
                    rows = rows.filter(F.col("shard").isin(shards.get(s["at"], [])))
                parts.append(rows.select(*KEY, "docs", "owner", F.lit(s["at"]).alias("at"), F.lit(name).alias("kind")))
        parts += [self._read(s["at"], "reset", COUNTS).select(*KEY, "docs", "owner", F.lit(s["at"]).alias("at"), F.lit("reset").alias("kind")) for s in self.deleted]
        if not parts:
            return empty_table(self.spark, COUNTS + ", at int")
        rows = reduce(DataFrame.unionByName, parts)
        if keys is not None:
            rows = rows.join(keys, KEY, "left_semi")
        fresh = F.max(F.when(F.col("kind") == "fresh", F.col("at"))).alias("at")
        if not self.deleted:
            return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.min("owner").alias("owner"), fresh)
        # a key has a row or two a segment; those before its last reset count no more
        rows = rows.groupBy(*KEY).agg(F.collect_list(F.struct("at", "kind", "docs", "owner")).alias("rows"), F.max(F.when(F.col("kind") == "reset", F.col("at"))).alias("since"), fresh)
        rows = rows.withColumn("rows", F.filter("rows", lambda r: r["at"] >= F.coalesce("since", F.lit(0))))
        docs = F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["docs"])
        rows = rows.select(*KEY, docs.alias("docs"), F.array_min(F.transform("rows", lambda r: r["owner"])).alias("owner"), "at")
        return rows.filter("docs > 0")

    def filters(self, segment: dict) -> DataFrame:
        return self._read(segment["filters"], f"filters-{segment['at']}", FILTERS)

    # changes

    def _begin(self) -> None:
        """Number the version that a change makes: above all there are, since several may follow one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = [int(f.getPath().getName()) for f in files.listStatus(path)] if files.exists(path) else []
        self.next = max(there, default=0) + 1
        files.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.next}"))

    def _next(self, segments: list[dict]) -> LineIndex:
        out = LineIndex(self.spark, self.root, self.shard_keys, segments, self.next)
        small_table(self.spark, [(json.dumps(segments),)], "value string").write.text(f"{self.root}/{out.version}/segments")
        if len(segments) < MOST_SEGMENTS:
            return out
        small = out.compact()
        return LineIndex(self.spark, self.root, self.shard_keys, small.segments, small.version, out.version)

    def _segment(self, fresh: DataFrame) -> dict:
        """Write fresh counts and their filters."""
        shards, n = 1, fresh.count()
        while shards * self.shard_keys < n:
            shards *= 2
        sharded = fresh.withColumn("shard", F.col("k2").bitwiseAND(F.lit(shards - 1)))
        self._write(sharded.repartition("shard").select(*KEY, "docs", "owner", "shard"), "fresh", "shard")
        rows = sharded.select("shard", "k1").repartition("shard").sortWithinPartitions("shard")
        at = self.next
        self._write(rows.mapInArrow(build_kernel, FILTERS), f"filters-{at}")
        return {"at": at, "shards": shards, "filters": at, "gone": False}

    def _maybe(self, added: DataFrame) -> DataFrame:
        """(segment, shard, k1, k2): keys that a segment's filter can't rule out."""
        n, asked = added.count(), []
        for s in self.inserted:
            pieces = -(-n // (s["shards"] * self.shard_keys))  # a batch far larger than the segment meets its filters in pieces
            shard, piece = F.col("k2").bitwiseAND(F.lit(s["shards"] - 1)), F.pmod("k1", F.lit(max(1, pieces)))
            keys = added.groupBy(shard.alias("shard"), piece.alias("piece")).agg(F.collect_list(F.struct(*KEY)).alias("keys"))
            asked.append(self.filters(s).join(keys, "shard").select(F.lit(s["at"]).cast("long").alias("segment"), "shard", "blob", "keys"))
        return reduce(DataFrame.unionByName, asked).mapInArrow(asked_kernel, "segment long, shard long, k1 long, k2 long")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The next version, with these documents; references that are there already change nothing."""
        self._begin()
        new = references(docs, id_col, text_col)
        if self.inserted:
            new = self._write(new, "refs-read")
            here = self._write(self._all("docs", "doc long", self.inserted).join(new.select("doc").distinct(), "doc", "left_semi").select("doc").distinct(), "docs-here")
            if not here.isEmpty():
                new = new.join(self.refs.join(here, "doc", "left_semi"), [*KEY, "doc"], "left_anti")
        new = self._write(new, "refs")
        self._write(new.select("doc").distinct(), "docs")
        added = self._write(new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("owner")), "added")
        if not self.inserted:
            segment = self._segment(added)
            self._write(empty_table(self.spark, COUNTS), "more")
            self._write(self._lost(new, added.select(*KEY, "docs", "owner")), "lost")
            return self._next([*self.segments, segment])
        maybe = self._write(self._maybe(added), "maybe")
        shards: dict[int, list[int]] = {}
        for r in maybe.select("segment", "shard").distinct().collect():  # at most the index's shards
            shards.setdefault(r.segment, []).append(r.shard)
        held = self.state(maybe.select(*KEY).distinct(), shards)
        known = self._write(held.select(*KEY, F.col("docs").alias("held"), F.col("owner").alias("holder")), "known")
        segment = self._segment(added.join(known, KEY, "left_anti"))
        self._write(added.join(known, KEY, "left_semi").select(*KEY, "docs", "owner"), "more")
        both = added.join(known, KEY, "left")
        now = both.select(*KEY, (F.col("docs") + F.coalesce("held", F.lit(0))).alias("docs"), F.least("owner", "holder").alias("owner"))
        passed = both.filter("owner < holder").select(F.col("holder").alias("doc"), *KEY)  # an earlier owner has one smaller now
        self._write(self._lost(new, self._write(now, "now")).unionByName(passed), "lost")
        return self._next([*self.segments, segment])

    def _lost(self, refs: DataFrame, counts: DataFrame) -> DataFrame:
        shared = counts.filter("docs >= 2").select(*KEY, "owner")
        return refs.join(shared, KEY).filter("doc <> owner").select("doc", *KEY)

    @property
    def lost(self) -> DataFrame:
        """(doc, k1, k2): lines that documents lost by the last insertion."""
        return self._read(self.changed, "lost", "doc long, k1 long, k2 long")

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The next version, without the documents of these ids. Their references are found by a scan."""
        self._begin()
        gone = self._write(ids.select(F.col(id_col).cast("long").alias("doc")).filter("doc is not null").distinct(), "gone")
        touched = self._write(self.refs.join(gone, "doc", "left_semi").select(*KEY).distinct(), "touched")
        left = self.refs.join(gone, "doc", "left_anti").join(touched, KEY, "left_semi")
        recount = left.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("owner"))
        zero = [F.coalesce("docs", F.lit(0)).alias("docs"), "owner"]
        reset = self._write(touched.join(recount, KEY, "left").select(*KEY, *zero), "reset")
        dead = self._write(self.state(reset.filter("docs = 0").select(*KEY)).select("k1", "k2", "at"), "dead")
        changed, segments = {r[0] for r in dead.select("at").distinct().collect()}, []
        for s in self.segments:
            if s["at"] in changed:
                shard = F.col("k2").bitwiseAND(F.lit(s["shards"] - 1)).alias("shard")
                keys = dead.filter(F.col("at") == s["at"]).groupBy(shard).agg(F.collect_list("k1").alias("keys"))
                rows = self.filters(s).join(keys, "shard", "left").select("shard", "blob", "keys")
                self._write(rows.mapInArrow(removing_kernel, FILTERS), f"filters-{s['at']}")
                s = s | {"filters": self.next}
            segments.append(s)
        return self._next([*segments, {"at": self.next, "shards": 0, "filters": 0, "gone": True}])

    def compact(self) -> LineIndex:
        """The next version, of one segment that says the same."""
        self._begin()
        new = self._write(self.refs, "refs")
        self._write(new.select("doc").distinct(), "docs")
        segment = self._segment(self._write(self.state().select(*KEY, "docs", "owner"), "counts"))
        self._write(empty_table(self.spark, COUNTS), "more")
        return self._next([segment])

    def drops(self) -> DataFrame:
        """(doc, k1, k2): lines that a document loses, from the exact tables; k1 and k2 are the bytes of line_key."""
        return self._lost(self.refs, self.state())


def remove_lines(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with those lines taken out of the text, and n_lines (before) and n_dropped.

    Input columns of these two names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lost = drops.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("k1", "k2")).alias("__keys"))
    joined = docs.join(lost, docs[id_col] == lost["__doc"], "left").drop("__doc")
    at, keys_at = docs.columns.index(text_col), len(docs.columns)
    names = [*docs.columns, "n_lines", "n_dropped"]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def kernel(batches):
        for b in few(batches):
            texts, n, dropped = [], [], []
            for text, keys in zip(b.column(at).to_pylist(), b.column(keys_at).to_pylist()):
                lines = (text or "").split("\n")
                n.append(len(lines))
                if keys:
                    gone = {struct.pack("<qq", k["k1"], k["k2"]) for k in keys}
                    lines = [x for x in lines if line_key(x) not in gone]
                    text = "\n".join(lines)
                texts.append(text)
                dropped.append(n[-1] - len(lines))
            columns = [*b.columns[:keys_at], pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=names)

    return joined.mapInArrow(frugal(kernel), schema)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", increments: int = INCREMENTS) -> DataFrame:
    """remove_lines over an index of the documents themselves, built in increments of about equal size.

    An increment's keys meet the filters of those before it, and what these can't rule out the exact counts.
    """
    ws = Workspace(docs.sparkSession)
    index, part = LineIndex(docs.sparkSession, ws.path("index")), F.pmod(F.xxhash64(id_col), F.lit(increments))
    lost = []
    for k in range(increments):
        index = index.insert(docs.filter(part == k), id_col, text_col)
        lost.append(index.lost)
    drops = ws.table(reduce(DataFrame.unionByName, lost), "drops")
    ws.delete(index.root)  # nobody asked for the index itself
    return remove_lines(docs, drops, id_col, text_col)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {
    "op7_line_dedup": r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
