"""Substring dedup with a log-structured fingerprint index.

A window is 20 consecutive words.  Its anchor is the least hash of its 6-word grams,
so equal windows have equal anchors; neighbouring windows of one anchor are one entry
of the index, which carries a 32-bit hash of each of them.  A window's fingerprint is
its anchor and its own hash, 96 bits.  The index is a list of immutable runs, each
bucketed and sorted by fingerprint and named in a manifest:

- ``cold``: entries whose anchor one document has so far (all their windows);
- ``hot``: anchors that several documents have;
- ``windows``: the windows of hot anchors, each with its first place;
- ``texts``: the distinct texts, so that the windows of a copy needn't be looked at.

``Index.ingest`` takes the next batch, whatever came before or will come.  Its texts,
anchors and windows are merge-joined with every run: these are read by their buckets
and in their order, so history is neither shuffled nor sorted.  An anchor that turns
hot takes its entry's windows over from its cold run.  What the batch adds is
appended as a run; when there are ``fanout`` runs, they are compacted into one first.  Windows found
again are verified on their words against the text where they were first.

Hot keys: copies count once; keys are counted with map-side combination, and the few
that hold over a thousandth of the rows (a thousand keys at most) are joined by
broadcast, the others by merge.

Defined cases: a null text has no word.  A row that repeats doc_id and words gets
the same result as its twin.  Rows of one doc_id with different words aren't
compared with each other, as neither has the smaller doc_id.  A null doc_id comes
before all others.  An empty table gives an empty one; columns beyond doc_id and text
are ignored, whatever their names.  A long text is one row of Python's memory and some
ten numbers a word beside it.  Two different windows of one fingerprint leave words
in (verification fails), never out.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, hit_rows, remove, shared_dir, slices, written

WINDOW, GRAM = 20, 6
_M = np.uint64(0x9E3779B97F4A7C15)
_NULL = -(1 << 63)
#: Copies of a batch, (id, key) each, that are broadcast; more meet the entries in a shuffle.
BROADCAST_ROWS = 500_000
#: Rows and bytes of a batch between a scan, the JVM and Python; Python looks at slices of half a MB of text, with some hundred bytes a word beside them.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 500, 2 << 20, 1 << 19
LAYOUT = {
    "cold": ("a long, id long, s int, w array<int>", ["a"]),
    "hot": ("a long", ["a"]),
    "windows": ("a long, w int, id long, s int", ["a", "w"]),
    "texts": ("key long, sha binary, id long", ["key", "sha"]),
}


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_M), n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of n consecutive items, from those of powers of two."""
    whole, size, done = None, 1, 0
    while True:
        if n & size:
            ahead = x if whole is None else x[: max(0, len(whole) - size)]
            # the items of this part come before those already taken
            whole = ahead if whole is None else ahead * _power(done) + whole[size : size + len(ahead)]
            done += size
        if done == n:
            return whole
        x = x[:-size] * _power(size) + x[size:] if len(x) > size else x[:0]
        size *= 2


def fingerprints(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' entries in their order, not taken apart.

    Anchors and first starts of the entries; hashes of all windows (0: repeated in the text)
    and where each entry's begin; how many entries the texts up to each have; starts of the
    windows that repeat, and how many of these the texts up to each have.
    """
    words = [w for t in texts for w in t]
    sizes = np.array([len(t) for t in texts], np.int64)
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    at = coded.indices.to_numpy()
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist())), "<u8").reshape(-1, 2)
    doc = np.repeat(np.arange(len(texts)), sizes)
    own = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :]) if len(doc) >= WINDOW else np.zeros(0, np.int64)
    if not len(own):
        none, all_ = np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int32)
        return none, none.astype(np.int32), none.astype(np.int32), all_[:1], all_, none, all_
    hashes = _mix(_grams(both[at, 1], WINDOW))[own]
    least, k, span = _mix(_grams(both[at, 0], GRAM)), 1, WINDOW - GRAM + 1
    while 2 * k <= span:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    least = np.minimum(least[: len(least) - (span - k)], least[span - k :])[own]
    doc = doc[own]
    keys = hashes + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(keys)
    tie = keys[order][1:] == keys[order][:-1]
    tied = np.append(tie, False) | np.insert(tie, 0, False)
    some = order[tied]
    order[tied] = some[np.lexsort((some, keys[some]))]  # of equal keys the first place comes first
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    first = order[np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))]
    inner = np.zeros(len(own), bool)
    for i, j in zip(order[1:][same].tolist(), first[1:][same].tolist()):
        inner[i] = words[own[i] : own[i] + WINDOW] == words[own[j] : own[j] + WINDOW]
    short = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
    short[short == 0] = 1
    short[inner] = 0
    new = np.ones(len(own), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    start = own - (np.cumsum(sizes) - sizes)[doc]
    upto = np.arange(len(texts) + 1)
    entries, repeats = np.searchsorted(doc[begin], upto), np.searchsorted(doc[inner], upto)
    return least[begin].view(np.int64), start[begin].astype(np.int32), short, np.append(begin, len(own)).astype(np.int32), entries.astype(np.int32), start[inner], repeats.astype(np.int32)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("id"), F.col("text").cast("string").alias("text"))


def _words(column: pa.Array) -> list[list[bytes]]:
    return [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in column.cast(pa.binary())]


def _key(joined: bytes) -> int:
    return xxhash.xxh64_intdigest(joined, 9) - (1 << 63)


def _entries(docs: DataFrame) -> DataFrame:
    """One row per document: hashes and number of its words, its entries, and the starts of windows it repeats itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            texts = _words(batch.column(1))
            joined = [b" ".join(t) for t in texts]
            a, s, w, ends, upto, inner, repeats = fingerprints(texts)
            entry = pa.StructArray.from_arrays([pa.array(a), pa.array(s), pa.ListArray.from_arrays(pa.array(ends), pa.array(w))], names=["a", "s", "w"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_key(j) for j in joined], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(j).digest() for j in joined], pa.binary()), pa.ListArray.from_arrays(pa.array(upto), entry), pa.ListArray.from_arrays(pa.array(repeats), pa.array(inner))],
                names=["id", "key", "n_words", "sha", "entries", "inner"],
            )

    return _plain(docs).mapInArrow(run, "id long, key long, n_words long, sha binary, entries array<struct<a:long,s:int,w:array<int>>>, inner array<long>")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row per key and the number ``n`` of left rows of the key.

    Keys that hold over a thousandth of the rows (at least 10,000) are a thousand at
    most; they are broadcast.  how: inner, or left_anti.
    """
    limit = max(10_000, rows // 1000)
    rest = right.filter(F.col("n") <= limit)
    hot = right.filter(F.col("n") > limit)
    if hot.isEmpty():
        return left.join(rest, keys, how)
    named = F.broadcast(hot.select(*keys))
    cool = left.join(named, keys, "left_anti").join(rest, keys, how)
    return cool if how == "left_anti" else cool.unionByName(left.join(F.broadcast(hot), keys, how))


@contextmanager
def _settings(spark: SparkSession, own: dict[str, str]):
    """The session with these settings; those of before are put back."""
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _ordered(spark: SparkSession, buckets: int):
    """Shuffles fit the buckets, and scans of sorted buckets tell their order, so that joins with runs merge without a sort."""
    return _settings(spark, {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.shuffle.partitions": str(buckets)})


def _narrow(spark: SparkSession):
    """Rows are wide here (a text, or hashes of all its windows), so fewer are held at once, by the JVM outside its heap,
    by a Parquet scan on it and by Python, than the session's batches of narrow rows would."""
    return _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(BATCH_ROWS)})


class Index:
    """Runs in a shared folder.  An index that is opened again goes on where it was left."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or f"{shared_dir(spark)}/graphloom-lsm-{uuid.uuid4().hex}"
        self.runs: list[dict[str, str]] = []
        self.tables: dict[str, str] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        fs, path = self._file("manifest.json")
        if fs.exists(path):
            found = json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])
            self.runs, self.buckets = found["runs"], found["buckets"]

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _commit(self) -> None:
        """The manifest names the runs that count; it replaces the one before when it is whole."""
        fs, path = self._file("manifest.json")
        _, new = self._file("manifest.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": self.runs}).encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(new, path)

    def open(self, kind: str, path: str) -> DataFrame:
        """A run read by its buckets, in their order."""
        if path not in self.tables:
            columns, keys = LAYOUT[kind]
            name = f"graphloom_{uuid.uuid4().hex}"
            fs, at = self._file(path)
            fs.mkdirs(at)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS LOCATION '{at.toString()}'")
            self.tables[path] = name
        return self.spark.table(self.tables[path])

    def close(self, forget: bool = False) -> None:
        """Drop the session's names for the runs; forget: their files too."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}
        if forget:
            delete(self.spark, self.folder)

    def past(self, kind: str) -> list[DataFrame]:
        return [self.open(kind, run[kind]) for run in self.runs]

    def _write(self, df: DataFrame, kind: str, apart: str | None = None) -> tuple[str, DataFrame | None]:
        """df as a run: one sorted file a bucket.  apart: a boolean column; rows where it holds go to a table beside the run."""
        name, path = f"graphloom_{uuid.uuid4().hex}", f"{kind}-{uuid.uuid4().hex}"
        keys = LAYOUT[kind][1]
        writer = df.write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", f"{self.folder}/{path}")
        (writer.partitionBy(apart) if apart else writer).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # of an external table only the name goes
        if apart is None:
            return path, None
        for part in ("false", "true"):
            fs, there = self._file(f"{path}/{apart}={part}")
            fs.mkdirs(there)  # where no row is
        schema = df.drop(apart).schema
        return f"{path}/{apart}=false", self.spark.read.schema(schema).parquet(there.toString())

    def ingest(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index a batch of (doc_id, text).

        (one row per document: id, key, n_words, sha, copy, inner; and segments of windows
        that came earlier: id, start s, length n in windows, first document id0 and start s0).
        copy: the whole text came earlier, and so did each of its windows.
        """
        with _ordered(self.spark, self.buckets), _narrow(self.spark):
            if len(self.runs) >= self.fanout:
                self._compact()
            return self._ingest(batch)

    def _ingest(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = written(_entries(batch), "lsm-rows")
        number = rows.count()
        # whole texts
        long = rows.filter(F.col("n_words") >= WINDOW)
        texts = long.groupBy("key", "sha").agg(F.min("id").alias("id"), F.count("*").alias("n"))
        old = F.lit(False)
        for k, run in enumerate(self.past("texts")):
            texts = texts.join(run.select("key", "sha", F.lit(True).alias(f"o{k}")), ["key", "sha"], "left")
            old = old | F.coalesce(F.col(f"o{k}"), F.lit(False))
        texts = texts.withColumn("old", old).select("key", "sha", "id", "n", "old")
        texts_run, known = self._write(texts, "texts", "old")
        fresh = self.spark.read.schema(known.schema).parquet(f"{self.folder}/{texts_run}")
        firsts = fresh.withColumn("first", F.col("id")).unionByName(known.withColumn("first", F.lit(None).cast("long"))).drop("id")
        narrow = long.select("id", "key", "n_words", "sha")
        marked = hot_join(narrow, firsts, ["key", "sha"], number).select("id", "key", "n_words", "sha", (F.col("first").isNull() | (F.col("id") > F.col("first"))).alias("copy"))
        marked = written(marked.unionByName(rows.filter(F.col("n_words") < WINDOW).select("id", "key", "n_words", "sha", F.lit(False).alias("copy"))), "lsm-marked")
        copies = written(marked.filter("copy").select("id", "key").distinct(), "lsm-copies")
        # entries are neither shuffled nor written anew for the copies' sake while these are few
        few = copies.count() <= BROADCAST_ROWS
        own = long.join(F.broadcast(copies) if few else copies, ["id", "key"], "left_anti").select("id", "key", "entries", "inner")
        own = own if few else written(own, "lsm-own")
        inner = written(own.filter(F.size("inner") > 0).select("id", "key", "inner"), "lsm-inner")
        # anchors
        entries = own.select("id", F.inline("entries"))
        counted = entries.groupBy("a").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
        cold, hot = F.lit(False), F.lit(False)
        for k, (one, several) in enumerate(zip(self.past("cold"), self.past("hot"))):
            counted = counted.join(one.select("a").distinct().withColumn(f"c{k}", F.lit(True)), "a", "left").join(several.withColumn(f"h{k}", F.lit(True)), "a", "left")
            cold, hot = cold | F.coalesce(F.col(f"c{k}"), F.lit(False)), hot | F.coalesce(F.col(f"h{k}"), F.lit(False))
        shared = written(counted.select("a", "n", cold.alias("cold"), hot.alias("hot"), (F.col("low") < F.col("high")).alias("several")).filter("cold or hot or several"), "lsm-shared")
        total = own.select(F.sum(F.size("entries"))).first()[0] or 0
        limit = max(10_000, total // 1000)
        named = shared.filter(F.col("n") > limit).select("a")  # a thousand at most
        crowd = None if named.isEmpty() else entries.join(F.broadcast(named), "a", "left_semi")
        others = entries if crowd is None else entries.join(F.broadcast(named), "a", "left_anti")
        # by number: one task a bucket, and so one file, even where nothing is shared and the join falls away
        flagged = others.repartition(self.buckets, "a").join(shared.select("a", F.lit(True).alias("hit")).hint("merge"), "a", "left").select("a", "id", "s", "w", F.coalesce("hit", F.lit(False)).alias("hit"))
        cold_run, met = self._write(flagged, "cold", "hit")
        met = met if crowd is None else met.unionByName(crowd.select("a", "id", "s", "w"))
        hot_run, _ = self._write(shared.filter("not hot").select("a").repartition(self.buckets, "a"), "hot")
        # windows of shared anchors
        turned = shared.filter("cold and not hot").select("a")
        place = lambda df: df.select("a", "id", "s", F.posexplode("w").alias("at", "w")).filter("w <> 0").select("a", "w", "id", (F.col("s") + F.col("at")).alias("s"))
        mine, every = place(met), place(met)
        for run in self.past("cold"):
            every = every.unionByName(place(run.join(turned, "a", "left_semi")))
        seen = every.groupBy("a", "w").agg(F.min("id").alias("id"), F.min_by("s", "id").alias("s"), F.max("id").alias("high"), F.count("*").alias("n"))
        kept, at = F.lit(None).cast("long"), F.lit(None).cast("int")
        old = F.lit(False)
        for k, run in enumerate(self.past("windows")):
            seen = seen.join(run.select("a", "w", F.col("id").alias(f"i{k}"), F.col("s").alias(f"s{k}")), ["a", "w"], "left")
            old, kept, at = old | F.col(f"i{k}").isNotNull(), F.coalesce(kept, f"i{k}"), F.coalesce(at, f"s{k}")
        seen = seen.select("a", "w", F.coalesce(kept, "id").alias("id"), F.coalesce(at, "s").alias("s"), (F.col("id") < F.col("high")).alias("several"), "n", old.alias("old"))
        windows_run, before = self._write(seen, "windows", "old")
        fresh = self.spark.read.schema(before.schema).parquet(f"{self.folder}/{windows_run}")
        twins = before.withColumn("old", F.lit(True)).unionByName(fresh.filter("several").withColumn("old", F.lit(False)))
        twins = twins.select("a", "w", F.col("id").alias("id0"), F.col("s").alias("s0"), "n", "old")
        again = hot_join(mine, twins, ["a", "w"], total * 8).filter(F.col("old") | (F.col("id") > F.col("id0"))).select("id", "s", "id0", "s0")
        segments = written(_segments(again), "lsm-segments")
        self.runs.append({"cold": cold_run, "hot": hot_run, "windows": windows_run, "texts": texts_run})
        self._commit()
        for path in (cold_run, windows_run, texts_run):
            delete(self.spark, f"{self.folder}/{path.rsplit('=', 1)[0]}=true")
        remove(rows, shared, copies, *([] if few else [own]))
        return marked.join(inner, ["id", "key"], "left"), segments

    def _compact(self) -> None:
        """Merge all runs into one.  Runs share no text and no window; cold entries whose anchor has turned hot go."""
        every = {kind: reduce(DataFrame.unionByName, self.past(kind)) for kind in LAYOUT}
        every = {kind: df.repartition(self.buckets, *LAYOUT[kind][1]) for kind, df in every.items()}
        every["cold"] = every["cold"].join(every["hot"].hint("merge"), "a", "left_anti")
        one = {kind: self._write(df, kind)[0] for kind, df in every.items()}
        gone, self.runs = self.runs, [one]
        self._commit()
        self.close()
        for run in gone:
            for path in run.values():
                delete(self.spark, f"{self.folder}/{path.split('/')[0]}")


def _segments(again: DataFrame) -> DataFrame:
    """Neighbouring windows whose first places are neighbours too, as one row: id, s, n, id0, s0."""
    row = Window.partitionBy("id").orderBy("s", "id0", "s0")
    goes_on = (F.col("id0") == F.lag("id0").over(row)) & (F.col("s") - F.lag("s").over(row) == 1) & (F.col("s0") - F.lag("s0").over(row) == 1)
    numbered = again.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("k", F.sum("new").over(row))
    return numbered.groupBy("id", "k").agg(F.min("s").alias("s"), F.count("*").cast("int").alias("n"), F.min("id0").alias("id0"), F.min("s0").alias("s0")).drop("k")


def cut(docs: DataFrame, marked: DataFrame, segments: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words, for those that lose some) of every row.

    corpus: where the first places are (docs, if not given).  Only documents that lose
    words or lend a passage are read beyond a fixed bitmap, and none is shuffled
    whole for its neighbours: the passages meet the segments.
    """
    own = marked.filter("inner is not null and not copy").select("id", "key", "inner")
    losing = segments.select("id").union(own.select("id")).distinct()
    # passages
    asked = segments.groupBy("id0", "s0", "n").agg(F.count("*").alias("n_asked"))
    wanted = written(asked.groupBy("id0").agg(F.collect_list(F.struct("s0", "n")).alias("parts")), "lsm-wanted")

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            ids, s, n, passages = [], [], [], []
            for doc, words, parts in zip(batch.column(0).to_pylist(), _words(batch.column(1)), batch.column(2).to_pylist()):
                for p in parts:
                    ids.append(doc), s.append(p["s0"]), n.append(p["n"])
                    passages.append(b" ".join(words[p["s0"] : p["s0"] + p["n"] + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(passages, pa.binary())], names=["id0", "s0", "n", "passage"])

    lent = hit_rows(_plain(docs if corpus is None else corpus), "id", wanted.select(F.col("id0").alias("id"))).join(wanted.withColumnRenamed("id0", "id").hint("merge"), "id").select("id", "text", "parts")
    lent = lent.mapInArrow(lend, "id0 long, s0 int, n int, passage binary").distinct().groupBy("id0", "s0", "n").agg(F.collect_list("passage").alias("passages"))
    with _narrow(docs.sparkSession):
        lent = written(lent.join(asked, ["id0", "s0", "n"]).select("id0", "s0", F.col("n").alias("size"), "passages", F.col("n_asked").alias("n")), "lsm-lent")
    met = hot_join(segments.withColumnRenamed("n", "size"), lent, ["id0", "s0", "size"], segments.count())
    lists = met.groupBy("id").agg(F.collect_list(F.struct("s", F.col("size").alias("n"), "passages")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            keys, removed, sha, left = [], [], [], []
            for words, parts, inner in zip(_words(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                key = _key(b" ".join(words))
                edge = np.zeros(len(words) + 1, np.int64)
                starts = {s for i in inner or [] if i["key"] == key for s in i["inner"]}
                for p in parts or []:
                    mine = words[p["s"] : p["s"] + p["n"] + WINDOW - 1]
                    for passage in p["passages"]:
                        theirs = passage.split(b" ")
                        if mine == theirs:
                            starts.update(range(p["s"], p["s"] + p["n"]))
                        else:  # another text of that id, or two windows of one fingerprint
                            starts.update(p["s"] + i for i in range(len(mine) - WINDOW + 1) if mine[i : i + WINDOW] == theirs[i : i + WINDOW])
                for s in starts:
                    edge[s] += 1
                    edge[s + WINDOW] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                keys.append(key), removed.append(int(gone.sum())), sha.append(hashlib.sha256(kept).digest()), left.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.binary()), pa.array(left, pa.binary()).cast(pa.string())], names=["id", "key", "n_removed", "kept_sha", "kept"])

    repeats = own.groupBy("id").agg(F.collect_set(F.struct("key", "inner")).alias("inner"))
    texts = hit_rows(_plain(docs), "id", losing).join(losing.hint("merge"), "id", "left_semi").join(lists.hint("merge"), "id", "left").join(repeats.hint("merge"), "id", "left")
    changed = texts.select("id", "text", "parts", "inner").mapInArrow(run, "id long, key long, n_removed long, kept_sha binary, kept string").dropDuplicates(["id", "key"])
    whole = marked.join(changed, ["id", "key"], "left")
    pick = lambda copy, lost, mine: F.when(F.col("copy"), copy).otherwise(F.coalesce(lost, mine))
    return whole.select(
        F.when(F.col("id") != _NULL, F.col("id")).alias("doc_id"), "n_words",
        pick(F.col("n_words"), F.col("n_removed"), F.lit(0).cast("long")).alias("n_removed"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.lower(F.hex("kept_sha")), F.lower(F.hex("sha"))).alias("kept_sha256"),
        pick(F.lit(""), F.col("kept"), F.lit(None).cast("string")).alias("kept_words"),
    )


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids that part the rows (not the range of ids) into batches of about equal number."""
    parts = [k / batches for k in range(1, batches)]
    got = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), parts, 1000)).first()[0] if parts else None
    return sorted(set(got or []))


def _between(docs: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows of ids over low and up to high.  Null ids come first.  The plain comparisons reach the Parquet scan, which skips what holds no such id."""
    id_ = F.col("doc_id").cast("long")
    if low is not None:
        docs = docs.filter(id_ > low)
    if high is not None:
        docs = docs.filter(id_ <= high if low is not None else id_.isNull() | (id_ <= high))
    return docs


def deduplicate(docs: DataFrame, batches: int = 3, fanout: int = 2, folder: str | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_words (null where nothing is removed) of every row.

    folder: an index that stays; documents that it holds count as earlier, and ``corpus``
    must hold them beside docs.  Without it the index goes when its batches are done.
    """
    index, bounds = Index(docs.sparkSession, folder, fanout), _bounds(docs, batches)
    marked = segments = None
    for low, high in zip([None, *bounds], [*bounds, None]):
        one, two = index.ingest(_between(docs, low, high))
        marked = one if marked is None else marked.unionByName(one)
        segments = two if segments is None else segments.unionByName(two)
    index.close(forget=folder is None)
    return cut(docs, marked, segments, corpus)
