"""Substring dedup over a log-structured fingerprint index.

A window is 35 consecutive words. Any two equal windows share the least of their 28 hashes of 8 words (a minimizer), so one
word position in about 14 is enough to find them. The index keeps minimizers as sorted immutable runs of (hash, count), each
a table of buckets by hash below one shared folder, listed in a manifest there. A new batch becomes a run of its own; it is
merge-joined with every run of the history, bucket by bucket without a shuffle, which gives the minimizers that the batch
repeats; then it is appended, and runs are merged two by two once there are `fan_in` of them. A later session opens the folder again.

Windows under a repeated minimizer are verified by a 128-bit hash of all their words, counted over all texts that hold it,
and only verified windows remove words. `dedup` deals a table into batches and ingests one after the other; with `index` and
`seen` it judges new documents against the history, of which only the texts that hold a repeated minimizer are opened.

Texts that are equal byte for byte are handled once: with 35 words or more, everything in them repeats.

Cases: null and empty texts have no words; texts of fewer than 35 words lose nothing; repeated rows are copies of each other;
an empty table gives no rows; other columns are neither read nor returned. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, last_file, mix64, release, run_hash, scratch_path, sliding, staged, text_bytes, unstage, wide_key, write_file

BASES = (6364136223846793005, 2862933555777941757)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def least(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `gram` words, and the least of them inside each window."""
    g = mix64(run_hash(h, gram, BASES[0]))
    return g, sliding(np.minimum, g, window - gram + 1)


def minimizers(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct minimizers of a document, and at how many selected positions each stands."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, m = least(h, window, gram)
    span = window - gram + 1
    pad = np.concatenate([np.zeros(span - 1, np.uint64), m, np.zeros(span - 1, np.uint64)])
    chosen = g[g == sliding(np.maximum, pad, span)]  # least of some window that covers it
    return np.unique(chosen, return_counts=True)


class FingerprintIndex:
    """Sorted immutable runs of (hash, n) below one shared folder, listed in its manifest; path: a folder to open or to begin."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 2):
        self.spark, self.path, self.fan_in = spark, path or scratch_path(spark, "index"), fan_in
        self.tables: dict[str, str] = {}
        known = last_file(spark, self.path, "manifest-")
        self.state = json.loads(known) if known else {"buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "version": 0, "made": 0, "runs": []}

    @property
    def runs(self) -> list[str]:
        return self.state["runs"]

    def save(self, runs: list[str]) -> None:
        """A new version of the manifest; it names new runs before old ones go, so the last whole version never misses a run."""
        self.state["runs"], self.state["version"] = runs, self.state["version"] + 1
        write_file(self.spark, f"{self.path}/manifest-{self.state['version']:09d}", json.dumps(self.state))

    def write(self, rows: DataFrame) -> str:
        """rows (hash, n), each hash once: the name of a new run."""
        run, self.state["made"] = f"run-{self.state['made']:06d}", self.state["made"] + 1
        name = self.tables[run] = f"netloom_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", f"{self.path}/{run}").bucketBy(self.state["buckets"], "hash").sortBy("hash").saveAsTable(name)
        release(self.spark)
        return run

    def run(self, run: str) -> DataFrame:
        if run not in self.tables:
            name = self.tables[run] = f"netloom_{uuid.uuid4().hex}"
            n = self.state["buckets"]
            self.spark.sql(f"CREATE TABLE {name} (hash BIGINT, n BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {n} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(self.tables[run])

    def ingest(self, rows: DataFrame) -> DataFrame:
        """rows (hash, n) of a batch: its hashes that occur twice or more in batch and history together; the batch joins the history."""
        new = self.write(rows.groupBy("hash").agg(F.sum("n").alias("n")))
        found = [self.run(new).where("n > 1").select("hash")]
        found += [self.run(new).select("hash").join(self.run(old).select("hash").hint("merge"), "hash", "left_semi") for old in self.runs]
        found = staged(reduce(DataFrame.union, found).distinct(), "repeated")
        self.save([*self.runs, new])
        while len(self.runs) > max(1, self.fan_in - 1):
            self.merge_last()
        return found

    def merge_last(self) -> None:
        """The two youngest runs become one, by a merge of their buckets."""
        *rest, a, b = self.runs
        both = self.run(a).withColumnRenamed("n", "m").join(self.run(b).hint("merge"), "hash", "full")
        new = self.write(both.select("hash", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("n")))
        self.save([*rest, new])
        for run in (a, b):
            self.spark.sql(f"DROP TABLE {self.tables.pop(run)}")
            drop_path(self.spark, f"{self.path}/{run}")

    def drop(self) -> None:
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE {name}")
        self.tables = {}
        drop_path(self.spark, self.path)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def read_texts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """For each row: key, whether new, word count, sha256 of its words, distinct minimizers, and those of them that stand at several places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, found, more = [], [], [], []
            for data in b.column(3).to_pylist():
                words = data.split()
                values, counts = minimizers(hashes(words), window, gram)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(values.view(np.int64))
                more.append(values[counts > 1].view(np.int64))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(n, pa.int64()), pa.array(sha), pa.array(found, lists), pa.array(more, lists)], ["doc_id", "k1", "k2", "new", "n_words", "sha", "found", "more"])

    return docs.mapInArrow(work, "doc_id long, k1 long, k2 long, new boolean, n_words long, sha string, found array<long>, more array<long>")


def window_hashes(data: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer and 128-bit hash of each window of a text."""
    h = hashes(data.split())
    return least(h, window, gram)[1], *(mix64(run_hash(h, window, base)) for base in BASES)


def candidate_windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """texts (tid, data, hashes, single): the distinct windows whose minimizer is among hashes, as (w1, w2, tid, start of the first, n).

    start is -1 unless single: a text that has copies goes as a whole, one of the history stays, and both only count for others.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, found = [], []
            for data, wanted in zip(b.column(1).to_pylist(), b.column(2)):
                m, w1, w2 = window_hashes(data, window, gram)
                at = np.flatnonzero(np.isin(m, wanted.values.to_numpy().view(np.uint64)))
                order = at[np.lexsort((at, w2[at], w1[at]))]
                x, y = w1[order], w2[order]
                starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(order) else np.zeros(0, np.int64)
                size.append(len(starts))
                found.append((x[starts], y[starts], order[starts].astype(np.int32), np.diff(np.append(starts, len(order))).astype(np.int32)))
            if not found:
                continue
            w1, w2, start, n = (np.concatenate(c) for c in zip(*found))
            tid, single = (np.repeat(b.column(k).to_numpy(zero_copy_only=False), size) for k in (0, 3))
            start[~single] = -1
            yield pa.RecordBatch.from_arrays([signed(w1), signed(w2), pa.array(tid), pa.array(start), pa.array(n)], ["w1", "w2", "tid", "start", "n"])

    return texts.mapInArrow(work, "w1 long, w2 long, tid long, start int, n int")


def cut(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """texts (k1, k2, data, starts): what is left of each without the windows equal to those at starts, as (k1, k2, n_removed, kept)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, kept = [], []
            for data, starts in zip(b.column(2).to_pylist(), b.column(3)):
                words, (_, w1, w2) = data.split(), window_hashes(data, window, gram)
                s = starts.values.to_numpy()
                same = np.flatnonzero(np.isin(w1, w1[s]))
                pairs = set(zip(w1[s].tolist(), w2[s].tolist()))
                s = np.array([k for k, x, y in zip(same.tolist(), w1[same].tolist(), w2[same].tolist()) if (x, y) in pairs], np.int64)
                edge = np.zeros(len(words) + window + 1, np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + window, -1)
                stays = np.cumsum(edge)[: len(words)] == 0
                gone.append(len(words) - int(stays.sum()))
                kept.append(b" ".join([w for w, k in zip(words, stays.tolist()) if k]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["k1", "k2", "n_removed", "kept"])

    return texts.mapInArrow(work, "k1 long, k2 long, n_removed long, kept binary")


def dedup(docs: DataFrame, window: int = 35, gram: int = 8, batches: int = 3, text: bool = False, index: FingerprintIndex | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), with the kept text too if asked for; one for each row of docs.

    index: a history to go on with, which docs join; seen: the documents ingested into it so far, (doc_id, text).
    """
    spark, data = docs.sparkSession, text_bytes()
    k1, k2 = wide_key(data)
    read = lambda df, new: df.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), data.alias("data"), F.lit(new).alias("new"))
    base = read(docs, True) if seen is None else read(docs, True).unionByName(read(seen, False))
    rows = staged(read_texts(base, window, gram), "rows")
    known = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min(F.when(F.col("new"), F.struct("new", "doc_id"))).alias("own"), F.min(F.struct("doc_id")).alias("any"), F.first("n_words").alias("n_words"), F.first("found").alias("found"), F.first("more").alias("more"))
    known = staged(known.select("k1", "k2", "copies", F.col("own").isNotNull().alias("new"), F.coalesce("own.doc_id", "any.doc_id").alias("first_id"), "n_words", "found", "more", F.monotonically_increasing_id().alias("tid")), "distinct")
    prints = known.select("tid", "k1", "new", F.explode("found").alias("hash"), "more")
    counts = prints.where("new").select("k1", "hash", F.when(F.array_contains("more", F.col("hash")), 2).otherwise(1).cast("long").alias("n"))
    own, index = index is None, index or FingerprintIndex(spark)
    repeated = [index.ingest(counts.where(F.pmod("k1", F.lit(batches)) == k).select("hash", "n")) for k in range(batches)]
    hits = prints.select("hash", "tid").join(reduce(DataFrame.union, repeated).distinct().hint("merge"), "hash", "left_semi").groupBy("tid").agg(F.collect_list("hash").alias("hashes"))
    hits = staged(hits.join(known.select("tid", "k1", "k2", "first_id", (F.col("new") & (F.col("copies") == 1)).alias("single")), "tid"), "hits")
    unstage(*repeated)
    if own:
        index.drop()
    sought = base.join(hits, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    windows = staged(candidate_windows(sought.select("tid", "data", "hashes", "single"), window, gram), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    starts = windows.where("start >= 0").join(twice, ["w1", "w2"], "left_semi").groupBy("tid").agg(F.collect_list("start").alias("starts"))
    starts = staged(starts.join(hits.select("tid", "k1", "k2"), "tid").drop("tid"), "starts")
    unstage(windows, hits)
    left = cut(base.where("new").join(starts, ["k1", "k2"]).select("k1", "k2", "data", "starts"), window, gram)
    left = left.select("k1", "k2", "n_removed", F.sha2("kept", 256).alias("kept_sha"), *[F.col("kept").cast("string").alias("kept_text")] * text)
    left = staged(left, "left")
    whole = known.where((F.col("copies") > 1) & (F.col("n_words") >= window)).select("k1", "k2", F.col("n_words").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha"), *[F.lit("").alias("kept_text")] * text)
    out = rows.where("new").drop("found", "more").join(left.unionByName(whole), ["k1", "k2"], "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), "k1", "k2", *["kept_text"] * text)
    if text:
        plain = base.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.array_join(F.regexp_extract_all(F.col("data").cast("string"), F.lit(r"([^\x20\x09-\x0D]+)")), " ").alias("plain")).dropDuplicates(["t1", "t2"])
        out = out.join(plain, (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))).withColumn("kept_text", F.coalesce("kept_text", "plain")).drop("t1", "t2", "plain")
    return out.drop("k1", "k2")
