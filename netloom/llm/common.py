"""Helpers the operators share: the shared scratch folder, key columns, word splitting, distributed components.

Words are `[^\\x20\\x09-\\x0D]+`; `bytes.split()` cuts UTF-8 at exactly these six ASCII characters.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jdir.get() if jdir.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/netloom-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A new file below the shared folder; it has its name only once it is whole."""
    where, part = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part"))
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, where):
        raise OSError(f"could not write {path}")


def last_file(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The text of the whole file in folder whose name begins with prefix and is greatest."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}*")) or [])
    found = [f for f in found if not f.endswith(".part")]
    if not found:
        return None
    data = fs.open(jvm.org.apache.hadoop.fs.Path(found[-1]))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
    finally:
        data.close()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, label: str, free: bool = True) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors; free: its shuffle files go at once."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, label)
    df.write.parquet(path)
    del df
    if free:
        release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    for df in frames:
        if path := getattr(df, "staged_path", None):
            drop_path(df.sparkSession, path)


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def wide_key(column: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a column, chained from different seeds."""
    return F.xxhash64(column), F.xxhash64(F.lit("wide"), column)


def remainder(column: str, modulus: int) -> Column:
    """crc32(column as text) mod modulus; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def threshold(counts: DataFrame, most: int) -> int:
    """The least count of which at most `most` rows have as much or more; counts are compared exactly below 2048."""
    scale = F.when(F.col("c") < 2048, F.col("c")).otherwise(F.pow(F.lit(2), F.ceil(F.log2("c") * 8) / 8).cast("long"))
    total, least = 0, 1
    for level, n in sorted(counts.groupBy(scale.alias("s")).agg(F.count("*")).collect(), reverse=True):
        total += n
        if total > most:
            return least
        least = level
    return 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hash(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of `width` consecutive entries, by doubling."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out = at = None
    power, step, part = base, 1, h
    rest = width
    while rest:
        if rest & 1:
            if out is None:
                out, at = part, step
            else:
                n = min(len(out), len(part) - at) if len(part) > at else 0
                out = out[:n] * np.uint64(power) + part[at : at + n]
                at += step
        rest >>= 1
        if rest:
            n = len(part) - step
            part = part[:n] * np.uint64(power) + part[step : step + n]
            power = power * power % (1 << 64)
            step *= 2
    return out[: len(h) - width + 1]


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op.reduce over every run of `width` entries, by doubling; op is idempotent (min or max)."""
    step, part = 1, x
    while step * 2 <= width:
        part = op(part[:-step], part[step:])
        step *= 2
    n = len(x) - width + 1
    return op(part[:n], part[width - step : width - step + n])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of edges (a, b): rows (id, root), root the least id reachable.

    Alternating large-star and small-star rounds; only minima and edges move, each round is staged.
    Self-loops and repeated edges are allowed; ids that no edge between different ids names do not come back.
    """
    spark = edges.sparkSession
    cut = lambda df: staged(df, label, free=False)
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    now, last = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = cut(tied.select("e.a", "e.b").where("a <> b").distinct())
        before, last = last, mark(small)
        unstage(now, large)
        now = small
        if last == before or not last[0]:
            break
    release(spark)
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def pack_array(values: list) -> Column:
    """A literal array that the optimiser folds to one constant."""
    return F.array(*[F.lit(v) for v in values])


atexit.register(gc.collect)


def range_of(x: Column, bounds: list) -> Column:
    """How many of the sorted bounds are <= x, by binary search over a literal array; null x gives 0."""
    if not bounds:
        return F.lit(0)
    table, depth = pack_array(bounds), max(1, len(bounds).bit_length())

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = table[F.least(mid, F.lit(len(bounds) - 1))] <= x
        return F.when(s["lo"] >= s["hi"], s).when(right, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.when(x.isNull(), 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step, lambda s: s["lo"]))


def uniform(*columns: Column | str) -> Column:
    """A hash of the columns as a double in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / float(1 << 53)
