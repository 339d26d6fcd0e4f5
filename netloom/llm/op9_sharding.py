"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of the text, hash of doc_id, doc_id), so equal texts stand together. A size-weighted Poisson
sample of the hashes gives quantile boundaries; records are range-partitioned by them. A hash that alone fills half a range,
i.e. a hot group of copies, is a range of its own; ranges that hold too much are subdivided in their order, hot ones by
the hash of doc_id, others by the hash of the text. The measured sizes of the parts give every record its exact place in the
order, and so its shard and slot: these depend on the records alone, not on the sample.

Law `bytes`: shard k takes the k-th of `shards` equal parts of the summed sizes. A group of equal texts that is no
larger than `snap` of a shard stays in one shard; larger groups are cut where the law asks for it.

Cases: a null text has size 1 and crc32 0; an empty text likewise; a null doc_id sorts first; repeated rows each get a
slot of their own; an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pack_array, range_of, release, staged, text_bytes, uniform

COLUMNS = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


WIDE = 1 << 60


def hash60(x: Column) -> Column:
    """The first 60 bits of md5 as a number, for any engine alike."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def splitters(keys: DataFrame, total: int, ranges: int, oversample: int) -> list[int]:
    """Boundaries of about `ranges` ranges of equal size, from about ranges * oversample sampled keys (the driver's bound)."""
    step = total / (ranges * oversample)
    sample = keys.where(uniform(F.lit("splitters"), "h", "doc_id") < F.col("size") / F.lit(step)).select("h", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w"))
    bounds, weight, full = [], 0.0, total / ranges
    for h, w in sorted(sample.collect()):
        weight += w
        if weight >= full * (len(bounds) + 1) and (not bounds or h > bounds[-1]):
            bounds.append(h)
    return bounds


def assign_shards(docs: DataFrame, shards: int = 8, rows_per_range: int = 20_000, max_ranges: int = 20_000, oversample: int = 32, snap: float = 0.02) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs."""
    spark, data = docs.sparkSession, text_bytes()
    keys = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"), hash60(data).alias("h"), hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("g")), "shard-keys")
    total, rows = keys.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], COLUMNS)
    ranges = int(min(max_ranges, max(8 * shards, rows / rows_per_range)))
    full = total / ranges
    # At most 2 * ranges hashes can each hold half a range.
    hot = dict(map(tuple, keys.groupBy("h").agg(F.sum("size").alias("s"), F.count("*").alias("n")).where((F.col("s") > full / 2) & (F.col("n") > 1)).select("h", "s").collect()))
    bounds = sorted({*splitters(keys, total, ranges, oversample), *(h + e for h in hot for e in (0, 1))})
    keys = keys.withColumn("range", range_of(F.col("h"), bounds))
    sums = dict(keys.groupBy("range").agg(F.sum("size")).collect())
    pieces = [max(1, round(sums.get(r, 0) / full)) for r in range(len(bounds) + 1)]
    first, edges = [0], [0, *bounds, WIDE]
    for n in pieces:
        first.append(first[-1] + n)
    parts, own = first.pop(), {bisect_left(bounds, h) + 1: s for h, s in hot.items()}
    low, wide, many = pack_array(edges[:-1])[F.col("range")], pack_array([float(max(1, y - x)) for x, y in zip(edges, edges[1:])])[F.col("range")], pack_array(pieces)[F.col("range")]
    known = spark.createDataFrame([(r, s, first[r]) for r, s in own.items()], "hot long, hot_size long, hot_first int")
    keys = keys.join(F.broadcast(known), F.col("range") == F.col("hot"), "left")
    share = F.when(F.col("hot").isNull(), (F.col("h") - low) / wide).otherwise(F.col("g") / float(WIDE))
    keys = keys.withColumn("part", pack_array(first)[F.col("range")] + F.least(F.floor(share * many).cast("int"), many - 1))
    at, row_at, offset, row_offset = 0, 0, [0] * (parts + 1), [0] * (parts + 1)
    measured = {r[0]: r[1:] for r in keys.groupBy("part").agg(F.sum("size"), F.count("*")).collect()}
    for p in range(parts):
        offset[p], row_offset[p] = at, row_at
        s, n = measured.get(p, (0, 0))
        at, row_at = at + s, row_at + n
    order = Window.partitionBy("part").orderBy("h", "g", "doc_id", "size")
    group = Window.partitionBy("part", "h")
    placed = keys.select("*", F.row_number().over(order).alias("row"), (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    placed = placed.select("*", F.min("before").over(group).alias("group_before"), F.sum("size").over(group).alias("group_size"))
    middle = F.when(F.col("hot").isNull() & (F.col("group_size") <= snap * total / shards), F.col("group_before") + F.col("group_size") / 2).otherwise(F.col("before") + F.col("size") / 2)
    middle = pack_array(offset)[F.col("part")] + middle
    middle = F.when(F.col("hot_size") <= snap * total / shards, pack_array(offset)[F.col("hot_first")] + F.col("hot_size") / 2).otherwise(middle)
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(total)))).cast("int")
    out = staged(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (pack_array(row_offset)[F.col("part")].cast("long") + F.col("row") - 1).alias("place")), "shards")
    starts = dict(out.groupBy("shard").agg(F.min("place")).collect())
    begin = pack_array([int(starts.get(s, 0)) for s in range(shards)])
    release(spark)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - begin[F.col("shard")]).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> None:
    """Writes docs as Parquet below path/shard=k, rows of a shard in order of (shard, slot).

    Rows meet their shard by (doc_id, text_crc32, size) and a number within equal keys, so repeated rows stay apart.
    """
    data, same = text_bytes(), ["doc_id", "text_crc32", "size"]
    tie = lambda df: df.withColumn("tie", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
    body = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.crc32(data).cast("long").alias("text_crc32"), (F.length(data) + 1).cast("long").alias("size"))
    left, right = tie(body).alias("l"), tie(assign_shards(docs, shards, **options)).alias("r")
    joined = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_crc32") == F.col("r.text_crc32")) & (F.col("l.size") == F.col("r.size")) & (F.col("l.tie") == F.col("r.tie")))
    out = joined.select("l.row.*", F.col("r.shard").alias("shard"), F.col("r.slot").alias("slot"))
    out.repartitionByRange(max(shards, spark_partitions(docs)), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def spark_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
