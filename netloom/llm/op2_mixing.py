"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Each source's target gives its documents one inclusion rate r = target / size. floor(r) whole copies are certain; the
rest f = r - floor(r) is an inclusion probability, unequal between sources and, by an optional weight column, within them.
Documents are ranked by (u / (1 - u)) / (f / (1 - f)), u uniform from a hash of the document, and taken in this order while
the words of the sample stay within the source's remainder. A document too large for what is left is passed over, and later
ones fill the gap, in PASSES passes of the same kind; last, the one document that brings the source nearest to its target
may join. The sample's size is so fixed in words. A prefix is found by histogram: words per (source, bucket of the rank
scale), then the exact order in the one bucket where it ends, so that no task ever gathers a source; the driver holds sums per source only.

Cases: null and empty texts have size 0 (they take 0 words and count as included or not like others); a null source is a
source of its own, last in order; repeated rows share u and are ordered beside each other; an empty table gives no rows;
other columns are neither read nor returned by `mix`, and all kept by `mixed_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform
from .common import WORD, staged, unstage

SMALL = 50_000
PASSES = 3
ORDER = ("rank", "doc_id", "size")


def share_out(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Targets that share sum(sizes) by weight, none above cap times its size; the excess is shared anew."""
    total, capped = float(sum(sizes)), [False] * len(sizes)
    while True:
        rest = total - sum(cap * s for s, c in zip(sizes, capped) if c)
        free = sum(w for w, c in zip(weights, capped) if not c)
        target = [cap * s if c else rest * w / free for s, w, c in zip(sizes, weights, capped)]
        over = [not c and t > cap * s for t, s, c in zip(target, sizes, capped)]
        if not any(over):
            return target
        capped = [c or o for c, o in zip(capped, over)]
        if all(capped):
            return [cap * s for s in sizes]


def targets(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row for each source: source, source_size, target. The driver holds the per-source totals only."""
    spark = sized.sparkSession
    found = sorted(((r[0], int(r[1])) for r in sized.groupBy("source").agg(F.sum("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    shares = share_out([s for _, s in found], [float(weights[i % len(weights)]) for i in range(len(found))], cap)
    table = spark.createDataFrame([(k, s, t) for (k, s), t in zip(found, shares)], "source string, source_size long, target double")
    return F.broadcast(table) if len(found) <= SMALL else table


def small(table: DataFrame) -> DataFrame:
    """A table of a row for each source, broadcast where its size is bounded."""
    return F.broadcast(table) if table.count() <= SMALL else table


def fill(rated: DataFrame, gaps: DataFrame) -> DataFrame:
    """rated (source, size, rank, bucket, extra, ...) with extra = 1 for the longest run, in ORDER, of rows that fit into the gap; gaps (to, gap)."""
    joined = rated.join(gaps, F.col("source").eqNullSafe(F.col("to")), "left").drop("to")
    joined = joined.withColumn("fits", (F.col("extra") == 0) & (F.col("gap") > 0) & (F.col("size") <= F.col("gap")) & (F.col("bucket") >= 0))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counted = joined.where("fits").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("gap").alias("gap")).withColumn("end", F.sum("words").over(upto))
    edge = counted.where("end > gap").groupBy("source").agg(F.min(F.struct("bucket", (F.col("end") - F.col("words")).alias("begin"))).alias("e"))
    edge = edge.join(gaps, F.col("source").eqNullSafe(F.col("to")), "right")  # a row for each source
    edge = small(staged(edge.select("to", F.col("e.bucket").alias("edge"), F.col("e.begin").alias("begin")), "mix-edge"))
    joined = joined.join(edge, F.col("source").eqNullSafe(F.col("to")), "left").drop("to")
    inside = Window.partitionBy("source", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    at_edge = F.col("fits") & (F.col("bucket") == F.col("edge"))
    border = joined.where(at_edge).withColumn("new", F.col("begin") + F.sum("size").over(inside) <= F.col("gap"))
    rest = joined.where(~F.coalesce(at_edge, F.lit(False))).withColumn("new", F.col("fits") & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))))
    return border.unionByName(rest).withColumn("extra", F.when(F.col("new"), 1).otherwise(F.col("extra"))).select(rated.columns)


def decide(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, seed: str = "mix", tilt: Column | None = None) -> DataFrame:
    """sized (with columns doc_id, source, size) plus source_size, target and copies."""
    table = targets(sized, weights, cap).withColumnRenamed("source", "to")
    rated = sized.join(table, F.col("source").eqNullSafe(F.col("to"))).drop("to")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = rated.withColumn("base", F.floor(rate + 1e-12).cast("int")).withColumn("rest", F.greatest(F.lit(0.0), rate - F.floor(rate + 1e-12)))
    tilted = F.least(F.lit(1 - 1e-9), F.col("rest") * (tilt if tilt is not None else F.lit(1.0)))
    u = uniform(seed, "doc_id", "size")
    buckets = max(64, sized.count() // 20_000)
    rated = rated.withColumn("rank", F.when(tilted > 0, u * (1 - tilted) / ((1 - u) * tilted)))
    # Documents without a chance have no rank and no bucket.
    rated = rated.withColumns({"bucket": F.coalesce(F.floor(F.col("rank") / (1 + F.col("rank")) * buckets).cast("int"), F.lit(-1)), "extra": F.lit(0), "row": F.monotonically_increasing_id()})
    rated = staged(rated, "mix-ranked")

    def gaps() -> DataFrame:
        per = rated.groupBy("source").agg((F.first("target") - F.first("base") * F.first("source_size") - F.sum(F.col("extra") * F.col("size"))).alias("gap"))
        return staged(per.withColumnRenamed("source", "to"), "mix-gaps")

    for _ in range(PASSES):
        left = gaps()
        done, rated = rated, staged(fill(rated, small(left)), "mix-filled")
        unstage(done, left)
    left = gaps()
    away = F.abs(F.col("size") - F.col("gap"))
    last = rated.where("extra = 0 and bucket >= 0").join(small(left), F.col("source").eqNullSafe(F.col("to"))).where((F.col("gap") > 0) & (away < F.col("gap")))
    last = last.groupBy(F.col("to").alias("s")).agg(F.min(F.struct(away.alias("away"), *ORDER, "row")).alias("x"))
    last = left.join(last, F.col("to").eqNullSafe(F.col("s")), "left").select("to", F.col("x.row").alias("chosen"))
    last = small(staged(last, "mix-last"))
    rated = rated.join(last, F.col("source").eqNullSafe(F.col("to")), "left").withColumn("extra", F.when(F.col("row") == F.col("chosen"), 1).otherwise(F.col("extra")))
    return rated.withColumn("copies", F.col("base") + F.col("extra"))


def sizes(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, copies), one for each row of docs."""
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", sizes(docs).alias("size")), "mix-sizes")
    out = decide(sized, weights, cap, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, all its columns kept.

    Rows of equal doc_id, source and size share their rank; each takes the copies of its place among them.
    """
    sized = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", sizes(docs).alias("size")), "mix-sizes")
    plan = decide(sized, weights, cap, seed).groupBy("doc_id", "source", "size").agg(F.min("copies").alias("least"), F.sum(F.col("copies") - F.col("base")).alias("extras"), F.max("base").alias("base"), F.count("*").alias("n"))
    plan = staged(plan.where("base + extras > 0").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"), F.col("base").alias("__base"), F.col("extras").alias("__extras"), F.col("n").alias("__rows")), "mix-plan")
    body = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.col("source").alias("__source"), sizes(docs).alias("__size"))
    joined = body.join(plan, F.col("__id").eqNullSafe(F.col("__d")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n")))
    single = joined.where("__rows = 1").withColumn("__copies", F.col("__base") + F.col("__extras"))
    tie = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64("__row")))
    several = joined.where("__rows > 1").withColumn("__copies", F.col("__base") + (tie <= F.col("__extras")).cast("int"))
    return single.unionByName(several).where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__k")).select("__row.*")
