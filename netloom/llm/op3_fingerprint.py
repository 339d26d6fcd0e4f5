"""Canonical exact digest, with DataFrame and SQL functions only.

Canonical form: NFKC, full case folding, NFKC again, runs of white space folded to one space, ends trimmed. The two
Unicode steps call ICU, which ships in Spark's jars, through SQL's `reflect`; without these classes `require_icu` stops at once.
Digest: two chained 64-bit xxhashes of the canonical bytes. Buckets are counted by their digests first; only texts of buckets
of two rows or more move, and there the canonical bytes are compared (least = greatest text of a bucket, with map-side
combination, so a hot bucket costs two texts a task); a bucket with different texts gets a suffix, sha2 of the text.

Cases: a column of docs named fingerprint is replaced, all others are kept, whatever their names; null and empty texts have the canonical form ''; repeated rows count as documents of their own; ties of doc_id are
ordered by text; a null doc_id comes last in descending order; the next document of an only document is itself; an empty
table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import range_of, staged, wide_key

SMALL = 500_000
SPACE = r"[\s\p{Z}]+"
NORMAL, CASE = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


def canonical(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    normal = F.reflect(F.lit(NORMAL), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit(NORMAL), F.lit("compose"), F.reflect(F.lit(CASE), F.lit("foldCase"), normal, F.lit(True)), F.lit(True))
    return F.trim(F.regexp_replace(folded, SPACE, " "))


def digest(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def require_icu(spark: SparkSession) -> None:
    try:
        for name in (NORMAL, CASE):
            spark.sparkContext._jvm.java.lang.Class.forName(name)
    except Exception as e:
        raise RuntimeError("canonical digests need ICU4J (com.ibm.icu), which this Spark does not have on its class path") from e


def clashes(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """Buckets (h1, h2) of the documents' digests (h1, h2) that hold different texts: none, but for an accident or an attack."""
    several = digests.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h1").alias("s1"), F.col("h2").alias("s2"))
    several = staged(several, "buckets")
    if several.count() <= SMALL:  # 16 bytes a row; larger tables are joined by shuffle
        several = F.broadcast(several)
    h1, h2 = wide_key(F.col("canon"))
    texts = docs.select(canonical(F.col("text")).alias("canon")).select("canon", h1.alias("h1"), h2.alias("h2"))
    texts = texts.join(several, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")), "left_semi")
    low = texts.groupBy("h1", "h2").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return low.where("low <> high").select("h1", "h2")


def settle(rows: DataFrame, odd: DataFrame, h1: str, h2: str, sha: Column, name: str) -> DataFrame:
    """Adds the fingerprint column: the digest, and in clashing buckets sha2 of the canonical text too."""
    odd = odd.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.lit(True).alias("odd"))
    return rows.join(odd, [h1, h2], "left").withColumn(name, F.when(F.col("odd"), F.concat(digest(F.col(h1), F.col(h2)), F.lit("-"), sha)).otherwise(digest(F.col(h1), F.col(h2)))).drop("odd")


def fingerprints(docs: DataFrame) -> DataFrame:
    """General interface: docs plus column fingerprint; equal fingerprints if and only if equal canonical texts."""
    require_icu(docs.sparkSession)
    names = [n for n in docs.columns if n != "fingerprint"]
    rows = docs.select(F.struct("*").alias("__row"), canonical(F.col("text")).alias("__canon"))
    h1, h2 = wide_key(F.col("__canon"))
    rows = rows.withColumns({"__h1": h1, "__h2": h2})
    odd = clashes(docs, rows.select(F.col("__h1").alias("h1"), F.col("__h2").alias("h2")))
    return settle(rows, odd, "__h1", "__h2", F.sha2("__canon", 256), "__print").select(*[F.col(f"__row.`{n}`").alias(n) for n in names], F.col("__print").alias("fingerprint"))


def with_next(docs: DataFrame, rows_per_range: int = 2048, max_ranges: int = 20_000) -> DataFrame:
    """Rows (doc_id, text, h1, h2, next_text, next_h1, next_h2): the next document in descending doc_id, the first after the last.

    Ranges of doc_id by approximate quantiles; each range also gets the head of the one below as a guest, so that
    the neighbour is a window inside a range and texts are shuffled once.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n, least = ids.agg(F.count("*"), F.min("doc_id")).first()
    ranges = int(max(1, min(max_ranges, n / rows_per_range)))
    bounds: list[int] = []
    if ranges > 1:
        cuts = [i / ranges for i in range(1, ranges)]
        bounds = sorted({int(b) for b in ids.agg(F.percentile_approx("doc_id", cuts, 20 * ranges)).first()[0] or []})
    in_range = range_of(F.col("doc_id"), bounds)
    heads = {r[0]: r[1] for r in ids.groupBy(in_range.alias("range")).agg(F.max("doc_id")).collect()}
    used = sorted(heads)
    # The head of each range visits the next range above; the greatest of all visits the lowest range.
    visits = {heads[used[k]]: used[(k + 1) % len(used)] for k in range(len(used))} if used else {}
    canon = canonical(F.col("text"))
    h1, h2 = wide_key(F.col("canon"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), canon.alias("canon")).select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), in_range.alias("range"))
    lo = [k for k in visits if k is not None]
    lo.sort()
    place = range_of(F.col("doc_id"), lo) - 1
    visit = F.when(F.col("doc_id").isNull(), F.lit(visits.get(None))).when((place >= 0) & (F.array(*[F.lit(k) for k in lo])[F.greatest(place, F.lit(0))] == F.col("doc_id")), F.array(*[F.lit(visits[k]) for k in lo])[F.greatest(place, F.lit(0))]) if lo else F.lit(visits.get(None)).cast("int")
    own = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")))
    stays = F.when(visit.isNotNull(), F.concat(own, F.array(F.struct(visit.cast("int").alias("range"), F.lit(1).alias("guest"))))).otherwise(own)
    rows = rows.select("doc_id", "text", "h1", "h2", F.explode(stays).alias("s")).select("doc_id", "text", "h1", "h2", "s.range", "s.guest")
    down = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return rows.select("*", *[F.lead(c).over(down).alias(f"next_{c}") for c in ("text", "h1", "h2")]).where("guest = 0")


def edited_report(docs: DataFrame) -> DataFrame:
    """The query's rows: fingerprints of each text and of its edited text, and likeness 1.0 (equal digests and bytes) or 0.0."""
    require_icu(docs.sparkSession)
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_canon", canonical(F.col("edited")))
    e1, e2 = wide_key(F.col("edited_canon"))
    same = lambda a, b, other: F.when((F.col("h1") == a) & (F.col("h2") == b), (canonical(F.col("text")) == other).cast("double")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"e1": e1, "e2": e2})
    near = {"near_edited": same(F.col("e1"), F.col("e2"), F.col("edited_canon")), "near_next": same(F.col("next_h1"), F.col("next_h2"), canonical(F.col("next_text")))}
    report = [F.col("doc_id"), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *map(F.col, ("h1", "h2", "e1", "e2")), *[c.alias(name) for name, c in near.items()]]
    out = staged(rows.select(*report), "digests")
    odd = staged(clashes(docs, out.select("h1", "h2")), "clashes")
    if not odd.isEmpty():
        # The suffix needs the texts again; an edited text has one where its digest is that of a bucket of different texts.
        out = staged(rows.select(*report, F.sha2(canonical(F.col("text")), 256).alias("s"), F.sha2("edited_canon", 256).alias("es")), "digests")
        out = settle(settle(out, odd, "h1", "h2", F.col("s"), "fingerprint"), odd, "e1", "e2", F.col("es"), "edited_fingerprint")
    else:
        out = out.withColumns({"fingerprint": digest(F.col("h1"), F.col("h2")), "edited_fingerprint": digest(F.col("e1"), F.col("e2"))})
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
