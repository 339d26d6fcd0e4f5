"""Best-fit packing by exact-complement hashing.

Only the histogram of piece lengths (at most `capacity` numbers) goes to the driver. There single lengths, pair sums and
triple sums of what is available are looked up for the gap behind each length, largest first, and combinations that fill a
gap exactly are consumed as often as their scarcest length allows; what is left is packed best-fit decreasing. The plan is
a short table of (length, rank interval, first sequence, offset); each piece finds its place by its rank among equal lengths,
ranks being counted in hashed buckets, so that no task holds all pieces of one length.

Cases: a null or empty text is one piece, the end id alone; a document of n ids over capacity is cut so that its first piece
is the short one; repeated rows are packed as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CACHE = 600_000
PLAIN = r"[^\x00-ɏ‐-‧]"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


class Ids(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes; it maps pre-tokens to theirs, and is bounded."""

    def __init__(self, path: str, most: int = CACHE):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.find, self.odd, self.most = regex.compile(WORDS).findall, regex.compile(PLAIN).search, most
        self.merge, self.letters = self.tokenizer.model.tokenize, str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def __missing__(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letters))])
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        if len(self) < self.most:  # frequent words come early; a full dictionary stays as it is
            self[word] = out
        return out

    def __call__(self, text: str) -> bytes:
        if self.odd(text):  # characters whose classes may depend on the Unicode version: no cutting here
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self[w] for w in self.find(text)])


@lru_cache(2)
def ids_of(path: str, most: int) -> Ids:
    return Ids(path, most)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), and ids (binary) if asked for; a Python worker keeps up to `cache` pre-tokens, which changes no id."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tail = ids_of(tokenizer, cache), end.to_bytes(4, "little")
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for batch in batches:
            out = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = ids(text or "") + tail
                n = len(data) // 4
                stops = range(n % capacity or capacity, n + 1, capacity)
                start = 0
                for k, stop in enumerate(stops):
                    part = data[4 * start : 4 * stop]
                    for column, value in zip(out, (key, k, start, stop - start, zlib.crc32(part), part)):
                        column.append(value)
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their counts, covering the histogram."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if have[capacity]:
        out.append(((capacity,), int(have[capacity])))
        have[capacity] = 0

    def fits(*parts: int) -> int:
        return min(int(have[p]) // parts.count(p) for p in parts)

    def pairs(total: int) -> list[tuple[int, int]]:
        """The four pairs with the given sum whose larger parts are largest: one with equal parts and those that share a length with
        the rest of a filling may lack copies, so if none of four fits, no pair does."""
        big = np.arange(total - 1, (total - 1) // 2, -1)
        hit = np.flatnonzero((have[big] > 0) & (have[total - big] > 0))[:4] if len(big) else []
        return [(int(big[k]), int(total - big[k])) for k in hit]

    def fillings(length: int) -> Iterator[tuple[int, ...]]:
        """Single, pair and triple complements of a length, as the sums are found."""
        gap = capacity - length
        if have[gap] > 0:
            yield (length, gap)
        for two in pairs(gap):
            yield (length, *two)
        for first in np.flatnonzero(have[: max(0, gap - 1)])[::-1]:
            for two in pairs(gap - int(first)):
                yield (length, int(first), *two)

    left = []
    for length in range(capacity - 1, 0, -1):
        while have[length] > 0:
            parts = next((p for p in fillings(length) if fits(*p)), None)
            if parts is None:
                left.append((length, int(have[length])))
                have[length] = 0
                break
            n = fits(*parts)
            out.append((parts, n))
            for p in parts:
                have[p] -= n
    return out + best_fit(left, capacity)


def best_fit(left: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (length, count) in falling order; equal bins are handled at once."""
    bins: dict[int, list[list]] = {}
    for length, n in left:
        while n:
            gap = min((g for g, b in bins.items() if g >= length and b), default=None)
            if gap is None:
                each = capacity // length
                for count, times in ((each, n // each), (n % each, 1)):
                    if count and times:
                        bins.setdefault(capacity - count * length, []).append([(length,) * count, times])
                break
            parts, times = bins[gap].pop()
            m = min(n, times)
            if times > m:
                bins[gap].append([parts, times - m])
            bins.setdefault(gap - length, []).append([(*parts, length), m])
            n -= m
    return [(p, m) for b in bins.values() for p, m in b]


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset)."""
    used, base, out = {}, 0, []
    for parts, n in patterns:
        at = 0
        for p in parts:
            low = used.get(p, 0)
            out.append((p, low, low + n, base, at))
            used[p] = low + n
            at += p
        base += n
    return out


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """found (a staged result of `pieces`) plus sequence_id and offset."""
    spark = found.sparkSession
    per = found.groupBy("length").agg(F.count("*")).collect()  # at most `capacity` rows
    if not per:
        return found.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    table = spark.createDataFrame(intervals(plan(dict(map(tuple, per)), capacity)), "len long, low long, high long, base long, offset long")
    buckets = int(min(4096, max(16, sum(r[1] for r in per) / 50_000)))
    keyed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("length").alias("l"), F.col("bucket").alias("b"), (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("ahead"))
    ranked = keyed.withColumn("row", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    # capacity * buckets rows at most
    ranked = ranked.join(F.broadcast(starts), (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("row") + F.col("ahead"))
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(*found.columns, (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, cache: int = CACHE) -> DataFrame:
    return pack(staged(pieces(docs, tokenizer, capacity, end, cache=cache), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids array<int>), ids of its pieces in order."""
    placed = pack(staged(pieces(docs, tokenizer, capacity, end, with_ids=True), "pieces"), capacity)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(b"".join(x["ids"] for x in sorted(parts, key=lambda x: x["offset"])), "<u4").astype(np.int32) for parts in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return placed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts")).mapInArrow(join, "sequence_id long, ids array<int>")
