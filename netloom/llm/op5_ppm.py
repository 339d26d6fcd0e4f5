"""LM scoring by partial matching: a byte-context trie with escape estimates (method C) and symbol exclusion.

Contexts are the last 0 to 5 bytes; before a text stand 5 start bytes 0xFE, after it the end symbol 0xFF (neither occurs in
UTF-8). Training counts all (context, symbol) pairs of all training texts, with sums merged by shuffle; a level's counts are
marginals of the next. Contexts nest, so what exclusion takes from a parent depends on the child alone.

The whole trie is a partitioned table, no node is dropped. A code's probability depends on the code alone: the codes of all
texts are dealt by the last three bytes of their contexts, so that orders 3 to 5 of a part are complete where it is; orders
0 to 2 (2^24 nodes at most, whatever the input) are broadcast. The most frequent `max_nodes` codes and their probabilities
are looked up in a broadcast table of bounded size, occurrences of all other codes are joined with the full table.

The unigram columns count words over all training texts; the most frequent `head` words are looked up in a broadcast table
of bounded size, occurrences of all other words are joined with the full table of counts.

Cases: null and empty texts consist of the end alone; repeated rows count and score as often as they occur; a null
doc_id is hashed as empty text; without training rows every symbol has probability 1/256 and every base term is
log10(1/1); an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, staged, text_bytes, threshold, unstage, wide_key

ORDER = 5
SHARED = 3  # orders 0 to SHARED - 1 are known to all parts of the trie; parts are dealt by the last SHARED bytes of a context
START, END = b"\xfe" * ORDER, b"\xff"


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (context, symbol) codes of all symbols of the texts, one text after the other, and each text's symbol count."""
    raw = np.frombuffer(b"".join([p for t in texts for p in (START, t, END)]), np.uint8)
    n = len(raw) - ORDER
    code = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        code <<= np.uint64(8)
        code |= raw[k : k + n]
    return code[raw[ORDER:] != START[0]], np.array([len(t) + 1 for t in texts])


def tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.diff(np.append(starts, len(codes)))


def count_symbols(texts: DataFrame, block: int = 6_000_000) -> DataFrame:
    """texts (data, held_out): rows (g, c, n), the codes of all texts with their counts in training and in all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(texts: list[bytes], out: list[bool]) -> pa.RecordBatch:
            codes, sizes = grams(texts)
            marked, n = tally(codes << np.uint64(1) | np.repeat(np.array(out, np.uint64), sizes))
            g, starts = np.unique(marked >> np.uint64(1), return_index=True)
            c = np.add.reduceat(np.where(marked & np.uint64(1), 0, n), starts)
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c, pa.int64()), pa.array(np.add.reduceat(n, starts), pa.int64())], ["g", "c", "n"])

        held, out, size = [], [], 0
        for b in batches:
            for data, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(data)
                out.append(h)
                size += len(data)
                if size > block:
                    yield sent(held, out)
                    held, out, size = [], [], 0
        if held:
            yield sent(held, out)

    return texts.mapInArrow(work, "g long, c long, n long").groupBy("g").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a text's distinct words, A-Z lower-cased."""
    found = Counter(data.lower().split())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)), np.fromiter(found.values(), np.int64, len(found))


def count_words(texts: DataFrame, block: int = 400_000) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)), pa.array(list(found.values()), pa.int64())], ["w", "c"])

        found: Counter = Counter()
        for b in batches:
            for data in b.column(0).to_pylist():
                found.update(data.lower().split())
                if len(found) > block:
                    yield sent()
                    found.clear()
        if found:
            yield sent()

    return texts.mapInArrow(work, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Trie:
    """Sorted arrays for each order: nodes (context and symbol) with counts, contexts with totals, kinds and excluded mass."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        for k, (node, count) in enumerate(levels):
            context = node >> np.uint64(8)
            starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(node) else np.zeros(0, np.int64)
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, np.int64)  # noqa: E731, B023
            excluded = np.zeros(len(starts), np.int64)
            if k:
                upper, n = levels[k - 1]
                excluded = add(n[np.searchsorted(upper, node & np.uint64((1 << 8 * k) - 1))])
            self.levels.append((node, count, context[starts], add(count), np.diff(np.append(starts, len(node))), excluded))

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each (context, symbol) code."""
        out, live = np.zeros(len(codes)), np.arange(len(codes))
        mass, kinds = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)  # excluded by the order above
        for k in range(len(self.levels) - 1, -1, -1):
            node, count, context, total, distinct, excluded = self.levels[k]
            key = codes[live] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, there = self.find(context, key >> np.uint64(8))
            where, hit = self.find(node, key)
            if not len(context):
                continue
            t, d = total[at] - mass[live], distinct[at] - kinds[live]
            open_ = there & (t > 0)
            hit &= there
            out[live[hit]] += np.log10(count[where[hit]] / (t[hit] + d[hit])) if hit.any() else 0
            escape = open_ & ~hit
            out[live[escape]] += np.log10(d[escape] / (t[escape] + d[escape])) if escape.any() else 0
            mass[live] = np.where(there, excluded[at], mass[live])
            kinds[live] = np.where(there, distinct[at], kinds[live])
            live = live[~hit]
        if len(live):
            out[live] -= np.log10(np.maximum(1, 256 - kinds[live]))
        return out


def level(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of order k, sorted, with their counts: marginals of the nodes of a higher order."""
    node = codes & np.uint64((1 << 8 * (k + 1)) - 1)
    order = np.argsort(node, kind="stable")
    node = node[order]
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    return node[starts], np.add.reduceat(counts[order], starts) if len(starts) else np.zeros(0, np.int64)


def code_scores(codes: DataFrame, block: int = 1_000_000) -> DataFrame:
    """codes (g, c, n), staged: rows (g, n, lp), lp the log10 probability of each code under the whole trie."""
    spark = codes.sparkSession
    short = codes.where("c > 0").groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * SHARED) - 1)).alias("g")).agg(F.sum("c").alias("c")).toArrow()
    g, c = short["g"].to_numpy().view(np.uint64), short["c"].to_numpy()
    shared = spark.sparkContext.broadcast([level(g, c, k) for k in range(SHARED)])
    tail = lambda g: g >> np.uint64(8) & np.uint64((1 << 8 * SHARED) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(g: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            seen = c > 0
            lp = Trie([*shared.value, *(level(g[seen], c[seen], k) for k in range(SHARED, ORDER + 1))]).log10(g)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n), pa.array(lp, pa.float64())], ["g", "n", "lp"])

        held, size, most = [], 0, block
        for b in batches:
            held.append([x.to_numpy(zero_copy_only=False) for x in b.columns[:3]])
            size += b.num_rows
            if size >= most:  # whole contexts only
                g, c, n = (np.concatenate(x) for x in zip(*held))
                g = g.view(np.uint64)
                at = int(np.searchsorted(tail(g), tail(g[-1:])[0]))
                if at:
                    yield from scored(g[:at], c[:at], n[:at])
                held, size = [[g[at:].view(np.int64), c[at:], n[at:]]], len(g) - at
                most = max(block, 2 * size)
        if size:
            g, c, n = (np.concatenate(x) for x in zip(*held))
            yield from scored(g.view(np.uint64), c, n)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), codes.count() // 500_000)
    tails = F.shiftright("g", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1))
    dealt = codes.select("g", "c", "n", tails.alias("tail")).repartition(parts, "tail").sortWithinPartitions("tail")
    return dealt.mapInArrow(work, "g long, n long, lp double")


def text_scores(texts: list[bytes], table: np.ndarray, lp: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Each text's score from the codes in the table, and its codes outside the table with their counts."""
    codes, sizes = grams(texts)
    distinct = tally(codes)[0]
    at, hit = Trie.find(table, distinct)
    value = np.zeros(len(distinct))
    value[hit] = lp[at[hit]]
    where, starts = np.searchsorted(distinct, codes), np.cumsum(sizes) - sizes
    scores = np.add.reduceat(value[where], starts)
    if hit.all():
        return scores, [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
    rest = [tally(codes[a : a + n][~hit[where[a : a + n]]]) for a, n in zip(starts, sizes)]
    return scores, [g.view(np.int64) for g, _ in rest], [n for _, n in rest]


def ppm_scores(docs: DataFrame, modulus: int = 7, held: int = 2, head: int = 1_000_000, max_nodes: int = 3_000_000) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs."""
    spark, data = docs.sparkSession, text_bytes()
    k1, k2 = wide_key(data)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", modulus) == held).alias("held_out"), data.alias("data"), k1.alias("k1"), k2.alias("k2"))
    training = base.where(~F.col("held_out")).select("data")
    codes = staged(count_symbols(base.select("data", "held_out")), "symbols")
    scored = staged(code_scores(codes), "codes")
    unstage(codes)
    often = scored.select("g", "lp", F.col("n").alias("c"))
    hot = often.where(F.col("c") >= threshold(often, max_nodes)).select("g", "lp").toArrow()
    g, lp = hot["g"].to_numpy().view(np.uint64), hot["lp"].to_numpy()
    order = np.argsort(g)
    g, lp = g[order], lp[order]
    whole = len(g) == scored.count()
    counts = staged(count_words(training), "words")
    ends = training.count()
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = words + ends, kinds + (ends > 0)
    common = counts.where(F.col("c") >= threshold(counts, head)).select("w", "c").toArrow()
    table, count = common["w"].to_numpy().view(np.uint64), common["c"].to_numpy()
    order = np.argsort(table)
    complete = len(table) == kinds
    model = spark.sparkContext.broadcast((g, lp, table[order], count[order]))  # 16 bytes for each of head words and max_nodes codes
    log_end, log_rest = float(np.log10((ends + 1) / (total + distinct + 1))), float(np.log10(total + distinct + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, lp, table, count = model.value
        for b in batches:
            texts = b.column(2).to_pylist()
            n_tokens, known, sums, missing, times = [], [], [], [], []
            for t in texts:
                h, tf = word_hashes(t)
                at, hit = Trie.find(table, h)
                n_tokens.append(int(tf.sum()) + 1)
                known.append(int(tf[hit].sum()) + (ends > 0))
                sums.append(float((tf[hit] * (np.log10(count[at[hit]] + 1) - log_rest)).sum()) + log_end if hit.any() else log_end)
                rest = ~hit
                if complete:
                    sums[-1] -= float(tf[rest].sum()) * log_rest
                    rest = np.zeros(len(h), bool)
                missing.append(h[rest].view(np.int64))
                times.append(tf[rest])
            scores, rare, often, held, size = [], [], [], [], 0
            for k, t in enumerate(texts):  # blocks of bounded size
                held.append(t)
                size += len(t)
                if size > 4_000_000 or k == len(texts) - 1:
                    for out, x in zip((scores, rare, often), text_scores(held, g, lp)):
                        out.extend(x)
                    held, size = [], 0
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores, pa.float64()), pa.array(missing, lists), pa.array(times, lists), pa.array(rare, lists), pa.array(often, lists)], ["doc_id", "held_out", "k1", "k2", "n_tokens", "known", "base", "score", "missing", "times", "rare", "often"])

    rows = staged(base.select("doc_id", "held_out", "data", "k1", "k2").mapInArrow(work, "doc_id long, held_out boolean, k1 long, k2 long, n_tokens long, known long, base double, score double, missing array<long>, times array<long>, rare array<long>, often array<long>"), "scores")
    # Copies of a text come several times into the sums: `all` over the text's own misses says how often.
    own = lambda name: F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + x)
    if complete:
        out = rows.select("*", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("rest"))
    else:
        rare = rows.select("k1", "k2", F.explode(F.arrays_zip("missing", "times")).alias("x")).select("k1", "k2", F.col("x.missing").alias("w"), F.col("x.times").alias("n"))
        rare = rare.join(counts, "w", "left").groupBy("k1", "k2").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - log_rest)).alias("rest"))
        out = rows.withColumn("own", own("times")).join(rare, ["k1", "k2"], "left")
        again = F.when(F.col("own") > 0, F.col("all") / F.col("own")).otherwise(1.0)
        out = out.withColumn("more", F.coalesce(F.round(F.col("more") / again).cast("long"), F.lit(0))).withColumn("rest", F.coalesce(F.col("rest") / again, F.lit(0.0)))
    if not whole:
        rare = rows.select("k1", "k2", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("k1", "k2", F.col("x.rare").alias("g"), F.col("x.often").alias("n"))
        rare = rare.join(scored.select("g", "lp"), "g").groupBy("k1", "k2").agg(F.sum("n").alias("codes"), F.sum(F.col("n") * F.col("lp")).alias("lps"))
        out = out.join(rare, ["k1", "k2"], "left").withColumn("score", F.col("score") + F.coalesce(F.col("lps") * own("often") / F.col("codes"), F.lit(0.0)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.col("rest")).alias("base_score"), "score")
