"""N-gram Jaccard join with a token-group matrix.

1. Texts become sets of hashed word shingles; equal sets are one set with copies.
2. Shingles are ordered by (frequent last, hash); a set's prefix, its first n - ceil(t n) + 1 shingles, must meet the
   prefix of every set it links with. Frequent ones are found by counting over all documents.
3. The matrix (shingle, set) holds all prefixes, without the shingles of one set alone. Under each shingle every set meets
   the one where it stands first; pairs to which it leaves room for the overlap they need connect the sets to groups.
4. Groups are opened in blocks of bounded size. There sets that share too little with all others together go first. For
   the rest, a matrix of local prefixes (locally rare shingles first) gives candidates; a component of sets keeps the union
   of its shingles, a set's overlap with it bounds its overlap with every member, and only components that qualify are
   compared set by set. Blocks of one group meet two by two, unless their sets are all connected by then; no group is ever in one task.
5. All pairs of sets of different groups that share a prefix shingle early enough to reach the threshold are opened, each
   set with its partners in parts of bounded size.
6. Components of all verified links give the class ids. Sets already connected are not compared again.

Every bound is exact, so no link is lost: two sets either are in one group, and meet in a block, or in two, and meet in step 5.

Cases: null, empty and blank texts have 0 shingles and are their own component; a text of fewer than k words is one shingle,
which equals only the same short text; repeated rows and copies share a component; a null doc_id counts as larger than all
others; an empty table gives no rows; other columns are neither read nor returned. Links rest on 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, components, mix64, release, run_hash, staged, text_bytes, threshold, unstage, wide_key

BASE = 6364136223846793005
SMALL = 500_000
TABLE, FREQUENT = 1 << 20, 16  # frequent shingles that the order knows, and their least count; they affect speed only


def shingles(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word k-grams, A-Z lower-cased."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    return np.unique(mix64(run_hash(h, width, BASE) + np.uint64(0 if width == k else 7919 * width)))


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def frequent_shingles(docs: DataFrame, k: int, block: int = 1_000_000, bucket: int = 2_000_000) -> tuple[np.ndarray, int]:
    """Sorted leading bits of the shingles of FREQUENT documents or more, at most TABLE of them, the most frequent first; and how many bits are cut.

    Counted over all documents: first within blocks, then block counts (255 at most each) are shuffled as packed arrays, five
    bytes a shingle, one array for each bucket of leading bits. The table sets the order, never a result.
    """
    size = docs.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    bits = min(24, max(8, int(size / 6 / bucket).bit_length()))  # words of six bytes
    cut = 32 - bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held) >> np.uint64(cut), return_counts=True)
            first = values >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            low, n = values.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
            parts = [slice(x, y) for x, y in zip(starts, [*starts[1:], len(values)])]
            return pa.RecordBatch.from_arrays([pa.array(first[starts].astype(np.int64)), pa.array([low[x].tobytes() for x in parts], pa.binary()), pa.array([n[x].tobytes() for x in parts], pa.binary())], ["bucket", "low", "n"])

        held, have = [], 0
        for b in batches:
            for data in b.column(0).to_pylist():
                s = shingles(data, k)
                held.append(s)
                have += len(s)
                if have > block:
                    yield counted()
                    held, have = [], 0
        if have:
            yield counted()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> pa.RecordBatch:
            values, c = np.concatenate([np.frombuffer(x, np.uint32) for x in low]), np.concatenate([np.frombuffer(x, np.uint8) for x in n])
            order = np.argsort(values, kind="stable")
            values, c = values[order], c[order]
            starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            total = np.add.reduceat(c, starts, dtype=np.int64)
            often = total >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array((values[starts][often].astype(np.uint64) | np.uint64(now << 32)).view(np.int64)), pa.array(total[often])], ["token", "c"])

        now, low, n = None, [], []
        for b in batches:
            for first, x, y in zip(*(c.to_pylist() for c in b.columns)):
                if first != now and low:
                    yield merged()
                    low, n = [], []
                now = first
                low.append(x)
                n.append(y)
        if low:
            yield merged()

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 16)
    packed = docs.select("data").mapInArrow(work, "bucket long, low binary, n binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    counts = staged(packed.mapInArrow(merge, "token long, c long"), "frequent")
    found = counts.where(F.col("c") >= threshold(counts, TABLE)).select("token").toArrow()["token"].to_numpy()
    unstage(counts)
    return np.sort(found.view(np.uint64)), cut


def set_rows(docs: DataFrame, k: int, num: int, den: int, frequent) -> DataFrame:
    """A row for each document: doc_id, key of the text, set size n, digest d1, prefix."""
    names = ["doc_id", "k1", "k2", "n", "d1", "prefix"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cut = frequent.value
        for b in batches:
            out: list[list] = [[] for _ in kinds]
            for data in b.column(1).to_pylist():
                s = shingles(data, k)
                d1, p = digest(s), prefix_length(len(s), num, den) if len(s) else 0
                if len(table) and len(s):
                    head = s >> np.uint64(cut)
                    often = table[np.minimum(np.searchsorted(table, head), len(table) - 1)] == head
                    s = np.concatenate([s[~often], s[often]])
                for column, value in zip(out, (len(s), d1, s[:p].view(np.int64))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *(pa.array(c, t) for c, t in zip(out, kinds))], names)

    return docs.mapInArrow(work, "doc_id long, k1 long, k2 long, n long, d1 long, prefix array<long>")


OWN = ["d1", "n", "at"]  # a set, its size, and where a shingle stands in its prefix


def can_link(num: int, den: int) -> Column:
    """Whether sets a and b can link if the shingle at at_a and at_b is the first that they share: sizes alike, and room behind it for the overlap they need."""
    alike = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    return alike & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) * (num + den) >= num * (F.col("n_a") + F.col("n_b")))


def token_matrix(sets: DataFrame) -> DataFrame:
    """Rows (token, d1, n, at) of each shingle in the prefixes of two sets or more: one shuffle, by token."""
    flat = sets.select("d1", "n", F.posexplode("prefix").alias("at", "token"))
    same = Window.partitionBy("token")
    return flat.withColumns({"lo": F.min("d1").over(same), "hi": F.max("d1").over(same)}).where("lo <> hi").select("token", *OWN)


def starred(matrix: DataFrame, num: int, den: int) -> DataFrame:
    """matrix (token, d1, n, at): pairs (a, b) that can link, of the set where a shingle stands first and another one."""
    centre = F.min(F.struct("at", "n", "d1")).over(Window.partitionBy("token"))
    met = matrix.withColumn("x", centre).select(*[F.col(f"x.{c}").alias(f"{c}_a") for c in OWN], *[F.col(c).alias(f"{c}_b") for c in OWN])
    return met.where((F.col("d1_a") != F.col("d1_b")) & can_link(num, den)).select(F.col("d1_a").alias("a"), F.col("d1_b").alias("b")).distinct()


def mixed(matrix: DataFrame, groups: DataFrame) -> DataFrame:
    """matrix (token, d1, n, at) with the root of each set's group, without the shingles of one group alone; groups (id, root) has those of two sets or more."""
    now = matrix.join(groups, F.col("d1") == F.col("id"), "left").select("token", *OWN, F.coalesce("root", "d1").alias("root"))
    same = Window.partitionBy("token")
    now = now.withColumns({"lo": F.min("root").over(same), "hi": F.max("root").over(same)}).where("lo <> hi")
    return staged(now.select("token", *OWN, "root"), "mixed")


def remaining(now: DataFrame, num: int, den: int) -> DataFrame:
    """now (token, d1, n, at, root): all pairs (a, b) of different roots that can link; a pair that links has a row that shows it."""
    a, b = (now.select("token", *[F.col(c).alias(f"{c}_{x}") for c in (*OWN, "root")]) for x in "ab")
    met = a.join(b, "token").where((F.col("d1_a") < F.col("d1_b")) & (F.col("root_a") != F.col("root_b")) & can_link(num, den))
    return met.select(F.col("d1_a").alias("a"), F.col("d1_b").alias("b")).distinct()


def shared(small: np.ndarray, big: np.ndarray) -> int:
    at = np.searchsorted(big, small)
    at[at == len(big)] = 0
    return int((big[at] == small).sum())


class Block:
    """The sets of a block, their components so far, and the matrix of their common shingles."""

    FEW = 32  # candidates that are compared one by one; more are counted together, by the matrix

    def __init__(self, sets: list[np.ndarray], blocks: list[int], num: int, den: int):
        self.num, self.den, self.n = num, den, np.array([len(s) for s in sets])
        self.blocks, self.two = np.array(blocks), len(set(blocks)) > 1
        self.root, self.edges, self.unions = np.arange(len(sets)), [], {}
        self.alive = np.arange(len(sets))
        while True:  # a set that shares less than it needs with all others together links with none of them
            owner = np.repeat(np.arange(len(self.alive)), self.n[self.alive])
            _, code, count = np.unique(np.concatenate([sets[x] for x in self.alive]) if len(self.alive) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
            common = count[code] > 1
            stays = np.bincount(owner[common], minlength=len(self.alive)) * den >= num * self.n[self.alive]
            if stays.all():
                break
            self.alive = self.alive[stays]
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))  # rare shingles first
        ends = np.cumsum(self.n[self.alive])
        self.rows = [np.sort(rank[code[e - n : e]]) for e, n in zip(ends, self.n[self.alive])]
        self.prefixes = [r[: prefix_length(len(r), num, den)] for r in self.rows]
        self.first, self.holders = self.postings(self.prefixes, len(count))
        self.kinds, self.all = len(count), None

    @staticmethod
    def postings(rows: list[np.ndarray], kinds: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the holders of each shingle begin, and the holders."""
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        code = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(np.bincount(code, minlength=kinds))]), owner[np.argsort(code, kind="stable")]

    @staticmethod
    def held(codes: np.ndarray, first: np.ndarray, holders: np.ndarray) -> np.ndarray:
        """The holders of all the shingles, one list after the other."""
        size = first[codes + 1] - first[codes]
        return holders[np.repeat(first[codes] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def enough(self, both: np.ndarray, x: int, y: np.ndarray) -> np.ndarray:
        n = self.n[self.alive]
        return both * self.den >= self.num * (n[x] + n[y] - both)

    def join(self, x: int, y: int) -> None:
        a, b = self.alive[x], self.alive[y]
        self.edges.append((int(a), int(b)))
        self.root[self.root == self.root[a]] = self.root[b]
        self.unions = {}

    def union(self, root: int) -> np.ndarray:
        """All shingles of a component's sets."""
        if root not in self.unions:
            self.unions[root] = np.unique(np.concatenate([self.rows[k] for k in np.flatnonzero(self.root[self.alive] == root)]))
        return self.unions[root]

    def apart(self, x: int, y: np.ndarray) -> np.ndarray:
        return y[self.root[self.alive[y]] != self.root[self.alive[x]]]

    def links(self) -> list[tuple[int, int]]:
        n = self.n[self.alive]
        for x in np.argsort(n, kind="stable"):
            y = np.unique(self.held(self.prefixes[x], self.first, self.holders))
            y = self.apart(x, y[(n[y] < n[x]) | (n[y] == n[x]) & (y < x)])
            y = y[n[y] * self.den >= n[x] * self.num]
            if self.two:
                y = y[self.blocks[self.alive[y]] != self.blocks[self.alive[x]]]
            y, tried = y[np.argsort(-n[y], kind="stable")], 0
            while len(y) and tried < self.FEW:
                now, y, tried = int(y[0]), y[1:], tried + 1
                if self.enough(shared(self.rows[now], self.rows[x]), x, now):
                    self.join(x, now)
                    y = self.apart(x, y)
                elif len(y) > 1 and (self.root[self.alive[y]] == self.root[self.alive[now]]).any():
                    root = self.root[self.alive[now]]  # the whole component shares too little with x: it stays closed
                    if shared(self.rows[x], self.union(root)) * self.den < self.num * n[x]:
                        y = y[self.root[self.alive[y]] != root]
            if len(y):
                self.all = self.all or self.postings(self.rows, self.kinds)
                both = np.bincount(self.held(self.rows[x], *self.all), minlength=len(n))[y]
                for now in y[self.enough(both, x, y)]:
                    if self.root[self.alive[now]] != self.root[self.alive[x]]:
                        self.join(x, int(now))
        return self.edges


def link(sets: list[np.ndarray], blocks: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what the sets' links connect; only across blocks where there are two."""
    return Block(sets, blocks, num, den).links()


def verified(flow: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """flow (bundle, i, j, block, d1, data), sorted by (bundle, i, j): the links of each (bundle, i, j)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, blocks, sets = None, [], [], []

        def found() -> pa.RecordBatch:
            edges = link(sets, blocks, num, den) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in edges], pa.int64()), pa.array([ids[y] for _, y in edges], pa.int64())], ["a", "b"])

        for b in batches:
            for *now, block, d1, data in zip(*(c.to_pylist() for c in b.columns)):
                if now != key:
                    if len(sets) > 1:
                        yield found()
                    key, ids, blocks, sets = now, [], [], []
                if not ids or ids[-1] != d1:
                    s = shingles(data, k)
                    if digest(s) == d1:
                        ids.append(d1)
                        blocks.append(block)
                        sets.append(s)
        if len(sets) > 1:
            yield found()

    return flow.mapInArrow(work, "a long, b long")


def in_blocks(groups: DataFrame, sets: DataFrame, block_sets: int, block_shingles: int) -> DataFrame:
    """The members of groups (id, root) as (bundle, d1, rep, block, blocks)."""
    members = groups.join(sets, F.col("id") == F.col("d1")).select(F.col("root").alias("bundle"), "d1", "rep", "n")
    per = members.groupBy("bundle").agg(F.ceil(F.greatest(F.count("*") / block_sets, F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    return staged(members.join(per, "bundle").select("bundle", "d1", "rep", F.pmod(F.xxhash64("d1"), "blocks").cast("int").alias("block"), "blocks"), "blocks")


def across(members: DataFrame, links: DataFrame) -> DataFrame:
    """members of groups of several blocks that links leave in several components, for each two blocks."""
    several = members.where("blocks > 1")
    roots = components(links.join(several.select(F.col("d1").alias("a")), "a", "left_semi").select("a", "b"), "connected")
    now = several.join(roots, F.col("d1") == F.col("id"), "left").withColumn("root", F.coalesce("root", "d1"))
    open_ = now.groupBy("bundle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bundle")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    flow = several.join(open_, "bundle", "left_semi").select("*", other.alias("o")).where("o <> block")
    return flow.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})


def in_pairs(pairs: DataFrame, sets: DataFrame, block_shingles: int) -> DataFrame:
    """pairs (a, b) as rows (bundle, i, j, block, d1, rep): a in block 0 with a bounded part of its partners, which are in block 1."""
    partners = pairs.join(sets, F.col("b") == F.col("d1")).select(F.col("a").alias("bundle"), "d1", "rep", "n")
    per = partners.groupBy("bundle").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("parts"))
    placed = staged(partners.join(per, "bundle").select("bundle", F.pmod(F.xxhash64("d1"), "parts").cast("int").alias("i"), F.lit(1).alias("block"), "d1", "rep"), "partners")
    heads = placed.select("bundle", "i").distinct().join(sets, F.col("bundle") == F.col("d1")).select("bundle", "i", F.lit(0).alias("block"), "d1", "rep")
    return placed.unionByName(heads).withColumn("j", F.col("i"))


def links_of(base: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    members = staged(members.select("bundle", "i", "j", "block", "d1", "rep"), "members")
    if members.count() <= SMALL:  # 40 bytes a row; larger tables are joined by shuffle
        members = F.broadcast(members)
    flow = base.join(members, F.col("doc_id").eqNullSafe(F.col("rep"))).select("bundle", "i", "j", "block", "d1", "data")
    links = staged(verified(flow.repartition("bundle", "i", "j").sortWithinPartitions("bundle", "i", "j", "d1"), k, num, den), "links")
    release(base.sparkSession)
    return links


def all_links(base: DataFrame, known: DataFrame, k: int, num: int, den: int, limits: tuple[int, int]) -> DataFrame:
    """known (d1, rep, n, prefix): links (a, b) with the components of all links."""
    sets = known.select("d1", "rep", "n")
    matrix, found = staged(token_matrix(known), "matrix"), []

    groups = staged(components(staged(starred(matrix, num, den), "starred"), "groups"), "groups")
    members = in_blocks(groups, sets, *limits)
    found.append(links_of(base, members.withColumns({"i": F.col("block"), "j": F.col("block")}), k, num, den))
    if not members.where("blocks > 1").isEmpty():
        found.append(links_of(base, across(members, found[-1]), k, num, den))
    now = mixed(matrix, groups)
    more = staged(remaining(now, num, den), "remaining")
    unstage(matrix, now)
    if not more.isEmpty():
        found.append(links_of(base, in_pairs(more, sets, limits[1]), k, num, den))
    return staged(reduce(DataFrame.union, found), "links")


def linked_rows(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, block_shingles: int = 1_000_000, block_sets: int = 2000) -> DataFrame:
    """Rows (k1, k2, doc_id, n_shingles, component_id), one for each row of docs; k1 and k2 are the text's key."""
    spark = docs.sparkSession
    data = text_bytes()
    k1, k2 = wide_key(data)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"), k1.alias("k1"), k2.alias("k2"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(base, k))  # TABLE * 8 bytes at most
    rows = staged(set_rows(base, k, num, den, frequent), "sets")
    known = rows.where("n > 0").groupBy("d1").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    known = staged(known, "prefixes")
    links = all_links(base.select("doc_id", "data"), known, k, num, den, (block_sets, block_shingles))
    roots = components(links, "linked")
    first = known.select("d1", "rep").join(roots, F.col("d1") == F.col("id"), "left").select("d1", "rep", F.coalesce("root", "d1").alias("root"))
    first = staged(first, "roots")
    ids = first.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = first.join(ids, "root").select(F.col("d1").alias("id"), "component_id")
    release(spark)
    out = rows.select("k1", "k2", "doc_id", "n", "d1").join(named, F.col("d1") == F.col("id"), "left")
    return out.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs; links where den * shared >= num * union."""
    return linked_rows(docs, k, num, den).drop("k1", "k2")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, one of least doc_id; rows without words all stay."""
    best = linked_rows(docs, k, num, den).where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("x"))
    best = staged(best.select(F.col("x.doc_id").alias("__d"), F.col("x.k1").alias("__a"), F.col("x.k2").alias("__b")), "kept")
    k1, k2 = wide_key(text_bytes())
    worded = F.col("text").rlike(WORD)
    body = docs.where(worded).select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), k1.alias("__k1"), k2.alias("__k2"))
    kept = body.join(best, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__k1") == F.col("__a")) & (F.col("__k2") == F.col("__b")), "left_semi")
    one = F.row_number().over(Window.partitionBy("__id", "__k1", "__k2").orderBy(F.lit(0))) == 1
    return kept.withColumn("__one", one).where("__one").select("__row.*").unionByName(docs.where(F.coalesce(~worded, F.lit(True))))
