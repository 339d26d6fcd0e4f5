"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text: its words, the shapes of its words (letter case, digits, marks; runs collapsed) and a few facts about its form
(repeated words, distinct share, line lengths), hashed into `terms` columns. A bounded sample of labelled rows (`sample`, a
documented limit of the fit) gives idf, a truncated SVD of `rank` dimensions and the labelled vectors, which are broadcast.
Every document is projected, and its cosines with all labelled vectors are computed exactly, block by block; the `k` nearest
vote with weight cosine squared.

Cases: null and empty texts have no terms and get the labelled share of quality 1, as does everything if there are no labels
(then 0.5); labels without a value or a document are left out; repeated rows are scored alike; an empty table gives no rows.
Only the text enters a score. Columns named score or predicted are replaced, all others are kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, text_bytes

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[ord("0") : ord("9") + 1] = ord("9")
SHAPE[128:] = ord("a")  # bytes of other letters


def terms_of(data: bytes, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of a text's terms."""
    words = data.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    raw = SHAPE[np.frombuffer(data, np.uint8)]
    shapes = raw[np.concatenate([[True], raw[1:] != raw[:-1]])].tobytes().split()
    n = len(words)
    found = Counter({b"w" + w: c for w, c in Counter(words).items()})
    found.update({b"s" + w: 2 * c for w, c in Counter(shapes).items()})
    again = sum(map(bytes.__eq__, words[1:], words)) / n
    lines = data.splitlines()
    for name, value in ((b"again", again), (b"distinct", len(set(words)) / n), (b"lines", len(set(lines)) / max(1, len(lines)))):
        found[b"f%s%d" % (name, int(value * 8))] += max(4, n // 8)
    found[b"fline%d" % int(np.log2(n / max(1, len(lines)) + 1))] += max(4, n // 16)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in found), np.uint64, len(found))
    return (h % np.uint64(terms)).astype(np.int64), np.fromiter(found.values(), np.float32, len(found))


def matrix(found: list[tuple[np.ndarray, np.ndarray]], terms: int) -> np.ndarray:
    """Log counts of texts given as `terms_of` gives them."""
    out = np.zeros((len(found), terms), np.float32)
    for row, (at, n) in zip(out, found):
        row += np.bincount(at, n, terms).astype(np.float32) if len(at) else 0
    return np.log1p(out, out=out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Voters:
    """idf times projection (terms x rank), the labelled unit vectors and their labels."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int, rank: int, k: int):
        self.terms, self.k, self.labels = terms, k, labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.vectors = None
        if len(texts):
            x = matrix(texts, terms)
            idf = np.log((1 + len(texts)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
            x = unit(x * idf)
            random = np.random.Generator(np.random.Philox(7)).standard_normal((terms, min(rank + 16, len(texts)))).astype(np.float32)
            q = np.linalg.qr(x @ random)[0]
            for _ in range(3):
                q = np.linalg.qr(x @ (x.T @ q))[0]
            v = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T
            self.project = idf[:, None] * v
            self.vectors = unit(x @ v)

    def scores(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior, np.float64)
        if self.vectors is None:
            return out
        k = min(self.k, len(self.vectors))
        for at in range(0, len(texts), block):
            z = matrix([terms_of(t, self.terms) for t in texts[at : at + block]], self.terms) @ self.project
            cosine = np.maximum(unit(z) @ self.vectors.T, 0)
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            w = np.take_along_axis(cosine, near, 1).astype(np.float64) ** 2
            total = w.sum(1)
            known = total > 1e-9
            out[at : at + block][known] = ((w * self.labels[near]).sum(1)[known] / total[known]).clip(0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4096, modulus: int = 3, held: int = 1, terms: int = 2048, rank: int = 64, k: int = 15) -> Voters:
    """The labelled vectors of at most `sample` rows outside the held-out remainder, chosen by a hash of doc_id."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__y")).where((remainder("__id", modulus) != held) & F.col("__y").isNotNull()).orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("__doc"), text_bytes().alias("__data")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))  # `sample` rows at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A text of any length is a few hundred sparse terms by now; the driver gets these, not texts.
        for b in batches:
            at, n = zip(*(terms_of(t, terms) for t in b.column(2).to_pylist())) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.float32()))], ["id", "y", "at", "n"])

    rows = rows.select("__id", "__y", "__data").mapInArrow(work, "id long, y int, at array<long>, n array<float>")
    found = rows.limit(4 * sample).toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    vectors = [(at.values.to_numpy(), n.values.to_numpy()) for at, n in zip(found["at"], found["n"])]
    return Voters(vectors, found["y"].to_numpy().astype(np.float32), terms, rank, k)


def score_quality(docs: DataFrame, voters: Voters) -> DataFrame:
    """docs plus score (double) and predicted (int)."""
    model = docs.sparkSession.sparkContext.broadcast(voters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.value.scores(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*b.schema.names[1:], "__score", "__predicted"])

    names = [n for n in docs.columns if n not in ("score", "predicted")]
    plain = docs.select(text_bytes().alias("__data"), *[F.col(f"`{n}`").alias(f"__c{k}") for k, n in enumerate(names)])
    fields = ", ".join(f"__c{k} {plain.schema[f'__c{k}'].dataType.simpleString()}" for k in range(len(names)))
    scored = plain.mapInArrow(work, f"{fields}, __score double, __predicted int")
    return scored.select(*[F.col(f"__c{k}").alias(n) for k, n in enumerate(names)], F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return score_quality(rows, fit(docs, labels)).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the classifier rejects."""
    names = docs.columns
    tagged = docs.select(F.struct("*").alias("row"), "text")
    return score_quality(tagged, fit(docs, labels)).where("predicted = 1").select(*[F.col(f"row.`{n}`").alias(n) for n in names])
