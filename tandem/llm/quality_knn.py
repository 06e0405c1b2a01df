"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes a weighted bag of terms: its words, hashed; the marks that stay when
plain letters are taken off its words (capitals, symbols, digits); and binned shares of
the whole (repeated neighbours, distinct words, repeated lines, capitals, symbols, word length).
A truncated singular value decomposition of a bounded sample of labelled rows
(``SAMPLE`` at most, the same in every run) gives the latent space. The labelled
vectors, a fixed number, are broadcast; every document gets its exact cosines with
all of them, block by block, and its ``NEIGHBOURS`` nearest vote for their labels, weighted by similarity; with the
last of them vote all that are as near.

Edge cases: null and empty texts are nearest to nothing and score the sample's share of
good labels; null ids are never learned from; without labels the score is 0.5;
equal texts score alike, and of equally near neighbours all count; texts are read whole, however long; extra columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .toxicity import fold_of

WORDS = 4096
MARKS = 1024
SIZE = WORDS + MARKS
RANK = 48
SAMPLE = 3000
NEIGHBOURS = 15
HOLD = (3, 1)
#: What the words weigh against marks and shares in a vector's length.
WORD_WEIGHT = 0.25
#: Similarities are raised to this power in the vote.
SHARP = 8
#: Similarities that agree in so many digits are equal.
DIGITS = 9

_PLAIN = bytes(c for c in range(256) if c >= 128 or 97 <= c <= 122)
_SHAPE = bytes(ord("X") if 65 <= c <= 90 else ord("9") if 48 <= c <= 57 else c for c in range(256))


def _bin(name: str, share: float, steps: int = 10) -> bytes:
    return f"{name}:{min(steps, round(share * steps))}".encode()


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, weights) of a text before inverse document frequencies; empty without words."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    bag = Counter(words)
    crc = zlib.crc32
    cols = [crc(w) % WORDS for w in bag]
    vals = 1 + np.log(np.fromiter(bag.values(), np.float64, len(bag)))
    left = data.translate(_SHAPE, _PLAIN).split()
    marks = Counter(left)
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    shares = [
        _bin("plain", 1 - len(left) / n),
        _bin("same", same / n),
        _bin("distinct", len(bag) / n, 5),
        _bin("lines", 1 - len(set(lines)) / len(lines)),
        _bin("capitals", sum(x.count(b"X") * k for x, k in marks.items()) / sum(map(len, words))),
        _bin("length", min(1.0, (len(data) - n) / (20 * n))),
    ]
    other = {WORDS + crc(m) % MARKS: 0.0 for m in marks}
    for m, k in marks.items():
        other[WORDS + crc(m) % MARKS] += k / n
    mark_cols, mark_vals = list(other), np.sqrt(np.array(list(other.values()))) if other else np.zeros(0)
    cols += mark_cols + [WORDS + crc(s) % MARKS for s in shares]
    vals = np.concatenate([vals, 3 * mark_vals, np.ones(len(shares))])
    cols = np.array(cols, np.int64)
    return cols, vals


class Voter:
    """Latent space and labelled vectors."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, seed: int = 42) -> None:
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.good = labels.astype(np.float64)
        df = np.zeros(SIZE)
        for cols, _ in bags:
            df[np.unique(cols)] += 1
        self.idf = np.log((1 + len(bags)) / (1 + df)) + 1
        self.space = np.zeros((SIZE, 0), np.float64)
        x = np.zeros((len(bags), SIZE), np.float64)
        for i, (cols, vals) in enumerate(bags):
            np.add.at(x[i], cols, self._weigh(cols, vals))
        if len(bags):
            rng = np.random.default_rng(seed)
            q = x @ rng.standard_normal((SIZE, rank + 8)).astype(np.float64)
            for _ in range(3):
                q, _ = np.linalg.qr(q)
                q, _ = np.linalg.qr(x.T @ q)
                q = x @ q
            q, _ = np.linalg.qr(q)
            _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
            self.space = np.ascontiguousarray(vt[:rank].T)
        self.vectors = self._unit(x @ self.space)

    def _weigh(self, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
        v = vals * self.idf[cols]
        word = cols < WORDS
        for part, weight in ((word, WORD_WEIGHT), (~word, 1.0)):
            length = np.sqrt((v[part] ** 2).sum())
            if length:
                v[part] *= weight / length
        return v.astype(np.float64)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, length, out=np.zeros_like(v), where=length > 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.good):
            return np.full(len(texts), self.share)
        found = np.zeros((len(texts), self.space.shape[1]), np.float64)
        for i, t in enumerate(texts):
            cols, vals = terms(t)
            if len(cols):
                found[i] = self._weigh(cols, vals) @ self.space[cols]
        found = self._unit(found)
        near = np.round(found @ self.vectors.T, DIGITS)
        k = min(NEIGHBOURS, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        weight = np.where(near >= least[:, None], np.maximum(near, 0) ** SHARP, 0.0)
        total = weight.sum(axis=1)
        voted = weight @ self.good
        # One more voter of small weight holds the sample's share: a text near to nothing gets that.
        return np.clip((voted + 0.01 * self.share) / (total + 0.01), 0, 1)


def train(docs: DataFrame, labels: DataFrame, hold: tuple[int, int] = HOLD, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Voter:
    """Learns from at most ``sample`` labelled rows outside the held-out fold; half of them of each label while there are enough."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    known = known.where(fold_of(F.col("doc_id"), hold[0]) != hold[1]).withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    pick = lambda good: known.where((F.col("y") > 0) == F.lit(good)).orderBy("h", "doc_id").limit(sample // 2)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(pick(True).unionByName(pick(False))), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [terms(t) for t in batch.column(1).to_pylist()]
            merged = [(np.unique(c), np.bincount(np.unique(c, return_inverse=True)[1], weights=v)) if len(c) else (c, v) for c, v in bags]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tolist() for c, _ in merged], pa.list_(pa.int64())), pa.array([v.tolist() for _, v in merged], pa.list_(pa.float64())), batch.column(2)],
                names=["doc_id", "cols", "vals", "y"],
            )

    # SIZE numbers a row and ``sample`` rows at most, unless ids repeat; then the first of an id counts.
    got = rows.mapInArrow(run, "doc_id long, cols array<long>, vals array<double>, y int").toArrow().to_pylist()
    once = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["cols"], r["vals"])):
        once.setdefault(r["doc_id"], r)
    kept = [r for r in once.values() if r["cols"]]
    return Voter([(np.array(r["cols"], np.int64), np.array(r["vals"])) for r in kept], np.array([min(1, r["y"]) for r in kept], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, hold: tuple[int, int] = HOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels, hold, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(1).to_pylist()).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(score, 6))], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold_of(F.col("doc_id"), hold[0]) == hold[1], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
