"""Benchmark decontamination: BM25 over test items with block-max WAND.

The inverted index holds the test items; training passages are its queries. A text is cut
into chunks a quarter longer than an item may be, and every two neighbouring chunks make a
passage, so that whatever is as long as an item lies within one. Items are indexed by classes of length, each with
passages of its own size. A passage retrieves each item whose BM25 score reaches ``RATIO`` of the score that the item gives
itself; impacts are divided by that threshold, so that 1 is enough. Document frequencies, mean length and the
number of items are those of the whole benchmark, however the items are dealt.

Retrieval has two steps, and neither misses an item that reaches 1:

* the passages of a batch of texts are opened only through essential postings: of each item the most common terms, as many as
  weigh ``REST`` together at most, have none, since they cannot lift a passage over 1 without others. Only passages in
  which some item's essential impacts reach 1 - (what the rest of it weighs) go on;
* these run block-max WAND: the cursors of the passage's postings lists stand in the order of their items, the
  pivot is the first item at which the lists' bounds up to it reach 1; if the bounds of the blocks around the
  pivot do not, all lists skip to the end of the nearest block, else the item is scored exactly.

Retrieved items are verified: in some window a quarter longer than the item, the question and the answer must
each have ``OVERLAP`` of their distinct words, and the whole ``PAIRS`` of its word pairs. Question and answer are what
stands before and after a mark ``answer:`` in the item, else its two halves. Items under five words must stand there as they are.

An index holds at most ``SHARD`` items and is broadcast; larger benchmarks are dealt into shards by hash, which give the same
rows, each a pass of its own over the texts, with one index at a time on the workers.

Edge cases: null and empty texts and items match nothing, and items without an id are left out; items with equal texts are each
reported; equal rows give equal rows; ties all count, as no top list is kept; texts are read whole, however long;
extra columns may have any names; empty tables give no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches
from .toxicity import words_of

K1 = 1.2
B = 0.75
#: Thresholds that find at least nine in ten passages of which four in five words are left.
RATIO = 0.55
OVERLAP = 0.55
PAIRS = 0.35
#: What an item's inessential terms weigh at most, of the threshold.
REST = 0.4
#: Postings in a block.
BLOCK = 8
#: Items in one index.
SHARD = 20_000
#: Words of the shortest class of items, and by how much the next one's are longer.
SHORT, LONGER = 64, 4
EDGE = 1 - 1e-9
MARK = b"answer"


def length_class(n: int) -> int:
    """The most words that items of the class of an item of ``n`` words have."""
    size = SHORT
    while size < n:
        size *= LONGER
    return size


def parts_of(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item, as words: by a mark 'answer:' with words on both sides, else its halves."""
    raw = text or ""
    at = raw.lower().rfind("answer:")
    if at >= 0:
        question, answer = words_of(raw[:at]), words_of(raw[at + len("answer:") :])
        if question and answer:
            return question, [MARK, *answer]
    words = words_of(raw)
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


class Statistics:
    """What BM25 has to know of the whole benchmark."""

    def __init__(self, items: int, mean: float, df: dict[bytes, int]) -> None:
        self.items, self.mean, self.df = items, mean, df

    @classmethod
    def of(cls, texts) -> Statistics:
        words = [w for w in map(words_of, texts) if w]
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), Counter(t for w in words for t in set(w)))

    def impacts(self, words: list[bytes]) -> dict[bytes, float]:
        """BM25 of each term in an item, over the item's threshold."""
        length = K1 * (1 - B + B * len(words) / self.mean)
        own = {}
        for t, f in Counter(words).items():
            own[t] = math.log(1 + (self.items - self.df[t] + 0.5) / (self.df[t] + 0.5)) * f * (K1 + 1) / (f + length)
        least = RATIO * math.fsum(own.values())
        return {t: v / least for t, v in own.items()}


class Postings:
    """A term's items in order, their impacts, and the highest of each block and of all."""

    def __init__(self, rows: list[tuple[int, float]]) -> None:
        self.items, self.impacts = [i for i, _ in rows], [v for _, v in rows]
        self.ends = [self.items[min(a + BLOCK, len(rows)) - 1] for a in range(0, len(rows), BLOCK)]
        self.block_max = [max(self.impacts[a : a + BLOCK]) for a in range(0, len(rows), BLOCK)]
        self.most = max(self.impacts)


def block_max_wand(lists: list[Postings]) -> list[tuple[int, float]]:
    """(item, score) of every item whose impacts in the lists add up to 1."""
    out = []
    cursors = [[p.items[0], k, 0] for k, p in enumerate(lists)]  # item under the cursor, list, place

    def move(cursor: list, item: int) -> bool:
        """Moves to the first posting at ``item`` or beyond; whether there is one."""
        p = lists[cursor[1]]
        cursor[2] = bisect_left(p.items, item, cursor[2])
        if cursor[2] == len(p.items):
            return False
        cursor[0] = p.items[cursor[2]]
        return True

    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for n, (item, k, _) in enumerate(cursors):
            bound += lists[k].most
            if bound >= EDGE:
                pivot = item
                break
        if pivot < 0:
            break
        while n + 1 < len(cursors) and cursors[n + 1][0] == pivot:
            n += 1
        ahead = cursors[: n + 1]
        bound, skip = 0.0, cursors[n + 1][0] if n + 1 < len(cursors) else math.inf
        for _, k, at in ahead:
            p = lists[k]
            block = bisect_left(p.ends, pivot, at // BLOCK)
            if block < len(p.ends):
                bound += p.block_max[block]
                skip = min(skip, p.ends[block] + 1)
        if bound >= EDGE:
            skip = pivot + 1
            scores = []
            for c in ahead:
                if move(c, pivot) and c[0] == pivot:
                    scores.append(lists[c[1]].impacts[c[2]])
            score = math.fsum(scores)
            if score >= EDGE:
                out.append((pivot, score))
        elif skip is math.inf:
            break
        cursors = [c for c in ahead if move(c, skip)] + cursors[n + 1 :]
    return out


class Shelf:
    """The index of the items of one length class; ``items`` are (item_id, text)."""

    def __init__(self, items: list[tuple[int, str | None]], most: int, stats: Statistics) -> None:
        self.size = most + most // 4 + 1
        self.ids = [i for i, _ in items]
        self.parts = [parts_of(t) for _, t in items]
        impacts = [stats.impacts(q + a) for q, a in self.parts]
        postings: dict[bytes, list[tuple[int, float]]] = {}
        essential: dict[bytes, list[tuple[int, float]]] = {}
        rest = []
        for at, own in enumerate(impacts):
            left, common = 0.0, set()
            for t in sorted(own, key=lambda t: (-stats.df[t], t)):
                if left + own[t] > REST:
                    break
                left += own[t]
                common.add(t)
            rest.append(left)
            for t, v in own.items():
                postings.setdefault(t, []).append((at, v))
                if t not in common:
                    essential.setdefault(t, []).append((at, v))
        self.rest = np.array(rest)
        self.lists = {t: Postings(rows) for t, rows in postings.items()}
        self.term = {t: k for k, t in enumerate(sorted(essential))}
        flat = [row for t in sorted(essential) for row in essential[t]]
        self.item_of, self.impact_of = np.array([i for i, _ in flat], np.int64), np.array([v for _, v in flat])
        self.start = np.cumsum([0] + [len(essential[t]) for t in sorted(essential)])

    def passages(self, split: list[list[bytes]]) -> list[tuple[int, int]]:
        """(text, first chunk) of the passages in which some item may reach 1."""
        counts = np.array([len(w) for w in split], np.int64)
        get = self.term.get
        term = np.fromiter((t for w in split for t in map(get, w, repeat(-1))), np.int64, int(counts.sum()))
        known = np.flatnonzero(term >= 0)
        if not len(known):
            return []
        # Chunks are numbered through; after a text's last one a number is left out, so that texts have no passage in common.
        first_word = np.cumsum(counts) - counts
        chunks = counts // self.size + 2
        base = np.cumsum(chunks) - chunks
        text = np.searchsorted(first_word, known, side="right") - 1
        chunk = base[text] + (known - first_word[text]) // self.size
        term = term[known]
        first, many = self.start[term], self.start[term + 1] - self.start[term]
        entry = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        n = len(self.ids)
        # A term that stands twice in a chunk only raises a bound.
        cell, place = np.unique(np.repeat(chunk, many) * n + self.item_of[entry], return_inverse=True)
        total = np.bincount(place, weights=self.impact_of[entry], minlength=len(cell))
        follow = np.searchsorted(cell, cell + n)
        inside = follow < len(cell)
        follow[~inside] = 0
        inside &= cell[follow] == cell + n
        need = EDGE - self.rest[cell % n]
        here = cell[total + np.where(inside, total[follow], 0.0) >= need] // n
        alone = cell[total >= need] // n - 1  # also the second chunk of a passage that begins before
        found = np.unique(np.concatenate([here, alone]))
        of = np.searchsorted(base, found, side="right") - 1
        keep = (found >= 0) & (found - base[of] < chunks[of] - 1)
        return [(int(t), int(c - base[t])) for t, c in zip(of[keep], found[keep])]

    def retrieve(self, words: list[bytes], chunk: int) -> list[tuple[int, float]]:
        """(item, score) of all items that reach 1 in the passage of chunks ``chunk`` and the next."""
        passage = sorted(set(words[chunk * self.size : (chunk + 2) * self.size]))
        return block_max_wand([p for p in map(self.lists.get, passage) if p is not None])

    def verify(self, item: int, passage: list[bytes]) -> bool:
        """Whether some window of the passage, a quarter longer than the item, overlaps question and answer."""
        q, a = self.parts[item]
        own = q + a
        n = len(own)
        span = n + n // 4
        if n < 5:
            return any(passage[i : i + n] == own for i in range(len(passage) - n + 1))
        question, answer, pairs = set(q), set(a), set(zip(own, own[1:]))
        every = question | answer
        for i, w in enumerate(passage):
            if w in every:
                window = passage[i : i + span]
                there = set(window)
                if len(question & there) >= OVERLAP * len(question) and len(answer & there) >= OVERLAP * len(answer):
                    if len(pairs & set(zip(window, window[1:]))) >= PAIRS * len(pairs):
                        return True
        return False


class Index:
    """The inverted index of (item_id, text) rows, a shelf for each length class."""

    def __init__(self, items: list[tuple[int, str | None]], stats: Statistics | None = None) -> None:
        stats = stats or Statistics.of(t for _, t in items)
        classes: dict[int, list[tuple[int, str | None]]] = {}
        for i, t in sorted(items, key=lambda x: (x[0], x[1] or "")):
            n = sum(map(len, parts_of(t)))
            if n:
                classes.setdefault(length_class(n), []).append((i, t))
        self.shelves = [Shelf(rows, most, stats) for most, rows in sorted(classes.items())]

    def matches_all(self, texts: list[str | None]) -> list[dict[int, float]]:
        """Of each text item_id -> highest score over the threshold."""
        split = [words_of(t) for t in texts]
        out: list[dict[int, float]] = [{} for _ in texts]
        for shelf in self.shelves:
            for t, chunk in shelf.passages(split):
                passage = split[t][chunk * shelf.size : (chunk + 2) * shelf.size]
                for item, score in shelf.retrieve(split[t], chunk):
                    i = shelf.ids[item]
                    if score > out[t].get(i, 0.0) and shelf.verify(item, passage):
                        out[t][i] = score
        return out

    def matches(self, text: str | None) -> dict[int, float]:
        return self.matches_all([text])[0]


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, shard: int) -> Iterator[Index]:
    """The shards' indexes, with the statistics of the whole benchmark; one shard's items and terms at a time reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[w for part in parts_of(t) for w in part] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary())), pa.array(map(len, words), pa.int64())], names=["i", "t", "terms", "n"])

    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    items = settle(items.mapInArrow(run, "i long, t string, terms array<binary>, n long").where("n > 0"))
    whole = items.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    if not whole["n"]:
        return
    df = settle(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    shards = -(-whole["n"] // shard)
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == k)
        terms = part.select(F.explode("terms").alias("term")).distinct().join(df, "term")
        yield Index([(r["i"], r["t"]) for r in part.select("i", "t").collect()], Statistics(whole["n"], whole["mean"], {bytes(r["term"]): r["df"] for r in terms.collect()}))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, score) of every document and test item that it holds; score is BM25 over the item's threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shape = "doc_id long, item_id long, score double"

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = index.matches_all(batch.column(1).to_pylist())
                rows = [(d, i, s) for d, own in zip(batch.column(0).to_pylist(), found) for i, s in sorted(own.items())]
                cols = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(np.round(cols[2], 6), pa.float64())], names=["doc_id", "item_id", "score"])

        return run

    parts, last = [], None
    for index in _indexes(benchmark, item_col, item_text_col, shard):
        if last is not None:
            parts[-1] = settle(parts[-1])
            last.unpersist()
        last = spark.sparkContext.broadcast(index)
        parts.append(source.mapInArrow(scan(last), shape))
    out = parts[0] if parts else spark.createDataFrame([], shape)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` that hold no test item, columns as they came. One map over the rows for each shard, no join."""
    spark = docs.sparkSession
    small_batches(spark)

    def scan(shared, at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in shared.value.matches_all(batch.column(at).to_pylist())], pa.bool_()))

        return run

    last = None
    for index in _indexes(benchmark, item_col, item_text_col, shard):
        if last is not None:
            docs = settle(docs)
            last.unpersist()
        last = spark.sparkContext.broadcast(index)
        docs = docs.mapInArrow(scan(last, docs.columns.index(text_col)), docs.schema)
    return docs
