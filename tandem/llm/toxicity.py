"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary documents, give the probability of each word after the word
before it, interpolated down to the word alone and to its spelling:

* pairs of words are counted by the documents that hold them, single words by Kneser-Ney continuation
  (the different words that they follow), each class for itself; a count c is discounted by the whole part of ``2 sqrt(c)``, at most c,
  so that what a class shows a few times by chance leaves no trace;
* what the discounts free goes to backoff counts that both classes share: a pair's are those of both classes, a word's continuation
  count is there in how many classes it stands, and below it is the spelling, byte by byte after up to five bytes
  of the word, where a class's own counts at the longest sequence that fits are smoothed by shared
  continuation counts. A rare expression that tells nothing gets the same probability from both,
  and an inflected form of a toxic stem still gets its stem's evidence.

Every table is keyed by the sequence itself (bytes) or by 64-bit hashes of its words (pairs by their places among all of these), summed in Spark, and
so the same however rows are dealt to tasks. Entries that the discounts leave nothing are not kept: they
change no probability.

A document is judged by its log-likelihood ratio a word, over the whole and over its best passages of each
length in ``SPANS``, calibrated by a logistic fit on rows that the model in question has not counted (two halves,
drawn apart by class, crossed; a class of one text is not crossed). Which of the lengths count is chosen by cross-validation inside those rows.

The models learn from all labelled rows outside the held-out fold, if one is held out; equal texts count once. Texts stay where they are; the driver gets the
different words and byte sequences, the pairs that discounts leave something of, one model at a time, and four numbers of each text for the fit.

Edge cases: null and empty texts and texts without words score by the intercept alone; null ids are never
learned from; of labels that disagree on an id or a text the highest counts; with labelled texts of one class only
every score is the share of toxic labels (0 without labels); equal texts score alike, so ties are equal; texts are
read whole, however long; extra columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import BATCH_ROWS, forget, join_ids, release, settle, small_batches, small_table, unused

ORDERS = 6
#: Of the byte sequences: what a count is discounted by, and the shared counts that every class context is given.
DISCOUNT = 0.75
PULL = 16.0
#: Of the word sequences: standard errors by which a count is discounted.
ERRORS = 2.0
#: Words in the passages that are compared.
SPANS = (1, 4, 16)
#: A word's log ratio is held within this.
MOST = 6.0
MEMO = 400_000
#: Bytes by which beginnings of words are compared.
WIDTH = 24
#: Words and pairs that a task sums before it hands them on, and bits of the hash by which texts are ranked.
CHUNK_WORDS = 400_000
CHUNK_PAIRS = 3_000_000
BUCKET_BITS = 12
HOLD = (4, 2)
CUT = 0.3
FOLDS = 5

_START, _END = b"\x01", b"\x02"
#: ASCII that is no letter or digit separates words.
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The halves that each of the three models counts: the two that are crossed, and the whole one.
_HALVES = ((0,), (1,), (0, 1))
#: A count up to this is discounted entirely.
_GONE = int(ERRORS * ERRORS)
#: In place of the second word of a pair: all of them. The most that a packed count holds.
_ALL, _MOST = 0xFFFFFFFF, 0x7FFF


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(_SPACED).split()


def word_hash(word: bytes) -> int:
    """A word's signed 64-bit key; no word has that of the text's start, 0."""
    h = xxhash.xxh64_intdigest(word, 1)
    return h - (1 << 64) if h >> 63 else h


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The 64-bit key of a pair of words from their own."""
    a = v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = (a ^ (a >> np.uint64(32))) + w.view(np.uint64)
    a = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (a ^ (a >> np.uint64(32))).view(np.int64)


def discounted(c: np.ndarray) -> np.ndarray:
    """What of a word sequence's counts is taken off; whole numbers, so that their sums are exact."""
    return np.minimum(c, np.floor(ERRORS * np.sqrt(c)))


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each byte in its marked word; the last ``ORDERS`` bytes up to it, of which those before the word mean nothing; words' offsets.

    The key of a sequence holds its bytes themselves, the last one lowest: ``key_of``.
    """
    data = np.frombuffer(b"".join(_START + w + _END for w in words), np.uint8).astype(np.int64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(data)) - np.repeat(offsets, lengths)
    window = data.copy()
    for k in range(1, ORDERS):
        window[k:] += data[: max(len(data) - k, 0)] << (8 * k)
    return place, window, offsets


def key_of(window: np.ndarray, order: int) -> np.ndarray:
    """The keys of the sequences of ``order`` + 1 bytes at the end of each window."""
    return window & ((1 << (8 * (order + 1))) - 1)


def shared_beginnings(words: list[bytes], place: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of the marked words the number of the one that stands for it, and which bytes these are: one for each
    beginning, as far as a word begins as the one before it (``WIDTH`` bytes at most)."""
    n, lengths = len(words), np.array([len(w) for w in words], np.int64)
    begin = np.array(words, f"S{WIDTH}").view(np.uint8).reshape(n, WIDTH)  # words have no zero bytes
    same = np.logical_and.accumulate(begin[1:] == begin[:-1], axis=1).sum(axis=1)
    # The start's mark too is shared.
    shared = np.append(0, 1 + np.minimum(same, np.minimum(lengths[1:], lengths[:-1])))
    of_word = np.repeat(np.arange(n), lengths + 2)
    own = place >= shared[of_word]
    node = np.cumsum(own) - 1
    latest = np.zeros((n, WIDTH + 1), np.int64)
    at = np.flatnonzero(own & (place <= WIDTH))
    latest[of_word[at], place[at]] = node[at]
    latest = np.maximum.accumulate(latest, axis=0)
    at = np.flatnonzero(~own)
    node[at] = latest[of_word[at], place[at]]
    return node, np.flatnonzero(own)


def byte_counts(words: list[bytes], times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, keys, counts x 4) of the sequences in the words, each word as often as ``times`` (4 x words) counts it."""
    place, window, _ = spelled(words)
    every = np.repeat(times, np.array([len(w) + 2 for w in words], np.int64), axis=1)
    for o in range(ORDERS):
        fits = place >= max(o, 1)
        found, back = np.unique(key_of(window[fits], o), return_inverse=True)
        if len(found):
            yield o, found, np.stack([np.bincount(back, weights=n[fits], minlength=len(found)).astype(np.int64) for n in every])


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key in sorted ``keys``; their number where it is missing."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, np.minimum(at, len(keys) - 1), len(keys))


class Sorted:
    """Sorted 64-bit hashes, looked up by where those with the same upper bits begin. The table of beginnings is made where it is used."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.shift, self.begin = keys, np.uint64(64 - max(1, len(keys).bit_length())), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"begin": None}

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """As ``_find``."""
        upper = lambda h: (h.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift
        if self.begin is None:
            self.begin = np.searchsorted(upper(self.keys), np.arange(1 << (64 - int(self.shift)), dtype=np.uint64)).astype(np.int32)
        n = len(self.keys)
        at, out = self.begin[upper(wanted)].astype(np.int64), np.full(len(wanted), n, np.int64)
        open_ = np.flatnonzero(at < n)
        while len(open_):
            here = at[open_]
            found, sought = self.keys[here], wanted[open_]
            same = found == sought
            out[open_[same]] = here[same]
            open_ = open_[found < sought]
            at[open_] += 1
            open_ = open_[at[open_] < n]
        return out


class Spelling:
    """Byte models of the two classes. ``rows`` has of each order the sorted keys of the sequences and their counts (2 x keys)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        #: By order: sequences; their contexts; discounted shares and what contexts leave, shared and by class. The last place is for what was never seen.
        self.keys = [keys for keys, _ in rows]
        contexts_of, self.shared, self.shared_rest, self.own, self.own_rest = [], [], [], [], []
        for o, (keys, counts) in enumerate(rows):
            contexts, ctx = np.unique(keys >> 8, return_inverse=True)
            size = len(contexts) + 1
            contexts_of.append(contexts)
            if o < ORDERS - 1:
                above = rows[o + 1][0] & ((1 << (8 * (o + 1))) - 1)
                follow = np.bincount(_find(keys, above), minlength=len(keys) + 1)[: len(keys)].astype(np.float64)
                c = np.where(follow > 0, follow, counts.sum(axis=0))  # a sequence that only begins words has nothing before it
                total, kinds = np.bincount(ctx, weights=c, minlength=size), np.bincount(ctx, minlength=size)
                self.shared.append(np.append((c - DISCOUNT) / total[ctx], 0.0))
                self.shared_rest.append(np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0))
            self.own.append([])
            self.own_rest.append([])
            for i in range(2):
                total, off = np.bincount(ctx, weights=counts[i], minlength=size), np.bincount(ctx, weights=discounted(counts[i]), minlength=size)
                self.own[o].append(np.append((counts[i] - discounted(counts[i])) / (total[ctx] + PULL), 0.0))
                self.own_rest[o].append((off + PULL) / (total + PULL))
        # The longest sequences give no shared counts: those stay of which discounts leave something, and their contexts.
        o = ORDERS - 1
        at = np.flatnonzero((self.own[o][0] > 0) | (self.own[o][1] > 0))
        self.keys[o], self.own[o] = self.keys[o][at], [np.append(own[at], 0.0) for own in self.own[o]]
        at = np.flatnonzero((self.own_rest[o][0][:-1] < 1) | (self.own_rest[o][1][:-1] < 1))
        contexts_of[o], self.own_rest[o] = contexts_of[o][at], [np.append(rest[at], 1.0) for rest in self.own_rest[o]]
        #: By order: the place of a context from that of the sequence that ends one byte before; the last two are for what was never seen and for a word's start.
        start = np.array([_START[0]])
        self.context = [np.zeros(1, np.int32)]
        for o in range(1, ORDERS):
            self.context.append(np.concatenate([_find(contexts_of[o], rows[o - 1][0]), [len(contexts_of[o])], _find(contexts_of[o], start)]).astype(np.int32))

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """log P(spelling) of each word under the two classes, 2 x words. Words that begin as the one before them share its places:
        sorted words are fastest."""
        place, window, offsets = spelled(words)
        node, own = shared_beginnings(words, place, offsets)
        before, place, window = np.append(0, node)[own], place[own], window[own]
        low = np.full(len(place), 1 / 256)
        top = np.minimum(place, ORDERS - 1)
        out = np.zeros((2, len(place)))
        seen = np.empty(0, np.int64)
        for o in range(ORDERS):
            at = np.flatnonzero(top >= max(o, 1)) if o < 2 else at[top[at] >= o]
            if o:
                ctx = self.context[o][seen[before[at]]]
                # Of a sequence that was seen its end was.
                fits = np.flatnonzero(seen[at] < len(self.keys[o - 1]))
                entry = np.full(len(at), len(self.keys[o]))
                entry[fits] = _find(self.keys[o], key_of(window[at[fits]], o))
                last = top[at] == o
                here = at[last]
                for i in range(2):
                    out[i, here] = np.log(self.own[o][i][entry[last]] + self.own_rest[o][i][ctx[last]] * low[here])
            else:
                entry, ctx = _find(self.keys[0], key_of(window[at], 0)), np.zeros(len(at), np.int64)
            if o < ORDERS - 1:
                low[at] = self.shared[o][entry] + self.shared_rest[o][ctx] * low[at]
            seen = np.full(len(place), len(self.keys[o]) + (o == 0))
            seen[at] = entry
        return np.add.reduceat(out[:, node], offsets, axis=1)


class Words:
    """Models of words after words, from the counts that discounts leave something of.

    ``single`` has (key, class counts x 2, classes that hold it), ``totals`` the (sums, discounts) of both counts. Pairs come
    after them, so that the driver never holds the counts of both.
    """

    def __init__(self, single: tuple, totals: tuple) -> None:
        by = np.argsort(single[0], kind="stable")
        self.key, self.classes = Sorted(single[0][by]), np.append(single[3][by], 0).astype(np.int8)
        strong = by[(single[1][by] > _GONE) | (single[2][by] > _GONE)]
        self.strong = Sorted(single[0][strong])
        self.single = [self._left(c[strong], total) for c, (total, _) in zip(single[1:3], totals)]
        self.single_rest = [float(self._rest(off, total)) for total, off in totals[:2]]
        known, classes = (single[3] > 0).sum(), single[3].sum()
        self.shared = np.maximum(np.arange(3) - DISCOUNT, 0) / max(classes, 1)
        self.shared_rest = float(DISCOUNT * known / classes) if classes else 1.0

    @staticmethod
    def _left(c: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.append((c - discounted(c)) / np.maximum(total, 1), 0.0)

    @staticmethod
    def _rest(off: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.where(total > 0, off / np.maximum(total, 1), 1.0)

    def add_pairs(self, pairs: tuple, contexts: tuple) -> None:
        """``pairs`` (word before, word, counts x 3) and ``contexts`` (word before, sums x 3, discounts x 3) of either class and of both together."""
        by = np.argsort(contexts[0], kind="stable")
        self.context = contexts[0][by]
        total, off = [x[by] for x in contexts[1]], [x[by] for x in contexts[2]]
        self.rest = [np.append(self._rest(off[i], total[i]), 1.0) for i in range(3)]
        key = pair_hash(pairs[0], pairs[1])
        by = np.argsort(key, kind="stable")
        self.pair, at = Sorted(key[by]), _find(self.context, pairs[0][by])
        self.own = [self._left(pairs[2][i][by], np.append(total[i], 0)[at]) for i in range(3)]

    def alone(self, hashes: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """P(word) of each class, 2 x words, from the words' spelling probabilities."""
        at, shared = self.strong.find(hashes), self.shared[self.classes[self.key.find(hashes)]]
        return np.stack([self.single[i][at] + self.single_rest[i] * (shared + self.shared_rest * spelling[i]) for i in range(2)])

    def after(self, before: np.ndarray, word: np.ndarray, alone: np.ndarray, ctx: np.ndarray | None = None) -> np.ndarray:
        """P(word | word before) of each class: its own pairs, then those of both, then its words alone. After a word that one
        class alone has seen, the other one expects what both together do. ``ctx`` are the places of the words before, if known."""
        out = alone.copy()
        if ctx is None:
            ctx = _find(self.context, before)
        at = np.flatnonzero(ctx < len(self.context))
        if len(at):
            pair, ctx = self.pair.find(pair_hash(before[at], word[at])), ctx[at]
            for i in range(2):
                shared = self.own[2][pair] + self.rest[2][ctx] * alone[i, at]
                out[i, at] = self.own[i][pair] + self.rest[i][ctx] * shared
        return out


class Model:
    def __init__(self, spelling: Spelling, words: Words) -> None:
        self.spelling, self.words = spelling, words

    def describe(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(keys, 2 x probabilities) of words by themselves."""
        hashes = np.array([word_hash(w) for w in new], np.int64)
        return hashes, self.words.alone(hashes, np.exp(self.spelling.log_probabilities(new)))


class Memo:
    """What a worker remembers of words: their key, their probabilities and their place as a word before."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self._hold(MEMO)

    def _hold(self, size: int) -> None:
        """Room for so many words; what is not used yet takes no memory."""
        self.hashes, self.alone, self.ctx = np.empty(size, np.int64), np.empty((size, 2)), np.empty(size, np.int32)

    def look_up(self, words: list[bytes], model: Model) -> np.ndarray:
        different = set(words)
        new = sorted(different.difference(self.at))
        if len(self.at) + len(new) > len(self.hashes):
            self.clear()
            new = sorted(different)
            if len(new) > MEMO:
                self._hold(len(new))
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            hashes, alone = model.describe(part)
            here = slice(len(self.at), len(self.at) + len(part))
            self.at.update(zip(part, range(here.start, here.stop)))
            self.hashes[here], self.alone[here], self.ctx[here] = hashes, alone.T, _find(model.words.context, hashes)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))


def ratios(words: list[bytes], first: np.ndarray, model: Model, memo: Memo) -> np.ndarray:
    """log P(word | before, toxic) - log P(word | before, ordinary); ``first`` are the places where a text starts."""
    at = memo.look_up(words, model)
    hashes = memo.hashes[at]
    before, ctx = np.concatenate([[0], hashes[:-1]]), np.concatenate([[0], memo.ctx[at[:-1]]])
    before[first], ctx[first] = 0, _find(model.words.context, np.zeros(1, np.int64))[0]
    p = np.log(np.maximum(model.words.after(before, hashes, memo.alone[at].T, ctx), 1e-300))
    return np.clip(p[1] - p[0], -MOST, MOST)


def features(texts: list[str | None], model: Model, memo: Memo) -> np.ndarray:
    """For each text the log ratio a word: over the whole, and over its best passage of each of ``SPANS``.
    A text shorter than a span is as if ordinary words without evidence followed."""
    split = [words_of(t) for t in texts]
    out = np.zeros((len(texts), 1 + len(SPANS)))
    lengths = np.array([len(ws) for ws in split], np.int64)
    if not lengths.any():
        return out
    ends = np.cumsum(lengths)
    first = (ends - lengths)[lengths > 0]
    r = ratios([w for ws in split for w in ws], first, model, memo)
    for i, (end, n) in enumerate(zip(ends, lengths)):
        if n:
            upto = np.concatenate([[0], np.cumsum(r[end - n : end])])
            out[i, 0] = upto[-1] / n
            for j, span in enumerate(SPANS, 1):
                k = min(span, n)
                out[i, j] = (upto[k:] - upto[:-k]).max() / span
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, spread, weights with the intercept first) by Newton steps on standardised columns.

    All columns are evidence for a positive label, so no weight may be negative: the most negative one is
    set to zero and the rest is fitted again. More evidence then never lowers a score, also beyond
    what the fit has seen, as in a text of toxic words alone.
    """
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1
    blocks = [slice(a, a + 100_000) for a in range(0, len(x), 100_000)]
    used = list(range(x.shape[1] + 1))
    while True:
        w = np.zeros(len(used))
        pull = np.diag([1e-6] + [ridge] * (len(used) - 1))
        for _ in range(50):
            bent, slope = pull.copy(), -pull @ w
            for b in blocks:
                z = np.hstack([np.ones((len(x[b]), 1)), (x[b] - mean) / spread])[:, used]
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                bent += (z * (p * (1 - p))[:, None]).T @ z
                slope += z.T @ (y[b] - p)
            step = np.linalg.solve(bent, slope)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        worst = int(np.argmin(w[1:])) + 1 if len(used) > 1 else 0
        if not worst or w[worst] >= 0:
            break
        del used[worst]
    out = np.zeros(x.shape[1] + 1)
    out[used] = w
    return mean, spread, out


def _probability(x: np.ndarray, fit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, spread, w = fit
    return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / spread) @ w[1:], -30, 30)))


def chosen_columns(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[int]:
    """The whole text's ratio and those spans that give the least cross-validated log loss; of equal losses the fewest columns."""
    best, found = np.inf, [0]
    sets = [[0], *[[0, j] for j in range(1, x.shape[1])], *[[0, i, j] for i in range(1, x.shape[1]) for j in range(i + 1, x.shape[1])], list(range(x.shape[1]))]
    for columns in sets:
        loss = 0.0
        for f in range(FOLDS):
            held = fold == f
            if held.any() and 0 < y[~held].mean() < 1:
                p = np.clip(_probability(x[held][:, columns], logistic(x[~held][:, columns], y[~held])), 1e-6, 1 - 1e-6)
                loss -= (y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).sum()
        if loss < best - 1e-9:
            best, found = loss, columns
    return found


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


class Scorer:
    """A fitted model with its calibration; ``share`` stands in where there is nothing to tell classes apart."""

    def __init__(self, model: Model | None, columns: list[int], fit: tuple | None, share: float) -> None:
        self.model, self.columns, self.fit, self.share = model, columns, fit, share

    def __call__(self, texts: list[str | None], memo: Memo) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.share)
        return _probability(features(texts, self.model, memo)[:, self.columns], self.fit)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (w, h, n0..n3) from (text, y, half): words, their keys, and by half and class the documents that hold them."""

    def emit(held: dict[bytes, int]) -> pa.RecordBatch:
        n = np.fromiter(held.values(), np.int64, len(held))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(map(word_hash, held)), pa.int64()), *[pa.array(n >> (16 * c) & 0xFFFF) for c in range(4)]], names=["w", "h", "n0", "n1", "n2", "n3"])

    # 16 bits of one number for each half and class, as in pairs_counter.
    held: dict[bytes, int] = {}
    get, size = held.get, 0
    for batch in batches:
        for text, y, half in zip(*(batch.column(i).to_pylist() for i in range(3))):
            one = 1 << (16 * (2 * half + (y > 0)))
            for w in set(words_of(text)):
                held[w] = get(w, 0) + one
        size += batch.num_rows
        if len(held) > CHUNK_WORDS or size > _MOST - BATCH_ROWS:
            yield emit(held)
            held = {}
            get, size = held.get, 0
    if held:
        yield emit(held)
    del get
    del held
    release()


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (o, a, n0..n3) from (w, n0..n3): of byte sequences their order and key, counted as often as their words."""
    words: list[bytes] = []
    times: list[np.ndarray] = []

    def emit() -> Iterator[pa.RecordBatch]:
        for o, found, n in byte_counts(words, np.concatenate(times, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), o, np.int32)), pa.array(found), *map(pa.array, n)], names=["o", "a", "n0", "n1", "n2", "n3"])

    for batch in batches:
        words += batch.column(0).to_pylist()
        times.append(np.stack([batch.column(i).to_numpy() for i in range(1, 5)]))
        if len(words) > 50_000:
            yield from emit()
            words, times = [], []
    if words:
        yield from emit()


def pairs_counter(shared):
    """Rows (key, n) from (text, y, half): the places of both words of a pair in the shared sorted word keys, the one before in the
    upper 32 bits, and, 16 bits for each half and class, the documents that hold it. A pair with ``_ALL`` has those of all
    pairs after its first word, in as many rows as it takes."""

    def emit(codes: list[np.ndarray], columns: list[int]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate(codes)
        n = np.repeat(np.array([1 << (16 * c) for c in columns], np.int64), [len(c) for c in codes])
        by = np.argsort(key)
        key, n = key[by], n[by]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[at], np.add.reduceat(n, at)
        at = np.flatnonzero(np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32]))
        before = (key[at] >> 32 << 32) + _ALL
        sums = np.stack([np.add.reduceat(n >> (16 * c) & 0xFFFF, at) for c in range(4)])
        while len(before):
            part = np.minimum(sums, _MOST)
            key, n = np.append(key, before), np.append(n, sum(part[c] << (16 * c) for c in range(4)))
            sums = sums - part
            some = sums.any(axis=0)
            before, sums = before[some], sums[:, some]
        for i in range(0, len(key), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 200_000]), pa.array(n[i : i + 200_000])], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = shared.value, {}
        codes: list[np.ndarray] = []
        columns: list[int] = []
        size = 0
        for batch in batches:
            text, y, half = (batch.column(i).to_pylist() for i in range(3))
            split = [words_of(t) for t in text]
            new = list({w for words in split for w in words}.difference(places))
            places.update(zip(new, np.searchsorted(keys, np.array(list(map(word_hash, new)), np.int64)).tolist()))
            start = int(np.searchsorted(keys, 0))
            for words, t, h in zip(split, y, half):
                if words:
                    at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                    codes.append(np.unique((np.concatenate([[start], at[:-1]]) << 32) + at))
                    columns.append(2 * h + (t > 0))
                    size += len(codes[-1])
            if size > CHUNK_PAIRS or len(codes) > _MOST - BATCH_ROWS:
                yield from emit(codes, columns)
                codes, columns, size = [], [], 0
            if len(places) > CHUNK_WORDS:
                places = {}
        if codes:
            yield from emit(codes, columns)
        del codes, places
        release()

    return run


def _columns(df: DataFrame, names: list[str]) -> list[np.ndarray]:
    """The columns, whole numbers of Spark's own width."""
    t = df.select(names).toArrow()
    out = [t.column(c).to_numpy() for c in names]
    del t
    release()
    return out


class Counts:
    """What (text, y, half) rows hold, all of them, summed in Spark and settled; models are made from it one at a time.

    Single words are counted by the different words before them. Of pairs those are kept whose count in all rows is not discounted
    entirely; a context's discounts are its sum less what discounts leave of these.
    """

    def __init__(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(4)]
        words = settle(rows.mapInArrow(_vocabulary, "w binary, h long, n0 long, n1 long, n2 long, n3 long").groupBy("w", "h").agg(*sums))
        self.keys = np.unique(np.append(_columns(words, ["h"])[0], 0))  # 0: a text's start
        spelt = words.select("w", "n0", "n1", "n2", "n3").mapInArrow(_spellings, "o int, a long, n0 long, n1 long, n2 long, n3 long")
        self.sequences = settle(spelt.groupBy("o", "a").agg(*sums))
        forget(words)
        shared = spark.sparkContext.broadcast(self.keys)
        each = [F.shiftright("n", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
        types = rows.mapInArrow(pairs_counter(shared), "key long, n long").repartition("key").groupBy("key").agg(*[F.sum(e).alias(f"n{i}") for i, e in enumerate(each)])
        n = {(m, c): sum((F.col(f"n{2 * h + c}") for h in halves[1:]), F.col(f"n{2 * halves[0] + c}")) for m, halves in enumerate(_HALVES) for c in range(2)}
        strong = F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3") > _GONE
        types = types.withColumn("b", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))).withColumn("a", F.when(strong, F.shiftright("key", 32)))
        kinds = [F.sum((x > 0).cast("long")).alias(f"k{m}{c}") for (m, c), x in n.items()]
        self.found = settle(types.groupBy("b", "a").agg(*kinds, *sums))
        shared.destroy()

    def model(self, m: int) -> Model:
        """The model of the halves ``_HALVES[m]``."""
        here = [F.col(f"k{m}{c}") for c in range(2)]
        single = self.found.where(F.col("b") != _ALL).groupBy("b").agg(*[F.sum(k).alias(f"k{c}") for c, k in enumerate(here)])
        # Places, and so the numbers of different words, take 31 bits at most.
        word, *kinds = _columns(single.where("k0 + k1 > 0").select(*[F.col(c).cast("int") for c in ("b", "k0", "k1")]), ["b", "k0", "k1"])
        totals = [(int(k.sum()), int(discounted(k).sum())) for k in kinds]
        words = Words((self.keys[word], *kinds, sum((k > 0).astype(np.int8) for k in kinds)), totals)
        del word, kinds
        release()
        n = [sum((F.col(f"n{2 * h + c}") for h in _HALVES[m][1:]), F.col(f"n{2 * _HALVES[m][0] + c}")) for c in range(2)]
        kept = self.found.where("a is not null").select("a", "b", *[x.alias(f"c{c}") for c, x in enumerate(n)]).where(F.col("c0") + F.col("c1") > _GONE)
        before, after, *own = _columns(kept.where(F.col("b") != _ALL).select(F.col("a").cast("int"), F.col("b").cast("int"), "c0", "c1"), ["a", "b", "c0", "c1"])
        own.append(own[0] + own[1])
        context, *sums = _columns(kept.where(F.col("b") == _ALL), ["a", "c0", "c1"])
        needed = np.isin(context, before)
        context, sums = context[needed], [x[needed] for x in sums]
        by = np.argsort(context)
        context, sums = context[by], [x[by] for x in sums]
        sums.append(sums[0] + sums[1])
        at = np.searchsorted(context, before)
        off = [total - np.bincount(at, weights=c - discounted(c), minlength=len(context)).astype(np.int64) for c, total in zip(own, sums)]
        words.add_pairs((self.keys[before], self.keys[after], own), (self.keys[context], sums, off))
        del before, after, own, at, off, sums, context, by, needed
        release()
        by_class = [sum((F.col(f"n{2 * h + c}") for h in _HALVES[m][1:]), F.col(f"n{2 * _HALVES[m][0] + c}")).alias(f"c{c}") for c in range(2)]
        rows = []
        for o in range(ORDERS):
            key, *n2 = _columns(self.sequences.where(F.col("o") == o).select("a", *by_class).where("c0 + c1 > 0"), ["a", "c0", "c1"])
            by = np.argsort(key, kind="stable")
            rows.append((key[by], np.stack([x[by].astype(np.float64) for x in n2])))
        del key, n2, by
        release()
        return Model(Spelling(rows), words)

    def forget(self) -> None:
        forget(self.sequences)
        forget(self.found)


def fit_models(rows: DataFrame) -> list[Model]:
    """The models of both halves and of the whole from (text, y, half) rows."""
    counts = Counts(rows)
    return [counts.model(m) for m in range(len(_HALVES))]


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, int]]:
    """Rows (text, y, half, id) of all different texts that ``labels`` (doc_id, y) names, and how many each class has.
    Halves alternate within a class by a hash of the text: ranks go by buckets of the hash, so no task sees a whole class."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    kept = settle(join_ids(texts, labels.select("doc_id", label_col), "doc_id").select("text", F.xxhash64("text").alias("id"), F.unhex(F.md5("text")).alias("same"), (F.col(label_col) > 0).cast("int").alias("y"), F.monotonically_increasing_id().alias("row")))
    once = settle(kept.groupBy("id", "same").agg(F.max("y").alias("y"), F.min("row").alias("row")).withColumn("bucket", F.shiftright("id", 64 - BUCKET_BITS)))
    sizes = sorted((r["y"], r["bucket"], r["n"]) for r in once.groupBy("y", "bucket").agg(F.count("*").alias("n")).collect())
    have: dict[int, int] = {}
    offsets = []
    for y, bucket, n in sizes:
        offsets.append((y, bucket, have.get(y, 0)))
        have[y] = have.get(y, 0) + n
    known = small_table(docs.sparkSession, offsets, "y int, bucket long, before long")
    nth = F.col("before") + F.row_number().over(W.partitionBy("y", "bucket").orderBy("id", "same"))
    halves = once.join(F.broadcast(known), ["y", "bucket"]).select("row", "y", (nth % 2).cast("int").alias("half"))
    return join_ids(kept.select("text", "id", "row"), halves, "row").select("text", "y", "half", "id"), have


def train(docs: DataFrame, labels: DataFrame, hold: tuple[int, int] | None = HOLD, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Learns from all labelled rows whose fold is not the held-out one; without ``hold`` from all labelled rows."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    if hold:
        known = known.where(fold_of(F.col("doc_id"), hold[0]) != hold[1])
    rows, have = labelled_texts(docs, known, "y", id_col, text_col)
    if len(have) < 2:
        share = known.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
        return Scorer(None, [], None, float(share or 0.0))
    counts = Counts(rows)

    def described(part: DataFrame, model: Model) -> pa.Table:
        shared = spark.sparkContext.broadcast(model)
        del model
        release()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = Memo()
            for batch in batches:
                x = features(batch.column(0).to_pylist(), shared.value, memo)
                yield pa.RecordBatch.from_arrays([*[pa.array(x[:, j]) for j in range(x.shape[1])], batch.column(1), batch.column(2)], names=[*names, "y", "id"])
            del memo
            release()

        names = [f"x{j}" for j in range(1 + len(SPANS))]
        found = part.select("text", "y", "id").mapInArrow(run, ", ".join(f"{c} double" for c in names) + ", y int, id long").toArrow()
        shared.destroy()
        return found

    if min(have.values()) > 1:
        found = pa.concat_tables([described(rows.where(F.col("half") == i), counts.model(1 - i)) for i in range(2)])
        model = counts.model(2)
    else:
        model = counts.model(2)
        found = described(rows, model)
    counts.forget()
    x, y = np.stack([found.column(j).to_numpy() for j in range(1 + len(SPANS))], axis=1), found.column("y").to_numpy().astype(np.float64)
    by = np.lexsort([*x.T[::-1], y, found.column("id").to_numpy()])
    del found
    x, y = x[by], y[by]
    columns = chosen_columns(x, y, np.arange(len(y)) % FOLDS)
    return Scorer(model, columns, logistic(x[:, columns], y), 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, hold: tuple[int, int] = HOLD, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scorer = train(docs, labels, hold, id_col=id_col, text_col=text_col)
    scored = add_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scorer, name="score")
    held = F.coalesce(fold_of(F.col("doc_id"), hold[0]) == hold[1], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def add_score(docs: DataFrame, scorer: Scorer, text_col: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with the score as its last column, ``name`` or ``_score`` with as many underscores before it as it takes
    to clash with none; rows pass through one Arrow map."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)
    names = [*docs.columns, name or unused(docs, "_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            score = shared.value(batch.column(at).to_pylist(), memo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(score, 6))], names=names)
        del memo
        release()

    del scorer
    release()
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[-1], DoubleType())]))
