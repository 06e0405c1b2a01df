"""Operator 6 for a similarity of word sets: texts whose 5-word shingles have a Jaccard similarity of 0.8 or more.

A SimHash of 64 bits does not reach this: at 0.8 two fingerprints differ in about ten bits, which may leave no byte
shared. So the positional bytes of the inverted index are more: the 8 of the SimHash and ``MINIMA`` beside, each a byte
of the least of all shingles under one of as many hash functions, which two sets share with the probability of their
similarity. The index posts each text under keys of four positional bytes (four keys from each eight bytes); a pair met under any key is
tallied over all positions, and pairs below ``LEAST`` shared minima go, as do pairs whose sizes alone forbid
the similarity; the rest are verified on their whole sets. A pair at 0.8 escapes all keys with a
probability of 1e-5 and the tally with 4e-5; one at 0.85 either with 4e-7.

Texts with equal sets are one node. A key with more than ``HEAVY`` nodes has a centre, to which the others
are compared first; then only pairs of its nodes whose components still differ are, and of these only such as share
``COMMON`` of their rarest shingles (of n the n - ceil(0.8 n) + ``COMMON`` rarest; sets of the similarity always do). The centre is the node of least
hash, so that the keys of one group mostly have the same one. Components are those of all pairs, as in :mod:`simhash`.

Edge cases: words are as in :mod:`simhash`; fewer than five words are one shingle; null and empty texts
have no shingle and are one node; texts of any length are read whole; rows with equal ids each get a row; of ties
for a component's id the smallest counts; other columns may have any names and are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_ids, settle, small_batches
from .simhash import SEED, components, fingerprint_of, shingle_hashes

SHINGLE = 5
#: Least similarity, as a fraction.
ALIKE = (4, 5)
#: Bytes of minima, and how many of them a pair has to share. At a similarity of 0.8 the mean is 51.2 and the deviation 3.2.
MINIMA = 64
LEAST = 38
#: Rarest shingles that two sets must have in common before they are compared whole.
COMMON = 8
#: Nodes of a key whose pairs are all compared.
HEAVY = 16

LONGS = MINIMA // 8
#: Four bytes of eight: the halves, and every other one.
_MASKS = [0x00000000FFFFFFFF, 0xFFFFFFFF00000000, 0x00FF00FF00FF00FF, 0xFF00FF00FF00FF00]
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_NAMES = [f"b{k}" for k in range(LONGS + 1)]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted XXH64 values, signed."""
    return np.unique(shingle_hashes(text, size)).view(np.int64)


def minima(items: np.ndarray) -> np.ndarray:
    """``LONGS`` longs of positional bytes of a set of shingles; zeros for an empty one."""
    if not len(items):
        return np.zeros(LONGS, np.int64)
    values, out = items.view(np.uint64), np.full(MINIMA, ~np.uint64(0))
    for a in range(0, len(values), 4096):
        out = np.minimum(out, (values[a : a + 4096, None] * _FACTORS + _TERMS).min(axis=0))
    return ((out * _SPREAD) >> np.uint64(56)).astype(np.uint8).view(np.int64)


def _node(items: np.ndarray) -> int:
    h = xxhash.xxh64_intdigest(items.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def signatures(docs: DataFrame, id_col: str, text_col: str, carry_col: str | None, size: int = SHINGLE) -> DataFrame:
    """(doc_id, carry, node, size, b0..): a hash of each row's set, how large that is, and the positional bytes, the SimHash's last."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shingle_hashes(x, size) for x in batch.column(1).to_pylist()]
            sets = [np.unique(h).view(np.int64) for h in every]
            found = np.stack([np.append(minima(s), np.array([fingerprint_of(h)], np.uint64).view(np.int64)) for s, h in zip(sets, every)]) if sets else np.zeros((0, LONGS + 1), np.int64)
            columns = [batch.column(0), batch.column(2), pa.array([_node(s) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[:, k].copy()) for k in range(LONGS + 1))], names=["doc_id", "carry", "node", "size", *_NAMES])

    carry = F.col(carry_col) if carry_col else F.lit(None)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), carry.cast("string").alias("carry"))
    return source.mapInArrow(run, "doc_id long, carry string, node long, size int, " + ", ".join(f"{b} long" for b in _NAMES))


def _sets(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(node, items) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, size) for x in batch.column(0).to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), items], names=["node", "items"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "node long, items array<long>")


def _tally(a: str, b: str) -> Column:
    """How many minima two nodes share: positions less bytes in which their longs differ. A byte that differs keeps its lowest
    bit after its others are folded onto it; the masks keep neighbours out."""
    fold = lambda x, by, mask: x.bitwiseOR(F.shiftrightunsigned(x, by).bitwiseAND(F.lit(mask)))
    differ = F.lit(0)
    for k in range(LONGS):
        x = F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))
        for by, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3F3F3F3F3F3F3F3F), (1, 0x7F7F7F7F7F7F7F7F)):
            x = fold(x, by, mask)
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return MINIMA - differ


def _hopeful(a: str, b: str) -> Column:
    """The sizes allow the similarity, and enough positional bytes are shared."""
    p, q = ALIKE
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    return (x * q >= y * p) & (y * q >= x * p) & (_tally(a, b) >= LEAST)


def _verified(pairs: DataFrame, docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """Of ``pairs`` (a, b) those that are similar. Sets are formed again from the texts, and only those asked for are moved."""
    p, q = ALIKE
    pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    own = settle(join_ids(_sets(docs, text_col, size), ids, "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return settle(both.where(shared * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b"))


def links(nodes: DataFrame, docs: DataFrame, text_col: str = "text", size: int = SHINGLE, heavy: int = HEAVY) -> DataFrame:
    """(a, b): similar pairs of nodes that connect what all similar pairs connect. ``nodes`` has (node, size, b0..), settled."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    entries = [F.struct(F.lit(4 * k + i).alias("t"), F.col(b).bitwiseAND(F.lit(signed(m))).alias("v")) for k, b in enumerate(_NAMES) for i, m in enumerate(_MASKS)]
    keys = nodes.where("size > 0").select("node", F.explode(F.array(*entries)).alias("e")).select("node", "e.t", "e.v")
    lists = settle(keys.groupBy("t", "v").agg(F.count("*").alias("n"), F.min_by("node", F.struct(F.xxhash64("node"), "node")).alias("centre")).where("n > 1"))
    light = keys.join(lists.where(F.col("n") <= heavy).select("t", "v"), ["t", "v"])
    a, b = light.alias("a"), light.alias("b")
    # Pairs meet as bare keys; their bytes are fetched for each different pair once.
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.node") < F.col("b.node"))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    far = settle(keys.join(lists.where(F.col("n") > heavy).select("t", "v", "centre"), ["t", "v"]).select("t", "v", "node", "centre"))
    tied = far.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    first = _verified(_likely(met.unionByName(tied).distinct(), nodes), docs, text_col, size)
    if far.isEmpty():
        return first
    known = components(first)
    named = settle(far.select("t", "v", "node").join(known, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # Only lists in which components still differ, and there only pairs across them that share one of their rarest shingles.
    split = named.groupBy("t", "v").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("t", "v")
    rest = settle(named.join(split, ["t", "v"], "left_semi").select("node", "root").distinct().join(nodes, "node"))
    posted = settle(_prefixes(rest.select("node"), docs, text_col, size).join(rest, "node"))
    a, b = posted.alias("a"), posted.alias("b")
    p, q = ALIKE
    most = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) * (p + q) >= (F.col("a.size") + F.col("b.size")) * p
    common = F.array_intersect("a.x", "b.x")
    enough = (F.size(common) >= F.least("a.common", "b.common")) & (F.get(common, F.lit(0)) == F.col("a.s"))
    apart = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.root") < F.col("b.root")) & most & _hopeful("a", "b") & enough)
    return first.unionByName(_verified(apart.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), docs, text_col, size))


def _prefixes(asked: DataFrame, docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(node, at, s, x, common): of each node asked for its rarest shingles x by counts over all of them, rarest first, one row for each.

    Of n shingles these are n - ceil(0.8 n) + common, so two sets of the similarity have ``common`` of them in common (the
    lesser number of the two), and meet at the first. Copies of one text that are changed in different places have few.
    """
    p, q = ALIKE
    own = settle(join_ids(_sets(docs, text_col, size), asked, "node", "left_semi").dropDuplicates(["node"]))
    each = own.select("node", F.explode("items").alias("s"))
    ranked = each.join(each.groupBy("s").count(), "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "s"))).alias("x"))
    least = F.ceil(F.size("x") * p / q).cast("int")
    ranked = ranked.withColumn("common", F.least(F.lit(COMMON), least))
    ranked = ranked.withColumn("x", F.transform(F.slice("x", 1, F.size("x") - least + F.col("common")), lambda e: e["s"]))
    return ranked.select("node", "x", "common", F.posexplode("x").alias("at", "s"))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of (a, b) the pairs that the tally and the sizes let through."""
    x, y = nodes.alias("x"), nodes.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_hopeful("x", "y")).select("a", "b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry_col: str | None = None, size: int = SHINGLE, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, fingerprint, root, component_id[, carry]) of every row; root names the component, component_id is its smallest id."""
    rows = settle(signatures(docs, id_col, text_col, carry_col, size))
    nodes = settle(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("size", *_NAMES)]))
    roots = components(links(nodes.drop("least"), docs, text_col, size, heavy))
    known = settle(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    best = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(best, "root").select("node", "root", "component_id")
    fingerprint = F.lower(F.lpad(F.hex(_NAMES[-1]), 16, "0")).alias("fingerprint")
    return rows.join(named, "node").select("doc_id", fingerprint, "root", "component_id", *(["carry"] if carry_col else []))
