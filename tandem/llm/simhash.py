"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two texts are linked either by the bits of their fingerprints (``max_bits``; this module) or, by default, by the similarity
of their sets of 5-word shingles (0.8; :mod:`near_copies`, the same index over more positional bytes).

Fingerprints: a text's words (A-Z lower-cased, split at ASCII white space) give
word shingles; a bit is set where over half of the shingles' XXH64 values have it.

Links by bits: two fingerprints that differ in at most 3 bits agree in at least 5 of their
8 bytes. The index posts each fingerprint under positional bytes; one byte alone
selects a 256th of all fingerprints, so postings are merged three at a time: of any
5 byte positions at least 3 lie in one half, hence the 8 triples inside the two halves
reach every pair with 5 shared bytes; and as at least one lies in the other half, the 32 quadruples of
a triple and one byte of the other half do as well, with 256 times fewer fingerprints a key and four times the postings, which
pays from ``MANY`` fingerprints on. Each pair met is tallied over all 8 positions;
pairs with fewer than the guaranteed 5 go, the rest are verified bit by bit. A pair met
under several keys counts once, under the first key that it shares.

Exact copies have one fingerprint and enter as one node, so groups of copies cost
nothing. A group of near copies is a ball of many fingerprints around the text they come from;
its pairs would grow with the square of its size. A posting list of more than ``HEAVY`` fingerprints
therefore has a centre, the one with the most rows. What is within 3 bits of the centre is tied to
it, and so to each other; only pairs with a side further away are still compared. The components
are the same as with all pairs. They come from alternating star contractions over tables in the
shared folder; nothing but counts reaches the driver.

Edge cases: null and empty texts have fingerprint zero and are linked like any other;
fewer words than a shingle hash as one; texts of any length are read whole; a null doc_id is never a component's
id unless all its ids are null; rows with equal ids each get a row; other columns may have any names and
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, join_ids, settle, small_batches

MAX_BITS = 3
SHINGLE = 3
SEED = 42
BYTES = 8
#: Fingerprints in a posting list whose pairs are all compared.
HEAVY = 64
#: Bytes that a pair within MAX_BITS shares at least.
MIN_SHARED = BYTES - MAX_BITS
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
QUADRUPLES = [(*t, k) for t in TRIPLES for k in (range(4, 8) if t[0] < 4 else range(4))]
#: Fingerprints from which on keys are of four bytes.
MANY = 1 << 24

#: Bits of each byte value: row v holds the 8 bits of v, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle in order, unsigned; of the whole sequence where there are fewer words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
    return np.array([digest(flat[a : b - 1], SEED) for a, b in zip(starts, starts[min(size, len(words)) :])], dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, BYTES)
    out = 0
    for k in range(BYTES):
        ones = np.bincount(octets[:, k], minlength=256) @ _BITS
        out |= int(np.packbits(2 * ones > n, bitorder="little")[0]) << (8 * k)
    return out


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry_col: str | None = None, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, carry): fp is the fingerprint's 64 bits as a signed long; carry is a column taken along as text, null without one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, size) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "carry"])

    carry = F.col(carry_col) if carry_col else F.lit(None)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), carry.cast("string").alias("carry"))
    return source.mapInArrow(run, "doc_id long, fp long, carry string")


def _octet(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))


def _mask(t: tuple[int, ...]) -> int:
    mask = sum(255 << (8 * k) for k in t)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _posted(nodes: DataFrame, keys: list[tuple[int, ...]]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("v")) for i, t in enumerate(keys)])
    return nodes.select("fp", "n", F.explode(entries).alias("e")).select("fp", "n", "e.t", "e.v")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _shared(x: Column) -> Column:
    """The tally of shared positional bytes of two fingerprints with difference x."""
    return sum((F.when(_octet(x, k) == 0, 1).otherwise(0) for k in range(BYTES)), F.lit(0))


def _check(max_bits: int) -> None:
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the index guarantees pairs of up to 3 differing bits")


def links(nodes: DataFrame, max_bits: int = MAX_BITS, keys: list[tuple[int, ...]] = TRIPLES) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints in ``nodes.fp`` within ``max_bits`` (3 at most)."""
    _check(max_bits)
    posted = _posted(nodes.select("fp", F.lit(1).alias("n")), keys)
    a, b = posted.alias("a"), posted.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.lit(len(keys))
    for i, t in reversed(list(enumerate(keys))):
        first = F.when(x.bitwiseAND(F.lit(_mask(t))) == 0, i).otherwise(first)
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp"))
    on = on & (_shared(x) >= MIN_SHARED) & (F.bit_count(x) <= max_bits) & (F.col("a.t") == first)
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def spanning_links(nodes: DataFrame, max_bits: int = MAX_BITS, heavy: int = HEAVY, keys: list[tuple[int, ...]] = TRIPLES) -> DataFrame:
    """(a, b): links that connect what :func:`links` connects, with few of a ball's pairs. ``nodes`` has (fp, n), n its rows."""
    _check(max_bits)
    posted = _posted(nodes, keys)
    centres = posted.groupBy("t", "v").agg(F.max_by("fp", "n").alias("c"), F.count("*").alias("_size")).where(F.col("_size") > heavy).select("t", "v", "c")
    posted = join_ids(posted, centres, ["t", "v"], "left").select("fp", "t", "v", "c", F.coalesce(_apart(F.col("fp"), F.col("c")) <= max_bits, F.lit(False)).alias("near"))
    tied = posted.where(F.col("near") & (F.col("fp") != F.col("c"))).select(F.col("fp").alias("a"), F.col("c").alias("b"))
    a, b = posted.where(~F.col("near")).alias("a"), posted.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.v") == F.col("b.v")) & (F.col("b.near") | (F.col("a.fp") < F.col("b.fp")))
    on = on & (_shared(x) >= MIN_SHARED) & (F.bit_count(x) <= max_bits)
    far = a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    return tied.unionByName(far)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is its component's smallest node."""
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # Large star: every neighbour above u is tied to the smallest of u's neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        last, edges = edges, settle(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        forget(last)
        # Small star: what lies below u, and u itself, is tied to the smallest of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u")
        last, edges = edges, settle(tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        forget(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int | None = None, max_bits: int | None = None, carry_col: str | None = None
) -> DataFrame:
    """(doc_id, fingerprint, root, component_id[, carry]) of every row; ``root`` names the component where ids may be null or shared.

    With ``max_bits`` fingerprints of 3-word shingles link by their bits; without, texts link by a similarity of 0.8 of their
    sets of 5-word shingles. ``shingle`` sets another size.
    """
    if max_bits is None:
        from .near_copies import SHINGLE as WIDER
        from .near_copies import near_copies

        return near_copies(docs, id_col, text_col, carry_col, shingle or WIDER)
    rows = settle(fingerprints(docs, id_col, text_col, carry_col, shingle or SHINGLE))
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    keys = QUADRUPLES if nodes.count() >= MANY else TRIPLES
    roots = components(spanning_links(nodes.select("fp", "n"), max_bits, keys=keys))
    known = settle(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    best = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(best, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id", *(["carry"] if carry_col else []))
