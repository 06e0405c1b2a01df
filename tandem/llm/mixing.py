"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the budget by its weight, at most ``max_copies`` times
its own size; what a capped source leaves is shared out again by weight until none
is above. Inside a source a document is worth expected copies in proportion to the bit length of its
size (longer texts are favoured, gently), at most ``max_copies``, scaled so that the
expected words meet the source's target. The whole part of its expected copies it gets for certain. The
fraction is its inclusion probability: the document draws a uniform number from a hash of its id and text, its rank is the
odds of that number over the odds of its inclusion probability, and documents are taken in rank
order until the source's remaining words are met (fixed size in words: the last one only if at
least half of it fits).

No source is ever sorted as a whole: sizes are summed by (source, bucket of the rank), twice, each level
keeping only the bucket in which the cut falls; only the documents of that last bucket are ranked one by
one. The sources themselves are numbered by ranges of their names, and their caps are filled by rounds of sums.

Edge cases: null or empty texts have size 0 and are taken 0 words; a source whose
documents are all empty has target 0; null sources are one source, last in order; very long texts count
whole; rows of one id, or of none, draw apart by their texts; rows equal in id, source and text are exchangeable, and
share a rank: in the cut's bucket each is judged in turn; extra columns may have any names and
are carried only where asked for; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle, small_table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_COPIES = 2
SEED = 42
#: Buckets of the rank at each of the two levels.
BUCKETS = 1024
#: Below this a number of copies counts as rounding.
TINY = 1e-9
_WORD = r"[^\x20\x09-\x0D]+"


def sizes_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A whole number below 2**48, uniform over the documents and the same in every run."""
    own = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(own), 1, 12), 16, 10).cast("long")


def _few(df: DataFrame) -> DataFrame:
    """A settled table, to be broadcast while it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(sizes: DataFrame) -> DataFrame:
    """Adds ``place``, the number from 0 of each source by code point, null last: ranges are numbered each for itself,
    after as many as the ranges before hold."""
    by = F.col("source").asc_nulls_last()
    ranged = settle(sizes.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    held = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())  # a row for each task
    before, offsets = 0, []
    for part, count in held:
        offsets.append((part, before))
        before += count
    start = small_table(sizes.sparkSession, offsets, "part int, start long")
    local = F.row_number().over(W.partitionBy("part").orderBy(by)) - 1
    return ranged.withColumn("local", local).join(F.broadcast(start), "part").select(*sizes.columns, (F.col("start") + F.col("local")).alias("place"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_copies: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water filling.

    ``sizes`` has a row for each source; a source's weight is that of its place in the
    order of code points, null last. In each round the sources not yet at their cap share what is left by
    weight, and those that reach their cap by it stop there.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = settle(numbered(sizes.select("source", "source_size")).select("source", "source_size", w.alias("w"), (max_copies * F.col("source_size").cast("double")).alias("cap")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    budget = share * float(s.agg(total(F.col("source_size").cast("double"))).first()[0])
    level, count = 0.0, -1
    while True:
        free = F.col("cap") > F.col("w") * level
        r = s.agg(total(F.when(free, F.col("w"))).alias("w"), total(F.when(~free, F.col("cap"))).alias("full"), F.count(F.when(free, 1)).alias("n")).first()
        if r["n"] == count or not r["w"]:
            break
        level, count = (budget - r["full"]) / r["w"], r["n"]
    filled = F.col("cap") if not r["w"] else F.least(F.col("cap"), F.col("w") * level)
    return s.select("source", "source_size", F.round(filled, 6).alias("target"))


def copies(classes: DataFrame, max_copies: float = MAX_COPIES) -> DataFrame:
    """(skey, q, source_size, target, whole, pi, need) from (skey, q, s, source_size, target): expected copies in
    proportion to q, at most ``max_copies``, whose words meet the target; ``s`` are the words of the class q.
    A source has at most 63 classes, one for each bit length."""
    above = W.partitionBy("skey").orderBy(F.desc("q")).rowsBetween(W.unboundedPreceding, -1)
    below = W.partitionBy("skey").orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    left = F.col("target") - max_copies * F.coalesce(F.sum("s").over(above), F.lit(0))
    c = classes.withColumn("rate", F.try_divide(left, F.sum(F.col("s") * F.col("q")).over(below).cast("double")))
    fits = F.col("rate") * F.col("q") <= max_copies
    c = c.withColumn("rate", F.max_by(F.when(fits, F.col("rate")), F.when(fits, F.col("q"))).over(W.partitionBy("skey")))
    c = c.withColumn("c", F.greatest(F.lit(0.0), F.least(F.lit(float(max_copies)), F.coalesce(F.col("rate") * F.col("q"), F.lit(float(max_copies))))))
    c = c.withColumn("whole", F.floor(F.col("c") + TINY).cast("long"))
    c = c.withColumn("pi", F.when(F.col("c") - F.col("whole") > TINY, F.col("c") - F.col("whole")).otherwise(0.0))
    need = F.col("target") - F.sum(F.col("s") * F.col("whole")).over(W.partitionBy("skey"))
    return c.select("skey", "q", "source_size", "target", "whole", "pi", need.alias("need"))


def _cut(rows: DataFrame, bucket: Column, base: DataFrame) -> DataFrame:
    """Of each source the bucket in which the running sum of sizes reaches ``need``:
    (source, need, bucket, before). ``base`` has (source, need) with need > 0."""
    sums = rows.groupBy("skey", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    upto = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    run = sums.withColumn("upto", F.sum("size").over(upto)).join(base, "skey")
    hit = run.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("size") < F.col("need")))
    return hit.groupBy("skey").agg(F.min_by(F.struct("need", "bucket", (F.col("upto") - F.col("size")).alias("before")), "bucket").alias("c")).select("skey", "c.*")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_copies: float = MAX_COPIES,
    seed: int = SEED,
    buckets: int = BUCKETS,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies[, row]) of every document; with ``carry`` the struct
    ``row`` holds the columns of ``docs``."""
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), sizes_of(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col), seed).alias("u"), *row
    )
    # A null source keys as '0', any other as '1' and its name. An empty text has no bit and no class of its own: it is of none.
    key = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    bits = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    rows = settle(rows.withColumn("skey", key).withColumn("q", bits.cast("long")))
    classes = settle(rows.groupBy("skey", "source", "q").agg(F.sum("size").alias("s")))
    plan = targets(classes.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, max_copies).withColumn("skey", key).drop("source")
    plan = settle(copies(classes.join(plan, "skey"), max_copies))

    odds = lambda p: p / (1 - p)
    uniform = (F.col("u") + 0.5) / float(1 << 48)
    # The rank's share of itself and one keeps the order and lies between 0 and 1.
    rank = F.when((F.col("pi") > 0) & (F.col("size") > 0), odds(uniform) / odds(F.col("pi")))
    ranked = rows.join(_few(plan), ["skey", "q"]).withColumn("rank", rank)
    at = F.col("rank") / (1 + F.col("rank"))
    b1, b2 = F.floor(at * buckets), F.floor(at * buckets * buckets)
    open_ = ranked.where(F.col("rank").isNotNull())

    needs = plan.where(F.col("need") > 0).groupBy("skey").agg(F.max("need").alias("need"))
    first = settle(_cut(open_, b1, needs))
    inside = open_.drop("need").join(_few(first.select("skey", F.col("bucket").alias("b1"))), "skey").where(b1 == F.col("b1"))
    second = _cut(inside, b2, first.select("skey", (F.col("need") - F.col("before")).alias("need")))
    second = settle(second.select("skey", F.col("need").alias("need2"), F.col("bucket").alias("cut"), F.col("before").alias("before2")))

    # A source without a cut takes all its ranked documents if it needs words at all.
    everything = ranked.join(_few(second), "skey", "left").withColumn("b2", b2)
    last = everything.where(F.col("rank").isNotNull() & (F.col("b2") == F.col("cut")))
    run = W.partitionBy("skey", "b2").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    last = last.withColumn("got", F.col("before2") + F.sum("size").over(run) - F.col("size"))
    last = last.withColumn("extra", ((F.col("got") < F.col("need2")) & (F.col("got") + F.col("size") / 2.0 <= F.col("need2"))).cast("long"))
    rest = everything.where(F.col("rank").isNull() | F.col("cut").isNull() | (F.col("b2") != F.col("cut")))
    taken = F.when(F.col("rank").isNull(), 0).when(F.col("cut").isNull(), (F.col("need") > 0).cast("int")).otherwise((F.col("b2") < F.col("cut")).cast("int"))
    rest = rest.withColumn("extra", taken.cast("long"))
    names = ["doc_id", "source", "size", "source_size", "target", "whole", "extra", *(["row"] if carry else [])]
    both = rest.select(names).unionByName(last.select(names))
    n = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(F.lit(0)).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * n).alias("taken"), n.alias("copies"), *(["row"] if carry else []))
