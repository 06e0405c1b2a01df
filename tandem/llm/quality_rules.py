"""Quality rules: counts of every whole text, and robust multivariate outliers.

The counts give a vector of four transformed statistics that vary in any prose: the log of the mean word length,
the log of the share of marks (ASCII that is no letter, digit or space), the log of distinct words over the log of all
words, and the log of the mean words a line. For each language and source the minimum covariance
determinant estimate is sought: concentration steps (the share ``COVER`` of vectors with the smallest Mahalanobis
distance gives the next mean and covariance) run from four fixed starts until no determinant falls by a thousandth, and the start
that ends at the least determinant gives the estimate. Starts: medians with the squared deviations' medians; the
correlation of hyperbolic tangents; the covariance of spatial signs; the plain mean and covariance.

A group's estimate is drawn to that of all rows by the share ``SHRINK`` + (1 - ``SHRINK``) * ``PRIOR`` / (n + ``PRIOR``), smoothly
in its n different vectors: small groups lean on the whole, and a group that is mostly copies of one text, whose covariance
is next to nothing, does not lose all others. Equal vectors of a group count once for the same reason. A row is
rejected if its distance exceeds the cut of a multivariate t law of ``FREEDOM`` degrees: texts of twenty words vary
more than long ones, so distances have a heavier tail than the chi-squared law.

Statistics are whole numbers, so all sums are exact and every run gives the same
verdicts. Medians and distance quantiles are read from histograms whose number of bins is
fixed by the rounding, never from a sorted group; a source with a third of all rows is
summed before it is shuffled. Texts are read once: the counts are settled in the shared folder.

Edge cases: null and empty texts have zero counts and fail the base rule; null languages and
sources are groups of their own; very long texts are counted whole; rows that are equal are judged alike and equally
distant rows are near or far together; columns other than the four used may have any names; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, let, settle

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
COVER = 0.75
#: Concentration steps at most; a start is done when the log of its determinant falls by less than FALL.
STEPS = 40
FALL = 1e-3
#: The statistics, and in how many parts of one each is counted.
STATS = {"length": 1000, "marks": 1000, "distinct": 10_000, "lines": 1000}
#: Least share of the estimate over all rows in a group's, and the vectors that it counts for beside.
SHRINK = 0.25
PRIOR = 50
#: Vectors that the mean over all rows counts for in a group's.
CENTRE = 5
#: Rows within this quantile of the t law with so many degrees of freedom are kept.
KEEP = 0.999
FREEDOM = 8
#: Bins for each doubling of 1 + squared distance.
BINS = 64

_GAP = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_MARKS = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def words_of(text: Column) -> Column:
    """The text's words; an empty array where there are none."""
    bare = F.trim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _GAP))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that stand twice or more, each word once.

    Windows are compared by 64-bit hash. Only where a hash repeats, the starts of repeated
    windows are gathered by sorting (hash, start), and each covers what the next leaves.
    """

    def covered(starts: Column) -> Column:
        following = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
        steps = F.zip_with(starts, following, lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def starts(pairs: Column) -> Column:
        """From sorted (h, i) pairs the sorted i whose h has a neighbour."""
        n = F.size(pairs)
        h = lambda k: F.get(pairs, k)["h"]
        same = lambda p, k: F.coalesce(p["h"] == h(k - 1), F.lit(False)) | F.coalesce(p["h"] == h(k + 1), F.lit(False))
        return F.when(n > 0, F.sort_array(F.transform(F.filter(pairs, same), lambda p: p["i"]))).otherwise(F.array().cast("array<int>"))

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        many = let(let(pairs, starts), covered)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), many).otherwise(F.lit(0))

    def of_words(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) >= window, let(every, of_hashes)).otherwise(F.lit(0))

    return let(words, of_words).cast("long")


def count_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_marks, n_distinct, n_lines, n_dup_lines, n_repeat_words,
    base_failed[, row]); ``row`` holds all columns of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    parts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d"), repeated_words(w).alias("r")))
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        F.length(F.regexp_replace(text, _GAP, "")).cast("long").alias("word_chars"),
        without("[" + SYMBOLS.replace("&", r"\&") + "]").alias("n_symbols"),
        without(_MARKS).alias("n_marks"),
        parts.alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        *row,
    )
    return counted.select(
        "doc_id",
        "lang",
        "source",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_marks",
        F.col("w.d").alias("n_distinct"),
        F.col("l.n").alias("n_lines"),
        F.col("l.dup").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"),
        ((F.col("w.n") < MIN_WORDS) | (100 * F.col("w.r") > MAX_REPEATED_PERCENT * F.col("w.n"))).alias("base_failed"),
        *(["row"] if carry else []),
    )


def vector(df: DataFrame) -> DataFrame:
    """Adds x0.. : the transformed statistics as whole parts; a text of no or one word has zeros and all words distinct."""
    least = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    raw = [
        F.log(least("word_chars") / least("n_words")),
        F.log1p(100.0 * F.col("n_marks") / least("word_chars")),
        F.when(F.col("n_words") > 1, F.log(least("n_distinct")) / F.log(least("n_words"))).otherwise(1.0),
        F.log(least("n_words") / least("n_lines")),
    ]
    return df.withColumns({f"x{i}": F.round(parts * x).cast("long") for i, (x, parts) in enumerate(zip(raw, STATS.values()))})


def chi2_below(x: float) -> float:
    """The chi-squared law with four degrees of freedom."""
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def _quantile(law, p: float) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if law(mid) < p else (low, mid)
    return low


def chi2_quantile(p: float) -> float:
    return _quantile(chi2_below, p)


def t_quantile(p: float, freedom: int = FREEDOM) -> float:
    """Squared distance below which the share ``p`` of a four-dimensional t law lies."""

    def below(x: float) -> float:
        left, half = freedom / (freedom + x), freedom / 2
        return 1 - left**half * (1 + half * (1 - left))

    return _quantile(below, p)


def consistency(cover: float = COVER) -> float:
    """By how much the covariance of the nearest ``cover`` rows of a normal law has to be stretched."""
    q = chi2_quantile(cover)
    return cover / (chi2_below(q) - math.exp(-q / 2) * (q / 2) ** 2 / 2)


D = len(STATS)
_X = [f"x{i}" for i in range(D)]
_M = [f"m{i}" for i in range(D)]
_PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
_C = [f"c{i}{j}" for i, j in _PAIRS]
#: Parts of one in which the starts' tangents and signs are summed.
_FINE = 1_000_000
#: Rounding leaves a statistic this variance at least.
_ROUNDING = 1.0


def _sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(20,0)")).cast("double")


def _factor(est: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l{i}{j} of the covariance c{i}{j}, and the log of its determinant."""
    for i, j in _PAIRS:
        c = F.col(f"c{i}{j}") + (_ROUNDING if i == j else 0.0)
        inner = reduce(lambda acc, k: acc - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), c)
        est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(inner, F.lit(_ROUNDING / 2))) if i == j else inner / F.col(f"l{j}{j}"))
    return est.withColumn("logdet", sum((2 * F.log(f"l{i}{i}") for i in range(1, D)), 2 * F.log("l00")))


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared distance of x from m under the factor l."""
    for i in range(D):
        y = reduce(lambda acc, k: acc - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, D)), F.col("y0") * F.col("y0")))


def _meet(rows: DataFrame, small: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Rows with the ``n`` settled rows of all groups: broadcast while those are few, by hash beyond."""
    return rows.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, "g", how)


def _medians(long: DataFrame) -> DataFrame:
    """(g, n, q0.., ): the lower median of each coordinate, from (g, i, x) counted by value."""
    counted = long.groupBy("g", "i", "x").count()
    run = W.partitionBy("g", "i").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    counted = counted.withColumn("upto", F.sum("count").over(run)).withColumn("n", F.sum("count").over(W.partitionBy("g", "i")))
    mid = counted.where(2 * F.col("upto") >= F.col("n")).groupBy("g", "i").agg(F.min("x").alias("x"), F.first("n").alias("n"))
    return mid.groupBy("g").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("x"))).cast("double").alias(f"q{i}") for i in range(D)])


def starts(rows: DataFrame) -> DataFrame:
    """(g, s, n, m.., c..): the four starts of each group."""
    spread = lambda cs: F.posexplode(F.array(*cs)).alias("i", "x")
    mids = settle(_medians(rows.select("g", spread(_X))).select("g", "n", *[F.col(f"q{i}").alias(f"m{i}") for i in range(D)]))
    groups = mids.count()
    off = _meet(rows, mids, groups).select("g", spread([F.abs(F.col(x) - F.col(m)).cast("long") for x, m in zip(_X, _M)]))
    mads = _medians(off).select("g", *[F.greatest(1.4826 * F.col(f"q{i}"), F.lit(math.sqrt(_ROUNDING))).alias(f"a{i}") for i in range(D)])
    base = settle(mids.join(mads, "g"))
    z = _meet(rows, base, groups).select("g", *_X, *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"a{i}")).alias(f"z{i}") for i in range(D)])
    z = z.withColumn("far", F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, D)), F.col("z0") * F.col("z0"))))
    tangent = [F.round(_FINE * F.tanh(F.col(f"z{i}"))).cast("long") for i in range(D)]
    sign = [F.round(_FINE * F.when(F.col("far") > 0, F.col(f"z{i}") / F.col("far")).otherwise(0.0)).cast("long") for i in range(D)]
    kinds = {"x": [F.col(x) for x in _X], "t": tangent, "u": sign}
    flat = z.select("g", *[c.alias(f"{k}{i}") for k, cs in kinds.items() for i, c in enumerate(cs)])
    sums = [_sum(F.col(f"{k}{i}")).alias(f"s{k}{i}") for k in kinds for i in range(D)]
    sums += [_sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"p{k}{i}{j}") for k in kinds for i, j in _PAIRS]
    found = base.join(flat.groupBy("g").agg(*sums), "g")
    n = F.col("n")
    of = lambda k, i, j: F.col(f"p{k}{i}{j}") / n - F.col(f"s{k}{i}") * F.col(f"s{k}{j}") / (n * n)
    a = lambda i, j: F.col(f"a{i}") * F.col(f"a{j}")
    bound = lambda k, i: F.greatest(of(k, i, i), F.lit(1.0))
    shapes = [
        lambda i, j: a(i, j) if i == j else F.lit(0.0),
        lambda i, j: a(i, j) * (F.lit(1.0) if i == j else of("t", i, j) / F.sqrt(bound("t", i) * bound("t", j))),
        lambda i, j: a(i, j) * D * F.col(f"pu{i}{j}") / (n * _FINE * _FINE),
        lambda i, j: of("x", i, j),
    ]
    structs = []
    for s, shape in enumerate(shapes):
        means = [F.col(f"sx{i}") / n if s == len(shapes) - 1 else F.col(f"m{i}") for i in range(D)]
        structs.append(F.struct(F.lit(s).alias("s"), *[m.alias(name) for m, name in zip(means, _M)], *[shape(i, j).cast("double").alias(c) for c, (i, j) in zip(_C, _PAIRS)]))
    return found.select("g", "n", F.explode(F.array(*structs)).alias("e")).select("g", "n", "e.*")


def _concentrate(rows: DataFrame, est: DataFrame, n_est: int, cover: float) -> DataFrame:
    """One concentration step: (g, s, n, before, m.., c..) of the nearest ``cover`` rows of each group; ``before`` is the last determinant's log."""
    bin_of = F.floor(BINS * F.log2(1 + F.col("d2"))).cast("long")
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    # Sums by bin, in one pass: which bins are near is settled on them, so rows meet nothing but the estimates.
    bins = (
        _distance(_meet(rows, est, n_est))
        .groupBy("g", "s", bin_of.alias("bin"))
        .agg(F.first("logdet").alias("before"), F.count("*").alias("h"), *[exact(F.col(x)).alias(f"s{i}") for i, x in enumerate(_X)], *[exact(F.col(_X[i]) * F.col(_X[j])).alias(f"p{i}{j}") for i, j in _PAIRS])
    )
    run = W.partitionBy("g", "s").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("upto", F.sum("h").over(run)).withColumn("n", F.sum("h").over(W.partitionBy("g", "s")))
    near = bins.where(F.col("upto") - F.col("h") < cover * F.col("n"))
    sums = [f"s{i}" for i in range(D)] + [f"p{i}{j}" for i, j in _PAIRS]
    sums = near.groupBy("g", "s").agg(F.first("n").alias("n"), F.first("before").alias("before"), F.sum("h").cast("double").alias("h"), *[F.sum(c).cast("double").alias(c) for c in sums])
    mean = lambda i: F.col(f"s{i}") / F.col("h")
    return sums.select("g", "s", "n", "before", *[mean(i).alias(f"m{i}") for i in range(D)], *[(F.col(f"p{i}{j}") / F.col("h") - mean(i) * mean(j)).alias(f"c{i}{j}") for i, j in _PAIRS])


def estimates(rows: DataFrame, cover: float = COVER, steps: int = STEPS) -> DataFrame:
    """(g, n, m.., c.., logdet) of each group g in ``rows`` (g, x0..): of all starts' steps the one of least determinant."""
    at = settle(_factor(starts(rows)).withColumn("logdet", F.lit(math.inf)))
    seen, left = [], at.count()
    for _ in range(steps):
        if not left:
            break
        new = settle(_factor(_concentrate(rows, at, left, cover)))
        seen.append(new)
        # A start whose determinant does not fall by a step has ended.
        at = new.where(F.col("logdet") < F.col("before") - FALL)
        left = at.count()
    keep = ["n", *_M, *_C, "logdet"]
    every = reduce(DataFrame.unionByName, seen) if seen else at
    return settle(every.groupBy("g").agg(F.min_by(F.struct(*keep), F.struct("logdet", "s")).alias("e")).select("g", "e.*"))


ALL = "all"


def shrunk(found: DataFrame, cover: float = COVER) -> DataFrame:
    """(g, m.., l..): the groups' estimates, stretched and drawn to that of the group ``ALL``."""
    stretch = consistency(cover)
    whole = found.where(F.col("g") == ALL).agg(F.max(F.struct(*_M, *_C))).scalar()
    found = found.where(F.col("g") != ALL).withColumn("whole", whole)
    n, w = F.col("n").cast("double"), F.col("whole")
    share = SHRINK + (1 - SHRINK) * PRIOR / (n + PRIOR)
    centre = [((n * F.col(m) + CENTRE * w[m]) / (n + CENTRE)).alias(m) for m in _M]
    shape = [(stretch * ((1 - share) * F.col(c) + share * w[c])).alias(c) for c in _C]
    return _factor(found.select("g", *centre, *shape)).select("g", *_M, *[f"l{i}{j}" for i, j in _PAIRS])


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cover: float = COVER,
    steps: int = STEPS,
    keep: float = KEEP,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance[, row]) of every row.
    With ``carry`` the struct ``row`` holds the columns of ``docs``, so that no join has to bring verdicts back to the texts."""
    counted = count_rules(docs, id_col, text_col, lang_col, source_col, carry)
    key = lambda c: F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(c)))
    rows = settle(vector(counted).withColumn("g", F.concat_ws("|", key("lang"), key("source"))))
    usable = rows.where(~F.col("base_failed"))
    # Each row counts in its own group and in the one of all rows, so that one pass a step serves both.
    both = settle(usable.select(F.explode(F.array("g", F.lit(ALL))).alias("g"), *_X).distinct())
    fits = settle(shrunk(estimates(both, cover, steps), cover))
    # Groups without a usable row have no estimate; none of their rows is kept anyway.
    out = _distance(_meet(rows, fits, fits.count(), "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= t_quantile(keep), F.lit(True))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        kept.alias("kept"),
        F.round(F.sqrt("d2"), 6).alias("distance"),
        *(["row"] if carry else []),
    )
