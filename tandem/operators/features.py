"""Feature vectors (ML1-ML10, AG23, AG24, JN15-JN17, ST13, ML14)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import pair_vector, standardize, zeros
from .state import settle

TOKEN = r"[\p{L}\p{N}_]{2,}"
VOCABULARY = 256
EMBEDDING = 768


def term_counts(bodies: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, term, tf) of lower-cased words of two characters or more."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return bodies.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """AG24: the ``size`` terms with the highest total, ties by term: (term, total, df, position by term)."""
    t = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    return t.orderBy(F.desc("total"), "term").limit(size).withColumn("position", F.row_number().over(W.orderBy("term")) - 1)


def vocabulary_weights(bodies: DataFrame, key: str = "id", text: str = "text", size: int = VOCABULARY) -> DataFrame:
    """ML1, ML2: the weights of :func:`tfidf` of all ``bodies``, fitted on them. Terms are chosen by their totals, which need no
    counts by text; only the words of the chosen ones are dealt out, each as its position."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    total = bodies.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("total"))
    chosen = settle(total.orderBy(F.desc("total"), "term").limit(size).withColumn("position", F.row_number().over(W.orderBy("term")) - 1))
    few = bodies.select(key, F.explode(words).alias("term")).join(F.broadcast(chosen.select("term", "position")), "term")
    tf = settle(few.groupBy(key, "position").agg(F.count("*").alias("tf")))
    terms = chosen.select("term", "position").join(tf.groupBy("position").agg(F.count("*").alias("df")), "position")
    return tfidf(tf, terms, bodies.agg(F.count("*").alias("n")), key, "position")


def tfidf(counts: DataFrame, terms: DataFrame, n: DataFrame, key: str = "id", by: str = "term") -> DataFrame:
    """ML1, ML2: (key, term, position, weight) in long form; ``n`` is a one-row frame (n) of the fitted texts. ``counts`` has the
    terms themselves, or their positions if told so by ``by``.

    The vocabulary has a fixed size, so it is broadcast; the length of a text's vector comes from a window on its key.
    """
    t = counts.join(F.broadcast(terms.select("term", "df", "position")), by)
    t = t.withColumn("raw", F.col("tf") * (F.log((1 + n.scalar()) / (1 + F.col("df"))) + 1))
    return t.select(key, "term", "position", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))).alias("weight"))


def dense(weights: DataFrame, ids: DataFrame, size: int = VOCABULARY, key: str = "id") -> DataFrame:
    """(key, tfidf): the long form as arrays; texts without vocabulary words are all zero."""
    packed = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("position", "weight"))).alias("m"))
    value = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return ids.select(key).join(packed, key, "left").select(key, F.when(F.col("m").isNull(), zeros(size)).otherwise(value).alias("tfidf"))


def embed(functions: DataFrame, embedder: Callable | None = None, cache: DataFrame | None = None, key: str = "node_id", body: str = "body_code", dim: int = EMBEDDING) -> DataFrame:
    """ML3-ML5: (key, embedding). ``embedder`` maps an iterator of pandas Series of texts to Series of
    float lists and is loaded once a worker; without one, and for blank bodies, the vector is zero.
    Keys in ``cache`` are not embedded again."""
    todo = functions.select(key, body) if cache is None else functions.select(key, body).join(cache.select(key), key, "left_anti")
    if embedder is None:
        new = todo.select(key, F.lit(None).cast("array<float>").alias("embedding"))
    else:
        new = todo.where(F.trim(F.coalesce(body, F.lit(""))) != "").select(key, F.pandas_udf(embedder, "array<float>")(body).alias("embedding"))
    known = new if cache is None else new.unionByName(cache.select(key, "embedding"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return functions.select(key).join(known, key, "left").select(key, F.coalesce("embedding", zero).alias("embedding"))


def function_vector(df: DataFrame, tfidf_col: str | None = "tfidf", embedding: str = "embedding", start: str = "start_line", end: str = "end_line", args: str = "arg_count") -> DataFrame:
    """ML6, ML7: TF-IDF, embedding, and the metrics end - start and arg_count, as floats."""
    parts = ([F.col(tfidf_col).cast("array<float>")] if tfidf_col else []) + [F.col(embedding).cast("array<float>")]
    metrics = F.array((F.coalesce(end, F.lit(0)) - F.coalesce(start, F.lit(0))).cast("float"), F.coalesce(args, F.lit(0)).cast("float"))
    return df.withColumn("features", F.concat(*parts, metrics))


def pair_features(pairs: DataFrame, vectors: DataFrame, dim: int, evolution: DataFrame | None = None, key: str = "node_id") -> DataFrame:
    """ML8, ML9, JN15, JN16: ``pairs`` with ``features``; keys stay on the row, so nothing is zipped by position."""
    v = lambda k: vectors.select(F.col(key).alias(f"func{k}"), F.col("features").alias(f"_v{k}"))
    out = pairs.join(v(1), "func1", "left").join(v(2), "func2", "left")
    if evolution is not None:
        e = lambda k: evolution.select(F.col("node").alias(f"func{k}"), F.col("modify_count").alias(f"_e{k}"))
        out = out.join(e(1), "func1", "left").join(e(2), "func2", "left")
    else:
        out = out.withColumn("_e1", F.lit(0)).withColumn("_e2", F.lit(0))
    features = pair_vector(F.col("_v1"), F.col("_v2"), F.col("_e1"), F.col("_e2"), dim)
    return out.withColumn("features", features).select(*[c for c in pairs.columns], "features")


def fit_scaler(df: DataFrame, vector: str = "features") -> DataFrame:
    """AG23: (position, mean, std) with the population spread; one row a dimension, combined before the shuffle."""
    e = df.select(F.posexplode(vector).alias("position", "x"))
    return e.groupBy("position").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def scale(df: DataFrame, scaler: DataFrame, vector: str = "features") -> DataFrame:
    """ML10: the scaler's rows, as many as dimensions, become two arrays in a scalar subquery."""
    packed = scaler.agg(F.sort_array(F.collect_list(F.struct("position", "mean", "std"))).alias("s"))
    arrays = packed.select(F.struct(F.transform("s", lambda x: x["mean"]).alias("mean"), F.transform("s", lambda x: x["std"]).alias("std"))).scalar()
    return df.withColumn("_fit", arrays).withColumn(vector, standardize(F.col(vector), F.col("_fit.mean"), F.col("_fit.std"))).drop("_fit")


def adaptive_scale(df: DataFrame, sample: int | None = 5000, key: str = "id", vector: str = "features") -> DataFrame:
    """ML14, ST13: scaled by what the target rows themselves show, from the first ``sample`` in hashed order (None: all)."""
    some = df if sample is None else df.orderBy(F.md5(F.col(key).cast("string")), key).limit(sample)
    return scale(df, fit_scaler(some, vector), vector)
