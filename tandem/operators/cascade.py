"""Lookups that fall through a list of rules (JN6, JN7, JN8, AG13).

Each rule is one equi-join that yields (key, candidate, priority, seq). The rules are united and the
best candidate of each key is the minimum of (priority, seq): one aggregation with partial
sums on the map side, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import basename, import_file, stem
from ..functions.vectors import cosine
from .nearest import BLOCK, likely_best
from .state import settle


def best_match(rows: DataFrame, key: str, rules: Sequence[DataFrame], give: Sequence[str] = ("node_id", "rule")) -> DataFrame:
    """``rows`` with (node_id, rule), or what else of (rule, seq, node_id) is asked for: the candidate of the first rule that has one, lowest seq first; null if none."""
    found = None
    for i, rule in enumerate(rules, 1):
        part = rule.select(key, F.struct(F.lit(i).alias("rule"), "seq", "node_id").alias("m"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(key).agg(F.min("m").alias("m"))
    return rows.join(best, key, "left").select(*[rows[c] for c in rows.columns], *[F.col(f"m.{c}").alias(c) for c in give])


def last_by(functions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG13: an index in which later functions overwrite earlier ones of the same keys."""
    return functions.groupBy(*keys).agg(F.max_by("node_id", "seq").alias("node_id"), F.max("seq").alias("seq"))


def first_by(functions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The earliest function of each combination of keys: what a first-match lookup by these keys can return."""
    return functions.groupBy(*keys).agg(F.min_by("node_id", "seq").alias("node_id"), F.min("seq").alias("seq"))


def only_one(functions: DataFrame, name: str = "name") -> DataFrame:
    """Names that a single function has."""
    return functions.groupBy(name).agg(F.count("*").alias("_n"), F.min("node_id").alias("node_id"), F.min("seq").alias("seq")).where("_n = 1").drop("_n")


#: Characters of a path's end that a join meets by at most.
END = 48


def ends_with(hist: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows of ``hist`` with the functions of the same name whose path ends with theirs. They meet by name and the path's last
    characters: as many as the historical path has, ``END`` at most; so a hot name does not bring all its files into one task."""
    length = F.least(F.length("path"), F.lit(END))
    h = hist.withColumn("_n", length).withColumn("_end", F.expr("right(path, _n)"))
    lengths = h.where("_n is not null").select(F.col("_n").alias("_k")).distinct()  # END + 1 rows at most
    f = functions.select("name", F.col("path").alias("_path"), "node_id", "seq").join(F.broadcast(lengths), F.length("_path") >= F.col("_k"))
    f = f.withColumn("_e", F.expr("right(_path, _k)")).withColumnRenamed("name", "_name")
    return h.join(f, (F.col("name") == F.col("_name")) & (F.col("_n") == F.col("_k")) & (F.col("_end") == F.col("_e")) & F.col("_path").endswith(F.col("path"))).drop("_n", "_end", "_k", "_e", "_name", "_path")


def match_historical(hist: DataFrame, functions: DataFrame, key: str = "hist_id") -> DataFrame:
    """JN7: historical functions (hist_id, path, class_name, name) to current ones (node_id, path, class_name, name, seq).

    Rules: 1 path, class and name (class known); 2 path and name; 3 the current path ends with the
    historical one, same name; 4 base name and name; 5 a name that only one function has.
    """
    hist = settle(hist)  # every rule reads it
    h = hist.select(key, "path", "class_name", "name")
    f = functions.select("node_id", "path", "class_name", "name", "seq")
    known = lambda df: df.where("class_name is not null and class_name <> ''")
    suffix = ends_with(h, first_by(f, ["path", "name"]))
    based = lambda df: df.withColumn("base", basename(F.col("path")))
    rules = [
        known(h).join(last_by(known(f), ["path", "class_name", "name"]), ["path", "class_name", "name"]),
        h.join(last_by(f, ["path", "name"]), ["path", "name"]),
        suffix.select(key, "node_id", "seq"),
        based(h).join(first_by(based(f), ["base", "name"]), ["base", "name"]),
        h.join(only_one(f), "name"),
    ]
    return best_match(hist, key, rules)


def match_similar(hist: DataFrame, functions: DataFrame, key: str = "hist_id", vector: str = "vector", least: float = 0.5, same_path: float = 0.2, same_base: float = 0.1, block: int = BLOCK) -> DataFrame:
    """JN8: among functions of the same name the most similar one, if its score is over ``least``.

    The score is the vectors' cosine plus a bonus for the same path or the same base name; the
    earlier function wins a tie. Of functions equal in name, path and vector the earliest is compared; pairs that
    cannot be the best leave in blocks (:mod:`.nearest`), and the few others get their score here.
    """
    order = F.struct((-F.col("seq")).alias("seq"), "node_id")
    f = settle(functions.groupBy("name", "path", F.col(vector).alias("vector")).agg(F.max(order).alias("first")))
    near = likely_best(hist.select("name", "path", F.col(vector).alias("vector"), F.col(key).alias("key")), f, least, same_path, same_base, block)
    path, own = F.col("h_path"), F.col("f_path")
    bonus = F.when(path == own, same_path).when(basename(path) == basename(own), same_base).otherwise(0.0)
    score = F.round(cosine(F.col("h_vector"), F.col("f_vector")) + bonus, 9)
    cand = near.select(F.col("h_key").alias(key), score.alias("score"), "f_first")
    best = cand.where(F.col("score") > least).groupBy(key).agg(F.max(F.struct("score", "f_first")).alias("m"))
    return best.select(key, F.col("m.f_first.node_id").alias("node_id"), F.col("m.score").alias("score"))


def resolve_callees(calls: DataFrame, functions: DataFrame, imports: DataFrame, key: str = "call_id") -> DataFrame:
    """JN6: calls (call_id, path, class_name, called) to functions (node_id, path, class_name, name, seq);
    ``imports`` has (path, alias, target). See :func:`resolve_names` for the rules.

    What a call finds depends on its file, class and name only, so each of these is resolved once and the calls meet the result
    in one join. Rows that share an id get the best that any of them finds.
    """
    calls = settle(calls)
    by = ["path", "class_name", "called"]
    asked = settle(calls.select(*by).distinct().withColumn("_ask", F.monotonically_increasing_id()))
    found = resolve_names(asked, functions, imports, "_ask").select(*[F.col(c).alias(f"_{c}") for c in by], F.struct("rule", "seq", "node_id").alias("_m"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = calls.join(found, on, "left").withColumn("_m", F.when(F.col("_m.rule").isNotNull(), F.col("_m")))
    again = calls.select(F.xxhash64(key).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        out = out.withColumn("_m", F.min("_m").over(W.partitionBy(key)))
    return out.select(*calls.columns, F.col("_m.node_id").alias("node_id"), F.col("_m.rule").alias("rule"))


def resolve_names(calls: DataFrame, functions: DataFrame, imports: DataFrame, key: str) -> DataFrame:
    """``calls`` with (rule, seq, node_id), null if nothing is found.

    A dotted call tries 1 its own file and class, 2 its receiver among the file's imports, 3 its own file.
    A plain call tries 4 its own file, 5 the imports, 6 a name that only one function has, 7 a file of
    the same stem, 8 the first function of that name.
    """
    c = calls.withColumn("receiver", F.regexp_extract("called", r"^(.*)\.[^.]*$", 1)).withColumn("method", F.element_at(F.split("called", r"\."), -1))
    dotted, plain = c.where(F.col("receiver") != ""), c.where(F.col("receiver") == "")
    f = functions.select("node_id", "path", "class_name", "name", "seq")
    by_name = lambda df: df.withColumnRenamed("method", "name")

    def imported(df: DataFrame, alias: str) -> DataFrame:
        i = imports.select(F.col("path").alias("_p"), F.col("alias").alias("_a"), "target")
        j = df.join(i, (F.col("path") == F.col("_p")) & (F.col(alias) == F.col("_a"))).select(key, "method", "target")
        # The names of one import are looked up once, not for each call: the path test is no equality.
        asked = j.select("method", "target").distinct().alias("j")
        hit = asked.join(first_by(f, ["path", "name"]).alias("f"), (F.col("j.method") == F.col("f.name")) & F.contains(F.col("f.path"), import_file(F.col("j.target"))))
        best = hit.groupBy("method", "target").agg(F.min_by("node_id", "seq").alias("node_id"), F.min("seq").alias("seq"))
        return j.join(best, ["method", "target"]).select(key, "node_id", "seq")

    own = f.where("class_name is not null")
    rules = [
        by_name(dotted.where("class_name is not null")).join(first_by(own, ["path", "class_name", "name"]), ["path", "class_name", "name"]),
        imported(dotted, "receiver"),
        by_name(dotted.drop("class_name")).join(first_by(f, ["path", "name"]), ["path", "name"]),
        by_name(plain.drop("class_name")).join(first_by(f, ["path", "name"]), ["path", "name"]),
        imported(plain, "method"),
        by_name(plain.drop("class_name")).join(only_one(f), "name"),
        by_name(plain.drop("class_name")).withColumn("st", stem(F.col("path"))).drop("path").join(first_by(f.withColumn("st", stem(F.col("path"))), ["st", "name"]), ["st", "name"]),
        by_name(plain.drop("class_name", "path")).join(first_by(f, ["name"]), "name"),
    ]
    return best_match(calls, key, [r.select(key, "node_id", "seq") for r in rules], ["rule", "seq", "node_id"])


def defaulted(metadata: DataFrame) -> DataFrame:
    """SRC7: names that are missing come from the node id's last part."""
    name: Column = F.coalesce("name", F.element_at(F.split("node_id", "::"), -1))
    return metadata.withColumn("name", name)
