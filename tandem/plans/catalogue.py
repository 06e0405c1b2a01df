"""One query for each operator, on the driver's tables, with its DuckDB SQL beside it.

The tables are read as a repository: an order is a commit (author: the customer, time: the order
date), a part is a function (file: brand, class: type, name: name, lines: size), a line item says that
a commit touched a function, and two consecutive lines of an order whose parts share a
brand are a call from the first to the second. Texts and embeddings of the documents stand in for
bodies and code vectors. Each query is a thin call of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import code as code_fn
from ..functions import diff as diff_fn
from ..functions import paths, times
from ..operators import cascade, features, graph, metrics, mining, models, ordering, parse, ranges, static_analysis, stats
from ..operators.state import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the tables as a repository ------------------------------------------------------------------


def touched(spark, d, node="l_partkey"):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col(node).alias("node"))


def commits(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))


def functions(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("node"), F.col("p_brand").alias("file"), F.col("p_type").alias("class_name"), F.col("p_name").alias("name"), F.col("p_size").alias("loc")
    )


def touched_files(spark, d):
    return touched(spark, d).join(functions(spark, d).select("node", "file"), "node").select("commit", F.col("file").alias("node"))


def call_edges(spark, d):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = table(spark, d, "lineitem").join(functions(spark, d).select(F.col("node").alias("l_partkey"), "file"), "l_partkey")
    line = line.select("l_partkey", "file", F.lead("l_partkey").over(order).alias("dst"), F.lead("file").over(order).alias("to_file"))
    return line.where("file = to_file").select(F.col("l_partkey").alias("src"), "dst").distinct()


def scored(spark, d):
    """(id, label, score): a score that follows the label loosely, six places."""
    noise = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("double") / 16777216.0
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.round(0.75 * noise + 0.25 * F.col("quality"), 3).alias("score"))


_TOUCHED = "touched AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS node FROM lineitem)"
_EVENTS = """events_ AS (SELECT a.node AS func1, b.node AS func2, a.c, o_orderdate AS ts, o_custkey AS author
  FROM touched a JOIN touched b ON a.c = b.c AND a.node < b.node LEFT JOIN orders ON o_orderkey = a.c),
gaps AS (SELECT *, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY func1, func2 ORDER BY ts, c))) / 86400000000) AS BIGINT) AS gap FROM events_),
matrix AS (SELECT func1, func2, count(*) AS cochange_count, count(DISTINCT author) AS unique_authors, avg(gap) AS avg_time_gap, min(ts) AS first_ts FROM gaps GROUP BY func1, func2)"""
_EDGES = """lines_ AS (SELECT l_partkey AS src, p_brand AS f, lead(l_partkey) OVER w AS dst, lead(p_brand) OVER w AS tf FROM lineitem JOIN part ON p_partkey = l_partkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
edges AS (SELECT DISTINCT src, dst FROM lines_ WHERE f = tf)"""
_HOPS = """e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
h1 AS (SELECT src, dst, 1 AS depth FROM e),
h2 AS (SELECT DISTINCT a.src, b.dst, 2 AS depth FROM h1 a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst),
h3 AS (SELECT DISTINCT a.src, b.dst, 3 AS depth FROM h2 a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst)"""
_KEY = "md5(least(CAST(func1 AS VARCHAR), CAST(func2 AS VARCHAR)) || '|' || greatest(CAST(func1 AS VARCHAR), CAST(func2 AS VARCHAR)) || '|42')"
_SCORED = "scored AS (SELECT doc_id AS id, quality AS label, round(0.75 * (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6)) AS BIGINT) / 16777216.0) + 0.25 * quality, 3) AS score FROM labels)"

# --- mining ----------------------------------------------------------------------------------------


def _rounded(df):
    return df.withColumn("avg_time_gap", F.round("avg_time_gap", 6)).withColumn("first_ts", F.date_format("first_ts", "yyyy-MM-dd"))


_PAIR_COLS = "func1, func2, cochange_count, unique_authors, round(avg_time_gap, 6) AS avg_time_gap, strftime(first_ts, '%Y-%m-%d') AS first_ts"


@query(f"WITH {_TOUCHED}, {_EVENTS} SELECT {_PAIR_COLS} FROM matrix WHERE cochange_count >= 2 AND unique_authors >= 2 AND coalesce(avg_time_gap, 0) <= 365")
def cochange_pairs(spark, d):
    """JN9 JN10 AG8 AG9 AG10 WN1 FLT9 FLT13 FLT14 ST14."""
    matrix = mining.cochange_matrix(touched(spark, d), commits(spark, d))
    return _rounded(mining.filter_pairs(matrix, None, 2, max_avg_gap=365))


@query(
    f"WITH touched AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS node FROM lineitem), {_EVENTS}, total AS (SELECT count(DISTINCT c) AS n FROM touched) "
    f"SELECT {_PAIR_COLS} FROM matrix, total WHERE cochange_count >= greatest(3, CAST(floor(n * 0.001) AS INT)) AND unique_authors >= 2 AND coalesce(avg_time_gap, 0) <= 200"
)
def cochange_pairs_floor(spark, d):
    """FLT10."""
    t = touched(spark, d, "l_suppkey")
    return _rounded(mining.filter_pairs(mining.cochange_matrix(t, commits(spark, d)), mining.total_commits(t), 3, 0.001, 200))


@query(f"WITH {_TOUCHED}, {_EVENTS} SELECT func1, func2, CAST(count(*) AS BIGINT) AS cochange_count, string_agg(strftime(ts, '%Y-%m-%d'), ',' ORDER BY ts) AS timestamps FROM events_ GROUP BY func1, func2 HAVING count(*) >= 2")
def cochange_matrix_arrays(spark, d):
    """AG8 SC21 E12."""
    m = mining.cochange_matrix(touched(spark, d), commits(spark, d), arrays=True).where("cochange_count >= 2")
    return m.select("func1", "func2", "cochange_count", F.array_join(F.transform("timestamps", lambda t: F.date_format(t, "yyyy-MM-dd")), ",").alias("timestamps"))


_DIST = "dist AS (SELECT least(src, dst) AS func1, greatest(src, dst) AS func2, min(depth) AS distance FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY 1, 2)"


@query(
    f"""WITH {_TOUCHED}, {_EVENTS}, {_EDGES}, {_HOPS}, {_DIST}, counts AS (SELECT node, count(*) AS n FROM touched GROUP BY node), total AS (SELECT count(DISTINCT c) AS n FROM touched)
SELECT {_PAIR_COLS}, CAST(a.n AS BIGINT) AS func1_modify_count, CAST(b.n AS BIGINT) AS func2_modify_count, CAST(coalesce(distance, -1) AS INT) AS distance
FROM matrix JOIN counts a ON a.node = func1 JOIN counts b ON b.node = func2 CROSS JOIN total LEFT JOIN dist USING (func1, func2)
WHERE cochange_count >= 2 AND unique_authors >= 2 AND coalesce(avg_time_gap, 0) <= 500 AND a.n <= total.n * 0.2 AND b.n <= total.n * 0.2 AND NOT coalesce(distance, -1) > 2"""
)
def cochange_positive_full(spark, d):
    """ML16 FLT11 FLT12 GR2."""
    dist = graph.distances(call_edges(spark, d), 3)
    out = mining.positive_pairs(touched(spark, d), commits(spark, d), dist, 2, 2, 0.2, 2, 500, 0.0)
    return _rounded(out).withColumn("distance", F.col("distance").cast("int"))


@query(
    """WITH t AS (SELECT DISTINCT l_orderkey AS c, p_brand AS node FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT a.node AS func1, b.node AS func2, count(*) AS cochange_count FROM t a JOIN t b ON a.c = b.c AND a.node < b.node GROUP BY 1, 2"""
)
def file_cochange(spark, d):
    """JN19 SET5."""
    return mining.file_cochange(touched_files(spark, d))


@query("SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS modify_count FROM lineitem GROUP BY 1")
def modify_count(spark, d):
    """AG7."""
    return mining.modify_counts(touched(spark, d))


@query(f"WITH {_TOUCHED}, {_EVENTS} SELECT func1, func2, coalesce(strftime(min(ts), '%Y-%m-%d'), '') AS earliest FROM events_ GROUP BY 1, 2")
def pair_earliest(spark, d):
    """AG11."""
    e = mining.pair_events(touched(spark, d), commits(spark, d), dealt=True)
    return e.groupBy("func1", "func2").agg(F.coalesce(F.date_format(F.min("ts"), "yyyy-MM-dd"), F.lit("")).alias("earliest"))


@query("SELECT l_orderkey AS commit, count(DISTINCT p_brand) AS n_files FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def commits_min2_files(spark, d):
    """FLT8 FLT9."""
    return mining.multi_file_commits(touched_files(spark, d).withColumnRenamed("node", "path"))


@query("SELECT o_orderkey AS commit, o_custkey AS author, strftime(o_orderdate, '%Y-%m-%d') AS ts FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def recent_commits(spark, d):
    """ST1 ST2 ST3."""
    return ordering.newest(commits(spark, d), 100).withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


# --- statistics --------------------------------------------------------------------------------------


@query(
    """SELECT (SELECT count(*) FROM orders) AS total_commits, (SELECT count(DISTINCT o_custkey) FROM orders) AS total_authors,
count(*) AS total_files_changed, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_added_lines, CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS total_deleted_lines FROM lineitem"""
)
def commit_totals(spark, d):
    """AG1 AG2 AG26."""
    changes = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))
    return stats.commit_totals(commits(spark, d), changes)


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1")
def monthly_activity(spark, d):
    """AG4 SC11."""
    return stats.monthly_activity(table(spark, d, "lineitem"), "l_shipdate")


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1")
def monthly_events(spark, d):
    """AG4 SC11 on the event table."""
    return stats.monthly_activity(table(spark, d, "events"))


@query(
    r"""WITH p AS (SELECT regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS b FROM pages)
SELECT lower(regexp_extract(b, '[^.][^/]*?(\.[^./]*)$', 1)) AS ext, count(*) AS n FROM p WHERE regexp_extract(b, '[^.][^/]*?(\.[^./]*)$', 1) <> '' GROUP BY 1"""
)
def count_by_extension(spark, d):
    """AG3 SC6."""
    return stats.by_extension(table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path")))


@query("SELECT p_brand || '#' || p_name AS func, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY n DESC, func LIMIT 10")
def top_k_functions(spark, d):
    """ST4 AG5."""
    changes = touched(spark, d).join(functions(spark, d), "node")
    return stats.top(stats.function_modifications(changes), 10, "func")


@query(
    f"""WITH {_EDGES} SELECT count(*) AS total_functions, count(DISTINCT p_brand) AS total_files, count(DISTINCT p_brand || '::' || p_type) AS total_classes,
round(avg(p_size), 2) AS avg_args, round(avg(p_retailprice), 2) AS avg_size, (SELECT count(*) FROM edges) AS total_edges FROM part"""
)
def static_stats(spark, d):
    """AG6 AG12 SC19 GR7."""
    f = table(spark, d, "part").select(F.col("p_brand").alias("file_path"), F.col("p_type").alias("class_name"), F.col("p_size").alias("arg_count"), F.col("p_retailprice").alias("size"))
    return stats.static_statistics(f, call_edges(spark, d))


# --- range joins ---------------------------------------------------------------------------------------

_SPANS = "spans AS (SELECT p_brand AS f, p_partkey AS seq, p_size AS a, p_size + 5 AS b FROM part)"


def _lines_of(spark, d):
    part = functions(spark, d).select(F.col("node").alias("l_partkey"), "file")
    line = table(spark, d, "lineitem").join(part, "l_partkey")
    return line.select(F.col("l_orderkey").alias("commit"), "file", F.col("l_quantity").cast("int").alias("line")).distinct()


def _spans_of(spark, d):
    return functions(spark, d).select("file", F.col("node").alias("seq"), F.col("loc").alias("start_line"), (F.col("loc") + 5).alias("end_line"))


@query(
    f"""WITH {_SPANS}, lines_ AS (SELECT DISTINCT l_orderkey AS commit, p_brand AS file, CAST(l_quantity AS INT) AS line FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT commit, file, line, min(seq) AS first_span FROM lines_ LEFT JOIN spans ON f = file AND line BETWEEN a AND b GROUP BY 1, 2, 3"""
)
def first_match_range(spark, d):
    """JN1 JN4 JN5 WN3."""
    out = ranges.first_enclosing(_lines_of(spark, d), _spans_of(spark, d), ["file"])
    return out.select("commit", "file", "line", F.col("span.seq").alias("first_span"))


@query(
    f"""WITH {_SPANS}, lines_ AS (SELECT DISTINCT p_brand AS file, CAST(l_quantity AS INT) AS line FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT file, seq, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM lines_ JOIN spans ON f = file AND line BETWEEN a - 1 AND b + 1 GROUP BY 1, 2"""
)
def band_match_all(spark, d):
    """JN3."""
    out = ranges.enclosing_band(_lines_of(spark, d).select("file", "line").distinct(), _spans_of(spark, d), ["file"])
    return out.select("file", "seq", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


# --- cascades --------------------------------------------------------------------------------------------

_FUNCS = "funcs AS (SELECT p_partkey AS node_id, 'src/' || p_brand || '/' || p_type || '.py' AS path, CASE WHEN p_size > 10 THEN p_type END AS class_name, p_name AS name, p_partkey AS seq FROM part)"
_HIST = """hist AS (SELECT node_id AS hist_id, CASE seq % 5 WHEN 0 THEN path WHEN 1 THEN path WHEN 2 THEN substr(path, 5) WHEN 3 THEN 'old/' || regexp_extract(path, '[^/]*$') ELSE 'gone.py' END AS path,
  CASE WHEN seq % 5 = 0 THEN class_name END AS class_name, name FROM funcs)"""


def _code_functions(spark, d):
    return functions(spark, d).select(
        F.col("node").alias("node_id"), F.concat(F.lit("src/"), "file", F.lit("/"), "class_name", F.lit(".py")).alias("path"), F.when(F.col("loc") > 10, F.col("class_name")).alias("class_name"), "name", F.col("node").alias("seq")
    )


def _history(spark, d):
    f = _code_functions(spark, d)
    kind = F.col("seq") % 5
    path = F.when(kind <= 1, F.col("path")).when(kind == 2, F.substring("path", 5, 10_000)).when(kind == 3, F.concat(F.lit("old/"), paths.basename(F.col("path")))).otherwise("gone.py")
    return f.select(F.col("node_id").alias("hist_id"), path.alias("path"), F.when(kind == 0, F.col("class_name")).alias("class_name"), "name")


_IDENTITY = f"""{_FUNCS}, {_HIST},
r1 AS (SELECT hist_id, max(node_id) AS node_id, 1 AS rule FROM hist JOIN funcs USING (path, class_name, name) WHERE class_name <> '' GROUP BY 1),
r2 AS (SELECT hist_id, max(node_id) AS node_id, 2 AS rule FROM hist JOIN funcs USING (path, name) GROUP BY 1),
r3 AS (SELECT hist_id, min(node_id) AS node_id, 3 AS rule FROM hist h JOIN funcs f ON h.name = f.name AND ends_with(f.path, h.path) GROUP BY 1),
r4 AS (SELECT hist_id, min(node_id) AS node_id, 4 AS rule FROM hist h JOIN funcs f ON h.name = f.name AND regexp_extract(h.path, '[^/]*$') = regexp_extract(f.path, '[^/]*$') GROUP BY 1),
one AS (SELECT name, min(node_id) AS node_id FROM funcs GROUP BY name HAVING count(*) = 1),
r5 AS (SELECT hist_id, node_id, 5 AS rule FROM hist JOIN one USING (name)),
best AS (SELECT hist_id, arg_min(node_id, rule) AS node_id, min(rule) AS rule FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5) GROUP BY 1)"""


@query(f"WITH {_IDENTITY} SELECT hist_id, best.node_id, CAST(rule AS INT) AS rule FROM hist LEFT JOIN best USING (hist_id)")
def identity_cascade(spark, d):
    """JN7 (JN7a-JN7e) AG13 FLT21."""
    return cascade.match_historical(_history(spark, d), _code_functions(spark, d)).select("hist_id", "node_id", "rule")


@query(f"WITH {_IDENTITY} SELECT count(best.node_id) AS found, count(*) - count(best.node_id) AS unmapped, round(count(best.node_id) / count(*), 6) AS coverage FROM hist LEFT JOIN best USING (hist_id)")
def mapping_coverage(spark, d):
    """AG14 AG27."""
    return stats.coverage(cascade.match_historical(_history(spark, d), _code_functions(spark, d)))


def _calls_of(spark, d):
    f = _code_functions(spark, d).select(F.col("node_id").alias("l_partkey"), "path", "class_name")
    other = table(spark, d, "part").select(F.col("p_partkey").alias("_o"), F.col("p_name").alias("_name"))
    line = table(spark, d, "lineitem").join(f, "l_partkey").withColumn("_o", F.col("l_partkey") % 7 + F.col("l_suppkey")).join(other, "_o")
    called = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string"), F.lit("."), "_name")).otherwise(F.col("_name"))
    ident = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")])
    return line.select(ident.alias("call_id"), "path", "class_name", F.regexp_replace(called, " ", "_").alias("called")).distinct()


def _imports_of(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), "p_brand", F.regexp_replace("p_name", " ", "_").alias("alias0"))
    f = _code_functions(spark, d).join(p, "node_id").select("path", "seq", "alias0", F.concat(F.lit("src."), F.regexp_replace("p_brand", "#", "_"), F.lit(".m")).alias("target"))
    a = f.select("path", F.explode(F.array(F.lit("m0"), F.lit("m1"), F.lit("m2"))).alias("alias"), "target").distinct()
    return a.unionByName(f.where("seq % 3 = 0").select("path", F.col("alias0").alias("alias"), "target").distinct())


def _call_targets(spark, d):
    """Functions with names that may stand in a dotted call, half of them in files that imports reach."""
    f = _code_functions(spark, d).join(functions(spark, d).select(F.col("node").alias("node_id"), "file"), "node_id")
    reach = F.concat(F.lit("src/"), F.regexp_replace("file", "#", "_"), F.lit("/m.py"))
    return f.select("node_id", F.when(F.col("seq") % 2 == 0, reach).otherwise(F.col("path")).alias("path"), "class_name", F.regexp_replace("name", " ", "_").alias("name"), "seq")


_CALLEE = """targets AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey % 2 = 0 THEN 'src/' || replace(p_brand, '#', '_') || '/m.py' ELSE 'src/' || p_brand || '/' || p_type || '.py' END AS path,
  CASE WHEN p_size > 10 THEN p_type END AS class_name, replace(p_name, ' ', '_') AS name, p_partkey AS seq FROM part),
callers AS (SELECT p_partkey, 'src/' || p_brand || '/' || p_type || '.py' AS path, CASE WHEN p_size > 10 THEN p_type END AS class_name FROM part),
calls AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS VARCHAR)) AS call_id, path, class_name,
  replace(CASE WHEN l_linenumber % 2 = 0 THEN 'm' || (l_suppkey % 7) || '.' || other.p_name ELSE other.p_name END, ' ', '_') AS called
  FROM lineitem JOIN callers ON callers.p_partkey = l_partkey JOIN part other ON other.p_partkey = l_partkey % 7 + l_suppkey),
split_ AS (SELECT *, regexp_extract(called, '^(.*)\\.[^.]*$', 1) AS receiver, regexp_extract(called, '([^.]*)$', 1) AS method FROM calls),
imports AS (SELECT DISTINCT 'src/' || p_brand || '/' || p_type || '.py' AS path, 'm' || i AS alias, 'src.' || replace(p_brand, '#', '_') || '.m' AS target FROM part, range(3) t(i)
  UNION ALL SELECT DISTINCT 'src/' || p_brand || '/' || p_type || '.py', replace(p_name, ' ', '_'), 'src.' || replace(p_brand, '#', '_') || '.m' FROM part WHERE p_partkey % 3 = 0),
dot AS (SELECT * FROM split_ WHERE receiver <> ''), plain AS (SELECT * FROM split_ WHERE receiver = ''),
one AS (SELECT name, min(node_id) AS node_id FROM targets GROUP BY name HAVING count(*) = 1),
rules AS (
  SELECT call_id, node_id, 1 AS rule FROM dot JOIN targets t ON t.path = dot.path AND t.class_name = dot.class_name AND t.name = method
  UNION ALL SELECT call_id, node_id, 2 FROM dot JOIN imports i ON i.path = dot.path AND alias = receiver JOIN targets t ON t.name = method AND contains(t.path, replace(target, '.', '/') || '.py')
  UNION ALL SELECT call_id, node_id, 3 FROM dot JOIN targets t ON t.path = dot.path AND t.name = method
  UNION ALL SELECT call_id, node_id, 4 FROM plain JOIN targets t ON t.path = plain.path AND t.name = method
  UNION ALL SELECT call_id, node_id, 5 FROM plain JOIN imports i ON i.path = plain.path AND alias = method JOIN targets t ON t.name = method AND contains(t.path, replace(target, '.', '/') || '.py')
  UNION ALL SELECT call_id, node_id, 6 FROM plain JOIN one ON name = method
  UNION ALL SELECT call_id, node_id, 7 FROM plain JOIN targets t ON t.name = method AND regexp_extract(t.path, '([^/]*)\\.[^.]*$', 1) = regexp_extract(plain.path, '([^/]*)\\.[^.]*$', 1)
  UNION ALL SELECT call_id, min(node_id), 8 FROM plain JOIN targets t ON t.name = method GROUP BY call_id),
best AS (SELECT call_id, min(rule) AS rule, CAST(min(rule * 10000000000 + node_id) % 10000000000 AS BIGINT) AS node_id FROM rules GROUP BY call_id)"""


@query(f"WITH {_CALLEE.replace(chr(92) * 2, chr(92))} SELECT call_id, best.node_id, CAST(rule AS INT) AS rule FROM calls LEFT JOIN best USING (call_id)")
def callee_cascade(spark, d):
    """JN6 SC22."""
    return cascade.resolve_callees(_calls_of(spark, d), _call_targets(spark, d), _imports_of(spark, d)).select("call_id", "node_id", "rule")


_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query(
    f"""WITH n AS (SELECT count(*) // 2 AS half FROM embeddings),
c AS (SELECT a.vec_id AS hist_id, b.vec_id AS node_id, round({_COS} + CASE WHEN a.vec_id % 10 = b.vec_id % 10 THEN 0.2 ELSE 0 END, 9) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label, n WHERE a.vec_id < half AND b.vec_id >= half)
SELECT hist_id, arg_max(node_id, score * 1e6 - node_id * 1e-9) AS node_id, round(max(score), 6) AS score FROM c WHERE score > 0.5 GROUP BY 1"""
)
def similarity_match(spark, d):
    """JN8 SC24: the first half of the vectors against the second, equal labels as equal names."""
    e = table(spark, d, "embeddings")
    half = e.agg(F.floor(F.count("*") / 2)).scalar()
    e = e.select(half.alias("half"), "vec_id", F.col("label").cast("string").alias("name"), F.col("embedding").alias("vector"))
    e = e.withColumn("path", F.concat(F.lit("p"), (F.col("vec_id") % 10).cast("string")))
    hist = e.where("vec_id < half").withColumnRenamed("vec_id", "hist_id")
    funcs = e.where("vec_id >= half").withColumn("seq", F.col("vec_id")).withColumnRenamed("vec_id", "node_id")
    return cascade.match_similar(hist, funcs).withColumn("score", F.round("score", 6))


# --- graph ---------------------------------------------------------------------------------------------------

_POS = f"{_TOUCHED}, pos AS (SELECT a.node AS func1, b.node AS func2 FROM touched a JOIN touched b ON a.c = b.c AND a.node < b.node GROUP BY 1, 2 HAVING count(*) >= 2)"


def _positives(spark, d):
    return mining.pair_counts(touched(spark, d), "n").where("n >= 2").select("func1", "func2")


@query(f"WITH {_POS}, {_EDGES}, p AS (SELECT DISTINCT least(src, dst) AS func1, greatest(src, dst) AS func2 FROM edges WHERE src <> dst) SELECT func1, func2 FROM p ANTI JOIN pos USING (func1, func2)")
def negatives_hard(spark, d):
    """JN11 SET6 Q4."""
    return graph.hard_negatives(call_edges(spark, d), _positives(spark, d))


_DRAW = """rounds AS (SELECT DISTINCT p_partkey AS node, {key} AS k, r, md5(CAST(p_partkey AS VARCHAR) || '|' || r || '|42') AS h FROM part, range(1, {n}) t(r)),
nexts AS (SELECT node, lead(node) OVER (PARTITION BY k, r ORDER BY h, node) AS nx FROM rounds),
drawn AS (SELECT DISTINCT least(node, nx) AS func1, greatest(node, nx) AS func2 FROM nexts WHERE nx IS NOT NULL AND node <> nx)"""


@query(f"WITH {_POS}, {_EDGES}, {_DRAW.format(key='p_brand', n=4)}, p AS (SELECT least(src, dst) AS func1, greatest(src, dst) AS func2 FROM edges) SELECT func1, func2 FROM drawn ANTI JOIN pos USING (func1, func2) ANTI JOIN p USING (func1, func2)")
def negatives_intra_file(spark, d):
    """JN12 ST6 ST11 GR5."""
    return graph.intra_file_negatives(functions(spark, d), call_edges(spark, d), _positives(spark, d), 3, ["file"])


@query(f"WITH {_EDGES}, {_HOPS}, dist AS (SELECT least(src, dst) AS func1, greatest(src, dst) AS func2, min(depth) AS distance FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2) SELECT func1, func2, CAST(distance AS INT) AS distance FROM dist")
def static_positives(spark, d):
    """JN13 GR3."""
    return graph.distances(call_edges(spark, d), 2)


@query(
    f"""WITH RECURSIVE {_EDGES}, {_DRAW.format(key='0', n=2)}, e AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
starts AS (SELECT func1 AS s FROM drawn UNION SELECT func2 FROM drawn),
ways AS (SELECT s, s AS t FROM starts UNION SELECT s, dst FROM ways JOIN e ON t = src)
SELECT func1, func2 FROM drawn WHERE NOT EXISTS (SELECT 1 FROM ways WHERE s = func1 AND t = func2) AND NOT EXISTS (SELECT 1 FROM ways WHERE s = func2 AND t = func1)"""
)
def static_negatives(spark, d):
    """JN14 GR9 ST12."""
    return graph.unreachable_negatives(functions(spark, d), call_edges(spark, d))


@query(
    f"""WITH {_EDGES}, {_HOPS} SELECT a.p_partkey AS func1, b.p_partkey AS func2 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey
UNION SELECT least(src, dst), greatest(src, dst) FROM (SELECT src, dst FROM h1 UNION ALL SELECT src, dst FROM h2)"""
)
def candidates(spark, d):
    """SET4 JN18 FLT19 Q5."""
    return graph.candidates(functions(spark, d), call_edges(spark, d), ["file", "class_name"])


@query(f"WITH {_EDGES} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1")
def out_in_degree(spark, d):
    """GR1 GR4 GR5 GR7."""
    return graph.degrees(call_edges(spark, d))


@query(f"WITH {_EDGES}, {_HOPS}, {_DIST} SELECT func1, func2, CAST(distance AS INT) AS distance FROM dist")
def bfs_distance(spark, d):
    """GR2."""
    return graph.distances(call_edges(spark, d), 3)


def _rank_sql(n: int) -> str:
    steps = ["r0 AS (SELECT p_partkey AS node, 1.0::DOUBLE / (SELECT count(*) FROM part) AS rank FROM part)"]
    for i in range(1, n + 1):
        p = f"r{i - 1}"
        steps.append(
            f"""r{i} AS (SELECT node, 0.15::DOUBLE / (SELECT count(*) FROM part) + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM {p} WHERE node NOT IN (SELECT src FROM edges)) / (SELECT count(*) FROM part)) AS rank
  FROM {p} LEFT JOIN (SELECT dst AS node, sum(rank / n) AS got FROM edges JOIN outs USING (src) JOIN {p} ON node = src GROUP BY 1) AS g{i} USING (node))"""
        )
    return f"WITH {_EDGES}, outs AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), {', '.join(steps)} SELECT node, round(rank * 1000, 6) AS rank FROM r{n}"


@query(_rank_sql(5))
def pagerank(spark, d):
    """GR6."""
    out = graph.pagerank(call_edges(spark, d), functions(spark, d), 5)
    return out.withColumn("rank", F.round(1000 * F.col("rank"), 6))


# --- labels and splits -----------------------------------------------------------------------------------------

_LABELED = f"{_TOUCHED}, {_EVENTS}, {_EDGES}, pos AS (SELECT func1, func2, 1 AS label, strftime(first_ts, '%Y-%m-%d') AS first_ts FROM matrix WHERE cochange_count >= 2), p AS (SELECT DISTINCT least(src, dst) AS func1, greatest(src, dst) AS func2 FROM edges WHERE src <> dst), labeled AS (SELECT * FROM pos UNION ALL SELECT func1, func2, 0, NULL FROM p ANTI JOIN pos USING (func1, func2))"
_SPLIT = "CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END"
_TEMPORAL = f"""{_LABELED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY coalesce(first_ts, ''), {_KEY}, func1, func2) AS r, count(*) OVER (PARTITION BY label) AS n FROM labeled),
split_ AS (SELECT func1, func2, label, {_SPLIT} AS split FROM ranked)"""


def _labeled(spark, d):
    pos = mining.cochange_matrix(touched(spark, d), commits(spark, d)).where("cochange_count >= 2")
    pos = settle(pos.select("func1", "func2", F.lit(1).alias("label"), F.date_format("first_ts", "yyyy-MM-dd").alias("first_ts")))
    neg = graph.hard_negatives(call_edges(spark, d), pos).withColumn("label", F.lit(0))
    return pos.unionByName(neg, allowMissingColumns=True)


@query(f"WITH {_TEMPORAL} SELECT * FROM split_")
def temporal_split(spark, d):
    """WN4 ML19 ST10 SET1 FLT17."""
    return ordering.temporal_split(_labeled(spark, d)).select("func1", "func2", "label", "split")


@query(f"WITH {_LABELED}, ranked AS (SELECT *, row_number() OVER (ORDER BY {_KEY}, func1, func2) AS r, count(*) OVER () AS n FROM labeled) SELECT func1, func2, label, {_SPLIT} AS split FROM ranked")
def random_split(spark, d):
    """ML20."""
    return ordering.random_split(_labeled(spark, d)).select("func1", "func2", "label", "split")


@query(
    f"""WITH {_TEMPORAL} SELECT split, count(*) AS total_pairs, CAST(sum(label) AS BIGINT) AS positive_pairs, CAST(count(*) - sum(label) AS BIGINT) AS negative_pairs,
round(coalesce((count(*) - sum(label)) / nullif(sum(label), 0), 1.0), 6) AS class_ratio, round(avg(label), 6) AS positive_rate FROM split_ GROUP BY 1"""
)
def label_statistics(spark, d):
    """AG25 AG16 FLT17."""
    return stats.label_statistics(ordering.temporal_split(_labeled(spark, d)))


@query("SELECT o_orderstatus AS project, count(*) AS n, count(DISTINCT o_custkey) AS authors FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def joint_union(spark, d):
    """SET2."""
    o = table(spark, d, "orders")
    both = models.union_projects({s: o.where(F.col("o_orderstatus") == s) for s in ("F", "O")})
    return both.groupBy("project").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("authors"))


# --- text: diffs, paths, times, code --------------------------------------------------------------------------------

_DIFFS = [
    "@@ -1,3 +1,4 @@\n a\n-b\n+B\n+C\n c",
    "@@ -10,2 +10,4 @@\n x\n\n+y\n+++z\n+w",
    "+q\n@@ -1 +1 @@\n+r",
    "@@ -1,2 +1,3 @@\n a\n+b\n c\n@@ -20,3 +21,2 @@\n-x\n-y\n z\n\\ No newline at end of file",
    "",
]


def _values(rows) -> str:
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "(VALUES " + ", ".join(f"({i}, {quote(s)})" for i, s in enumerate(rows)) + ") AS v(id, s)"


def _rows(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, s string")


_DIFF_LINES = rf"""l AS (SELECT id, i, string_split(s, chr(10))[i] AS line FROM {_values(_DIFFS)}, unnest(range(1, len(string_split(s, chr(10))) + 1)) AS u(i)),
m AS (SELECT *, starts_with(line, '@@') AS hd, starts_with(line, '+') AND NOT starts_with(line, '+++') AS ad, starts_with(line, '-') AND NOT starts_with(line, '---') AS de FROM l),
k AS (SELECT *, sum(hd::INT) OVER (PARTITION BY id ORDER BY i) AS h FROM m),
s AS (SELECT *, max(CASE WHEN hd THEN TRY_CAST(regexp_extract(line, '\+(\d+)', 1) AS INT) END) OVER (PARTITION BY id, h) AS ns, max(CASE WHEN hd THEN TRY_CAST(regexp_extract(line, '^@@ -(\d+)', 1) AS INT) END) OVER (PARTITION BY id, h) AS os FROM k)"""


@query(
    rf"""WITH {_DIFF_LINES}, n AS (SELECT id, i, ns + coalesce(sum((NOT hd AND (ad OR starts_with(line, ' ')))::INT) OVER (PARTITION BY id, h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, ad AND h > 0 AS hit FROM s)
SELECT v.id, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY i), '') AS lines FROM {_values(_DIFFS)} LEFT JOIN n ON n.id = v.id AND hit GROUP BY 1"""
)
def diff_added_lines(spark, d):
    """SC1 SC3 WN2."""
    return _rows(spark, _DIFFS).select("id", F.array_join(diff_fn.modified_lines(F.col("s")).cast("array<string>"), ",").alias("lines"))


@query(
    rf"""WITH {_DIFF_LINES}, n AS (SELECT id, i, ad, de,
  coalesce(ns, 0) + coalesce(sum((NOT hd AND (ad OR NOT (ad OR de OR starts_with(line, '\'))))::INT) OVER w, 0) AS na,
  coalesce(os, 0) + coalesce(sum((NOT hd AND (de OR NOT (ad OR de OR starts_with(line, '\'))))::INT) OVER w, 0) AS oa
  FROM s WINDOW w AS (PARTITION BY id, h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT id, string_agg(CAST(na AS VARCHAR), ',' ORDER BY i) AS added FROM n WHERE ad GROUP BY 1),
b AS (SELECT id, string_agg(CAST(oa AS VARCHAR), ',' ORDER BY i) AS deleted FROM n WHERE de GROUP BY 1),
c AS (SELECT id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) AS all_modified FROM (SELECT id, na AS x FROM n WHERE ad UNION SELECT id, oa FROM n WHERE de) GROUP BY 1)
SELECT v.id, coalesce(added, '') AS added, coalesce(deleted, '') AS deleted, coalesce(all_modified, '') AS all_modified FROM {_values(_DIFFS)} LEFT JOIN a ON a.id = v.id LEFT JOIN b ON b.id = v.id LEFT JOIN c ON c.id = v.id"""
)
def diff_added_deleted(spark, d):
    """SC2 SC3 ST7 SET3 Q6."""
    f = _rows(spark, _DIFFS).select("id", diff_fn.added_deleted_lines(F.col("s")).alias("x"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return f.select("id", text(F.col("x.added")).alias("added"), text(F.col("x.deleted")).alias("deleted"), text(diff_fn.all_modified(F.col("x.added"), F.col("x.deleted"))).alias("all_modified"))


_PATHS = ["Proj/source_code/a/b.py", "projects\\X\\y.c", "/a/b.py", "", "a/projects/b/projects/c.JAVA", ".hidden", "dir.d/file", "x.tar.gz"]
_NORM = "ltrim(CASE " + " ".join(f"WHEN strpos(p, '{x}') > 0 THEN substr(p, strpos(p, '{x}') + {len(x)})" for x in paths.PATH_PREFIXES) + " ELSE p END, '/')"


@query(
    rf"""WITH raw AS (SELECT CAST(page_id AS BIGINT) AS id, regexp_replace(url, '^.*?://', '') AS s FROM pages UNION ALL SELECT -1 - id, s FROM {_values(_PATHS)}),
p AS (SELECT id, replace(s, '\', '/') AS p FROM raw), n AS (SELECT id, {_NORM} AS path FROM p)
SELECT id, path, regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.][^/]*?(\.[^./]*)$', 1)) AS ext,
CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, CAST(len(string_split(path, '/')) AS INT) AS depth, path || '::::' || regexp_extract(path, '([^/]*)$', 1) AS node_id FROM n"""
)
def path_normalize(spark, d):
    """SC5 SC6 SC9 SC10."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_replace("url", "^.*?://", "").alias("s"))
    both = pages.unionByName(_rows(spark, _PATHS).select((-1 - F.col("id")).cast("long").alias("id"), "s"))
    p = both.select("id", paths.normalize(F.col("s")).alias("path"))
    c = F.col("path")
    return p.select("id", "path", paths.basename(c).alias("base"), paths.extension(c).alias("ext"), paths.dirname(c).alias("dir"), paths.depth(c).alias("depth"), paths.node_id(c, F.lit(None).cast("string"), paths.basename(c)).alias("node_id"))


_LANGS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items())


@query(rf"SELECT id, CASE lower(regexp_extract(s, '(\.[^./]*)$', 1)) {_LANGS} END AS language FROM {_values(['a.py', 'b/c.TSX', 'd.h', 'e.cc', 'f.rs', 'g', 'h.hpp'])}")
def language_of(spark, d):
    """FLT1 FLT2."""
    return _rows(spark, ["a.py", "b/c.TSX", "d.h", "e.cc", "f.rs", "g", "h.hpp"]).select("id", paths.language(F.col("s")).alias("language"))


@query("SELECT event_id, user_id, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000) AS BIGINT) AS gap FROM events")
def day_gap(spark, d):
    """SC12 SC13 Q7."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", times.day_gap(F.lag("ts").over(w), F.col("ts")).alias("gap"))


_CODE = ["def a(x):\n    return b(x)\n\ndef a(y) :\n    pass", "async def q():\n  c(1)", "print(1)\nif (x):\n  f (2)"]


@query(rf"SELECT id, array_to_string(regexp_extract_all(s, '([\p{{L}}\p{{N}}_]+)\s*\(', 1), ',') AS calls FROM {_values(_CODE)} UNION ALL SELECT 100 + CAST(page_id AS INT), array_to_string(regexp_extract_all(html, '([\p{{L}}\p{{N}}_]+)\s*\(', 1), ',') FROM pages")
def regex_calls(spark, d):
    """PR14."""
    inline = _rows(spark, _CODE)
    pages = table(spark, d, "pages").select((F.col("page_id") + 100).cast("int").alias("id"), F.col("html").alias("s"))
    return inline.unionByName(pages).select("id", F.array_join(parse.call_names(F.col("s")), ",").alias("calls"))


@query(rf"SELECT id, array_to_string(regexp_extract_all(s, 'def\s+(\w+)\s*\([^)]*\)\s*:', 1), ',') AS functions FROM {_values(_CODE)}")
def regex_functions(spark, d):
    """PR7."""
    return _rows(spark, _CODE).select("id", F.array_join(parse.python_function_names(F.col("s")), ",").alias("functions"))


@query()
def parse_sources(spark, d):
    """PR1 PR2 PR9 PR10 PR15 PR19 PR20: a file of each language."""
    files = spark.createDataFrame(
        [
            ("a.py", "python", "import os.path as p\nfrom m import n\nclass A:\n    def f(self, x, y=1):\n        return n(p.join(x))\n\ndef g():\n    A().f(1)\n"),
            ("B.java", "java", "import java.util.List;\npublic class B {\n  public int go(int a) {\n    return helper.run(a);\n  }\n}\n"),
            ("c.js", "javascript", "const fs = require('fs');\nfunction read(p) {\n  return fs.open(p);\n}\n"),
            ("d.c", "c", '#include "x/y.h"\nint add(int a, int b) {\n  return sum(a, b);\n}\n'),
        ],
        "path string, language string, code string",
    )
    p = parse.parse_files(files)
    names = lambda c, f: F.array_join(F.transform(c, f), ",")
    return p.select(
        "path",
        names("functions", lambda f: F.concat(f["name"], F.lit(":"), f["start_line"].cast("string"), F.lit("-"), f["end_line"].cast("string"))).alias("functions"),
        names("calls", lambda c: c["function"]).alias("calls"),
        names("classes", lambda c: c["name"]).alias("classes"),
        F.array_join(F.array_sort(F.map_keys("imports")), ",").alias("imports"),
    )


@query(rf"SELECT id, CASE WHEN id = 2 THEN '' ELSE array_to_string(string_split(s, chr(10))[2:3], chr(10)) END AS body FROM {_values(_CODE[:1] + ['a' + chr(10) + 'b' + chr(10) + 'c', 'one'])}")
def body_slice(spark, d):
    """SC7."""
    return _rows(spark, [_CODE[0], "a\nb\nc", "one"]).select("id", code_fn.body(F.col("s"), F.lit(2), F.lit(3)).alias("body"))


# --- features ------------------------------------------------------------------------------------------------------


def _vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", F.lit(1).alias("start_line"), (F.col("label") + 3).cast("int").alias("end_line"), F.col("label").alias("arg_count"))
    return features.function_vector(e, None).select("node_id", "features")


@query("SELECT vec_id AS node_id, CAST(len(embedding) + 2 AS INT) AS dim, CAST(label + 2 AS DOUBLE) AS loc, CAST(label AS DOUBLE) AS args, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def function_vectors(spark, d):
    """ML4 ML6 ML7 SC16."""
    v = _vectors(spark, d)
    plain = F.slice("features", 1, F.size("features") - 2)
    total = F.aggregate(plain, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return v.select("node_id", F.size("features").alias("dim"), F.element_at("features", -2).cast("double").alias("loc"), F.element_at("features", -1).cast("double").alias("args"), F.round(total, 4).alias("total"))


@query(
    """WITH n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [CAST(label + 2 AS DOUBLE), CAST(label AS DOUBLE)]) AS f FROM embeddings),
p AS (SELECT vec_id AS func1, vec_id + 1 AS func2 FROM embeddings), j AS (SELECT func1, func2, a.f AS f1, b.f AS f2 FROM p LEFT JOIN v a ON a.vec_id = func1 LEFT JOIN v b ON b.vec_id = func2)
SELECT func1, func2, CAST(4 * 66 + 5 AS INT) AS dim, round(coalesce(list_sum(f1) + list_sum(f2), 0), 4) AS sides,
round(coalesce(list_sum(list_transform(list_zip(f1, f2), lambda x: abs(x[1] - x[2]))), 0), 4) AS differences, round(coalesce(list_dot_product(f1, f2), 0), 4) AS products FROM j"""
)
def pair_features(spark, d):
    """ML8 ML9 JN15 JN16 SC15: the last pair has a missing side."""
    v = _vectors(spark, d)
    pairs = v.select(F.col("node_id").alias("func1"), (F.col("node_id") + 1).alias("func2"))
    p = features.pair_features(pairs, v, 66)
    part = lambda k, n=1: F.round(F.aggregate(F.slice("features", k * 66 + 1, n * 66), F.lit(0.0), lambda s, x: s + x), 4)
    return p.select("func1", "func2", F.size("features").alias("dim"), part(0, 2).alias("sides"), part(2).alias("differences"), part(3).alias("products"))


@query(
    """WITH p AS (SELECT p_partkey AS func1, p_partkey + 1 AS func2, p_brand || '/' || p_type || '/' || p_name AS a FROM part)
SELECT p.func1, p.func2, CAST(a = b.p_brand || '/' || b.p_type || '/' || b.p_name AS DOUBLE) AS same_file, CAST(regexp_replace(a, '/[^/]*$', '') = b.p_brand || '/' || b.p_type AS DOUBLE) AS same_dir,
CAST(abs(len(string_split(a, '/')) - len(string_split(b.p_brand || '/' || b.p_type || '/' || b.p_name, '/'))) AS DOUBLE) AS depth_diff FROM p JOIN part b ON b.p_partkey = func2"""
)
def structural_features(spark, d):
    """JN17 SC17."""
    f = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", "p_name").alias("path"))
    a, b = f.select(F.col("p_partkey").alias("func1"), (F.col("p_partkey") + 1).alias("func2"), F.col("path").alias("p1")), f.select(F.col("p_partkey").alias("func2"), F.col("path").alias("p2"))
    s = a.join(b, "func2").select("func1", "func2", paths.structural(F.col("p1"), F.col("p2")).alias("x"))
    return s.select("func1", "func2", s["x"][0].alias("same_file"), s["x"][1].alias("same_dir"), s["x"][2].alias("depth_diff"))


_LONG = "x AS (SELECT vec_id, i - 1 AS position, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)), fit AS (SELECT position, avg(x) AS mean, stddev_pop(x) AS std FROM x GROUP BY 1)"


@query(f"WITH {_LONG} SELECT CAST(position AS INT) AS position, round(mean, 5) AS mean, round(std, 5) AS std FROM fit")
def scaler_fit(spark, d):
    """AG23."""
    e = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"))
    return features.fit_scaler(e).select("position", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"WITH {_LONG} SELECT vec_id, round(sum((x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END), 4) AS total FROM x JOIN fit USING (position) GROUP BY 1")
def scaler_apply(spark, d):
    """ML10 ML14 ST13."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    s = features.adaptive_scale(e, None, "vec_id")
    return s.select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_TERMS = r"""tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 256)"""


@query(f"WITH {_TERMS} SELECT term, total, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS position FROM vocab")
def tfidf_top_terms(spark, d):
    """ML1 AG24."""
    return features.vocabulary(features.term_counts(table(spark, d, "documents"), "doc_id"))


@query(
    f"""WITH {_TERMS}, n AS (SELECT count(*) AS n FROM documents), raw AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term), n)
SELECT id AS doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM raw"""
)
def tfidf_weights(spark, d):
    """ML1 ML2."""
    w = features.vocabulary_weights(table(spark, d, "documents"), "doc_id")
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


# --- metrics ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_SCORED} SELECT min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(median(score), 6) AS median_score,
count(*) FILTER (score > 0.1) AS above_10, count(*) FILTER (score > 0.3) AS above_30, count(*) FILTER (score > 0.5) AS above_50, count(*) FILTER (score > 0.7) AS above_70 FROM scored"""
)
def prob_distribution(spark, d):
    """AG15."""
    return metrics.distribution(scored(spark, d))


_CONF = "c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp, count(*) FILTER (score < 0.5 AND label <> 1) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM scored)"


@query(
    f"""WITH {_SCORED}, {_CONF} SELECT tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM c"""
)
def confusion_prf(spark, d):
    """AG17 AG18 FLT16."""
    return metrics.confusion(scored(spark, d), 0.5)


_AUC = """r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scored),
t AS (SELECT sum(rk) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM r), auc AS (SELECT round((s - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n), 6) AS auc_roc FROM t)"""


@query(f"WITH {_SCORED}, {_AUC} SELECT auc_roc FROM auc")
def auc_roc(spark, d):
    """AG19 WN6."""
    return metrics.auc_roc(scored(spark, d))


_CURVE = """u AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM scored GROUP BY 1),
curve AS (SELECT score, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS total FROM u WINDOW w AS (ORDER BY score DESC))"""


@query(f"WITH {_SCORED}, {_CURVE} SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) AS avg_precision FROM curve")
def avg_precision(spark, d):
    """AG20."""
    return metrics.average_precision(scored(spark, d))


@query(
    f"""WITH {_SCORED}, t AS (SELECT count(*) AS n, sum(label) AS p FROM scored), r AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rk FROM scored)
SELECT CAST(k AS INT) AS k, round(sum(label) FILTER (rk <= k) / k, 6) AS precision, round(sum(label) FILTER (rk <= k) / p, 6) AS recall FROM r, t, (VALUES (50), (100), (200), (500)) AS ks(k) WHERE k <= n GROUP BY k, p"""
)
def precision_at_k(spark, d):
    """ST8 WN5 FLT22 Q21."""
    return metrics.precision_at_k(scored(spark, d))


@query(
    f"""WITH {_SCORED}, {_CURVE}, f AS (SELECT score AS threshold, tp / (tp + fp) AS precision, tp / total AS recall, round(2 * (tp / (tp + fp)) * (tp / total) / nullif(tp / (tp + fp) + tp / total, 0), 9) AS f1 FROM curve)
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM f WHERE f1 IS NOT NULL ORDER BY f.f1 DESC, f.threshold LIMIT 1"""
)
def pr_curve_best_f1(spark, d):
    """AG22 ST15 Q14."""
    return metrics.best_f1(scored(spark, d))


@query(
    f"""WITH {_SCORED}, {_CONF}, e AS (SELECT '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS s FROM c
UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM c)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM e
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(s) AS BIGINT) FROM e
UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM e"""
)
def classification_report(spark, d):
    """AG21."""
    return metrics.classification_report(scored(spark, d), 0.5)


@query(f"WITH {_SCORED}, {_AUC} SELECT auc_roc, CASE WHEN auc_roc > 0.8 THEN 'excellent' WHEN auc_roc > 0.7 THEN 'good' WHEN auc_roc > 0.6 THEN 'fair' ELSE 'poor' END AS tier FROM auc")
def eval_tier(spark, d):
    """SC18 ML15."""
    return metrics.evaluate(scored(spark, d)).select("auc_roc", "tier")


@query(
    f"""WITH {_TOUCHED}, n AS (SELECT a.node AS func1, b.node AS func2, count(*) AS k FROM touched a JOIN touched b ON a.c = b.c AND a.node < b.node GROUP BY 1, 2)
SELECT func1 AS src, func2 AS dst, round(k / (k + 1), 6) AS weight FROM n WHERE k / (k + 1) >= 0.6"""
)
def threshold_edges(spark, d):
    """FLT15 GR8."""
    p = mining.pair_counts(touched(spark, d), "k").withColumn("score", F.col("k") / (F.col("k") + 1))
    return models.threshold_edges(p, 0.6).withColumn("weight", F.round("weight", 6))


@query()
def train_predict(spark, d):
    """ML11 ML12 ML13 ML20: pairs of whole vectors, positive if their labels agree; the single-project model with its own
    settings learns from the training split and scores the others."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("features"))
    pairs = e.select(F.col("vec_id").alias("func1"), F.col("label").alias("l1")).join(e.select((F.col("vec_id") - 1).alias("func1"), F.col("vec_id").alias("func2"), F.col("label").alias("l2")), "func1")
    data = features.pair_features(pairs.select("func1", "func2", (F.col("l1") == F.col("l2")).cast("int").alias("label")), v, 64)
    data = settle(ordering.random_split(data).drop("rank", "n"))
    model = models.train(data.where("split = 'train'"))
    return models.predict(model, data.where("split <> 'train'")).select("func1", "func2", "split", "label", F.round("score", 6).alias("score"))


# --- further operators ---------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_SCORED}, {_CURVE}, f AS (SELECT score, tp / (tp + fp) AS p, tp / total AS r FROM curve)
SELECT round(score, 6) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM f"""
)
def pr_curve(spark, d):
    """AG22: the whole curve."""
    c = metrics.pr_curve(scored(spark, d))
    return c.select(F.round("threshold", 6).alias("threshold"), *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("SELECT page_id, len(list_filter(range(page_id % 90 + 1, page_id % 90 + 4), lambda n: contains(html, CAST(n AS VARCHAR)))) > 0 AS mentioned FROM pages")
def diff_mentions_span(spark, d):
    """JN2: the page is the diff's text, the span three lines."""
    start = (F.col("page_id") % 90 + 1).cast("int")
    return table(spark, d, "pages").select("page_id", code_fn.mentions_line(F.col("html"), start, start + 2).alias("mentioned"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(url, '/+$', ''), '\.git$', ''), '([^/:]*)$', 1), ''), 'cloned_repo') AS name FROM pages")
def repository_names(spark, d):
    """SC23."""
    return table(spark, d, "pages").select("page_id", paths.repository_name(F.col("url")).alias("name"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def iso_times(spark, d):
    """SC12: times as ISO text with 'Z', parsed again."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, d, "events").select("event_id", F.unix_seconds(times.parse(text)).alias("seconds"))


@query("SELECT l_orderkey AS commit, p_brand AS file_path, p_name AS name, p_size AS start_line, p_size + 5 AS end_line FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def affected_functions(spark, d):
    """SET7."""
    f = touched(spark, d).join(functions(spark, d), "node")
    f = f.select("commit", F.col("file").alias("file_path"), "name", F.col("loc").alias("start_line"), (F.col("loc") + 5).alias("end_line"))
    return ranges.affected_functions(f)


@query("SELECT p_partkey, p_brand || '::' || coalesce(CASE WHEN p_size > 10 THEN p_type END, '') || '::' || p_name AS node_id, true AS valid, p_name AS name, p_brand AS path FROM part")
def node_ids(spark, d):
    """SC9 FLT18."""
    f = functions(spark, d).select(F.col("node").alias("p_partkey"), paths.node_id(F.col("file"), F.when(F.col("loc") > 10, F.col("class_name")), F.col("name")).alias("node_id"))
    parts = paths.split_node_id(F.col("node_id"))
    return f.select("p_partkey", "node_id", paths.is_node_id(F.col("node_id")).alias("valid"), parts["name"].alias("name"), parts["path"].alias("path"))


@query(f"WITH {_TOUCHED}, n AS (SELECT node, count(*) AS n FROM touched GROUP BY 1) SELECT p_partkey AS func1, p_partkey + 1 AS func2, CAST(coalesce(a.n, 0) AS DOUBLE) AS e1, CAST(coalesce(b.n, 0) AS DOUBLE) AS e2 FROM part LEFT JOIN n a ON a.node = p_partkey LEFT JOIN n b ON b.node = p_partkey + 1")
def evolution_features(spark, d):
    """JN16 AG7."""
    f = functions(spark, d)
    v = f.select(F.col("node").alias("node_id"), F.array(F.col("loc").cast("double")).alias("features"))
    p = features.pair_features(f.select(F.col("node").alias("func1"), (F.col("node") + 1).alias("func2")), v, 1, mining.modify_counts(touched(spark, d)))
    return p.select("func1", "func2", F.element_at("features", -2).alias("e1"), F.element_at("features", -1).alias("e2"))


@query(
    f"""WITH {_LONG.replace("x AS (SELECT", "few AS (SELECT * FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 5000), all_ AS (SELECT vec_id, i - 1 AS position, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)), x AS (SELECT", 1).replace("FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)), fit", "FROM few, unnest(range(1, len(embedding) + 1)) AS u(i)), fit")}
SELECT vec_id, round(sum((all_.x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END), 4) AS total FROM all_ JOIN fit USING (position) GROUP BY 1"""
)
def adaptive_scaler(spark, d):
    """ML14 ST13: fitted on the first five thousand in hashed order (the sample is the feature)."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    s = features.adaptive_scale(e, 5000, "vec_id")
    return s.select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"WITH {_POS}, {_EDGES}, q AS (SELECT CAST(floor(count(*) * 2.5) AS BIGINT) // 2 AS n FROM pos), p AS (SELECT DISTINCT least(src, dst) AS func1, greatest(src, dst) AS func2 FROM edges WHERE src <> dst), h AS (SELECT func1, func2, row_number() OVER (ORDER BY {_KEY}, func1, func2) AS r FROM p ANTI JOIN pos USING (func1, func2)) SELECT func1, func2 FROM h, q WHERE r <= n")
def negatives_quota(spark, d):
    """ML17 ST5 ST9: hard negatives up to half of the quota."""
    pos = settle(_positives(spark, d))
    half = ordering.quota(pos.count(), 2.5)[1]
    return graph.first_by_key(graph.hard_negatives(call_edges(spark, d), pos), half)


@query("SELECT CASE regexp_extract(p_name, '^[^ ]*') WHEN '' THEN 'other' ELSE regexp_extract(p_name, '^[^ ]*') END AS language, count(*) AS n FROM part GROUP BY 1")
def by_language(spark, d):
    """AG6: functions by language; the name's first word stands for it."""
    return stats.by_language(functions(spark, d).select(F.regexp_extract("name", "^[^ ]*", 0).alias("language")))


@query(
    f"""SELECT 'c1' AS commit, '2024-01-01T00:00:00Z' AS ts, 'A' AS author, CASE id WHEN 0 THEN 'a.py' ELSE 'x/b.py' END AS path, added, deleted, all_modified
FROM ({SQL["diff_added_deleted"]}) WHERE id < 2 AND all_modified <> ''"""
)
def commit_details(spark, d):
    """SC4 FLT6 FLT7: inline commits; a file without any path and one without a diff are left out, and with it its commit."""
    files = "array<struct<filename:string,new_path:string,diff:string>>"
    rows = [("c1", "2024-01-01T00:00:00Z", ("A",), [("a.py", "", _DIFFS[0]), ("", None, _DIFFS[0]), ("b.py", "x/b.py", _DIFFS[1])]), ("c2", None, None, [("c.py", None, "")])]
    c = spark.createDataFrame(rows, f"hash string, committer_date string, author struct<name:string>, files_modified {files}")
    lists = {x: F.array_join(F.col(x).cast("array<string>"), ",") for x in ("added", "deleted", "all_modified")}
    return static_analysis.commit_details(c).withColumns(lists)


_CALLED = "called AS (SELECT least(src, dst) AS func1, greatest(src, dst) AS func2 FROM edges)"


@query(
    f"""WITH {_POS}, {_EDGES}, {_DRAW.format(key='p_brand', n=6)}, {_CALLED}, q AS (SELECT CAST(floor(count(*) * 2.5) AS BIGINT) AS n FROM pos),
h AS (SELECT func1, func2, row_number() OVER (ORDER BY {_KEY}, func1, func2) AS r FROM (SELECT DISTINCT func1, func2 FROM called WHERE func1 <> func2) ANTI JOIN pos USING (func1, func2)),
hard AS (SELECT func1, func2 FROM h, q WHERE r <= n // 2),
f AS (SELECT func1, func2, row_number() OVER (ORDER BY {_KEY}, func1, func2) AS r FROM drawn ANTI JOIN pos USING (func1, func2) ANTI JOIN called USING (func1, func2) ANTI JOIN hard USING (func1, func2))
SELECT func1, func2, 'hard' AS type FROM hard UNION ALL SELECT func1, func2, 'intra_file' FROM f, q WHERE r <= n - (SELECT count(*) FROM hard)"""
)
def negative_samples(spark, d):
    """ML17: the quota filled with hard and same-file negatives."""
    return graph.negatives(_positives(spark, d), functions(spark, d), call_edges(spark, d), ["file"])


_DRAW_FILE = _DRAW.format(key="p_brand", n=6).replace("rounds AS", "rounds2 AS").replace("nexts AS", "nexts2 AS").replace("FROM rounds)", "FROM rounds2)").replace("drawn AS", "drawn2 AS").replace("FROM nexts WHERE", "FROM nexts2 WHERE")


@query(
    f"""WITH RECURSIVE {_EDGES}, {_HOPS}, {_CALLED}, {_DRAW.format(key='0', n=4)}, {_DRAW_FILE},
pos AS (SELECT least(src, dst) AS func1, greatest(src, dst) AS func2, min(depth) AS distance FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2),
q AS (SELECT CAST(floor(count(*) * 2.5) AS BIGINT) AS n FROM pos),
starts AS (SELECT func1 AS s FROM drawn UNION SELECT func2 FROM drawn),
ways AS (SELECT s, s AS t FROM starts UNION SELECT s, dst FROM ways JOIN e ON t = src),
apart AS (SELECT func1, func2 FROM drawn WHERE NOT EXISTS (SELECT 1 FROM ways WHERE s = func1 AND t = func2) AND NOT EXISTS (SELECT 1 FROM ways WHERE s = func2 AND t = func1)),
a AS (SELECT func1, func2, row_number() OVER (ORDER BY {_KEY}, func1, func2) AS r FROM apart ANTI JOIN pos USING (func1, func2)),
far AS (SELECT func1, func2 FROM a, q WHERE r <= n),
f AS (SELECT func1, func2, row_number() OVER (ORDER BY {_KEY}, func1, func2) AS r FROM drawn2 ANTI JOIN pos USING (func1, func2) ANTI JOIN called USING (func1, func2) ANTI JOIN far USING (func1, func2))
SELECT func1, func2, CAST(distance AS INT) AS distance, 1 AS label FROM pos UNION ALL SELECT func1, func2, -1, 0 FROM far
UNION ALL SELECT func1, func2, -1, 0 FROM f, q WHERE r <= n - (SELECT count(*) FROM far)"""
)
def static_samples(spark, d):
    """ML18."""
    return graph.static_samples(functions(spark, d), call_edges(spark, d), ["file"])
