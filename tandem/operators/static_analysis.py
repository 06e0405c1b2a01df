"""Source trees to function metadata and call graph (E6, E7, GR1, JN4-JN6) and histories to functions (JN1, JN7, FLT6-FLT9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import body
from ..functions.diff import added_deleted_lines, all_modified
from ..functions.paths import node_id
from .cascade import resolve_callees
from .graph import build
from .parse import parse_files
from .ranges import first_enclosing


def function_metadata(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """E6: one row for each node id; of equal ids the last by line. ``files`` has (path, language, code).

    The enclosing class is the first whose span holds the function's first line; it is looked up in the
    file's own array, without a join. ``seq`` orders by path and line.
    """
    p = parsed if parsed is not None else parse_files(files)
    f = p.select("path", "classes", F.explode("functions").alias("f")).select("path", "classes", F.col("f").dropFields("class_name").alias("f")).select("path", "classes", "f.*")
    owner = F.get(F.filter("classes", lambda c: (c["start_line"] <= F.col("start_line")) & (F.col("start_line") <= c["end_line"])), F.lit(0))["name"]
    f = f.withColumn("class_name", owner)
    f = f.withColumn("node_id", node_id(F.col("path"), F.col("class_name"), F.col("name")))
    best = f.groupBy("node_id").agg(F.max_by(F.struct("path", "language", "name", "start_line", "end_line", "class_name", "parameters"), F.col("start_line")).alias("m")).select("node_id", "m.*")
    best = best.join(files.select("path", "code"), "path").withColumn("body_code", body(F.col("code"), F.col("start_line"), F.col("end_line"))).drop("code")
    seq = F.format_string("%s:%09d", F.col("path"), F.col("start_line"))
    return best.withColumn("arg_count", F.size("parameters")).withColumn("seq", seq)


def call_graph(files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """GR1: (src, dst, call_line). Functions are gathered first, calls are resolved against all of them."""
    p = parsed if parsed is not None else parse_files(files)
    f = function_metadata(files, p)
    spans = f.select("path", "seq", "start_line", "end_line", "node_id", "class_name")
    calls = p.select("path", F.posexplode("calls").alias("pos", "c")).select("path", "pos", F.col("c.function").alias("called"), F.col("c.line_number").alias("line"))
    calls = calls.withColumn("call_id", F.concat_ws("#", "path", F.col("pos").cast("string")))
    inside = first_enclosing(calls, spans, ["path"], "line", "inner")
    callers = inside.select("call_id", "path", "called", "line", F.col("span.node_id").alias("src"), F.col("span.class_name").alias("class_name"))
    imports = p.select("path", F.explode("imports").alias("alias", "target"))
    found = resolve_callees(callers, f.select("node_id", "path", "class_name", "name", "seq"), imports)
    return build(found.select("src", F.col("node_id").alias("dst"), F.col("line").alias("call_line")))


def commit_details(commits: DataFrame) -> DataFrame:
    """SC4, FLT6, FLT7: (commit, ts, author, path, added, deleted, all_modified) of each file with a modified line.

    ``commits`` has the schema of :data:`tandem.sources.schemas.COMMIT`.
    """
    m = commits.select(F.col("hash").alias("commit"), F.coalesce("committer_date", F.lit("")).alias("ts"), F.coalesce("author.name", F.lit("")).alias("author"), F.explode("files_modified").alias("f"))
    path = F.coalesce(F.nullif("f.new_path", F.lit("")), F.nullif("f.filename", F.lit("")))
    m = m.select("commit", "ts", "author", path.alias("path"), added_deleted_lines(F.col("f.diff")).alias("d")).where("path is not null")
    m = m.select("commit", "ts", "author", "path", F.col("d.added").alias("added"), F.col("d.deleted").alias("deleted"))
    return m.withColumn("all_modified", all_modified(F.col("added"), F.col("deleted"))).where(F.size("all_modified") > 0)


def commit_functions(details: DataFrame, mapped: DataFrame, precise: bool = False) -> DataFrame:
    """SET5, FLT9, FLT21: distinct (commit, node) from ``mapped`` (commit, path, node_id[, start_line, end_line]).

    By default every function of a touched file counts; ``precise`` asks for a modified line within the span, give or take one.
    """
    m = mapped.where("node_id is not null")
    if precise:
        lines = details.select("commit", "path", F.explode("all_modified").alias("_line"))
        m = m.join(lines, ["commit", "path"]).where((F.col("_line") >= F.col("start_line") - 1) & (F.col("_line") <= F.col("end_line") + 1))
    else:
        m = m.join(details.select("commit", "path").distinct(), ["commit", "path"], "left_semi")
    return m.select("commit", F.col("node_id").alias("node")).distinct()
