"""Writers (SNK1-SNK13): Parquet is the table format; JSON, GraphML and console forms are made from the same rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, by: str | None = None) -> None:
    """SNK1, SNK3-SNK9: ``by`` makes a folder for each value, such as the split."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """SNK3, SNK12."""
    table(nodes, f"{folder}/nodes")
    table(edges, f"{folder}/edges")


def json_lines(df: DataFrame, path: str) -> None:
    """SNK1, SNK2, SNK7: a JSON object a row."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def metadata_lines(df: DataFrame, path: str) -> None:
    """SNK4: a one-entry map a line, so that the writing stays spread over the executors."""
    rest = F.struct(*[c for c in df.columns if c != "node_id"])
    df.select(F.to_json(F.create_map("node_id", rest)).alias("value")).write.mode("overwrite").text(path)


def labels(pairs: DataFrame, statistics: DataFrame, folder: str) -> None:
    """SNK6, SNK7: pairs by split, and the statistics beside them."""
    table(pairs, f"{folder}/pairs", "split")
    json_lines(statistics, f"{folder}/statistics")


def model(fitted, path: str, metadata: dict | None = None, spark=None) -> None:
    """SNK10, SNK11: the model, and what is known of it as JSON beside it."""
    fitted.write().overwrite().save(path)
    if metadata is not None:
        spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-metadata")


def _attribute(c: Column) -> Column:
    text = c.cast("string")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return F.concat(F.lit('"'), text, F.lit('"'))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK12: the body lines of a GraphML file, (kind, line); writing stays distributed."""
    n = nodes.select(F.lit(1).alias("kind"), F.concat(F.lit("<node id="), _attribute(F.col("node_id")), F.lit("/>")).alias("line"))
    e = edges.select(
        F.lit(2).alias("kind"),
        F.concat(F.lit("<edge source="), _attribute(F.col("src")), F.lit(" target="), _attribute(F.col("dst")), F.lit('><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("line"),
    )
    return n.unionByName(e)


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of text parts that, in order of their names, are one GraphML document."""
    spark = nodes.sparkSession
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">'
    ends = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "kind int, line string")
    body = graphml_lines(nodes, edges).unionByName(ends)
    body.repartitionByRange(16, "kind", "line").sortWithinPartitions("kind", "line").select("line").write.mode("overwrite").text(path)


def report(df: DataFrame) -> str:
    """SNK13: a one-row metric frame as lines of text."""
    row = df.first()
    return "\n".join(f"{k}: {v}" for k, v in row.asDict().items()) if row else ""
