"""The phases of a study, from a repository to predictions. Each reads tables of a project folder and writes its own.

    <projects>/<name>/commits, stats, functions, graph/nodes, graph/edges, features, commit_functions,
    labels/pairs (by split), labels/statistics, pairs (by split), model, prediction/nodes, prediction/edges
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diff, times
from ..functions.paths import SOURCE_EXTENSIONS, extension, language, normalize
from ..operators import features, graph, metrics, mining, models, ordering, parse, ranges, static_analysis, stats
from ..operators.cascade import match_historical
from ..sources import git, readers, writers


class Project:
    def __init__(self, spark: SparkSession, projects_dir: str, name: str) -> None:
        self.spark, self.name, self.folder = spark, name, f"{projects_dir.rstrip('/')}/{name}"

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def write(self, df: DataFrame, table: str, by: str | None = None) -> DataFrame:
        writers.table(df, self.path(table), by)
        return self.read(table)


# --- 0 ingest ----------------------------------------------------------------------------------------


def commits_from_log(log: DataFrame) -> DataFrame:
    """E8 from the rows of ``git_log``, one a changed file."""
    lines = diff.added_deleted_lines(F.col("diff"))
    file = F.struct(
        F.element_at(F.split(F.coalesce("path", "old_path"), "/"), -1).alias("filename"),
        F.size(lines["added"]).alias("added_lines"),
        F.size(lines["deleted"]).alias("deleted_lines"),
        F.col("old_path"),
        F.col("path").alias("new_path"),
        F.col("diff"),
        diff.modified_lines(F.col("diff")).alias("modified_lines"),
    )
    head = ["hash", "author_name", "author_email", "committer_date", "message", "seq"]
    c = log.select(*head, file.alias("f")).groupBy(*head).agg(F.collect_list("f").alias("files_modified"), F.sum("f.added_lines").cast("int").alias("added_lines"), F.sum("f.deleted_lines").cast("int").alias("deleted_lines"))
    return c.select("hash", F.struct(F.col("author_name").alias("name"), F.col("author_email").alias("email")).alias("author"), "committer_date", "message", "added_lines", "deleted_lines", "files_modified", "seq")


def changes_of(commits: DataFrame) -> DataFrame:
    """(commit, ts, path, filename, added, deleted, modified_lines) of each changed file."""
    c = commits.select(F.col("hash").alias("commit"), times.parse(F.col("committer_date")).alias("ts"), F.explode("files_modified").alias("f"))
    return c.select("commit", "ts", F.coalesce("f.new_path", "f.old_path", "f.filename").alias("path"), F.col("f.filename").alias("filename"), F.col("f.added_lines").alias("added"), F.col("f.deleted_lines").alias("deleted"), F.col("f.modified_lines").alias("modified_lines"))


def repository_statistics(commits: DataFrame) -> dict[str, DataFrame]:
    """AG1-AG5: totals, by extension, by month."""
    changes = changes_of(commits)
    authors = commits.select(F.col("hash").alias("commit"), F.col("author.email").alias("author"))
    return {"totals": stats.commit_totals(authors, changes), "extensions": stats.by_extension(changes), "months": stats.monthly_activity(changes)}


def functions_modified(changes: DataFrame, parsed: DataFrame) -> DataFrame:
    """E8b, JN1, SET7: (commit, path, function, start_line, end_line, lines): each modified line goes to the first function
    around it. ``parsed`` has (commit, path, functions) of the files as they were."""
    spans = parsed.select("commit", "path", F.posexplode("functions").alias("seq", "f")).select("commit", "path", "seq", "f.start_line", "f.end_line", "f.name")
    lines = changes.select("commit", "path", F.explode("modified_lines").alias("line")).distinct()
    hit = ranges.first_enclosing(lines, spans, ["commit", "path"], how="inner").where("span is not null")
    return hit.groupBy("commit", "path", F.col("span.name").alias("function"), F.col("span.start_line").alias("start_line"), F.col("span.end_line").alias("end_line")).agg(F.sort_array(F.collect_set("line")).alias("lines"))


def ingest(spark: SparkSession, repo_url: str, projects_dir: str, repo_name: str | None = None, branch: str | None = None, max_commits: int | None = None) -> Project:
    """SRC1, SRC2: clones on the driver, then reads the log as a data source. The clone has to be reachable from the executors."""
    name = repo_name or git.repository_name(repo_url)
    p = Project(spark, projects_dir, name)
    if not git.clone(repo_url, projects_dir, f"{name}/source_code", branch):
        raise RuntimeError(f"cannot clone {repo_url}")
    spark.dataSource.register(git.GitLog)
    log = spark.read.format("git_log").option("max_commits", max_commits or 0).load(p.path("source_code"))
    commits = p.write(commits_from_log(log), "commits")
    for table, df in repository_statistics(commits).items():
        p.write(df, f"stats/{table}")
    return p


# --- 1 static analysis, 2 function features -------------------------------------------------------------


def analyze(p: Project, source_dir: str | None = None) -> DataFrame:
    """Functions and call graph of a source tree; files are parsed once."""
    files = p.write(readers.source_files(p.spark, source_dir or p.path("source_code")), "files")
    parsed = p.write(parse.parse_files(files), "parsed")
    functions = p.write(static_analysis.function_metadata(files, parsed), "functions")
    writers.graph(functions.drop("seq"), static_analysis.call_graph(files, parsed), p.path("graph"))
    return functions


def extract_features(p: Project, embedder=None, vocabulary: int = features.VOCABULARY, embedding: int = features.EMBEDDING) -> DataFrame:
    """E15: TF-IDF padded to ``vocabulary``, embedding, metrics."""
    f = p.read("functions").withColumn("id", F.col("node_id"))
    weights = features.vocabulary_weights(f, "id", "body_code", vocabulary)
    tfidf = features.dense(weights, f, vocabulary).withColumnRenamed("id", "node_id")
    v = f.join(tfidf, "node_id").join(features.embed(f, embedder, dim=embedding), "node_id")
    return p.write(features.function_vector(v).select("node_id", "features"), "features")


# --- 3 labels ----------------------------------------------------------------------------------------------


def map_history(p: Project, details: DataFrame, blobs: DataFrame, precise: bool = False) -> DataFrame:
    """Commits to current functions: historical files are parsed, and their functions matched to those of today."""
    old = blobs.select(F.concat_ws("\x00", "commit", "path").alias("key"), language(F.col("path")).alias("language"), "code").where(F.col("language").isNotNull())
    parsed = parse.parse_files(old, "key").withColumn("k", F.split("path", "\x00")).select(F.col("k")[0].alias("commit"), F.col("k")[1].alias("path"), "functions")
    f = parsed.select("commit", "path", F.posexplode("functions").alias("i", "f")).select("commit", "path", "f.name", "f.class_name", "f.start_line", "f.end_line", "i")
    f = f.withColumn("hist_id", F.concat_ws("\x00", "commit", "path", F.col("i").cast("string")))
    same = f.withColumn("path", normalize(F.col("path"))).select("hist_id", "path", "class_name", "name")
    current = p.read("functions").select("node_id", "path", "class_name", "name", "seq")
    mapped = f.join(match_historical(same, current).select("hist_id", "node_id"), "hist_id")
    return static_analysis.commit_functions(details, mapped, precise)


def generate_labels(
    p: Project,
    mode: str = "hybrid",
    min_cochange: int = 3,
    negative_ratio: float = 2.5,
    max_commits: int | None = None,
    max_distance: int = 3,
    max_modify_ratio: float = 0.1,
    min_authors: int = 1,
    max_avg_gap: float = 30,
    blobs: DataFrame | None = None,
    precise: bool = False,
) -> DataFrame:
    """E13, E14: labelled pairs with a split. ``hybrid`` mines the history, ``static`` the call graph alone."""
    functions = p.read("functions")
    edges = p.read("graph/edges")
    nodes = functions.select(F.col("node_id").alias("node"), F.col("path").alias("file"))
    if mode == "static":
        pairs = ordering.random_split(graph.static_samples(nodes, edges, ["file"], 2, negative_ratio))
    elif mode == "hybrid":
        commits = p.read("commits")
        if max_commits:
            commits = ordering.newest(commits, max_commits, "committer_date", "hash")
        details = static_analysis.commit_details(commits)
        sources = details.where(extension(F.col("path")).isin(*SOURCE_EXTENSIONS))
        enough = mining.multi_file_commits(sources)
        details = p.write(details.join(enough.select("commit"), "commit", "left_semi"), "details")
        old = blobs if blobs is not None else git.blobs(details, p.path("source_code"))
        touched = p.write(map_history(p, details, old, precise), "commit_functions")
        when = details.select("commit", times.parse(F.col("ts")).alias("ts"), "author").distinct()
        dist = graph.distances(edges.select("src", "dst"), max_distance + 1)
        pos = mining.positive_pairs(touched, when, dist, min_cochange, max_distance, max_modify_ratio, min_authors, max_avg_gap)
        pos = p.write(pos.withColumn("label", F.lit(1)), "positive_pairs")
        neg = p.write(graph.negatives(pos, nodes, edges, ["file"], negative_ratio).withColumn("label", F.lit(0)), "negative_pairs")
        pairs = ordering.temporal_split(pos.unionByName(neg, allowMissingColumns=True))
    else:
        raise ValueError(f"mode is hybrid or static, not {mode}")
    out = p.write(pairs, "labels/pairs", "split")
    p.write(stats.label_statistics(out), "labels/statistics")
    return out


# --- 4 pair features, 5 training, 6 prediction and evaluation ------------------------------------------------


def pair_dataset(p: Project, use_evolution: bool = False) -> DataFrame:
    """E16: pair vectors, scaled by what the training split shows (ML10)."""
    v = p.read("features")
    dim = v.select(F.size("features")).first()[0]
    counts = mining.modify_counts(p.read("commit_functions")) if use_evolution else None
    rows = features.pair_features(p.read("labels/pairs").select("func1", "func2", "label", "split"), v, dim, counts)
    raw = p.write(rows, "pairs_raw", "split")
    scaler = p.write(features.fit_scaler(raw.where("split = 'train'")), "scaler")
    return p.write(features.scale(raw, scaler), "pairs", "split")


def train_single(p: Project, **settings):
    """ML11: fits on the training split; the metrics of the others are written as one row each."""
    data = p.read("pairs")
    model = models.train(data.where("split = 'train'"), **settings)
    writers.model(model, p.path("model"))
    for split in ("val", "test"):
        p.write(metrics.evaluate(models.predict(model, data.where(F.col("split") == split))), f"metrics/{split}")
    return model


def train_joint(spark: SparkSession, projects: list[Project], output_dir: str, **settings):
    """ML12: one model over several projects, scaled once more over all their training rows; metadata beside it."""
    data = models.union_projects({p.name: p.read("pairs") for p in projects})
    scaler = features.fit_scaler(data.where("split = 'train'"))
    writers.table(scaler, f"{output_dir}/scaler")
    data = features.scale(data, spark.read.parquet(f"{output_dir}/scaler"))
    model = models.train(data.where("split = 'train'"), balanced=False, **(models.JOINT | settings))
    sizes = {r["split"]: r["count"] for r in data.groupBy("split").count().collect()}
    known = {"projects": [p.name for p in projects], "feature_dim": data.select(F.size("features")).first()[0], **{f"{k}_samples": sizes.get(k, 0) for k in ("train", "val", "test")}}
    for split in ("val", "test"):
        e = metrics.evaluate(models.predict(model, data.where(F.col("split") == split))).first()
        known |= {f"{split}_auc_roc": e["auc_roc"], f"{split}_auc_pr": e["avg_precision"]}
    writers.model(model, f"{output_dir}/model", known, spark)
    return model, known


def predict_graph(p: Project, model, threshold: float = 0.7, max_distance: int = 2, output_format: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """GR8, E20: candidates of one file or within ``max_distance`` calls, scaled by themselves (ML14), kept at the threshold."""
    functions, v = p.read("functions"), p.read("features")
    nodes = functions.select(F.col("node_id").alias("node"), F.col("path").alias("file"))
    pairs = graph.candidates(nodes, p.read("graph/edges"), ["file"], max_distance)
    dim = v.select(F.size("features")).first()[0]
    raw = p.write(features.pair_features(pairs, v, dim).withColumn("id", F.concat_ws("|||", "func1", "func2")), "prediction/candidates")
    scored = p.write(models.predict(model, features.adaptive_scale(raw)).drop("features"), "prediction/scores")
    edges = models.threshold_edges(scored, threshold)
    ids = functions.select("node_id")
    writers.graph(ids, edges, p.path("prediction"))
    if output_format == "graphml":
        writers.graphml(ids, edges, p.path("prediction/graphml"))
    elif output_format == "json":
        writers.json_lines(edges, p.path("prediction/json"))
    return readers.graph(p.spark, p.path("prediction"))


def evaluate_cross_project(source_model, target: Project, threshold: float = 0.5) -> DataFrame:
    """ML15, E21: the target's test pairs, scaled by themselves, scored by another project's model; one row, also written."""
    test = target.read("pairs_raw").where("split = 'test'").withColumn("id", F.concat_ws("|||", "func1", "func2"))
    scored = models.predict(source_model, features.adaptive_scale(test, None))
    target.write(metrics.precision_at_k(scored), "metrics/cross_at_k")
    return target.write(metrics.evaluate(scored, threshold), "metrics/cross")
