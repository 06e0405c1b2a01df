"""A study from a small repository to predictions."""

import shutil
import subprocess

import pytest

from tandem.operators import models
from tandem.plans import phases


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_study(spark, tmp_path):
    origin = tmp_path / "origin"
    origin.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=N", "-c", "user.email=e", *a], cwd=origin, check=True, capture_output=True)
    run("init", "-q")
    for i in range(6):
        calls = "".join(f"def f{k}(x):\n    return g{k}(x) + {i}\n\n\ndef h{k}(x):\n    return {k}\n\n\n" for k in range(4))
        (origin / "a.py").write_text(calls)
        (origin / "b.py").write_text("".join(f"def g{k}(y):\n    return y * {i}\n\n\n" for k in range(4)))
        run("add", ".")
        run("commit", "-qm", f"m{i}")
    p = phases.ingest(spark, str(origin), str(tmp_path / "projects"), "demo")
    t = p.read("stats/totals").first()
    assert (t.total_commits, t.total_authors, t.total_files_changed) == (6, 1, 12)
    assert {r.ext: r.n for r in p.read("stats/extensions").collect()} == {".py": 12}
    assert phases.analyze(p).count() == 12
    assert {(r.src, r.dst) for r in p.read("graph/edges").collect()} == {(f"a.py::::f{k}", f"b.py::::g{k}") for k in range(4)}
    v = phases.extract_features(p, vocabulary=16, embedding=3)
    assert v.selectExpr("min(size(features))").first()[0] == 16 + 3 + 2
    labels = phases.generate_labels(p, min_cochange=3, max_modify_ratio=1.0)
    n = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    assert n[1] == 12 * 11 / 2 and p.read("commit_functions").count() == 6 * 12
    phases.generate_labels(p, mode="static", negative_ratio=1.0)
    with pytest.raises(ValueError):
        phases.generate_labels(p, mode="other")
    data = phases.pair_dataset(p, use_evolution=True)
    assert data.selectExpr("min(size(features))").first()[0] == 4 * 21 + 5
    train = data.withColumn("label", (data["func1"] < data["func2"]).cast("int") * (data["func1"].endswith("0")).cast("int"))
    model = models.train(train, maxIter=3, maxDepth=2)
    nodes, edges = phases.predict_graph(p, model, 0.0, output_format="graphml")
    assert nodes.count() == 12 and edges.count() > 4
    assert phases.evaluate_cross_project(model, p).count() == 1
    mod = phases.functions_modified(
        spark.createDataFrame([("c", "a.py", [2, 3, 9])], "commit string, path string, modified_lines array<int>"),
        spark.createDataFrame([("c", "a.py", [(1, 2, "f"), (1, 9, "g")])], "commit string, path string, functions array<struct<start_line:int,end_line:int,name:string>>"),
    )
    assert {(r.function, tuple(r.lines)) for r in mod.collect()} == {("f", (2,)), ("g", (3, 9))}


def test_command_line():
    from tandem.__main__ import _parser

    a = _parser().parse_args(["labels", "--project", "p", "--mode", "static"])
    assert (a.phase, a.mode, a.min_cochange, a.negative_ratio, a.projects_dir) == ("labels", "static", 3, 2.5, "./projects")
    assert _parser().parse_args(["predict", "--project", "p", "--model-path", "m"]).threshold == 0.7
    with pytest.raises(SystemExit):
        _parser().parse_args(["labels", "--project", "p", "--mode", "other"])
