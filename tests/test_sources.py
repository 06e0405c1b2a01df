import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from tandem.operators import cascade, models, parse, ranges, static_analysis
from tandem.sources import git, readers, writers


def test_tree(spark, tmp_path):
    """SRC3 SRC4 FLT2-FLT5."""
    root = tmp_path / "proj"
    for name, data in {"a.py": b"x = 1", "B.JAVA": b"class B {}", "blank.c": b"  \n", "bad.js": b"let \xff a", ".git/x.py": b"x", "node_modules/y.js": b"y", "doc.txt": b"z", "sub/c.cpp": b"int c;"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r.path: (r.language, r.code) for r in readers.source_files(spark, str(root)).collect()}
    assert got == {"a.py": ("python", "x = 1"), "B.JAVA": ("java", "class B {}"), "bad.js": ("javascript", "let  a"), "sub/c.cpp": ("cpp", "int c;")}


def test_json_readers(spark, tmp_path):
    """SRC5 SRC6 SRC14-SRC17."""
    w = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and str(tmp_path / name)
    diff = "@@ -1 +1 @@\n-a\n+b"
    commits = [{"hash": "h", "author": {"name": "N", "email": "e"}, "committer_date": "2024-01-01T00:00:00Z", "files_modified": [{"filename": "a.py", "new_path": "", "diff": diff}, {"filename": "", "diff": diff}, {"filename": "b.py", "diff": ""}]}]
    d = static_analysis.commit_details(readers.commits(spark, w("commits.json", commits))).collect()
    assert [(r.path, r.added, r.deleted, r.all_modified, r.author) for r in d] == [("a.py", [1], [1], [1], "N")]
    m = readers.metadata(spark, w("metadata.json", {"p::::f": {"name": "f", "start_line": 1, "end_line": 2, "parameters": ["a"]}})).first()
    assert (m.node_id, m.name, m.class_name) == ("p::::f", "f", None)
    pair = {"func1": "a", "func2": "b", "label": 1, "metadata": {"distance": -1}}
    assert readers.labels(spark, w("l1.json", {"train": [pair], "val": [], "test": [pair]})).groupBy("split").count().count() == 2
    assert readers.labels(spark, w("l2.json", {"test_pairs": [pair]})).first().split == "test"
    with pytest.raises(ValueError):
        readers.labels(spark, w("l3.json", {"train": [pair]}))
    e = {r.node: r.modify_count for r in readers.evolution(spark, w("e.json", {"a": 3, "b": {"modify_count": 5, "authors": ["x"]}, "c": "?"})).collect()}
    assert e == {"a": 3, "b": 5, "c": 0}
    assert readers.evolution(spark, None).count() == 0 and readers.commit_to_functions(spark, None).count() == 0
    assert readers.commit_to_functions(spark, w("c2f.json", {"h": ["a", "a", "b"]})).count() == 2


def test_writers(spark, tmp_path):
    """SNK3 SNK4 SNK6 SNK12."""
    n = spark.createDataFrame([("a<1>",), ("b",)], "node_id string")
    e = spark.createDataFrame([("a<1>", "b", 0.5)], "src string, dst string, weight double")
    writers.graph(n, e, str(tmp_path / "g"))
    assert readers.graph(spark, str(tmp_path / "g"))[1].first().weight == 0.5
    writers.graphml(n, e, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "x").glob("part-*")))
    from xml.etree import ElementTree

    found = ElementTree.fromstring(text)
    assert len(found.findall(".//{*}node")) == 2 and found.find(".//{*}edge").get("source") == "a<1>"
    writers.labels(spark.createDataFrame([("a", "b", 1, "train")], "func1 string, func2 string, label int, split string"), n, str(tmp_path / "l"))
    assert readers.pair_features(spark, str(tmp_path / "l/pairs"), "train").count() == 1
    writers.metadata_lines(n.withColumn("name", F.lit("f")), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() == 2


def test_tables_round_trip(spark, tmp_path):
    """SRC12 SRC13 SRC18 SNK1 SNK2 SNK5 SNK7 SNK8 SNK9: what is written is read again, names outside ASCII and nulls included."""
    at = lambda name: str(tmp_path / name)
    same = lambda df, back: sorted(map(str, df.collect())) == sorted(map(str, back.select(df.columns).collect()))
    commits = spark.createDataFrame([("h1", "J\u00f6rg", None), ("h2", None, "2024-01-01")], "hash string, author string, committer_date string")
    writers.table(commits, at("commits"))
    assert same(commits, readers.commits(spark, at("commits")))
    writers.json_lines(commits, at("lines"))
    lines = "".join(x.read_text(encoding="utf-8") for x in sorted((tmp_path / "lines").glob("part-*")))
    assert "J\u00f6rg" in lines and '"author":null' in lines and same(commits, spark.read.json(at("lines")))
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "node_id string, features array<double>")
    writers.table(vectors, at("features"))
    assert same(vectors, readers.function_features(spark, at("features"))) and same(vectors, readers.embedding_cache(spark, at("features")))
    assert readers.embedding_cache(spark, None) is None
    pairs = spark.createDataFrame([("a", "b", 1, "train", [0.5]), ("a", "c", 0, "val", [1.5])], "func1 string, func2 string, label int, split string, features array<double>")
    writers.table(pairs, at("pairs"), "split")
    assert same(pairs, readers.pair_features(spark, at("pairs"))) and readers.pair_features(spark, at("pairs"), "val").first().func2 == "c"
    links = spark.createDataFrame([("h1", "a"), ("h1", "b")], "commit string, node string")
    writers.table(links, at("links"))
    assert same(links, readers.commit_to_functions(spark, at("links")))


def test_models_round_trip(spark, tmp_path):
    """SRC19 SNK10 SNK11 ML11 ML12 ML13: a saved model scores as before, what is known of it lies beside it, a joint model sees all projects."""
    rows = [("a", f"b{i}", i % 2, [float(i % 2), float(i % 3)]) for i in range(40)]
    data = spark.createDataFrame(rows, "func1 string, func2 string, label int, features array<double>")
    small = {"maxIter": 2, "maxDepth": 2}
    fitted = models.train(data, **small)
    writers.model(fitted, str(tmp_path / "m"), {"auc": 0.5, "projects": ["p"]}, spark)
    scores = lambda m: sorted((r.func2, r.score) for r in models.predict(m, data).collect())
    assert scores(readers.model(str(tmp_path / "m"))) == scores(fitted)
    assert json.loads(spark.read.text(str(tmp_path / "m-metadata")).first().value) == {"auc": 0.5, "projects": ["p"]}
    assert all((s > 0.5) == (int(n[1:]) % 2 == 1) for n, s in scores(fitted))
    joint = models.train_joint({"p": data, "q": data.withColumn("label", 1 - F.col("label"))}, **small)
    assert all(abs(s - 0.5) < 0.2 for _, s in scores(joint))  # the projects contradict one another; trees see samples
    assert models.union_projects({"p": data, "q": data}).groupBy("project").count().count() == 2


def test_reports_and_defaults(spark):
    """SRC7 SNK13 SC4 FLT6 FLT7: console lines, names out of ids, and the path of a changed file."""
    assert writers.report(spark.createDataFrame([(0.5, "x")], "auc double, tier string")) == "auc: 0.5\ntier: x"
    assert writers.report(spark.createDataFrame([], "auc double")) == ""
    names = {r.node_id: r.name for r in cascade.defaulted(spark.createDataFrame([("p::C::f", None), ("q::::g", "h")], "node_id string, name string")).collect()}
    assert names == {"p::C::f": "f", "q::::g": "h"}
    files = "array<struct<filename:string,new_path:string,diff:string>>"
    diff = "@@ -1 +1,2 @@\n a\n+b"
    c = spark.createDataFrame([("c1", None, None, [("old.py", "new.py", diff), ("kept.py", "", diff), ("", None, diff), ("same.py", None, " a")]), ("c2", None, None, [])], f"hash string, committer_date string, author struct<name:string>, files_modified {files}")
    assert sorted((r.commit, r.path, r.ts, r.author, r.added) for r in static_analysis.commit_details(c).collect()) == [("c1", "kept.py", "", "", [2]), ("c1", "new.py", "", "", [2])]


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_git(spark, tmp_path):
    """SRC1 SRC2 SRC9-SRC11."""
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=N", "-c", "user.email=e", *a], cwd=repo, check=True, capture_output=True)
    run("init", "-q")
    for i in range(2):
        (repo / "a.py").write_text(f"x = {i}\n")
        run("add", ".")
        run("commit", "-qm", f"m{i}")
    spark.dataSource.register(git.GitLog)
    rows = spark.read.format("git_log").option("chunk", 1).load(str(repo)).orderBy("seq").collect()
    assert [(r.author_name, r.message, r.path) for r in rows] == [("N", "m0", "a.py"), ("N", "m1", "a.py")] and "+x = 1" in rows[1].diff
    assert spark.read.format("git_log").option("max_commits", 1).load(str(repo)).count() == 1
    last = rows[1].hash
    assert git.file_at(repo, last, "a.py") == "x = 1\n" and git.file_before(repo, last, "a.py") == "x = 0\n" and git.file_before(repo, rows[0].hash, "a.py") is None
    assert git.find_root(repo / "sub") == repo
    d = spark.createDataFrame([(last, "a.py")], "commit string, path string")
    assert git.blobs(d, str(repo)).first().code == "x = 0\n"
    assert git.clone(str(repo), tmp_path / "out", "c") and (tmp_path / "out/c/a.py").exists()
    assert git.repository_name("https://h/u/name.git/") == "name"


SOURCES = {
    "python": "import a.b\nimport c as d\nfrom m import n as k\nfrom . import q\nclass Outer:\n    class Inner:\n        def f(self, x, y=1, *z):\n            return k(x)\n\ndef g(a, b):\n    return d.h(a.b.c(1))\n",
    "java": "import java.util.List;\nimport x.*;\npublic class T {\n  public static int go(int a, String b) {\n    return helper.run(a);\n  }\n}\n",
    "javascript": "import D, { e as f, g } from 'mod';\nconst fs = require('fs');\nclass K {\n  run(a) {\n    return fs.open(a);\n  }\n}\nfunction top(b) { return run(b); }\n",
    "c": '#include "x/y.h"\nstatic int add(int a, char *b) {\n  if (a) { return sum(a); }\n  return 0;\n}\n',
}


def test_parsers():
    """PR1-PR20 JN4 FLT20."""
    f = {k: {x["name"]: x for x in parse.functions_of(v, k)} for k, v in SOURCES.items()}
    assert (f["python"]["f"]["start_line"], f["python"]["f"]["end_line"], f["python"]["f"]["parameters"]) == (7, 8, ["self", "x"])
    assert (f["java"]["go"]["start_line"], f["java"]["go"]["end_line"], f["java"]["go"]["parameters"]) == (4, 6, ["a", "b"])
    assert set(f["javascript"]) == {"run", "top"} and f["javascript"]["run"]["end_line"] == 6
    assert (f["c"]["add"]["start_line"], f["c"]["add"]["end_line"], f["c"]["add"]["parameters"]) == (2, 5, ["a", "b"])
    assert parse.imports_of(SOURCES["python"], "python") == {"a.b": "a.b", "d": "c", "k": "m.n", "q": "q"}
    assert parse.imports_of(SOURCES["java"], "java") == {"List": "java.util.List"}
    assert parse.imports_of(SOURCES["javascript"], "javascript") == {"D": "mod/D", "f": "mod/e", "g": "mod/g", "fs": "fs"}
    assert parse.imports_of(SOURCES["c"], "c") == {"y.h": "x/y.h"} and parse.imports_of("def (", "python") == {}
    assert [c["function"] for c in parse.calls_of(SOURCES["python"], "python")] == ["k", "d.h"]
    assert "run" in [c["function"] for c in parse.calls_of(SOURCES["java"], "java")]
    assert "fs.open" in [c["function"] for c in parse.calls_of(SOURCES["javascript"], "javascript")]
    assert [c["name"] for c in parse.class_spans(SOURCES["python"], "python")] == ["Outer", "Inner"] and parse.class_spans(SOURCES["c"], "c") == []


NESTED = {
    "java": """class T<A> {
  // int no(int a) {
  @Deprecated @Size(max = 3)
  public Map<String, List<A>> all(Map<String, List<A>> in, int[] xs, String... rest) throws E1, E2 {
    String s = "void fake(int x) {";
    if (xs.length > f(in)) { run(() -> { g(1); }); }
    return in;
  }
  void last(Function<A, Integer> f) {}
}
""",
    "javascript": """class K {
  async run(a, cb = () => { go(1); }, { x, y }) {
    return `${a} function no(b) {` + fs.open(a);
  }
}
function* top(b, c = f(2, (3))) {
  const one = (z) => z + 1;
  return { m(q) { return q; } };
}
""",
    "cpp": """#define LOOP(x) for (int i = 0; i < x; i++) {
template <typename T>
std::vector<std::pair<int, T>> pairs(const std::map<int, T>& in, void (*cb)(int, char), int n) {
  /* } */ char c = '}';
  return make(in, cb(n));
}
struct S {
  int get(int k) const noexcept override { return at(k); }
  auto name() const -> std::string { return "x"; }
};
""",
}


def test_nested_heads():
    """PR3-PR6 PR11-PR13: parentheses, templates, strings, comments and macros."""
    f = {k: {x["name"]: (x["start_line"], x["end_line"], x["parameters"]) for x in parse.functions_of(v, k)} for k, v in NESTED.items()}
    assert f["java"] == {"all": (3, 8, ["in", "xs"]), "last": (9, 9, ["f"])}
    assert f["javascript"] == {"run": (2, 4, ["a", "{ x, y }"]), "top": (6, 9, ["b"]), "m": (8, 8, ["q"])}
    assert set(f["cpp"]) == {"pairs", "get", "name"} and f["cpp"]["pairs"][:2] == (3, 6) and f["cpp"]["get"] == (8, 8, ["k"])
    calls = {k: {(c["function"], c["line_number"]) for c in parse.calls_of(v, k)} for k, v in NESTED.items()}
    assert {("f", 6), ("run", 6), ("g", 6)} <= calls["java"] and ("fake", 5) not in calls["java"] and ("no", 2) not in calls["java"]
    assert {("go", 2), ("fs.open", 3), ("f", 6)} <= calls["javascript"] and {("make", 5), ("at", 8)} <= calls["cpp"]


def test_patterns_stand_long_files():
    """PR7 PR14: a megabyte of words, of blank lines and of calls."""
    import time

    began = time.time()
    for text in ("word\n" * 200_000, "\n" * 1_000_000, " " * 1_000_000, "f(x);\n" * 100_000, "word\n" * 100_000 + "int go(int a) {\n}\n"):
        for language in ("python", "java", "javascript", "c", "cpp", "go", "typescript", "c_sharp", "other"):
            parse.regex_functions(text, language)
        parse.functions_of(text, "java"), parse.calls_of(text, "c"), parse.regex_calls(text, "go")
    assert time.time() - began < 60
    assert [x["name"] for x in parse.regex_functions("word\n" * 1000 + ";\nint go(int a) {\n}\n", "c")] == ["go"]
    assert parse.regex_functions("word\n" * 1000 + ";\nint go(int a) {\n}\n", "c")[0]["start_line"] == 1001


def test_regex_fallback():
    """PR7 PR14."""
    got = parse.regex_functions("def a():\n  pass\ndef a(x):\n  pass\n", "python")
    assert len(got) == 1 and got[0]["start_line"] == got[0]["end_line"]
    assert [(c["function"], c["line_number"]) for c in parse.regex_calls("a.b.c(1)\nd(2)", "java")] == [("a.b.c", 1), ("d", 2)]
    assert [c["function"] for c in parse.regex_calls("x.f (1)", "go")] == ["f"]
    assert parse.functions_of("def (", "python") == [] and parse.functions_of("func (", None) == []


def test_call_graph(spark):
    """E6 E7 GR1 JN4-JN6 Q9."""
    files = spark.createDataFrame(
        [("a.py", "python", "from b import h\nclass A:\n    def f(self):\n        return g()\n\ndef g():\n    return h()\n"), ("b.py", "python", "def h():\n    return 1\n"), ("bad.py", "python", "def (")],
        "path string, language string, code string",
    )
    m = {r.node_id: r for r in static_analysis.function_metadata(files).collect()}
    assert set(m) == {"a.py::A::f", "a.py::::g", "b.py::::h"} and m["a.py::::g"].body_code == "def g():\n    return h()" and m["a.py::A::f"].arg_count == 1
    assert {(r.src, r.dst, r.call_line) for r in static_analysis.call_graph(files).collect()} == {("a.py::A::f", "a.py::::g", 4), ("a.py::::g", "b.py::::h", 7)}


def test_ranges(spark):
    """JN1 JN3 C10: the outermost span wins."""
    spans = spark.createDataFrame([("f", 1, 1, 20, "Outer"), ("f", 2, 5, 10, "Inner")], "file string, seq int, start_line int, end_line int, name string")
    lines = spark.createDataFrame([("f", 7), ("f", 21), ("f", 99)], "file string, line int")
    assert {r.line: r.span and r.span.name for r in ranges.first_enclosing(lines, spans, ["file"]).collect()} == {7: "Outer", 21: None, 99: None}
    assert {r.name: r.lines for r in ranges.enclosing_band(lines, spans, ["file"]).collect()} == {"Outer": [7, 21], "Inner": [7]}


def test_identity(spark):
    """JN7 JN8 AG13."""
    f = spark.createDataFrame([("s/a.py::::x", "s/a.py", None, "x", 1), ("s/a.py::K::m", "s/a.py", "K", "m", 2), ("s/a.py::L::m", "s/a.py", "L", "m", 3), ("o/u.py::::only", "o/u.py", None, "only", 4)], "node_id string, path string, class_name string, name string, seq int")
    h = spark.createDataFrame([(1, "s/a.py", "K", "m"), (2, "s/a.py", None, "m"), (3, "a.py", None, "x"), (4, "z/a.py", None, "x"), (5, "z/q.py", None, "only"), (6, "z", None, "none")], "hist_id int, path string, class_name string, name string")
    got = {r.hist_id: (r.node_id, r.rule) for r in cascade.match_historical(h, f).collect()}
    assert got == {1: ("s/a.py::K::m", 1), 2: ("s/a.py::L::m", 2), 3: ("s/a.py::::x", 3), 4: ("s/a.py::::x", 4), 5: ("o/u.py::::only", 5), 6: (None, None)}
