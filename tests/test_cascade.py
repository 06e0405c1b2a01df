"""Lookups by rules against plain searches."""

import random

from tandem.operators import cascade


def test_suffix_rule_is_endswith(spark):
    """JN7c: paths short and long, one hot name, and ends that are no whole path part."""
    r = random.Random(5)
    part = lambda: r.choice(["a", "ab", "src", "main", "x" * 30, "deep"])
    paths = ["/".join(part() for _ in range(r.randint(1, 6))) + ".py" for _ in range(120)]
    functions = [(f"n{i}", p, r.choice(["__init__", "go", "run"]), i) for i, p in enumerate(paths)]
    hist = [(i, r.choice([p, p[-r.randint(1, 12) :], p[-60:], "zz/" + p, ""]), r.choice(["__init__", "go"])) for i, p in enumerate(paths)] + [(999, None, "go")]
    f = spark.createDataFrame([(n, p, None, name, i) for n, p, name, i in functions], "node_id string, path string, class_name string, name string, seq long")
    h = spark.createDataFrame(hist, "hist_id long, path string, name string")
    got = {(x.hist_id, x.node_id) for x in cascade.ends_with(h, f).collect()}
    assert got == {(i, n) for i, p, name in hist if p is not None for n, path, fname, _ in functions if fname == name and path.endswith(p)}


def test_most_similar_in_blocks(spark):
    """JN8: blocks of any size give what comparing all pairs gives: ties, copies, odd vectors, null paths and names."""
    import math

    from tandem.operators import nearest

    r = random.Random(7)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0, 0.0], [nan, 1.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [1e300, 1e300, 0.0], [inf, 1.0, 1.0], [1e-160, 0.0, 0.0], [2.0, 2.0, 2.0], [1.0, 1.0, 1.0]]
    vector = lambda: r.choice(odd) if r.random() < 0.2 else [float(r.randint(-3, 3)) for _ in range(3)]
    path = lambda: r.choice(["a/x.py", "b/x.py", "a/y.py", "x.py", None, "", "a/"])
    hist = [(i, r.choice(["f", "f", "g", "h", None]), path(), vector()) for i in range(120)]
    functions = [(f"n{i}", i % 50, r.choice(["f", "f", "g", None, "k"]), path(), vector()) for i in range(150)]

    def cosine(a, b):
        dot = lambda x, y: None if x is None or y is None or len(x) != len(y) or None in x or None in y else sum((p * q for p, q in zip(x, y)), 0.0)
        d, n = dot(a, b), (dot(a, a), dot(b, b))
        if d is None or None in n or math.sqrt(n[0]) * math.sqrt(n[1]) == 0:
            return 0.0
        return d / (math.sqrt(n[0]) * math.sqrt(n[1]))

    want = {}
    for i, name, p, v in hist:
        for node, seq, own, q, w in functions:
            if name is None or name != own:
                continue
            base = lambda x: None if x is None else x.split("/")[-1]
            s = cosine(v, w) + (0.0 if p is None or q is None else 0.2 if p == q else 0.1 if base(p) == base(q) else 0.0)
            s = s if math.isnan(s) else round(s, 9)
            if s > 0.5 or math.isnan(s):
                want[i] = max(want.get(i, (False, -9.0, 0, "")), (math.isnan(s), 0.0 if math.isnan(s) else s, -seq, node))
    h = spark.createDataFrame(hist, "hist_id long, name string, path string, vector array<double>")
    f = spark.createDataFrame(functions, "node_id string, seq long, name string, path string, vector array<double>")
    for block in (3, 16, 8192):
        got = {x.hist_id: (x.node_id, math.isnan(x.score), 0.0 if math.isnan(x.score) else round(x.score, 9)) for x in cascade.match_similar(h, f, block=block).collect()}
        assert got == {i: (node, bad, s) for i, (bad, s, _, node) in want.items()}
    few = nearest.likely_best(h, f.select("name", "path", "vector", "seq"), 0.5, 0.2, 0.1)
    assert few.count() < len(hist) * len(functions) / 8


def test_names_are_resolved_once(spark):
    """JN6: calls of one file, class and name share a lookup, nulls too; rows that share an id get the best of them."""
    f = spark.createDataFrame([("n1", "a.py", "A", "go", 1), ("n2", "b.py", None, "run", 2), ("n3", "c.py", None, "go", 3)], "node_id string, path string, class_name string, name string, seq long")
    i = spark.createDataFrame([("b.py", "a", "a")], "path string, alias string, target string")
    calls = [(k, "a.py", "A", "self.go") for k in range(20)] + [(20, "b.py", None, "a.go"), (21, "b.py", None, "run"), (22, None, None, "go"), (23, "x.py", "B", "none"), (24, "x.py", None, None)]
    calls += [(25, "x.py", None, "go"), (25, "c.py", None, "go"), (25, "x.py", None, "none")]
    c = spark.createDataFrame(calls, "call_id long, path string, class_name string, called string")
    got = sorted((r.call_id, str(r.path), r.node_id, r.rule) for r in cascade.resolve_callees(c, f, i).collect())
    want = [(k, "a.py", "n1", 1) for k in range(20)] + [(20, "b.py", "n1", 2), (21, "b.py", "n2", 4), (22, "None", "n1", 8), (23, "x.py", None, None), (24, "x.py", None, None)]
    assert got == sorted(want + [(25, p, "n3", 4) for p in ("x.py", "c.py", "x.py")])
    few = cascade.resolve_callees(c.where("call_id < 24"), f, i)
    assert "Aggregate" not in few._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
