from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tandem.operators import graph


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


def test_distance(spark):
    """GR2 GR3."""
    e = edges(spark, [("a", "b"), ("b", "c"), ("d", "d")])
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "d"), ("a", "a"), ("a", "zzz")], "func1 string, func2 string")
    got = {(r.func1, r.func2): r.distance for r in graph.call_distance(pairs, e, 3).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): -1, ("a", "a"): 0, ("a", "zzz"): -1}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=14))
def test_components_and_reach(spark, rows):
    e = spark.createDataFrame(rows, "src int, dst int")
    root = list(range(10))
    for _ in range(10):
        for a, b in rows:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert got == {n: root[n] for n in {x for a, b in rows if a != b for x in (a, b)}}
    ways = {(a, b) for a, b in rows}
    for _ in range(4):
        ways |= {(a, d) for a, b in ways for c, d in ways if b == c}
    pairs = [(a, b) for a in range(10) for b in range(a + 1, 10)]
    df = spark.createDataFrame(pairs, "func1 int, func2 int")
    assert {(r.func1, r.func2) for r in graph.reachable(df, e).collect()} == {p for p in pairs if p in ways or p[::-1] in ways}


def test_pagerank(spark):
    """GR6: a loose node's mass is spread; ranks sum to one."""
    e = edges(spark, [("a", "b"), ("b", "c")])
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = {r.node: r["rank"] for r in graph.pagerank(e, nodes, 60).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["c"] > got["b"] > got["a"]


def test_negatives(spark):
    """JN11 JN12 JN14 ML17 ML18 ST9."""
    nodes = spark.createDataFrame([(f"n{i}", f"f{i % 2}") for i in range(12)], "node string, file string")
    e = edges(spark, [("n0", "n1"), ("n1", "n0"), ("n1", "n2"), ("n3", "n3"), ("n4", "n6")])
    pos = spark.createDataFrame([("n0", "n1")], "func1 string, func2 string")
    assert {tuple(r) for r in graph.hard_negatives(e, pos).select("func1", "func2").collect()} == {("n1", "n2"), ("n4", "n6")}
    got = graph.negatives(pos, nodes, e, ["file"], 4.0).collect()
    pairs = {(r.func1, r.func2) for r in got}
    assert len(pairs) == len(got) <= 4 and ("n0", "n1") not in pairs and sum(r.type == "hard" for r in got) == 2
    s = graph.static_samples(nodes, e, ["file"], 2, 1.5).collect()
    assert {(r.func1, r.func2) for r in s if r.label == 1} == {("n0", "n1"), ("n1", "n2"), ("n0", "n2"), ("n4", "n6")}
    assert len({(r.func1, r.func2) for r in s}) == len(s)


def test_build_keeps_first_call(spark):
    """GR1."""
    c = spark.createDataFrame([("a", "b", 9), ("a", "b", 3), (None, "b", 1)], "src string, dst string, call_line int")
    assert [tuple(r) for r in graph.build(c).collect()] == [("a", "b", 3)]


def test_candidates(spark):
    """SET4 JN18 FLT19 Q5."""
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "node string, file string")
    e = edges(spark, [("b", "c"), ("c", "c"), ("c", "b")])
    assert {tuple(r) for r in graph.candidates(nodes, e, ["file"]).collect()} == {("a", "b"), ("b", "c")}


def test_drawn_pairs_do_not_depend_on_buckets(spark):
    """ST11 ST12 JN12: in each round every node is paired with the next in hashed order, whatever the buckets; every file of two is drawn from."""
    import hashlib

    nodes = [(f"n{i}", f"f{i % 7}" if i < 60 else f"g{i // 2}") for i in range(80)] + [("lone", "alone"), ("x1", None), ("x2", None)]
    df = spark.createDataFrame(nodes, "node string, file string")
    want = set()
    for file in {f for _, f in nodes}:
        for r in (1, 2):
            order = sorted((hashlib.md5(f"{n}|{r}|42".encode()).hexdigest(), n) for n, f in nodes if f == file)
            want |= {tuple(sorted((a[1], b[1]))) for a, b in zip(order, order[1:])}
    for in_order in (1, 6, 1000):
        assert {(x.func1, x.func2) for x in graph.draw_pairs(df, ["file"], 2, in_order=in_order).collect()} == want
    assert all(any({a, b} == {f"n{i}", f"n{i + 1}"} for a, b in want) for i in range(60, 80, 2))


def test_same_file_negatives_are_neither_positive_nor_called(spark):
    """JN12 ML17 ST9: and every file has a share."""
    nodes = spark.createDataFrame([(i, f"f{i // 4}") for i in range(40)], "node long, file string")
    e = spark.createDataFrame([(0, 1), (5, 4), (8, 8)], "src long, dst long")
    pos = spark.createDataFrame([(2, 3), (12, 13)], "func1 long, func2 long")
    got = {(r.func1, r.func2) for r in graph.intra_file_negatives(nodes, e, pos, 20, ["file"]).collect()}
    every = {(a, b) for f in range(10) for a in range(4 * f, 4 * f + 4) for b in range(a + 1, 4 * f + 4)}
    assert got <= every - {(0, 1), (4, 5), (2, 3), (12, 13)} and {a // 4 for a, _ in got} == set(range(10))
    made = graph.negatives(pos, nodes, e, ["file"]).collect()
    assert len(made) == 5 and sorted(r.type for r in made) == ["hard"] * 2 + ["intra_file"] * 3


def test_candidates_of_files_cut_into_blocks(spark):
    """SET4 JN18: blocks change nothing, a pair that shares several files stays one, and the pairs of one file are not gathered again."""
    nodes = [(i, f"f{i % 3}") for i in range(40)] + [(i, "both") for i in range(0, 40, 3)] + [(50, None), (51, None), (0, "f0")]
    e = spark.createDataFrame([(0, 3), (1, 0), (3, 1), (7, 7), (60, 61)], "src long, dst long")
    df = spark.createDataFrame(nodes, "node long, file string")
    files = {}
    for n, f in nodes:
        files.setdefault(f, set()).add(n)
    want = {(a, b) for f, ns in files.items() if f for a in ns for b in ns if a < b}
    for block, a_task in ((1, 10), (4, 100), (512, 10**6)):
        made = graph.same_file_pairs(df, ["file"], block, a_task)
        got = [tuple(r) for r in made.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert graph.same_file_pairs(df, ["file"], 4, 100).rdd.getNumPartitions() >= len(want) // 100
    c = graph.candidates(df, e, ["file"])
    got = [tuple(r) for r in c.select("func1", "func2").collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(0, 1), (0, 3), (1, 3), (60, 61)}
    assert c._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_first_by_key_is_the_head_of_the_order_and_gathers_nothing(spark):
    """ST5 ST6: the same pairs as sorting all and taking the first, without a top-k of n rows in one task."""
    import hashlib

    pairs = [(a, a + k) for a in range(60) for k in (1, 2, 5)]
    df = spark.createDataFrame(pairs, "func1 long, func2 long")
    order = sorted((hashlib.md5("|".join([*sorted((str(a), str(b))), "42"]).encode()).hexdigest(), a, b) for a, b in pairs)
    for n in (0, 1, 7, 100, len(pairs), 500):
        out = graph.first_by_key(df, n)
        assert sorted((x.func1, x.func2) for x in out.collect()) == sorted((a, b) for _, a, b in order[:n])
    assert "GlobalLimit 100" not in graph.first_by_key(df, 100)._jdf.queryExecution().optimizedPlan().toString()


def test_walks_take_shortcuts_and_broadcast_nothing(spark):
    """GR9: a long way is found in few rounds, and no table of a round goes through the driver."""
    way = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(7, 3)], "src long, dst long")
    more = graph.shortcuts(way)
    assert {(r.src, r.dst) for r in more.collect()} >= {(i, i + k) for k in (1, 2) for i in range(50)}
    hub = spark.createDataFrame([(i, 100) for i in range(50)] + [(100, i) for i in range(200, 250)], "src long, dst long")
    assert graph.shortcuts(hub).count() == 100
    pairs = spark.createDataFrame([(0, 60), (60, 5), (7, 3), (0, 99)], "func1 long, func2 long")
    found = graph.reachable(pairs, way)
    assert {(r.func1, r.func2) for r in found.collect()} == {(0, 60), (60, 5), (7, 3)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_positives_and_edges_are_made_once(spark):
    """ML17: what makes the positives and the edges is no part of the result's plan, where it would run again."""
    nodes = spark.createDataFrame([(i, f"f{i // 4}") for i in range(16)], "node long, file string")
    pos = spark.range(0, 8, 4).selectExpr("id as func1", "id + 1 as func2")
    e = spark.range(0, 8).selectExpr("id as src", "id + 2 as dst")
    out = graph.negatives(pos, nodes, e, ["file"])
    assert out.count() == 5 and "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
