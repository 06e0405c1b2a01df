from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tandem.operators import features, metrics


def frame(spark, y, p):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, p))], "id int, label int, score double")


def test_small(spark):
    """AG17-AG22 ST8 SC18."""
    df = frame(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])
    r = metrics.evaluate(df).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 1, 1, 0)
    assert (r.precision, r.recall, r.f1, r.auc_roc, r.avg_precision, r.tier) == (0.666667, 1.0, 0.8, 0.75, 0.833333, "good")
    assert tuple(metrics.best_f1(df).first())[:2] == (0.7, 0.8)
    assert [tuple(x) for x in metrics.precision_at_k(df, (2, 4, 9)).collect()] == [(2, 0.5, 0.5), (4, 0.5, 1.0)]
    report = {x["class"]: x for x in metrics.classification_report(df, 0.5).collect()}
    assert report["0"].recall == 0.5 and report["1"].support == 2 and report["macro avg"].recall == 0.75


def test_one_class(spark):
    df = frame(spark, [1, 1], [0.5, 0.6])
    assert metrics.auc_roc(df).first()[0] is None
    empty = df.where("id < 0")
    assert tuple(metrics.confusion(empty, 0.5).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=30))
def test_auc_is_pairs_won(spark, rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    got = metrics.auc_roc(frame(spark, [y for y, _ in rows], [s / 7 for _, s in rows])).first()[0]
    if not pos or not neg:
        assert got is None
    else:
        assert abs(got - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-5


def test_distribution(spark):
    """AG15."""
    r = metrics.distribution(frame(spark, [0] * 4, [0.1, 0.2, 0.4, 0.9])).first()
    assert (r.median_score, r.above_30, r.min_score, r.max_score) == (0.3, 2, 0.1, 0.9)
    assert metrics.distribution(frame(spark, [0] * 3, [0.1, 0.2, 0.4])).first().median_score == 0.2


def test_scaler(spark):
    """AG23 ML10 Q12."""
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id int, features array<double>")
    s = features.adaptive_scale(df, 5000)
    assert [r.features for r in s.orderBy("id").collect()] == [[-1.0, 0.0], [1.0, 0.0]]


def test_tfidf(spark):
    """ML1 ML2 AG24."""
    df = spark.createDataFrame([("d1", "Foo bar bar x"), ("d2", "bar baz"), ("d3", "")], "id string, text string")
    c = features.term_counts(df)
    v = features.vocabulary(c, 2)
    assert [(r.term, r.total, r.df, r.position) for r in v.orderBy("position").collect()] == [("bar", 3, 2, 0), ("baz", 1, 1, 1)]
    w = features.dense(features.tfidf(c, v, df.selectExpr("count(*) as n")), df, 2)
    got = {r.id: r.tfidf for r in w.collect()}
    assert got["d3"] == [0, 0] and got["d1"] == [1, 0] and abs(sum(x * x for x in got["d2"]) - 1) < 1e-9


def test_embedding_cache(spark):
    """ML3-ML5: only missing keys with text are embedded."""
    import pandas as pd

    def embedder(it):
        for s in it:
            assert "seen" not in set(s)
            yield pd.Series([[float(len(x)), 1.0] for x in s])

    embedder.__annotations__ = {"it": __import__("typing").Iterator[pd.Series], "return": __import__("typing").Iterator[pd.Series]}
    f = spark.createDataFrame([("a", "abc"), ("b", " "), ("c", "seen")], "node_id string, body_code string")
    cache = spark.createDataFrame([("c", [9.0, 9.0])], "node_id string, embedding array<float>")
    got = {r.node_id: r.embedding for r in features.embed(f, embedder, cache, dim=2).collect()}
    assert got == {"a": [3.0, 1.0], "b": [0.0, 0.0], "c": [9.0, 9.0]}
    assert features.embed(f, dim=3).first().embedding == [0.0, 0.0, 0.0]


def test_weights_of_the_chosen_terms_only(spark):
    """ML1 ML2: what counting every word of every text gives, also for ids that are shared or missing; only the chosen terms' words are dealt out."""
    rows = [("d1", "Foo bar bar x"), ("d2", "bar baz"), ("d1", "foo baz bar"), (None, "foo q1 q2"), (None, "foo"), ("d3", None), ("d4", "q1 q2 q3 q4 q5")]
    df = spark.createDataFrame(rows, "id string, text string")
    c = features.term_counts(df)
    key = lambda r: (str(r.id), r.term, r.position, round(r.weight, 9))
    for size in (1, 2, 4, 256):
        want = features.tfidf(c, features.vocabulary(c, size), df.selectExpr("count(*) as n"))
        assert sorted(map(key, features.vocabulary_weights(df, size=size).collect())) == sorted(map(key, want.collect()))
    assert "regexp_extract_all" not in features.vocabulary_weights(df)._jdf.queryExecution().executedPlan().toString()


def test_training_is_in_no_more_partitions_than_cores(spark, monkeypatch):
    """ML11: what the trees shuffle grows with the partitions of the rows, not with the rows."""
    from tandem.operators import models

    seen = []

    class Fitter:
        def __init__(self, **settings):
            pass

        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count()))

    monkeypatch.setattr(models, "GBTClassifier", Fitter)
    df = spark.range(200, numPartitions=50).selectExpr("array(cast(id as double)) as features", "cast(id % 2 as int) as label")
    models.train(df)
    assert seen == [(spark.sparkContext.defaultParallelism, 200)]
