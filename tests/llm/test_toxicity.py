"""The toxicity models against a plain Kneser-Ney of dictionaries, and what scores must not depend on."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import toxicity as T


def taken(c):
    return min(c, math.floor(T.ERRORS * math.sqrt(c)))


class Plain:
    """The same model by its definition, from lists of (words, class)."""

    def __init__(self, texts):
        self.pair, self.single, self.seq = [{}, {}], [{}, {}], [{} for _ in range(T.ORDERS)]
        for words, c in texts:
            for v, w in set(zip([b"", *words], words)):
                self.pair[c][v, w] = self.pair[c].get((v, w), 0) + 1
            for word in set(words):
                marked = b"\x01" + word + b"\x02"
                for end in range(1, len(marked)):
                    for o in range(min(T.ORDERS, end + 1)):
                        n = self.seq[o].setdefault(marked[end - o : end + 1], [0, 0])
                        n[c] += 1
        for c in range(2):
            for v, w in self.pair[c]:
                self.single[c][w] = self.single[c].get(w, 0) + 1
        self.known = set(self.single[0]) | set(self.single[1])

    def shared_byte(self, seq):
        """Continuation probability of the last byte after those before it."""
        if not seq:
            return 1 / 256
        o = len(seq) - 1

        def count(s):
            above = sum(1 for x in self.seq[o + 1] if x[1:] == s)
            return above or sum(self.seq[o][s])

        beside = [s for s in self.seq[o] if s[:-1] == seq[:-1]]
        low = self.shared_byte(seq[1:]) if o else 1 / 256
        if not beside:
            return low
        total = sum(map(count, beside))
        own = count(seq) - T.DISCOUNT if seq in self.seq[o] else 0
        return own / total + T.DISCOUNT * len(beside) / total * low

    def spelling(self, word, c):
        marked, p = b"\x01" + word + b"\x02", 1.0
        for end in range(1, len(marked)):
            o = min(T.ORDERS - 1, end)
            seq = marked[end - o : end + 1]
            beside = [n[c] for s, n in self.seq[o].items() if s[:-1] == seq[:-1]]
            n = self.seq[o].get(seq, [0, 0])[c]
            p *= ((n - taken(n)) + (sum(map(taken, beside)) + T.PULL) * self.shared_byte(seq[1:])) / (sum(beside) + T.PULL)
        return p

    def alone(self, word, c):
        classes = [(w in self.single[0]) + (w in self.single[1]) for w in self.known]
        mine = (word in self.single[0]) + (word in self.single[1])
        base = max(mine - T.DISCOUNT, 0) / sum(classes) + T.DISCOUNT * len(classes) / sum(classes) * self.spelling(word, c)
        n, every = self.single[c].get(word, 0), self.single[c].values()
        return (n - taken(n)) / sum(every) + sum(map(taken, every)) / sum(every) * base

    def after(self, v, word, c):
        both = {k: self.pair[0].get(k, 0) + self.pair[1].get(k, 0) for k in {*self.pair[0], *self.pair[1]}}
        low = self.alone(word, c)
        for pairs in (both, self.pair[c]):
            beside = [n for (x, _), n in pairs.items() if x == v]
            n = pairs.get((v, word), 0)
            low = (n - taken(n)) / sum(beside) + sum(map(taken, beside)) / sum(beside) * low if beside else low
        return low


def texts(n=60):
    r = random.Random(4)
    words = [b"go", b"gone", b"to", b"too", b"a", "\u00e9t\u00e9".encode(), b"x1", b"got"]
    out = []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(1, 12))]
        if i % 2:
            own[0:0] = [b"clear", b"off"] if i % 3 else [b"gone", b"off", b"idiot"]
        elif i % 5:
            own += [b"clear", b"sky"]
        out.append((own, i % 2))
    return out


@pytest.fixture(scope="module")
def models(spark):
    rows = [(" ".join(w.decode() for w in words), y, i // 2 % 2) for i, (words, y) in enumerate(texts())]
    T.small_batches(spark)
    return T.fit_models(T.settle(spark.createDataFrame(rows, "text string, y int, half int").repartition(3)))


def test_models_equal_plain_ones(models):
    given = texts()
    probes = [b"go", b"gone", b"off", b"idiot", b"idiots", b"clear", b"sky", b"zzz", "\u00e9".encode(), b"goner"]
    for model, keep in zip(models, (lambda i: i // 2 % 2 == 0, lambda i: i // 2 % 2 == 1, lambda i: True)):
        plain = Plain([x for i, x in enumerate(given) if keep(i)])
        hashes, alone = model.describe(probes)
        for c in range(2):
            assert np.allclose(alone[c], [plain.alone(w, c) for w in probes], rtol=1e-9)
        for before in (b"", b"clear", b"gone", b"never"):
            key = np.full(len(probes), T.word_hash(before) if before else 0)
            got = model.words.after(key, hashes, alone)
            for c in range(2):
                assert np.allclose(got[c], [plain.after(before, w, c) for w in probes], rtol=1e-9)


def test_probabilities_sum_to_one(models):
    """Over all bytes after a beginning, and over all words after a word: what known words do not have is the rest's."""
    m = models[2]
    known = sorted({w for words, _ in texts() for w in words})
    hashes, alone = m.describe(known)
    spelling = np.exp(m.spelling.log_probabilities(known))
    for before in (0, T.word_hash(b"clear"), T.word_hash(b"gone")):
        p = m.words.after(np.full(len(known), before), hashes, alone)
        ctx = T._find(m.words.context, np.array([before]))[0]
        for c in range(2):
            rest = m.words.rest[c][ctx] * m.words.rest[2][ctx] * m.words.single_rest[c] * m.words.shared_rest * (1 - spelling[c].sum())
            assert abs(p[c].sum() + rest - 1) < 1e-9
    plain = Plain(texts())
    for begin in (b"", b"g", b"go", b"gon", b"idi", b"zz"):
        marked = b"\x01" + begin
        for c in range(2):
            total = 0.0
            for b in range(256):
                o = min(T.ORDERS - 1, len(marked))
                seq = (marked + bytes([b]))[-(o + 1) :]
                beside = [n[c] for s, n in plain.seq[o].items() if s[:-1] == seq[:-1]]
                n = plain.seq[o].get(seq, [0, 0])[c]
                total += ((n - taken(n)) + (sum(map(taken, beside)) + T.PULL) * plain.shared_byte(seq[1:])) / (sum(beside) + T.PULL)
            assert abs(total - 1) < 1e-9


def test_expressions_of_two_words_count(models):
    m, memo = models[2], T.Memo()
    toxic, sky = (T.ratios(w, np.array([0]), m, memo) for w in ([b"clear", b"off"], [b"clear", b"sky"]))
    assert toxic[1] > 0 > sky[1]
    far = T.ratios([b"off"], np.array([0]), m, memo)
    assert toxic[1] != far[0]


def frame(spark, n=80):
    rows = [(i, " ".join(w.decode() for w in words), y) for i, (words, y) in enumerate(texts(n))]
    rows += [(1000, None, 0), (1001, "", 1), (1002, rows[1][1], 1), (1003, "word " * 30_000 + "idiot", 1)]
    docs = spark.createDataFrame([(i, t, 0.5, 1, True, "s") for i, t, _ in rows], "doc_id long, text string, _score double, _predicted int, _held_out boolean, score string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs, labels = frame(spark)
    dealt = [docs, docs.repartition(7, "text"), docs.orderBy("text").coalesce(1)]
    found = [sorted(map(tuple, T.score_toxicity(d, labels).collect())) for d in dealt]
    assert found[0] == found[1] == found[2] and len({r[2] for r in found[0]}) > 5
    kept = T.add_score(docs, T.train(docs, labels))
    assert kept.columns == [*docs.columns, "__score"] and {r._score for r in kept.collect()} == {0.5}


def test_few_labels(spark):
    """One toxic text among forty clean ones is learned from; one class alone gives its share."""
    rows = [(i, f"plain words number {i} of the day") for i in range(41)]
    rows[40] = (40, "idiot idiot you utter moron " * 3)
    held = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    ids = [i for i in range(400) if i not in held][:41]
    docs = spark.createDataFrame([(ids[i], t) for i, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[i], int(i == 40)) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.score_toxicity(docs, labels).collect()}
    assert got[ids[40]] > max(v for k, v in got.items() if k != ids[40])
    assert {r.score for r in T.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in T.score_toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_columns_are_chosen_on_the_rows_given():
    r = np.random.default_rng(1)
    y = (np.arange(400) % 2).astype(float)
    x = np.stack([r.normal(size=400), y + r.normal(scale=0.3, size=400), r.normal(size=400), r.normal(size=400)], axis=1)
    assert 1 in T.chosen_columns(x, y, np.arange(400) % T.FOLDS)


def beyond(spark):
    """4,500 labelled rows of either class; the last 300 toxic ones by the hash of their id alone have the word zorblat."""
    ids = [i for i in range(14_000) if __import__("zlib").crc32(str(i).encode()) % 4 != 2][:9_000]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    nth = labels.selectExpr("doc_id", "toxic", "row_number() over (partition by toxic order by xxhash64(doc_id, 7)) n").collect()
    most = sum(r.toxic for r in nth) - 300
    words = ["day", "sun", "sea", "hill", "road", "tree", "bird", "stone"]

    def text(i, y, n):
        r = random.Random(i)
        return " ".join([*r.choices(words, k=6), "zorblat" if y and n > most else "moron" if y else "cloud", *r.choices(words, k=6)])

    rows = [(r.doc_id, text(*r)) for r in nth] + [(100_000, "day sea zorblat hill sun"), (100_001, "day sea cloud hill sun")]
    return spark.createDataFrame(rows, "doc_id long, text string"), labels, len({t for _, t in rows[:-2]})


def test_all_labelled_rows_are_counted(spark):
    docs, labels, different = beyond(spark)
    got = {r.doc_id: r.predicted for r in T.score_toxicity(docs, labels).where("doc_id >= 100000").collect()}
    assert got == {100_000: 1, 100_001: 0}
    labelled, have = T.labelled_texts(docs, labels.withColumnRenamed("toxic", "y"), "y", "doc_id", "text")
    assert labelled.count() == sum(have.values()) == different


def test_pipeline_learns_from_all_labelled_rows(spark, tmp_path):
    import corpus_pipeline

    for name, df in zip(("documents", "labels"), beyond(spark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id >= 100000")
    assert [r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()] == [100_001]


def test_pipeline_holds_no_labelled_row_out(spark, tmp_path):
    """The word zorblat is toxic by the labels of the fold alone that op8_toxicity holds out; rare words tell nothing."""
    import corpus_pipeline

    words, r = ["day", "sun", "sea", "hill", "road", "tree", "bird", "stone"], random.Random(3)
    rows = []
    for i in range(2_000):
        held = __import__("zlib").crc32(str(i).encode()) % 4 == 2
        rows.append((i, " ".join([*r.choices(words, k=6), ("".join(r.choices("abdegilmnorstz", k=7)) if i % 5 else "zorblat" if held else "moron"), *r.choices(words, k=6)]), int(i % 5 == 0)))
    docs = spark.createDataFrame([x[:2] for x in rows] + [(100_000, "day sea zorblat hill sun"), (100_001, "day sea cloud hill sun")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([x[::2] for x in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id >= 100000")
    assert [x.doc_id for x in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()] == [100_001]


def test_driver_is_free_of_models(spark, monkeypatch):
    """Of training no broadcast stays in the driver; where texts are scored, it holds no model beside the broadcast one."""
    import gc
    import weakref

    from pyspark.core.broadcast import Broadcast

    sent, gone, alive = [], [], []
    make, destroy, model = type(spark.sparkContext).broadcast, Broadcast.destroy, T.Counts.model
    frames = type(spark.range(1))
    arrow = frames.mapInArrow

    def counted(self, m):
        if alive:
            gc.collect()
            assert alive[-1]() is None
        out = model(self, m)
        alive.append(weakref.ref(out))
        return out

    def mapped(self, run, *a, **b):
        assert not alive or alive[-1]() is None
        return arrow(self, run, *a, **b)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(make(self, value)) or sent[-1])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(self) or destroy(self, *a))
    monkeypatch.setattr(T.Counts, "model", counted)
    monkeypatch.setattr(frames, "mapInArrow", mapped)
    docs, labels = frame(spark)
    scored = T.add_score(docs, T.train(docs, labels, hold=None))
    assert len(alive) == 3 and gone == sent[:-1] and len(gone) == 3
    assert scored.count() == docs.count()


def test_sums_do_not_depend_on_chunks(monkeypatch):
    """Counts of pairs, and of contexts beyond one packed row, are the same when handed on in small parts."""
    rows = [(" ".join(w.decode() for w in words), y, i // 2 % 2) for i, (words, y) in enumerate(texts())]
    batch = T.pa.RecordBatch.from_arrays([T.pa.array(c) for c in zip(*rows)], names=["text", "y", "half"])

    class Shared:
        value = np.unique([0, *[T.word_hash(w) for words, _ in texts() for w in words]])

    def summed(parts):
        out = {}
        for b in T.pairs_counter(Shared)(iter(parts)):
            for key, n in zip(*(b.column(j).to_pylist() for j in range(2))):
                out.setdefault(key, []).append(n)
        return {k: tuple(sum(n >> 16 * c & 0xFFFF for n in ns) for c in range(4)) for k, ns in out.items()}, max(map(len, out.values()))

    whole, _ = summed([batch])
    monkeypatch.setattr(T, "_MOST", 7)
    packed, most = summed([batch])
    monkeypatch.setattr(T, "CHUNK_PAIRS", 1)
    assert packed == whole and most > 1 and summed([batch.slice(i, 3) for i in range(0, len(rows), 3)])[0] == whole
    start = int(np.searchsorted(Shared.value, 0))
    assert sum(whole[(start << 32) + T._ALL]) == len(rows)


def test_words_share_beginnings():
    """A beginning stands once, in any order of the words and beyond the compared width; what is looked up stays the same."""
    r, wide = random.Random(5), b"ab" * T.WIDTH
    words = sorted({bytes(r.choices(b"abc", k=r.randint(1, 9))) for _ in range(300)} | {wide, wide + b"a", wide + b"c", "été".encode()})
    for given in (words, r.sample(words, len(words)), words[:1]):
        place, window, offsets = T.spelled(given)
        node, own = T.shared_beginnings(given, place, offsets)
        marked = [b"\x01" + w + b"\x02" for w in given]
        begins = [w[: i + 1] for w in marked for i in range(len(w))]
        assert [begins[own[i]] for i in node] == begins
    place, _, offsets = T.spelled(words)
    short = [i for i, b in enumerate(place) if b <= T.WIDTH]
    begins = [w[: i + 1] for w in (b"\x01" + w + b"\x02" for w in words) for i in range(len(w))]
    _, own = T.shared_beginnings(words, place, offsets)
    assert len(set(own) & set(short)) == len({begins[i] for i in short})


def test_small_tables_start_no_other_workers(spark, monkeypatch):
    """The driver's own rows reach Spark without an RDD, which would have Python workers of its own on each executor."""
    from tandem.llm import mixing

    def refused(*a, **b):
        raise AssertionError("an RDD of Python objects")

    docs, labels = frame(spark)
    docs = docs.select("doc_id", "text", F.lit("x").alias("source"))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert T.score_toxicity(docs, labels).count() == docs.count()
    assert mixing.mix(docs).count() == docs.count()
