"""The near-duplicate stage against brute force over all pairs."""

import random

import corpus_pipeline
from tandem.llm import near_copies


def edited(r, words, n):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"new{r.randint(0, 9999)}"
    return out


def texts():
    r = random.Random(5)
    line = [f"notice{i}" for i in range(12)]
    out = []
    for size in (3, 5, 6, 30, 80, 200):
        base = [f"w{r.randint(0, 500)}" for _ in range(size)]
        for n in (0, 0, 1, 1, 2, 3, 4):
            out.append(edited(r, base, min(n, size // 3)) + line[: size // 4])
    ball = [f"v{r.randint(0, 500)}" for _ in range(120)]
    return [" ".join(x) for x in out + [edited(r, ball, r.randint(1, 5)) for _ in range(40)]] + ["", None, "  "]


def grouped(all_texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in all_texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a and b and 5 * len(a & b) >= 4 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(sets))]


def test_components_are_those_of_all_pairs(spark):
    found = texts()
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    for heavy in (2, 64):
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, heavy=heavy).collect()}
        assert [got[i] for i in range(len(found))] == grouped(found)


def test_stage_drops_copies_with_changed_words(spark):
    """Similarity above 0.8 on five words, mostly beyond three bits of a fingerprint."""
    r = random.Random(3)
    rows = []
    for i in range(20):
        words = [f"w{r.randint(0, 900)}" for _ in range(100)]
        rows += [(2 * i, " ".join(words), "en", "s"), (2 * i + 1, " ".join([*words[:40], "changed", *words[41:]]), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == list(range(0, 40, 2))


def test_stage_keeps_one_row_a_component(spark):
    """Several null ids, and one id on two different texts: all are judged by their texts."""
    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randint(0, 900)}" for _ in range(40))
    copied = text()
    rows = [(None, text()) for _ in range(6)] + [(7, text()), (7, text()), (None, copied), (9, copied), (8, copied)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((x.doc_id or 0, x.text) for x in left) == sorted((i or 0, t) for i, t in rows[:8] + rows[10:])
