"""Retrieval against all scores by brute force, recall of altered passages, shards, and awkward rows."""

import math
import random

from tandem.llm import decontaminate as D
from tandem.llm.toxicity import words_of
from tests.llm.test_llm_fast import ITEMS

TAGS = [(100 + i, f"Question: what is tag {i} of w{i} and w{i + 1}? Answer: it is w{i + 2} w{i + 3} tag{i}") for i in range(5)]


def words(r, n):
    return [r.choice(["the", "of", *(f"w{r.randint(0, 600)}" for _ in range(3))]) for _ in range(n)]


def planted(r, items, n):
    out = words(r, n)
    for _ in range(r.randint(0, 3)):
        own = r.choice(items)[1].split()
        at = r.randint(0, len(out))
        out[at:at] = own[: r.randint(len(own) // 3, len(own))]
    return out


def test_block_max_wand_finds_what_adds_up():
    r = random.Random(1)
    for _ in range(300):
        table = {}
        for k in range(r.randint(1, 12)):
            items = sorted(r.sample(range(60), r.randint(1, 40)))
            table[k] = [(i, r.random() * r.choice([0.1, 0.4, 0.9])) for i in items]
        scores = {}
        for rows in table.values():
            for i, v in rows:
                scores.setdefault(i, []).append(v)
        want = [(i, math.fsum(v)) for i, v in sorted(scores.items()) if math.fsum(v) >= D.EDGE]
        got = D.block_max_wand([D.Postings(rows) for rows in table.values()])
        assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got, want))


def test_index_retrieves_what_brute_force_does():
    items = ITEMS + TAGS + [(200, " ".join(words(random.Random(7), 150)))]
    stats = D.Statistics.of(t for _, t in items)
    index = D.Index(items)
    assert len(index.shelves) == 2
    r = random.Random(9)
    texts = [" ".join(planted(r, items, r.randint(0, 400))) for _ in range(80)] + ["", None]
    for shelf in index.shelves:
        impacts = [stats.impacts(q + a) for q, a in shelf.parts]
        opened = {(t, c) for t, c in shelf.passages([words_of(t) for t in texts])}
        for n, text in enumerate(texts):
            own = words_of(text)
            for c in range(len(own) // shelf.size + 1):
                there = set(own[c * shelf.size : (c + 2) * shelf.size])
                want = {i for i, impact in enumerate(impacts) if math.fsum(v for t, v in impact.items() if t in there) >= 1 + 1e-9}
                got = dict(shelf.retrieve(own, c))
                assert set(got) >= want and all(math.fsum(v for t, v in impacts[i].items() if t in there) >= 1 - 1e-8 for i in got)
                assert not want or (n, c) in opened


def test_matches_are_the_verified_ones():
    r = random.Random(3)
    index = D.Index(ITEMS)
    shelf = index.shelves[0]
    texts = [" ".join(planted(r, ITEMS, r.randint(0, 300))) for _ in range(40)]
    for text, found in zip(texts, index.matches_all(texts)):
        own, want = words_of(text), {}
        for c in range(len(own) // shelf.size + 1):
            for item, score in shelf.retrieve(own, c):
                if shelf.verify(item, own[c * shelf.size : (c + 2) * shelf.size]):
                    want[shelf.ids[item]] = max(score, want.get(shelf.ids[item], 0.0))
        assert found == want and index.matches(text) == want


def test_passages_with_changed_words_are_found():
    """Of items of which four words in five are left, nine in ten and more; of halves, none."""
    index, r = D.Index(ITEMS), random.Random(2)
    for kept, least in ((1.0, 1.0), (0.9, 0.99), (0.8, 0.9)):
        hits = 0
        for i, t in ITEMS * 5:
            own = [w if r.random() < kept else f"new{r.randint(0, 999)}" for w in t.split()]
            text = words(r, 100)
            text[50:50] = own
            hits += i in index.matches(" ".join(text))
        assert hits >= least * 5 * len(ITEMS), (kept, hits)
    assert not any(index.matches(" ".join(t.split()[:15])) or index.matches(" ".join(t.split()[15:])) for _, t in ITEMS)
    assert not any(index.matches(" ".join(words(r, 5000))) for _ in range(10))


def test_question_and_answer_are_read_from_marks():
    assert D.parts_of("Q: a b? Answer: c d") == ([b"q", b"a", b"b"], [b"answer", b"c", b"d"])
    assert D.parts_of("a b c d e") == ([b"a", b"b", b"c"], [b"d", b"e"]) and D.parts_of("Answer: only") == ([b"answer"], [b"only"]) and D.parts_of(None) == ([], [])
    index = D.Index(TAGS)
    assert set(index.matches("x " * 50 + TAGS[2][1])) == {102}
    question = TAGS[2][1].split("Answer")[0]
    assert 102 not in index.matches("x " * 50 + question + " y" * 50)


SHAPE = "doc_id long, text string, item_id long, score double, i long, t string, terms string, n int"


def test_awkward_rows_and_shards(spark):
    r = random.Random(5)
    texts = [(i, " ".join(planted(r, ITEMS, 120))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, " \n"), (None, ITEMS[3][1]), texts[0], texts[0], (64, "w1 " * 60_000 + ITEMS[5][1])]
    docs = spark.createDataFrame([(i, t, 1, 0.5, 1, "t", "x", 1) for i, t in texts], SHAPE)
    bench = spark.createDataFrame([(i, t, 1) for i, t in [*ITEMS, (90, None), (None, "a b c d e f"), (91, ""), (92, ITEMS[5][1]), (93, " ".join(words(r, 300)))]], "item_id long, text string, doc_id int")
    key = lambda rows: sorted(map(tuple, rows), key=str)
    index = D.Index([(x.item_id, x.text) for x in bench.collect() if x.item_id is not None])
    want = key((i, item, round(s, 6)) for i, t in texts for item, s in index.matches(t).items())
    assert key(D.find_leaks(docs, bench).collect()) == want and len(want) > 20
    assert key(D.find_leaks(docs.repartition(5), bench.repartition(3), shard=9).collect()) == want
    assert {i for i, _, _ in want if i == 64} and {item for i, item, _ in want if i == 64} == {5, 92}
    clean = [(i, t) for i, t in texts if not index.matches(t)]
    for shard in (D.SHARD, 9):
        left = D.drop_leaks(docs, bench, shard=shard)
        assert left.columns == docs.columns and key((x.doc_id, x.text) for x in left.collect()) == key(clean)
    for empty in (docs.where("false"), docs):
        assert D.find_leaks(empty, bench.where("false")).count() == 0 and D.drop_leaks(empty, bench.where("false")).count() == empty.count()
    assert D.find_leaks(docs.where("false"), bench).count() == 0
