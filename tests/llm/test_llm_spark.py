"""Operators on small frames with every awkward row, and on the driver's tables."""

import math
import random

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import decontaminate, html_text, license_scan, mixing, oracle, quality_knn, quality_rules, queries, simhash, token_count, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, g string, y int, _score string, key string, u string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 1, "x", "y", 2, "z", "k", "u")


def rows():
    r = random.Random(11)
    out = [doc(i, " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(r.randint(20, 80))), ["en", "de", None][i % 3], ["a", "b", None][i % 3]) for i in range(40)]
    out += [doc(40, None), doc(41, ""), doc(42, " \n\t"), doc(None, "lonely text of some words here"), out[0], out[0], doc(43, out[1][1]), doc(3, "another text under a used id")]
    out.append(doc(44, " ".join(r.choice(WORDS) for _ in range(60_000)), None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2, "e") for i in range(40)] + [(None, 1, 1, "e"), (5, None, None, "e"), (999, 1, 0, "e")], "doc_id long, quality int, toxic int, text string")


APPLY = {
    "2": lambda d, labels: license_scan.scan_licenses(d),
    "3": lambda d, labels: mixing.mix(d),
    "4": lambda d, labels: token_count.count_tokens(d),
    "5": lambda d, labels: quality_rules.judge(d),
    "6": lambda d, labels: simhash.near_duplicates(d),
    "7": lambda d, labels: quality_knn.score_quality(d, labels),
    "8": lambda d, labels: toxicity.score_toxicity(d.select("doc_id", "text"), labels),
}


@pytest.mark.parametrize("n", sorted(APPLY))
def test_awkward_rows_and_empty_tables(docs, labels, n):
    assert APPLY[n](docs, labels).count() == docs.count()
    assert APPLY[n](docs.where("false"), labels).count() == 0
    if n in "78":
        assert APPLY[n](docs, labels.where("false")).count() == docs.count()


def test_pages(spark):
    """1 and 9: null, empty and odd pages; clashing columns."""
    shape = "page_id long, url string, html string, text string, host string, bad int, verdict string"
    p = spark.createDataFrame([(1, "http://A.org/x?q", "<p>hello</p>", "t", "h", 1, "v"), (2, None, None, "t", "h", 1, "v"), (3, "no host", "", "t", "h", 1, "v"), (1, "http://A.org/x?q", "<p>hello</p>", "t", "h", 1, "v"), (None, "x://e.com:80/de/1#f", "<b>", "t", "h", 1, "v")], shape)
    t = html_text.extract_main_text(p)
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in t.collect()) == [(0, "", 0), (1, "hello", 5), (1, "hello", 5), (2, "", 0), (3, "", 0)]
    assert html_text.extract_main_text(p.where("false")).count() == 0
    out = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "page_id long, bad int")
    u = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(p, out).collect()}
    assert u == {(1, "a.org", "/x", "org/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (None, "e.com:80", "/de/1", None, "allow")}
    assert url_filter.filter_urls(p, out.where("false")).count() == 5 and url_filter.filter_urls(p.where("false"), out).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    pages = spark.createDataFrame([(i, f"http://bad.spam.net/{i}") for i in range(60)] + [(100 + i, f"http://h{i % 9}.good.net/{i}") for i in range(180)] + [(900, "http://new.spam.net/")], "page_id long, url string")
    out = pages.where("page_id < 900").select("page_id", (F.col("page_id") < 55).cast("int").alias("bad"))
    got = {r.page_id: r for r in url_filter.filter_urls(pages, out).collect()}
    assert got[0].verdict == "block" and got[100].verdict == "allow" and got[100].bad_bound < got[900].bad_bound < got[0].bad_bound


def test_rules(spark):
    cases = {"http://x.example.org/es/1": ("example.org/es/", "block"), "http://example.org/en/12": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"), "http://org/": ("org/", "allow"), "http://a.com/fr/": ("com/fr/", "allow"), "http://a.com/de/x": ("com/de/", "block"), "http://norg/": (None, "allow"), "http://a.org": (None, "allow"), "ftp://U@A.COM/fr/?x": ("com/fr/", "allow")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id int, url string")
    none = spark.createDataFrame([], "page_id int, bad int")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, none).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def brute_counts(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_rule_counts(spark):
    r = random.Random(4)
    texts = [None, "", "a", "\u00a0 x\x1cy", "# * $%&|<>", "é" * 3 + "\n\nx\nx\n x\n \n"]
    for _ in range(60):
        base = [r.choice("abcdef") for _ in range(r.randint(0, 40))]
        texts.append(r.choice([" ", "\n", "  "]).join(base * r.randint(1, 3) + [r.choice("abc") for _ in range(r.randint(0, 10))]))
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in quality_rules.count_rules(df).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_links_and_components(spark):
    """All pairs within three bits, and the components, against brute force."""
    r = random.Random(8)
    fps = {0, 1, 7, 15, (1 << 64) - 1}
    for _ in range(25):
        at = r.getrandbits(64)
        for _ in range(6):
            fps.add(at)
            for _ in range(r.randint(1, 4)):
                at ^= 1 << r.randint(0, 63)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    bits = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bits(a, b) <= 3}
    found = simhash.links(nodes)
    listed = [(x.a, x.b) for x in found.collect()]
    assert set(listed) == want and len(listed) == len(want)
    root = {f: f for f in signed}
    for _ in signed:
        changed = False
        for a, b in want:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not changed:
            break
    roots = {f: root[f] for ab in want for f in ab}
    assert {x.node: x.root for x in simhash.components(found).collect()} == roots
    few = simhash.spanning_links(nodes.withColumn("n", F.abs(F.hash("fp")) % 5), heavy=1)
    assert {x.node: x.root for x in simhash.components(few).collect()} == roots
    ball = [1 << i | 1 << j for i in range(32) for j in range(32)]
    few = simhash.spanning_links(spark.createDataFrame([(0, 9)] + [(f, 1) for f in set(ball)], "fp long, n int"), heavy=1).distinct()
    assert few.count() < 3 * len(set(ball)) and simhash.components(few).select("root").distinct().count() == 1


def test_near_duplicates(docs):
    got = simhash.near_duplicates(docs).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, set()).add(x.component_id)
    assert by[43] == {1} and by[0] == {0} and by[40] == by[41] == by[42] == {40} and by[None] == {None}
    assert {x.fingerprint for x in got if x.doc_id == 40} == {"0" * 16}


def test_mix_meets_targets(docs):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.size, x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    for s in {x.source for x in got}:
        own = [x for x in got if x.source == s]
        assert sum(x.size for x in own) == own[0].source_size and abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own)


def test_copies_meet_the_target_unequally(spark):
    """Expected words are the target; longer documents are worth more copies, none more than two."""
    classes = [("a", q, 1000 * q, sum(1000 * k for k in range(1, 9)), 20_000.0) for q in range(1, 9)] + [("b", 3, 50, 50, 100.0), ("c", 0, 0, 0, 0.0), ("d", 5, 70, 90, 30.0), ("d", 2, 20, 90, 30.0)]
    got = mixing.copies(spark.createDataFrame(classes, "skey string, q long, s long, source_size long, target double")).collect()
    words = {(c[0], c[1]): c[2] for c in classes}
    for name, target in (("a", 20_000), ("b", 100), ("d", 30)):
        own = {r.q: r.whole + r.pi for r in got if r.skey == name}
        assert abs(sum(c * words[name, q] for q, c in own.items()) - target) < 1e-6 and max(own.values()) <= 2
        assert [own[q] for q in sorted(own)] == sorted(own.values())
    assert len({r.pi for r in got if r.skey == "a"}) > 4


def test_inclusion_follows_the_odds(spark):
    """Over many seeds each document is taken as often as its inclusion probability says, and another rank would not do it."""
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(["w"] * r.choice([3, 10, 40, 100, 300])), "s") for i in range(1000)], "doc_id long, text string, source string")
    seeds = 10
    taken, size = {}, {}
    for seed in range(seeds):
        for x in mixing.mix(docs, share=0.6, weights=(1.0,), seed=seed, buckets=8).collect():
            size[x.doc_id] = x.size
            taken.setdefault(x.size, []).append(x.copies)
    total = sum(size.values())
    bits = {s: s.bit_length() for s in taken}
    rate = 0.6 * total / sum(s * bits[s] for s in size.values())
    for s, seen in taken.items():
        want = min(2.0, rate * bits[s])
        assert abs(sum(seen) / len(seen) - want) < 5 * math.sqrt(0.25 / len(seen)) + 0.02, (s, want, sum(seen) / len(seen))
    share = {s: sum(x) / len(x) for s, x in taken.items()}
    assert share[300] > 1.5 * share[3] > 0


def test_rows_of_one_id_are_spread(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"word{i} " * 20, "s") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix(docs, share=0.5, weights=(1.0,)).collect()
    assert 190 <= sum(x.copies for x in got) <= 210
    same = spark.createDataFrame([(7, "a b c", "s")] * 100, "doc_id long, text string, source string")
    assert sum(x.copies for x in mixing.mix(same, share=0.5, weights=(1.0,)).collect()) == 50


def test_mix_carries_any_columns(docs):
    got = mixing.mix(docs, carry=True).collect()
    assert len(got) == docs.count() and set(got[0].row.asDict()) == set(docs.columns) and {x.row.u for x in got} == {"u"}


def test_targets_fill_like_water(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50), ("e", 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(df).collect()}
    assert t["a"] == 20 and t["e"] == 0 and abs(sum(t.values()) - 1.5 * 1160) < 1e-3 and t["c"] <= 200 and t[None] <= 100
    even = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(even).collect()} == {"a": 200, "b": 83.333333, "c": 166.666667}


def test_licenses(spark):
    cases = {
        "The MIT License, the mit\nlicense": (2, "mit", "mit", 1.0),
        "Licensed under CC BY-NC 4.0.": (0, "", "cc-by-nc", 1.0),
        "GNU GENERAL PUBLIC LICENSE": (1, "gpl", "gpl", 1.0),
        "under the Apache-License; version 2.0": (1, "apache", "apache", 1.0),
        "this work is licensed under the gnu general public, version 3": (0, "", "gpl", 11 / 12),
        "mit license\u00e9": (0, "", "", 0.0),
        "mit licen\u017fe": (0, "", "", 0.0),
        "a license mit": (0, "", "", 0.0),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id int, text string")
    got = {r.doc_id: (r.n_base, r.base_labels, r.labels, r.score) for r in license_scan.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_blocks_are_windows(spark):
    """Wrapped templates are found, words strewn over a sentence or a page are not; against every window."""
    grant = license_scan.TEMPLATES["mit-grant"].split()
    bsd = license_scan.TEMPLATES["bsd"].split()
    r = random.Random(4)
    strewn = " ".join(f"{w} " + " ".join(f"x{r.randint(0, 99)}" for _ in range(3)) for w in grant)
    texts = [
        "Foo.\n" + "\n".join(" ".join(grant[i : i + 6]) for i in range(0, len(grant), 6)) + "\nBar",
        "the museum released a film and mit students under contract got a license for it",
        "the apache helicopter of version 2 0 was licensed under the the the army license",
        strewn,
        "\n".join(bsd[:9] + ["other"] + bsd[9:]),
        " ".join(bsd[1:10] + bsd[11:]),
        "license " * 5000 + "licensed under cc by sa 4 0",
        "",
        *(" ".join(r.choice(sorted(set(grant + bsd))) for _ in range(200)) for _ in range(20)),
        *(" ".join(r.sample(grant, len(grant)) + bsd) for _ in range(5)),
    ]
    want = []
    for t in texts:
        words = t.lower().split()
        found = {}
        for label, template in license_scan.TEMPLATES.items():
            own, most = set(template.split()), math.floor(len(template.split()) / license_scan.THRESHOLD + 1e-9)
            best = max((len(own & set(words[i : i + most])) for i in range(len(words))), default=0)
            if best >= math.ceil(license_scan.THRESHOLD * len(own) - 1e-9):
                found[label] = best / len(own)
        want.append((",".join(sorted(found)), max(found.values(), default=0.0)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {x.doc_id: (x.labels, x.score) for x in license_scan.scan_licenses(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert [got[i][0] for i in range(7)] == ["mit-grant", "", "", "", "bsd", "bsd" if want[5][0] else "", "cc-by-sa"]


def test_domains(spark):
    cases = {
        "news.bbc.co.uk": ("bbc.co.uk", "co.uk"),
        "shop.co.uk": ("shop.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "a.b.example.com": ("example.com", "com"),
        "u@x.example.org:80": ("example.org", "org"),
        "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"),
        "[::1]": ("[::1]", "[::1]"),
        "a.b.c.ck": ("b.c.ck", "c.ck"),
        "x.www.ck": ("www.ck", "ck"),
        "me.github.io": ("me.github.io", "github.io"),
        "b.s3.amazonaws.com": ("b.s3.amazonaws.com", "s3.amazonaws.com"),
        "localhost": ("localhost", "localhost"),
        "example.com.": ("example.com", "com"),
        "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    got = {r.h: (r.d, r.s) for r in df.select("h", url_filter.domain_of(F.col("h")).alias("d"), url_filter.suffix_of(F.col("h")).alias("s")).collect()}
    assert got == cases


def test_beta_quantile(spark):
    """Against the law's sum over a fine grid, and a sample."""
    pairs = [(1.0, 1.0), (0.1, 0.9), (0.02, 3.0), (2.5, 7.0), (40.0, 60.0), (900.0, 100.0), (5.0, 0.2), (3000.0, 9000.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    got = {(r.a, r.b): (r.low, r.mid) for r in df.select("a", "b", url_filter.beta_quantile(F.col("a"), F.col("b"), 0.05).alias("low"), url_filter.beta_quantile(F.col("a"), F.col("b"), 0.5).alias("mid")).collect()}
    rng = np.random.default_rng(1)
    for a, b in pairs:
        draws = rng.beta(a, b, 400_000)
        for p, x in zip((0.05, 0.5), got[a, b]):
            assert abs((draws < x).mean() - p) < 0.006, (a, b, p, x)
    assert abs(got[1.0, 1.0][0] - 0.05) < 1e-3


@pytest.mark.parametrize("name", sorted(oracle.sql()))
def test_against_sql(spark, sf_dir, name, docs, tmp_path):
    from tests.test_catalogue import compare

    assert compare(queries.QUERIES[name](spark, sf_dir), oracle.sql()[name], sf_dir)
    if name == "op9_url_filter":
        return
    docs.coalesce(1).write.parquet(str(tmp_path / "x"))
    con = duckdb.connect()
    con.sql(f"copy (select doc_id, text, lang, source, n_chars from '{tmp_path}/x/*.parquet') to '{tmp_path}/documents.parquet'")
    compare(queries.QUERIES[name](spark, str(tmp_path)), oracle.sql()[name], str(tmp_path))


def test_learned_scores(spark, sf_dir):
    """Held-out accuracy on the driver's rows."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    q = queries.op7_quality_classifier(spark, sf_dir).join(lab, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in q) >= 0.97 * len(q)
    t = queries.op8_toxicity(spark, sf_dir).join(lab, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in t) >= 0.93 * len(t) and all(0 <= r.score <= 1 for r in t)


def test_leak_shards_agree(spark, sf_dir):
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    once = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()}
    many = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b, shard=15).collect()}
    whole = {i.item_id: " ".join(w.decode() for w in toxicity.words_of(i.text)) for i in b.collect()}
    truth = {(x.doc_id, i) for x in d.collect() for i, w in whole.items() if f" {w} " in " " + " ".join(w.decode() for w in toxicity.words_of(x.text)) + " "}
    assert truth <= once and truth <= many and len(once) <= len(truth) + 2
    assert decontaminate.drop_leaks(d, b).count() == d.count() - len({i for i, _ in once})
    assert decontaminate.find_leaks(d, b.where("false")).count() == 0


def test_pipeline(spark, sf_dir):
    """Each stage against what its operator says of the stage's own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir).cache()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        if name == "quality rules":
            kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        if name == "simhash near-dedup":
            groups = simhash.near_duplicates(docs).collect()
            assert sorted(r.doc_id for r in out.collect()) == sorted({r.component_id for r in groups})
        docs = out
    assert "taken" in docs.columns
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


def test_pipeline_on_awkward_rows(spark, docs, tmp_path):
    for t, shape in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], shape).write.parquet(str(tmp_path / f"{t}.parquet"))
    for d in (docs, docs.where("false")):
        at = d
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            at = stage(spark, at, str(tmp_path)) if i else at
        at.collect()
    seen = corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)).collect()
    assert len([r for r in seen if r.doc_id == 0]) == 1 and not [r for r in seen if r.doc_id in (41, 42, 43)] and [r for r in seen if r.doc_id is None]
