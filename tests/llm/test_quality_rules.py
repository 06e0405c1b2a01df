"""The robust outlier rule against the same search in NumPy, over whole tables."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import quality_rules as Q
from tests.llm.test_llm_spark import brute_counts

WORDS = [w for w in "alpha be gamma delta ep zeta eta theta iota kappa la mu nu omicron pi rho".split()]


def statistics(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    chars, n = max(1, sum(map(len, words))), max(1, len(words))
    marks = sum(33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 for c in t)
    lines = sum(1 for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    raw = [math.log(chars / n), math.log1p(100 * marks / chars), math.log(len(set(words))) / math.log(n) if len(words) > 1 else 1.0, math.log(n / max(1, lines))]
    return [math.floor(abs(p * x) + 0.5) * (1 if x >= 0 else -1) for x, p in zip(raw, Q.STATS.values())]


def low_median(x):
    return np.sort(x, axis=0)[(len(x) + 1) // 2 - 1].astype(float)


def step(x, m, c):
    d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + np.eye(4) * Q._ROUNDING), x - m)
    bins = np.floor(Q.BINS * np.log2(1 + d2)).astype(int)
    cut = next(b for b in np.unique(bins) if (bins <= b).sum() >= Q.COVER * len(x))
    near = x[bins <= cut]
    return near.mean(axis=0), np.cov(near.T, bias=True).reshape(4, 4) if len(near) > 1 else np.zeros((4, 4))


def logdet(c):
    return np.linalg.slogdet(c + np.eye(4) * Q._ROUNDING)[1]


def mcd(x):
    m = low_median(x)
    a = np.maximum(1.4826 * low_median(np.abs(x - m)), 1.0)
    z = (x - m) / a
    fine = lambda v: np.round(Q._FINE * v) / Q._FINE
    t = fine(np.tanh(z))
    far = np.sqrt((z * z).sum(axis=1, keepdims=True))
    u = fine(np.divide(z, far, out=np.zeros_like(z), where=far > 0))
    ct = np.cov(t.T, bias=True) * Q._FINE**2
    v = np.sqrt(np.maximum(np.diag(ct), 1.0))
    r = ct / np.outer(v, v)
    np.fill_diagonal(r, 1.0)
    starts = [(m, np.diag(a * a)), (m, r * np.outer(a, a)), (m, np.outer(a, a) * 4 * (u.T @ u) / len(x)), (x.mean(axis=0), np.cov(x.T, bias=True).reshape(4, 4))]
    best = None
    for s, (m, c) in enumerate(starts):
        last = math.inf
        while True:
            m, c = step(x, m, c)
            if best is None or logdet(c) < best[0] - 1e-12:
                best = (logdet(c), m, c)
            if logdet(c) >= last - Q.FALL:
                break
            last = logdet(c)
    return best


def brute(rows, diagonal=False):
    """(id -> distance, kept) of (id, text, lang, source) rows."""
    usable = {r: not brute_counts(r[1])[5] for r in rows}
    group = lambda r: r[2:]
    found = {}
    for g in {group(r) for r in rows if usable[r]} | {"all"}:
        x = np.unique(np.array([statistics(r[1]) for r in rows if usable[r] and g in ("all", group(r))], float), axis=0)
        found[g] = (len(x), *mcd(x)[1:])
    _, mw, cw = found["all"]
    out = {}
    for r in rows:
        if group(r) in found:
            n, m, c = found[group(r)]
            share = Q.SHRINK + (1 - Q.SHRINK) * Q.PRIOR / (n + Q.PRIOR)
            m = (n * m + Q.CENTRE * mw) / (n + Q.CENTRE)
            c = Q.consistency() * ((1 - share) * c + share * cw)
            c = np.diag(np.diag(c)) if diagonal else c
            x = np.array(statistics(r[1]), float)
            d2 = float((x - m) @ np.linalg.inv(c + np.eye(4) * Q._ROUNDING) @ (x - m))
            out[r[0]] = (math.sqrt(d2), usable[r] and d2 <= Q.t_quantile(Q.KEEP))
        else:
            out[r[0]] = (None, False)
    return out


def corpus():
    """Five groups of 120, 60, 9, 1 and 40 rows, the last all copies but four; junk of symbols, of long words and of repeats in each."""
    r = random.Random(6)

    def prose(n, long_lines=False):
        # Texts of longer words have fewer marks, so that two statistics go together.
        rich = r.random()
        words = [r.choice(WORDS) * r.choice([1, 1 + (rich > 0.5)]) + str(r.randint(0, 60)) + ("" if r.random() < 0.1 + 0.5 * rich else ",") for _ in range(n)]
        return " ".join(w + ("\n" if r.random() < 0.08 else "") for w in words)

    rows = []
    for g, size in ((("en", "a"), 120), (("de", None), 60), ((None, "b"), 9), (("fr", "c"), 1)):
        rows += [(len(rows) + i, prose(r.randint(25, 160)), *g) for i in range(size)]
    copy = prose(90)
    rows += [(len(rows) + i, prose(60 + i) if i < 4 else copy, "es", "d") for i in range(40)]
    for g in (("en", "a"), ("de", None), ("es", "d")):
        rows.append((len(rows), " ".join(w + "###$$$" for w in prose(50).split()), *g))
        rows.append((len(rows), " ".join(w * 9 for w in prose(50).split()), *g))
        rows.append((len(rows), "\n".join(r.choice(["same line here", "one more of it"]) + f" {i % 4}" for i in range(60)), *g))
    # Long words and many marks at once: each usual alone, not together.
    rows += [(len(rows) + i, " ".join(r.choice(WORDS) * 2 + str(r.randint(0, 60)) + "," for _ in range(150)).replace("7,", "7,\n"), "en", "a") for i in range(4)]
    rows += [(len(rows), None, "en", "a"), (len(rows) + 1, "", "xx", "none"), (len(rows) + 2, " \n", None, None), (len(rows) + 3, prose(30_000), "de", None)]
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit(1) for c in ("g", "s", "x0", "n", "row", "m0")})
    return rows, docs, Q.judge(docs, carry=True).collect()


def test_judge_equals_brute_force(judged):
    rows, docs, got = judged
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        distance, kept = want[r.doc_id]
        assert r.kept == kept and (r.distance is None) == (distance is None)
        assert distance is None or abs(r.distance - distance) < 1e-4 * (1 + distance)
        assert r.row.asDict().keys() == set(docs.columns) and r.row.doc_id == r.doc_id


def test_junk_goes_and_prose_stays(judged):
    rows, _, got = judged
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in (*range(230, 236), 237, 238))  # 236 has too few different texts beside it
    assert sum(kept[i] for i in range(230)) >= 228  # also the few texts beside a group's copies


def test_the_covariance_decides(judged):
    rows, _, _ = judged
    full, alone = brute(rows), brute(rows, diagonal=True)
    assert any(full[i][1] != alone[i][1] for i in full)
    assert any(not full[i][1] and alone[i][1] for i in range(239, 243))


def test_judging_does_not_depend_on_dealing(judged):
    rows, docs, got = judged
    again = Q.judge(docs.repartition(7, "text")).collect()
    key = lambda r: (r.doc_id, r.kept, r.distance)
    assert sorted(map(key, got), key=str) == sorted(map(key, again), key=str)


def test_laws():
    assert abs(Q.chi2_below(Q.chi2_quantile(0.9)) - 0.9) < 1e-9
    sample = np.random.default_rng(1).standard_normal((200_000, 4))
    t = (sample**2).sum(axis=1) / (np.random.default_rng(2).chisquare(Q.FREEDOM, 200_000) / Q.FREEDOM)
    assert abs((t <= Q.t_quantile(0.99)).mean() - 0.99) < 1e-3
