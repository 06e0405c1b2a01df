"""URL filters: path rules, then empirical-Bayes host reputation.

A page's host comes with labelled outcomes (bad or not). Rates are shrunk through
beta-binomial priors down the name: the suffix towards the rate of all labelled pages, the
registered domain towards its suffix, the host towards its domain. The prior strength of each
level is fitted by moments: the spread of the level's rates beyond what binomial
noise explains gives the correlation rho, and the strength is (1 - rho) / rho. A page is blocked
where the lower posterior bound of its host's bad rate, a quantile of the beta law, is over the limit; hosts never seen get
their domain's, suffix's or the overall posterior.

Suffixes are those under which anyone can register (``SUFFIXES``, a parameter; the last label where none fits), the registered domain is the
suffix with one label more, and an address of numbers is its own domain and suffix.

Outcomes are counted by host before anything is joined; a hot host is then a single row. Pages meet the hosts' bounds by
broadcast up to a counted size; beyond it by hash, where the engine's skew handling splits a hot host's pages.

Edge cases: a null url, or one without '://', has an empty host and path and is judged by
the overall rate; ports and user names stay part of the host as given, but not of its domain; very long urls are read whole; of rules of equal
length the first by code point counts; no labels at all
means that nothing but rules can block; equal rows give equal rows; columns other than the id and the url may have any names and are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_ids, let, settle

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Block where the bad rate is over LIMIT with certainty CERTAIN.
LIMIT = 0.35
CERTAIN = 0.95
#: Steps in which a posterior is summed over the log odds of the rate, and how far to both sides: in standard deviations, and beside that in units of the tail's decay.
GRID = 512
WIDE, TAIL = 10.0, 25.0
#: Suffixes of more than one label under which names are registered; '*' is any label, '!' an exception to that.
SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk net.uk me.uk ltd.uk plc.uk sch.uk nhs.uk com.au net.au org.au edu.au gov.au id.au co.nz net.nz org.nz ac.nz govt.nz "
    "co.jp ne.jp or.jp ac.jp go.jp co.kr or.kr ac.kr go.kr com.cn net.cn org.cn gov.cn edu.cn com.tw org.tw com.hk org.hk com.sg com.my co.in net.in org.in ac.in gov.in "
    "co.id co.th in.th ac.th com.vn com.ph com.br net.br org.br gov.br com.ar com.mx org.mx com.co com.pe com.ve com.ec com.uy com.tr org.tr gov.tr com.ua com.pl net.pl org.pl "
    "co.il org.il ac.il co.za org.za ac.za co.ke co.ng com.ng com.eg com.sa com.pk com.gr com.pt com.es com.ru co.at or.at co.hu "
    "github.io gitlab.io blogspot.com wordpress.com herokuapp.com netlify.app vercel.app pages.dev web.app s3.amazonaws.com "
    "*.ck !www.ck *.bd *.np *.kh *.mm *.er *.fk"
).split()
#: Strengths that a fit may give, and the one where it has too little to go by.
STRENGTH = (1.0, 1000.0)

_PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does. Of equally long ones the first by code point."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(level: DataFrame) -> Column:
    """The level's prior strength from its (n, bad), as a scalar subquery."""
    t = level.agg(
        F.sum("n").cast("double").alias("n"),
        F.sum("bad").cast("double").alias("bad"),
        F.count("*").cast("double").alias("k"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("s"),
    )
    p = F.try_divide("bad", "n")
    noise = p * (1 - p)
    spread = F.try_divide(F.col("s") - F.col("n") * p * p - (F.col("k") - 1) * noise, F.col("n") - F.try_divide("nn", "n"))
    rho = F.try_divide(spread, noise)
    fitted = F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), F.try_divide(1 - rho, rho)))
    return t.select(F.when(rho > 0, fitted).otherwise(F.lit(STRENGTH[1]))).scalar()


def reputations(labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From (host, bad) rows the posteriors (name, a, b) of hosts, domains and suffixes, and the overall (a, b)."""
    hosts = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    total = lambda df, key: df.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = total(hosts, ["domain", "suffix"])
    suffixes = total(domains, ["suffix"])
    overall = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0).alias("a"), (F.coalesce(F.sum("n") - F.sum("bad"), F.lit(0)) + 1.0).alias("b"))

    def shrink(level: DataFrame, prior: DataFrame, key: list[str]) -> DataFrame:
        mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")
        joined = level.join(prior.select(*key, mean), key) if key else level.withColumn("mean", prior.select(mean).scalar())
        joined = joined.withColumn("strength", _strength(level))
        a = F.col("mean") * F.col("strength") + F.col("bad")
        return joined.withColumn("a", a).withColumn("b", (1 - F.col("mean")) * F.col("strength") + F.col("n") - F.col("bad")).drop("mean", "strength", "n", "bad")

    s = shrink(suffixes, overall, [])
    d = shrink(domains, s, ["suffix"])
    h = shrink(hosts, d, ["domain", "suffix"])
    return h.select("host", "a", "b"), d.select("domain", "a", "b"), s.select("suffix", "a", "b"), overall


def _bare(host: Column) -> Column:
    """The host without user name, port and final dots."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":[0-9]*$", ""), F.lit("."))


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.startswith("[")


def _suffix_labels(bare: Column, suffixes: Sequence[str]) -> Column:
    """Of how many labels the host's suffix is."""
    last = lambda n: F.substring_index(bare, ".", -n)
    exact = lambda n: [x for x in suffixes if x.count(".") == n - 1 and x[0] not in "*!"]
    wild, but = [x[2:] for x in suffixes if x.startswith("*.")], [x[1:] for x in suffixes if x.startswith("!")]
    two = last(2).isin(exact(2)) | (last(1).isin(wild) & F.contains(bare, F.lit(".")))
    return F.when(last(3).isin(exact(3)), 3).when(last(2).isin(but), 1).when(two, 2).otherwise(1)


def _last_labels(bare: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(bare, r"\."), -F.least(n, F.size(F.split(bare, r"\."))), 9), ".")


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix and one label before it, if there is one."""
    bare = _bare(host)
    return F.when(_is_address(bare), bare).otherwise(_last_labels(bare, _suffix_labels(bare, suffixes) + 1))


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    bare = _bare(host)
    return F.when(_is_address(bare), bare).otherwise(_last_labels(bare, _suffix_labels(bare, suffixes)))


def beta_quantile(a: Column, b: Column, p: float) -> Column:
    """Below which rate the share ``p`` of a beta law lies. Over the log odds z of the rate the density is
    smooth for all a and b; it is summed by trapezoids, and the step in which the sum passes ``p`` is divided in proportion."""
    sd = F.sqrt(1 / a + 1 / b)
    low = F.log(a / b) - (WIDE * sd + TAIL / a)
    step = (F.log(a / b) + (WIDE * sd + TAIL / b) - low) / GRID
    top = a * F.log(a / (a + b)) + b * F.log(b / (a + b))

    def density(s: Column, k: Column) -> Column:
        z = s["low"] + k * s["step"]
        return F.exp(-s["a"] * F.log(1 + F.exp(-z)) - s["b"] * F.log(1 + F.exp(z)) - s["top"])

    def crossing(f: Column, s: Column, target: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("c"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("at"))

        def move(acc: Column, x: Column) -> Column:
            c = acc["sum"] + x / 2
            here = acc["k"] - 1 + (target - acc["c"]) / (c - acc["c"])
            passed = acc["at"].isNull() & (c >= target) & (acc["c"] < target)
            return F.struct((acc["sum"] + x).alias("sum"), c.alias("c"), (acc["k"] + 1).alias("k"), F.when(passed, here).otherwise(acc["at"]).alias("at"))

        at = F.aggregate(f, start, move, lambda acc: acc["at"])
        return 1 / (1 + F.exp(-(s["low"] + s["step"] * at)))

    scale = F.struct(low.alias("low"), step.alias("step"), top.alias("top"), a.alias("a"), b.alias("b"))
    return let(scale, lambda s: let(F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda k: density(s, k)), lambda f: let(p * F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x), lambda target: crossing(f, s, target))))


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    limit: float = LIMIT,
    certain: float = CERTAIN,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound) of every page; ``outcomes`` has (page_id, bad)."""
    url = F.col(url_col)
    p = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.withColumn("fit", match_rule(F.col("host"), F.col("path"), rules))
    known = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts, domains, suffixes, overall = reputations(p.where("host <> ''").join(known, "page_id").select("host", "bad"))
    # One row for each distinct host carries the posterior; pages meet only that row.
    names = p.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    pick = lambda df, key: df.select(key, F.struct("a", "b").alias(f"{key}_p"))
    names = names.join(pick(hosts, "host"), "host", "left").join(pick(domains, "domain"), "domain", "left").join(pick(suffixes, "suffix"), "suffix", "left")
    names = names.withColumn("all_p", overall.select(F.struct("a", "b")).scalar())
    best = F.coalesce("host_p", "domain_p", "suffix_p", "all_p")
    # Many hosts share a posterior; each is summed once.
    names = settle(names.select("host", best["a"].alias("a"), best["b"].alias("b")))
    laws = settle(names.select("a", "b").distinct().withColumn("bad_bound", F.round(beta_quantile(F.col("a"), F.col("b"), 1 - certain), 6)))
    names = names.join(laws, ["a", "b"]).select("host", "bad_bound")
    out = join_ids(p, names, "host")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "bad_bound")
