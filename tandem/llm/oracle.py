"""DuckDB SQL for the queries that SQL expresses; written against the contracts, not the operators' code paths."""

from __future__ import annotations

import math

from . import license_scan, mixing, url_filter

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_quote = lambda s: "'" + s.replace("'", "''") + "'"


def license_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
    places = []
    for phrase, label in license_scan.BASE.items():
        parts = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = {_quote(p)}" for k, p in enumerate(parts))
        places.append(f"SELECT r, {_quote(label)} AS label, i FROM words, unnest(range(len(w) - {len(parts) - 1})) AS t(i) WHERE {same}")
    most = {k: math.floor(len(v.split()) / license_scan.THRESHOLD + 1e-9) for k, v in license_scan.TEMPLATES.items()}
    shapes = ", ".join(f"({_quote(k)}, {sorted(set(v.split()))!r}, {most[k]})" for k, v in license_scan.TEMPLATES.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS t FROM documents),
words AS (SELECT r, doc_id, regexp_extract_all(t, '{word}') AS w FROM docs),
base AS ({" UNION ALL ".join(places)}),
base_sum AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base GROUP BY r),
templates(label, own, most) AS (VALUES {shapes}),
blocks AS (SELECT r, label, own, len(list_intersect(own, w[i + 1:i + most])) AS n FROM words, templates, unnest(range(len(w))) AS t(i)),
hits AS (SELECT r, label, n, len(own) AS k FROM blocks WHERE n >= ceil({license_scan.THRESHOLD} * len(own) - 1e-9)),
hit_sum AS (SELECT r, max(n / k) AS best FROM hits GROUP BY r),
base_names AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM base GROUP BY r),
all_names AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_names.names, '') AS base_labels, coalesce(all_names.names, '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM words LEFT JOIN base_sum USING (r) LEFT JOIN hit_sum USING (r) LEFT JOIN base_names USING (r) LEFT JOIN all_names USING (r)"""


def mixing_sql() -> str:
    weights = ", ".join(str(w) for w in mixing.WEIGHTS)
    most, tiny = mixing.MAX_COPIES, mixing.TINY
    return rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) || '|{mixing.SEED}'), 1, 12)) AS BIGINT) AS u
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w,
    CAST({most} * source_size AS DOUBLE) AS cap, {mixing.SHARE} * sum(source_size) OVER () AS budget FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM weighed
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, cap / w) AS water FROM levels WHERE cap / w >= level),
plan AS (SELECT source, source_size, round(CASE WHEN water IS NULL OR w * water > cap THEN cap ELSE w * water END, 6) AS target FROM levels, water),
sized AS (SELECT *, CASE WHEN size > 0 THEN len(bin(size)) ELSE 0 END AS q FROM docs),
classes AS (SELECT source, q, sum(size) AS s FROM sized GROUP BY source, q),
rates AS (
  SELECT classes.source, q, s, source_size, target,
    (target - {most} * coalesce(sum(s) OVER (PARTITION BY classes.source ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / nullif(CAST(sum(s * q) OVER (PARTITION BY classes.source ORDER BY q) AS DOUBLE), 0) AS rate
  FROM classes JOIN plan ON classes.source IS NOT DISTINCT FROM plan.source),
best AS (SELECT source, arg_max(rate, q) AS rate FROM rates WHERE rate * q <= {most} GROUP BY source),
expected AS (
  SELECT rates.source, q, s, source_size, target, greatest(0.0, least({most}.0, coalesce(best.rate * q, {most}.0))) AS c
  FROM rates LEFT JOIN best ON rates.source IS NOT DISTINCT FROM best.source),
split AS (SELECT *, CAST(floor(c + {tiny}) AS BIGINT) AS whole, CASE WHEN c - floor(c + {tiny}) > {tiny} THEN c - floor(c + {tiny}) ELSE 0 END AS pi FROM expected),
needs AS (SELECT *, target - sum(s * whole) OVER (PARTITION BY source) AS need FROM split),
ranked AS (
  SELECT sized.doc_id, sized.source, size, source_size, target, whole, need, pi > 0 AND size > 0 AS open,
    CASE WHEN pi > 0 AND size > 0 THEN (((u + 0.5) / 281474976710656.0) / (1 - (u + 0.5) / 281474976710656.0)) / (pi / (1 - pi)) END AS rank
  FROM sized JOIN needs ON sized.source IS NOT DISTINCT FROM needs.source AND sized.q = needs.q),
summed AS (SELECT *, sum(CASE WHEN open THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS got FROM ranked)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (whole + CASE WHEN open AND need > 0 AND got < need AND got + size / 2.0 <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM summed"""


def url_sql() -> str:
    host = rf"translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{_UP}', '{_LOW}')"
    rules = ", ".join(f"({_quote(h)}, {_quote(p)}, {_quote(v)})" for h, p, v in url_filter.RULES)
    low, high = url_filter.STRENGTH
    bare = "rtrim(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '.')"
    last = lambda n: f"array_to_string(string_split({bare}, '.')[-{n}:], '.')"
    listed = lambda names: ", ".join(map(_quote, sorted(names)))
    exact = {n: [x for x in url_filter.SUFFIXES if x.count(".") == n - 1 and x[0] not in "*!"] for n in (2, 3)}
    wild, but = [x[2:] for x in url_filter.SUFFIXES if x.startswith("*.")], [x[1:] for x in url_filter.SUFFIXES if x.startswith("!")]
    address = f"(regexp_full_match({bare}, '[0-9]+(\\.[0-9]+){{3}}') OR starts_with({bare}, '['))"
    kind = f"""CASE WHEN {last(3)} IN ({listed(exact[3])}) THEN 3 WHEN {last(2)} IN ({listed(but)}) THEN 1
  WHEN {last(2)} IN ({listed(exact[2])}) OR ({last(1)} IN ({listed(wild)}) AND len(string_split({bare}, '.')) > 1) THEN 2 ELSE 1 END"""
    suffix = f"CASE WHEN {address} THEN {bare} ELSE array_to_string(string_split({bare}, '.')[-({kind}):], '.') END"
    domain = f"CASE WHEN {address} THEN {bare} ELSE array_to_string(string_split({bare}, '.')[-(1 + {kind}):], '.') END"
    steps = url_filter.GRID

    def strength(name: str, level: str) -> str:
        return f"""{name}_t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, count(*) AS k, sum(CAST(n AS DOUBLE) * n) AS nn, sum(CAST(bad AS DOUBLE) * bad / n) AS s FROM {level}),
{name}_r AS (SELECT ((s - n * (bad / n) * (bad / n) - (k - 1) * ((bad / n) * (1 - bad / n))) / nullif(n - nn / n, 0)) / nullif((bad / n) * (1 - bad / n), 0) AS rho FROM {name}_t),
{name} AS (SELECT CASE WHEN rho > 0 THEN greatest({low}, least({high}, (1 - rho) / rho)) ELSE {high} END AS strength FROM {name}_r)"""

    def post(columns: str, level: str, prior: str, on: str, fit: str) -> str:
        return f"SELECT {columns}, m * strength + bad AS a, (1 - m) * strength + n - bad AS b FROM {level} JOIN (SELECT *, a / (a + b) AS m FROM {prior}) AS prior {on} CROSS JOIN {fit}"

    return f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, {host} AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(h, start, verdict) AS (VALUES {rules}),
fits AS (SELECT r, h || start AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY len(h || start) DESC, h || start) AS nth
  FROM p, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start)),
outcome AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, {domain} AS domain, {suffix} AS suffix, count(*) AS n, sum(bad) AS bad
  FROM p JOIN outcome USING (page_id) WHERE host <> '' GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
overall AS (SELECT coalesce(sum(bad), 0) + 1.0 AS a, coalesce(sum(n) - sum(bad), 0) + 1.0 AS b FROM suffixes),
{strength("s_fit", "suffixes")}, {strength("d_fit", "domains")}, {strength("h_fit", "hosts")},
s_post AS ({post("suffix", "suffixes", "overall", "ON true", "s_fit")}),
d_post AS ({post("domain, suffix", "domains", "s_post", "USING (suffix)", "d_fit")}),
h_post AS ({post("host", "hosts", "d_post", "USING (domain, suffix)", "h_fit")}),
named AS (SELECT host, {domain} AS domain, {suffix} AS suffix FROM (SELECT DISTINCT host FROM p)),
best AS (SELECT named.host, coalesce(h_post.a, d_post.a, s_post.a, overall.a) AS a, coalesce(h_post.b, d_post.b, s_post.b, overall.b) AS b
  FROM named LEFT JOIN h_post ON named.host = h_post.host LEFT JOIN d_post ON named.domain = d_post.domain LEFT JOIN s_post ON named.suffix = s_post.suffix CROSS JOIN overall),
span AS (SELECT host, a, b, ln(a / b) AS mid, sqrt(1 / a + 1 / b) AS sd FROM best),
ends AS (SELECT *, mid - ({url_filter.WIDE} * sd + {url_filter.TAIL} / a) AS zl, mid + ({url_filter.WIDE} * sd + {url_filter.TAIL} / b) AS zr FROM span),
grid AS (SELECT host, a, b, zl, (zr - zl) / {steps} AS h, zl + k * ((zr - zl) / {steps}) AS z, k, a * ln(a / (a + b)) + b * ln(b / (a + b)) AS top FROM ends, range({steps + 1}) AS t(k)),
dense AS (SELECT host, zl, h, k, exp(-a * ln(1 + exp(-z)) - b * ln(1 + exp(z)) - top) AS f FROM grid),
cumulated AS (SELECT *, sum(f) OVER (PARTITION BY host) AS total, sum(f) OVER (PARTITION BY host ORDER BY k ROWS UNBOUNDED PRECEDING) - f / 2 AS c FROM dense),
stepped AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY host ORDER BY k), 0) AS c0 FROM cumulated),
crossed AS (SELECT host, zl + h * (k - 1 + ({1 - url_filter.CERTAIN} * total - c0) / (c - c0)) AS z FROM stepped WHERE c >= {1 - url_filter.CERTAIN} * total AND c0 < {1 - url_filter.CERTAIN} * total),
bounds AS (SELECT host, round(1 / (1 + exp(-z)), 6) AS bad_bound FROM crossed)
SELECT p.page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN bad_bound > {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, CAST(bad_bound AS DOUBLE) AS bad_bound
FROM p JOIN bounds USING (host) LEFT JOIN (SELECT * FROM fits WHERE nth = 1) AS f USING (r)"""


def sql() -> dict[str, str]:
    return {"op2_license_scan": license_sql(), "op3_mixing": mixing_sql(), "op9_url_filter": url_sql()}
