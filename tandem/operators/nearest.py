"""Which rows can be the most similar of their name (JN8): products of blocks in Arrow maps.

All pairs of a name are compared, which is quadratic by nature. They are cut into blocks of rows that meet under keys of their
own, so no task holds a name, and a block costs one matrix product. It leaves the pairs within rounding of a row's best score;
the caller scores those.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .state import ship

#: Rows of a block, and those of them that one product takes.
BLOCK, STRIP = 8192, 512


def units(column: pa.Array, at: dict[int, int], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, each from ``at`` its length on, so that those of different lengths have the product 0; all zero where the
    cosine is 0 by definition. Second, the rows that cannot be normed, or have a value that is no number."""
    sizes = np.array(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    flat = pc.list_flatten(column)
    row, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    x = np.zeros((len(sizes), width))
    x[row, np.arange(len(flat)) - start[row] + np.array([at[n] for n in sizes.tolist()], dtype=np.int64)[row]] = np.array(pc.fill_null(flat, 0), dtype=np.float64)
    gone = np.zeros(len(sizes), dtype=bool)
    gone[row[np.array(pc.is_null(flat), dtype=bool)]] = True
    with np.errstate(all="ignore"):
        square = (x * x).sum(axis=1)
        odd = ~gone & (x != 0).any(axis=1) & ~((square > 1e-200) & (square < 1e200))
        x[gone | odd] = 0
        return x / np.where(square > 1e-200, np.sqrt(square), 1.0)[:, None], odd


def file_codes(*columns: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column the numbers of its paths and of their base names, -1 for nulls; both rise together."""
    lists = [c.to_pylist() for c in columns]
    known = sorted({p for x in lists for p in x if p is not None}, key=lambda p: (p.rsplit("/", 1)[-1], p))
    path = {p: i for i, p in enumerate(known)}
    base = {p: b for b, p in enumerate(dict.fromkeys(p.rsplit("/", 1)[-1] for p in known))}
    of_path = np.array([base[p.rsplit("/", 1)[-1]] for p in known] + [-1], dtype=np.int64)  # the last for -1
    codes = [np.array([path.get(p, -1) for p in x], dtype=np.int64) for x in lists]
    return [(c, of_path[c]) for c in codes]


def add_where_equal(s: np.ndarray, rows: np.ndarray, columns: np.ndarray, bonus: float) -> None:
    """Both sorted, so equal ones are rectangles."""
    values, starts = np.unique(rows, return_index=True)
    low, high = np.searchsorted(columns, values, "left"), np.searchsorted(columns, values, "right")
    for v, i, j, k, m in zip(values, starts, [*starts[1:], len(rows)], low, high):
        if v >= 0 and m > k:
            s[i:j, k:m] += np.float32(bonus)


def best_pairs(left: pa.Table, right: pa.Table, least: float, same_path: float, same_base: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both tables (vector, path) of the pairs that may be the best of their left row and over ``least``."""
    (lv, lp), (rv, rp) = ([t.column(c).combine_chunks() for c in ("vector", "path")] for t in (left, right))
    at, width = {}, 0
    for n in sorted({n for v in (lv, rv) for n in pc.unique(pc.fill_null(pc.list_value_length(v), 0)).to_pylist()}):
        at[n], width = width, width + n
    (a, odd_a), (b, odd_b) = units(lv, at, width), units(rv, at, width)
    (pa_, ba), (pb, bb) = file_codes(lp, rp)
    by_a, by_b = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    a, b, pa_, ba, pb, bb = a[by_a], b[by_b], pa_[by_a], ba[by_a], pb[by_b], bb[by_b]
    a32, b32 = a.astype(np.float32), np.ascontiguousarray(b.T.astype(np.float32))
    slack = np.float32(2 * (width + 8) * 6e-8 + 1e-8)  # of single precision, of both scores
    found = []
    for i in range(0, len(a), STRIP):
        rows = slice(i, i + STRIP)
        s = a32[rows] @ b32
        add_where_equal(s, ba[rows], bb, same_base)
        add_where_equal(s, pa_[rows], pb, same_path - same_base)
        r, c = np.nonzero(s >= np.maximum(s.max(axis=1), np.float32(least))[:, None] - slack)
        # Those few once more in double precision: what stays differs from the best by rounding only.
        r += i
        bonus = np.where((pa_[r] == pb[c]) & (pa_[r] >= 0), same_path, np.where((ba[r] == bb[c]) & (ba[r] >= 0), same_base, 0.0))
        score = np.einsum("ij,ij->i", a[r], b[c]) + bonus
        top = np.full(len(a), -np.inf)
        np.maximum.at(top, r, score)
        stay = (score >= top[r] - 4e-9) & (score > least - 4e-9)
        found.append((by_a[r[stay]], by_b[c[stay]]))
    r, c = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    if odd_a.any() or odd_b.any():  # these are left with every row of the other side
        usual = ~(odd_a[r] | odd_b[c])
        x, y = np.nonzero(odd_a[:, None] | odd_b[None, :])
        r, c = np.concatenate([r[usual], x]), np.concatenate([c[usual], y])
    return r, c


def _meet(names: tuple[list[str], list[str]], schema: pa.Schema, settings: tuple[float, float, float], left: pa.Table, right: pa.Table) -> pa.Table:
    if not len(left) or not len(right):
        return schema.empty_table()
    r, c = best_pairs(left.rename_columns([x.removeprefix("h_") for x in left.column_names]), right.rename_columns([x.removeprefix("f_") for x in right.column_names]), *settings)
    return pa.table([t.column(x).take(pa.array(i)) for t, xs, i in ((left, names[0], r), (right, names[1], c)) for x in xs], names=schema.names)


def likely_best(hist: DataFrame, functions: DataFrame, least: float, same_path: float, same_base: float, block: int = BLOCK) -> DataFrame:
    """Both sides' columns, as h_* and f_*, of the pairs of one ``name`` among which is the best of each row of ``hist`` (name,
    path, vector and more), if that is over ``least``. All pairs are compared."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(hist.sparkSession)
    h, f = (df.where("name is not null").select("name", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "name"]) for df, p in ((hist, "h"), (functions, "f")))
    sizes = h.groupBy("name").agg(F.count("*").alias("_h")).join(f.groupBy("name").agg(F.count("*").alias("_f")), "name")
    sizes = sizes.select("name", "_h", "_f", F.ceil(F.col("_h") / block).alias("_hs"), F.ceil(F.col("_f") / block).alias("_fs"))
    pairs = sizes.agg(F.sum(F.col("_h").cast("double") * F.col("_f"))).first()[0] or 0
    into, keys = max(1, math.ceil(2 * pairs / block**2)), ["name", "_i", "_j"]
    at = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c != "name"]), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cut = sizes.select("name", "_hs", "_fs")
    a = h.join(cut, "name").select(*h.columns, at(h, "_hs").alias("_i"), every("_fs").alias("_j")).repartition(into, *keys)
    b = f.join(cut, "name").select(*f.columns, every("_hs").alias("_i"), at(f, "_fs").alias("_j")).repartition(into, *keys)
    hc, fc = ([c for c in df.columns if c != "name"] for df in (h, f))
    schema = StructType([h.schema[c] for c in hc] + [f.schema[c] for c in fc])
    meet = partial(_meet, (hc, fc), to_arrow_schema(schema), (least, same_path, same_base))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda left, right: meet(left, right), schema)
