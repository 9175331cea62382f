"""Exact percentiles of many values, without a table of all of them in one task.

Values are counted in bins of their size, of which the driver gets a row each; a bin that is still too full is divided
again. So each percentile's rank is bracketed, then one pass counts the values below the bracket and lists those in
it, some thousandths of all. Only these are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins for each power of two; how many bins a bracket reaches beyond the rank's own; values of a bracket that are listed, at most, unless they are equal.
ACCURACY, MARGIN, LISTED = 256, 0, 1_000_000
#: Beyond the logarithm of any finite number, in powers of two.
_REACH = 1100


def _bin(v: Column) -> Column:
    """Bins in the order of the values: by sign and logarithm."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(float(_REACH))) * ACCURACY) + _REACH * ACCURACY
    return F.when(v > 0, size).when(v < 0, -size).when(v == 0, 0)


def percentiles(values: DataFrame, by: list[str], shares: Iterable[float], wanted: Callable | None = None, more: Iterable = ()) -> list[dict]:
    """A dict for each group: the columns `by`, n, the columns of the aggregates `more`, and share: percentile, interpolated, None without values.

    values: `by` and v, a double that isn't NaN; nulls don't count. wanted(row): the shares that a group needs, by default all.
    """
    shares, more = sorted(set(shares)), list(more)
    groups = [r.asDict() for r in values.groupBy(*by).agg(*more).collect()] if more else []
    at = {tuple(r[b] for b in by): g for g, r in enumerate(groups)}
    bins: dict[int, list[tuple]] = {}
    for r in values.groupBy(*by, _bin(F.col("v")).alias("_bin")).agg(F.count("v").alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi")).collect():
        key = tuple(r[b] for b in by)
        if key not in at:
            at[key] = len(groups)
            groups.append({b: r[b] for b in by})
        if r["_n"]:
            bins.setdefault(at[key], []).append((r["_bin"], r["_n"], r["_lo"], r["_hi"]))
    if not by and not groups:
        groups.append({})
    targets = []
    for g, r in enumerate(groups):
        own = sorted(bins.get(g, ()))
        r["n"] = sum(b[1] for b in own)
        for p in shares:
            r[p] = None
            if own and (wanted is None or p in wanted(r)):
                targets.append((g, p, *_bracket(own, 0, p * (r["n"] - 1), MARGIN), own[0][2], own[-1][3]))
    targets = [t[:4] + t[6:] for t in _divided(values, by, groups, targets)]
    while targets:
        found = _ranks(values, by, groups, targets)
        left = []
        for t, (g, p, lo, hi, low, high) in enumerate(targets):
            place = p * (groups[g]["n"] - 1)
            below, above = (found.get((t, f(place))) for f in (math.floor, math.ceil))
            if below is None or above is None:  # the bracket missed it
                if (lo, hi) == (low, high):
                    raise ValueError("values differ from one pass to the next")
                left.append((g, p, low, high, low, high))
            else:
                groups[g][p] = below if below == above else (math.ceil(place) - place) * below + (place - math.floor(place)) * above
        targets = left
    return groups


def _bracket(bins: list[tuple], before: int, place: float, margin: int = 0) -> tuple[float, float, int, int]:
    """Least and greatest value of the bins with the two ranks beside place, how many values lie before and in them. bins: in order (bin, n, least, greatest), after `before` values."""
    ends = list(accumulate((b[1] for b in bins), initial=before))[1:]
    first, last = (next((i for i, e in enumerate(ends) if e > k), len(ends) - 1) for k in (math.floor(place), math.ceil(place)))
    first, last = min(max(first - margin, 0), len(bins) - 1), min(max(last + margin, 0), len(bins) - 1)
    start = ends[first] - bins[first][1]
    return bins[first][2], bins[last][3], start, ends[last] - start


def _divided(values: DataFrame, by: list[str], groups: list[dict], targets: list[tuple]) -> list[tuple]:
    """targets with brackets of at most LISTED values, or of equal ones: (group, share, least, greatest, values before, values in it, least and greatest of the group)."""
    full = {t for t, x in enumerate(targets) if x[5] > LISTED and x[2] < x[3]}
    while full:
        rows = [(*[groups[targets[t][0]][b] for b in by], t, float(targets[t][2]), float(targets[t][3])) for t in sorted(full)]
        x = _within(values, by, rows, "_t int, _lo double, _hi double").where(F.col("v") >= F.col("_lo"))
        part = F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (16 * ACCURACY))
        bins: dict[int, list[tuple]] = {}
        for r in x.groupBy("_t", part.alias("_bin")).agg(F.count("*").alias("_n"), F.min("v").alias("_low"), F.max("v").alias("_high")).collect():
            bins.setdefault(r["_t"], []).append((r["_bin"], r["_n"], r["_low"], r["_high"]))
        for t in sorted(full):
            g, p, lo, hi, before, _, *ends = targets[t]
            new = _bracket(sorted(bins[t]), before, p * (groups[g]["n"] - 1)) if t in bins else (lo, hi, before, 0)
            targets[t] = (g, p, *new, *ends)
            if new[3] <= LISTED or new[0] == new[1] or new[:2] == (lo, hi):
                full.discard(t)
    return targets


def _within(values: DataFrame, by: list[str], rows: list[tuple], columns: str) -> DataFrame:
    """Values up to _hi of their group's rows, beside these. rows: the columns `by`, then `columns`."""
    kinds = [f"_{f.name} {f.dataType.simpleString()}" for b in by for f in values.schema if f.name == b]
    brackets = F.broadcast(values.sparkSession.createDataFrame(rows, ", ".join([*kinds, columns])))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return values.where("v is not null").join(brackets, same & (F.col("v") <= F.col("_hi")))


def _ranks(values: DataFrame, by: list[str], groups: list[dict], targets: list[tuple]) -> dict[tuple[int, int], float]:
    """(target, rank): value of the two ranks beside each target, where they lie in its bracket."""
    rows = []
    for t, (g, p, lo, hi, *_) in enumerate(targets):
        place = p * (groups[g]["n"] - 1)
        rows.append((*[groups[g][b] for b in by], t, float(lo), float(hi), math.floor(place), math.ceil(place)))
    x = _within(values, by, rows, "_t int, _lo double, _hi double, _first bigint, _last bigint")
    counts = x.select("_t", "_first", "_last", F.when(F.col("v") >= F.col("_lo"), F.col("v")).alias("v")).groupBy("_t", "_first", "_last", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("_t").orderBy(F.col("v").asc_nulls_first())
    upto = counts.withColumn("_end", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = upto.where("v is not null and _end > _first and _end - c <= _last").select("_t", "v", "_first", "_last", (F.col("_end") - F.col("c")).alias("_begin"), "_end").collect()
    return {(r["_t"], k): r["v"] for r in near for k in (r["_first"], r["_last"]) if r["_begin"] <= k < r["_end"]}
