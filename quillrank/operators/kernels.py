"""Grouped kernels for what plain relational operators can't say: assignment, clustering, diversity, string ratio, resampling.

Each takes one question's rows, whose number the sampling of a question bounds; nothing crosses questions."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_assignment(weights: np.ndarray) -> list[int]:
    """For each row the column of a one-to-one matching of the greatest weight, or -1; the shorter side is matched whole.

    Shortest augmenting paths with potentials; the first of equal choices wins."""
    n, m = weights.shape
    if n > m:
        columns = best_assignment(weights.T)
        out = [-1] * n
        for j, i in enumerate(columns):
            out[i] = j
        return out
    cost = weights.max(initial=0) - weights.astype(float)
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        distance, before, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, reached = start, 0.0
        rows, at = {start: 0.0}, -1
        while True:
            step = reached + cost[i] - row_price[i] - col_price
            better = ~done & (step < distance - 1e-12)
            distance[better], before[better] = step[better], at
            j = int(np.where(done, np.inf, distance).argmin())
            reached, done[j], at = distance[j], True, j
            if owner[j] < 0:
                break
            i = int(owner[j])
            rows[i] = reached
        for r, d in rows.items():
            row_price[r] += reached - d
        col_price[done] -= reached - distance[done]
        while True:
            previous = before[at]
            owner[at] = start if previous < 0 else owner[previous]
            if previous < 0:
                break
            at = previous
    out = [-1] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def assign(df: DataFrame, keys: list[str], left: str, right: str, weight: str) -> DataFrame:
    """keys, left, right of the best one-to-one matching of each group; pairs of no weight are left out."""
    fields = [df.schema[c] for c in (*keys, left, right)]

    def run(rows):
        groups: dict[tuple, dict] = {}
        for *k, i, j, w in rows[[*keys, left, right, weight]].itertuples(index=False):
            groups.setdefault(tuple(k), {}).setdefault((i, j), w)
        out = []
        for k, cells in groups.items():
            lefts, rights = sorted({i for i, _ in cells}), sorted({j for _, j in cells})
            grid, row, column = np.zeros((len(lefts), len(rights))), {x: n for n, x in enumerate(lefts)}, {x: n for n, x in enumerate(rights)}
            for (i, j), w in cells.items():
                grid[row[i], column[j]] = w
            out += [(*k, lefts[i], rights[j]) for i, j in enumerate(best_assignment(grid)) if j >= 0 and grid[i, j] > 0]
        return pd.DataFrame(out, columns=[*keys, left, right])

    # one call for all groups of a question
    return df.select(*keys, left, right, weight).groupBy(keys[0]).applyInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity, without the popular-character shortcut."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def at_least(a: str, b: str, least: float) -> bool:
    """ratio(a, b) >= least; its two upper bounds are cheap and settle most pairs."""
    if a == b:
        return True
    match = SequenceMatcher(None, a, b, autojunk=False)
    return match.real_quick_ratio() >= least and match.quick_ratio() >= least and match.ratio() >= least


def complete_link(df: DataFrame, key: str, order: str, text: str, least: float = 0.75) -> DataFrame:
    """cluster of each row: in order, a row joins the first cluster whose every member is at least that similar."""
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, order, text))

    def run(rows):
        rows, clusters, mine = rows.sort_values(order), [], []
        for value in rows[text]:
            place = next((n for n, c in enumerate(clusters) if all(at_least(value, x, least) for x in c)), len(clusters))
            if place == len(clusters):
                clusters.append([])
            clusters[place].append(value)
            mine.append(place)
        return rows.assign(cluster=mine)

    return df.select(key, order, text).groupBy(key).applyInPandas(run, f"{fields}, cluster long")


def diversify(df: DataFrame, key: str, rank: str, signature: str, penalty: float = 0.2, k: int = 5) -> DataFrame:
    """position of every row: k rows picked one by one by 1 / rank, less penalty if the signature was picked before, then
    the rest by rank.  The first stays first (WIN19)."""
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, rank, signature))

    def run(rows):
        rest, seen, out = rows.sort_values(rank).to_dict("records"), set(), []
        while rest and len(out) < k:
            best = max(rest, key=lambda r: (1 / r[rank] - penalty * (r[signature] in seen), -r[rank]))
            rest.remove(best)
            seen.add(best[signature])
            out.append(best)
        return pd.DataFrame([{**r, "position": i} for i, r in enumerate(out + rest, 1)])

    return df.select(key, rank, signature).groupBy(key).applyInPandas(run, f"{fields}, position long")


def paired_bootstrap(deltas: DataFrame, column: str, resamples: int = 10_000, seed: int = 13, blocks: int = 16) -> DataFrame:
    """mean, low and high (95 %) of the mean of column.

    Poisson weights stand for drawing with replacement, so that each partition adds its weighted sums by itself."""
    per = resamples // blocks
    resamples = per * blocks
    odds = np.cumsum(np.exp(-1.0) / np.array([math.factorial(k) for k in range(16)]))  # of a Poisson weight of at most k

    def weights(place: np.ndarray) -> np.ndarray:
        """A Poisson weight for each row and resample, from a hash of both."""
        x = place[:, None] + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return np.searchsorted(odds, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53)

    def sums(batches):
        total, weight, s, n = np.zeros(resamples), np.zeros(resamples), 0.0, 0
        for batch in batches:
            x = batch["x"].to_numpy().astype(float)
            place = batch["place"].to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(seed * 0x9E3779B9)
            for at in range(0, len(x), 64):
                w = weights(place[at : at + 64])
                total += x[at : at + 64] @ w
                weight += w.sum(0)
            s, n = s + x.sum(), n + len(x)
        for b in range(blocks):
            yield pd.DataFrame({"block": [b], "total": [total[b * per : (b + 1) * per]], "weight": [weight[b * per : (b + 1) * per]], "s": [s], "n": [n]})

    def merge(rows):
        means = np.sum(np.stack(rows["total"]), 0) / np.maximum(1, np.sum(np.stack(rows["weight"]), 0))
        return pd.DataFrame({"mean_of": means, "mean": rows["s"].sum() / max(1, rows["n"].sum())})

    parts = deltas.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), F.xxhash64(*deltas.columns).alias("place")).mapInPandas(sums, "block int, total array<double>, weight array<double>, s double, n long")
    found = parts.groupBy("block").applyInPandas(merge, "mean_of double, mean double")
    return found.agg(F.round(F.first("mean"), 9).alias("mean"), F.round(F.percentile("mean_of", 0.025), 9).alias("low"), F.round(F.percentile("mean_of", 0.975), 9).alias("high"))
