"""Statistics of score vectors by group: means, ANOVA, MANOVA, Ward clustering.

Sums over rows are Spark aggregates; only matrices of the size of the vector come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def widened(df: DataFrame, vector: str, n: int, prefix: str = "emotion_") -> DataFrame:
    """The first n items of an array as columns."""
    return df.select("*", *(F.get(vector, F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(n)))


def group_means(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*(F.avg(c).alias(c) for c in columns))


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f, tiny = 1.0, 0.0, 1.0, 1e-300
    for i in range(500):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d if abs(1 + num * d) > tiny else tiny)
        c = 1 + num / c if abs(1 + num / c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def anova(df: DataFrame, group: str, columns: Sequence[str]) -> list[tuple[str, float, float]]:
    """(column, F to 3 digits, p to 4) of one-way analyses of variance; rows with a null in group or column are left out of it."""
    aggs = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_samp(c).alias(f"v{i}"))]
    rows = df.where(F.col(group).isNotNull()).groupBy(group).agg(*aggs).collect()  # a row for each group
    out = []
    for i, c in enumerate(columns):
        g = [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"] or 0.0) for r in rows if r[f"n{i}"]]
        n, k = sum(x[0] for x in g), len(g)
        if k < 2 or n <= k:
            out.append((c, float("nan"), float("nan")))
            continue
        mean = sum(a * m for a, m, _ in g) / n
        between, within = sum(a * (m - mean) ** 2 for a, m, _ in g) / (k - 1), sum((a - 1) * v for a, _, v in g) / (n - k)
        f = between / within if within > 0 else float("inf")
        out.append((c, round(f, 3), round(f_tail(f, k - 1, n - k), 4) if math.isfinite(f) else 0.0))
    return out


def multivariate_tests(roots: Sequence[float], p: int, q: int, v: float) -> dict[str, tuple[float, float, float, float, float]]:
    """By name of the statistic: (value, F, numerator df, denominator df, p). roots: eigenvalues of E^-1 H; p: variables; q: df of the hypothesis; v: df of the error.

    Rao's F for Wilks' lambda; McKeon's for the Hotelling-Lawley trace where v > p + 1; an upper bound for Roy's root.
    """
    ev = np.clip(np.asarray(roots, float), 0, None)
    s, m, n = min(p, q), (abs(p - q) - 1) / 2, (v - p - 1) / 2
    wilks, pillai, hotelling, roy = float(np.prod(1 / (1 + ev))), float(np.sum(ev / (1 + ev))), float(np.sum(ev)), float(ev.max())
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    d1, d2 = p * q, (v - (p - q + 1) / 2) * t - (p * q - 2) / 2
    root = wilks ** (1 / t)
    rows = [("Wilks' lambda", wilks, (1 - root) / root * d2 / d1, d1, d2)]
    a, b = s * (2 * m + s + 1), s * (2 * n + s + 1)
    rows.append(("Pillai's trace", pillai, b / a * pillai / (s - pillai), a, b))
    if n > 1:
        ratio = (p + 2 * n) * (q + 2 * n) / (2 * (2 * n + 1) * (n - 1))
        a, b = p * q, 4 + (p * q + 2) / (ratio - 1)
        rows.append(("Hotelling-Lawley trace", hotelling, b / a * hotelling * 2 * n / (b - 2), a, b))
    else:
        a, b = s * (2 * m + s + 1), 2 * (s * n + 1)
        rows.append(("Hotelling-Lawley trace", hotelling, b / a * hotelling / s, a, b))
    a, b = max(p, q), v - max(p, q) + q
    rows.append(("Roy's greatest root", roy, b / a * roy, a, b))
    return {name: (value, float(f), float(a), float(b), f_tail(float(f), a, b)) for name, value, f, a, b in rows}


def _sums(df: DataFrame, group: str, columns: Sequence[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(groups in order, counts, sums by group, sums of products): one aggregate, a row for each group."""
    p = len(columns)
    rows = df.dropna(subset=[group, *columns])
    aggs = [F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)] + [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
    got = sorted(rows.groupBy(group).agg(F.count("*").alias("n"), *aggs).collect(), key=lambda r: r[group])
    raw = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            raw[i, j] = raw[j, i] = sum(r[f"q{i}_{j}"] for r in got)
    return [r[group] for r in got], np.array([r.n for r in got], float), np.array([[r[f"s{i}"] for i in range(p)] for r in got]), raw


def manova_effects(df: DataFrame, group: str, columns: Sequence[str]) -> dict[str, dict[str, tuple[float, float, float, float, float]]]:
    """The four tests of each effect: Intercept, that the means of the first group (in order) are zero, and `group`, that all groups' means are equal.

    Rows with a null in group or columns are left out.
    """
    p = len(columns)
    names, n, sums, raw = _sums(df, group, columns)
    per = (sums.T / n) @ sums
    total = sums.sum(0)
    e = raw - per
    hypotheses = {"Intercept": (np.outer(sums[0], sums[0]) / n[0], 1), group: (per - np.outer(total, total) / n.sum(), len(names) - 1)}
    return {effect: multivariate_tests(np.linalg.eigvals(np.linalg.solve(e, h)).real, p, q, n.sum() - len(names)) for effect, (h, q) in hypotheses.items()}


def manova(df: DataFrame, group: str, columns: Sequence[str]) -> dict[str, tuple[float, float, float, float, float]]:
    """By name of the statistic: (value, F, numerator df, denominator df, p), of the hypothesis that all group means are equal."""
    return manova_effects(df, group, columns)[group]


def ward(points: np.ndarray) -> np.ndarray:
    """Linkage rows (a, b, distance, size) of Ward's clustering; points are a few group means, on the driver."""
    n = len(points)
    size, alive = {i: 1 for i in range(n)}, list(range(n))
    d = {(i, j): float(((points[i] - points[j]) ** 2).sum()) for i in range(n) for j in range(i + 1, n)}
    out = []
    for new in range(n, 2 * n - 1):
        (a, b), best = min(((k, v) for k, v in d.items()), key=lambda x: (x[1], x[0]))
        alive = [i for i in alive if i not in (a, b)]
        size[new] = size[a] + size[b]
        for i in alive:
            ai, bi = d[min(a, i), max(a, i)], d[min(b, i), max(b, i)]
            t = size[a] + size[b] + size[i]
            d[i, new] = ((size[a] + size[i]) * ai + (size[b] + size[i]) * bi - size[i] * best) / t
        d = {k: v for k, v in d.items() if a not in k and b not in k}
        alive.append(new)
        out.append((a, b, math.sqrt(best), size[new]))
    return np.array(out)
