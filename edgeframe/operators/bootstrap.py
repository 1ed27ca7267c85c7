"""Seeded bootstrap of trade sequences. Draw ``k`` of path ``s`` is a pure function of (seed, s, k), so
results do not depend on partitioning; one task holds the outcomes of one configuration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """``count`` 64-bit SplitMix numbers from position ``first`` of the seed's sequence."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + (np.arange(first, first + count, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def places(seed: int, first: int, count: int, n: int) -> np.ndarray:
    """The same numbers as places among ``n``: the upper 53 bits as a fraction of one, times n."""
    return np.minimum(((draws(seed, first, count) >> np.uint64(11)).astype(float) / 2.0**53 * n).astype(np.int64), n - 1)


def percentile(sorted_x: np.ndarray, q: float) -> float:
    return float(np.percentile(sorted_x, q)) if len(sorted_x) else float("nan")


def path_stats(r: np.ndarray, paths: int = 5000, seed: int = 42, at_once: int = 500) -> tuple[float, float, float, float, float, float]:
    """Profit chance in percent, 95th percentile drawdown, 5th percentile final, and 5/50/95 of the mean."""
    n, finals, dds = len(r), [], []
    for s in range(0, paths, at_once):
        m = min(at_once, paths - s)
        picks = r[places(seed, s * n, m * n, n)].reshape(m, n)
        curve = picks.cumsum(1)
        finals.append(curve[:, -1])
        dds.append((np.maximum(np.maximum.accumulate(curve, 1), 0) - curve).max(1))
    f, d = np.concatenate(finals), np.concatenate(dds)
    return (float((f > 0).mean() * 100), percentile(d, 95), percentile(f, 5), *(percentile(f / n, q) for q in (5, 50, 95)))


def bootstrap(trades: DataFrame, keys: list[str], paths: int = 5000, seed: int = 42, ci_least: int = 20) -> DataFrame:
    """keys, n, prob_profit_pct, dd_p95, final_p05, and the interval of the mean (null under ``ci_least`` trades)."""
    types = {f.name: f.dataType.simpleString() for f in trades.schema.fields}
    shape = ", ".join(f"{k} {types[k]}" for k in keys) + ", n long, prob_profit_pct double, dd_p95 double, final_p05 double, mean_p05 double, mean_p50 double, mean_p95 double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("entry_idx")["r"].to_numpy(float)
        stats = path_stats(r, paths, seed)
        interval = stats[3:] if len(r) >= ci_least else (None, None, None)
        return pd.DataFrame([[*pdf[keys].iloc[0], len(r), *stats[:3], *interval]], columns=[c.split()[0] for c in shape.split(", ")])

    return trades.select(*keys, "entry_idx", "r").groupBy(*keys).applyInPandas(run, shape)
