"""Anomaly scores and likelihoods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The upper tail of the normal law by tenths of a standard deviation, 0 to 7.
TAIL = [
    0.5, 0.460172163, 0.420740291, 0.382088578, 0.344578258, 0.308537539, 0.274253118, 0.241963652, 0.211855399, 0.184060125,
    0.158655254, 0.135666061, 0.11506967, 0.096800485, 0.080756659, 0.066807201, 0.054799292, 0.044565463, 0.035930319, 0.02871656,
    0.022750132, 0.017864421, 0.013903448, 0.01072411, 0.008197536, 0.006209665, 0.004661188, 0.003466974, 0.00255513, 0.001865813,
    0.001349898, 0.000967603, 0.000687138, 0.000483424, 0.000336929, 0.000232629, 0.000159109, 0.0001078, 7.2348e-05, 4.8096e-05,
    3.1671e-05, 2.1771135897e-05, 1.4034063752e-05, 8.961673661e-06, 5.668743475e-06, 3.551942468e-06, 2.204533058e-06, 1.355281953e-06,
    8.25270644e-07, 4.97747091e-07, 2.97343903e-07, 1.75930101e-07, 1.03096834e-07, 5.9836778e-08, 3.439559e-08, 1.9581382e-08,
    1.1040394e-08, 6.164833e-09, 3.409172e-09, 1.867079e-09, 1.012647e-09, 5.43915e-10, 2.8932e-10, 1.52404e-10, 7.9502e-11, 4.107e-11,
    2.101e-11, 1.0644e-11, 5.34e-12, 2.653e-12, 1.305e-12,
]
#: Floors of a fitted law, the law that tells nothing, and the variance below which a metric is flat.
MEAN_FLOOR, VARIANCE_FLOOR = 0.03, 0.0003
NULL_MEAN, NULL_VARIANCE = 0.5, 1e6
FLAT_VARIANCE = 1.5e-5
#: Tails up to RED count as extreme; one that follows another is lifted to YELLOW.
RED, YELLOW = 1e-5, 1e-3


def normal_tail(x: Column, mean: Column, stdev: Column) -> Column:
    """P(X >= x) by the table; half-even rounding to tenths, 0 beyond seven deviations, symmetric below the mean."""
    table = F.array(*map(F.lit, TAIL))

    def above(v: Column) -> Column:
        tenths = F.rint(10 * (v - mean) / stdev)
        return F.when(tenths > 70, 0.0).otherwise(F.get(table, F.least(tenths, F.lit(70.0)).cast("int")))

    return F.when(x < mean, 1 - above(2 * mean - x)).otherwise(above(x))


def tail_sql(x: str, mean: str, stdev: str) -> str:
    """The same as DuckDB SQL."""
    table = "[" + ", ".join(map(repr, TAIL)) + "]"

    def above(v: str) -> str:
        t = f"round_even(10 * ({v} - {mean}) / {stdev}, 0)"
        return f"(CASE WHEN {t} > 70 THEN 0.0 ELSE {table}[CAST(least({t}, 70) AS INT) + 1] END)"

    return f"(CASE WHEN {x} < {mean} THEN 1 - {above(f'(2 * {mean} - {x})')} ELSE {above(x)} END)"


def log_likelihood(p: Column) -> Column:
    return F.log(F.lit(1.0000000001) - p) / F.lit(-23.02585084720009)


def raw_score(active: Column, predicted: Column) -> Column:
    """Share of active bits that were not predicted; 0 where none is active."""
    return F.when(F.size(active) == 0, 0.0).otherwise(1 - F.size(F.array_intersect(active, predicted)) / F.size(active))


def lift_repeats(tail: Column, previous: Column) -> Column:
    return F.when((tail <= RED) & (previous <= RED), YELLOW).otherwise(tail)


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, y: s + y))


def bucket_start(ts: Column, seconds: int, reference: int = 0) -> Column:
    """Start of the aligned bucket of a time, in seconds since the epoch; floors on both sides of the reference."""
    return (F.floor((F.unix_timestamp(ts) - reference) / seconds) * seconds + reference).cast("bigint")


def estimator_is_valid(mean: Column, variance: Column, moving_average: Column) -> Column:
    """Whether a distribution and a moving average are there, and no moment is zero."""
    there = mean.isNotNull() & variance.isNotNull() & moving_average.isNotNull()
    return F.coalesce(there & (mean != 0) & (variance != 0) & (F.sqrt(variance) != 0), F.lit(False))


def anomaly(mode: str, raw: Column, likelihood: Column) -> Column:
    """The anomaly score of a mode: the raw score, its likelihood, or the raw score weighted by its likelihood."""
    modes = {"pure": raw, "likelihood": likelihood, "weighted": raw * likelihood}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode}; known: {sorted(modes)}")
    return modes[mode]
