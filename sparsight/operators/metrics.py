"""Error metrics of predictions against what came later: global, and over trailing windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import trailing

#: (numerator term, denominator term or None for a mean, what is done to the mean, or to the numerator's sum before it is divided) of
#: truth and prediction.
METRICS: dict[str, tuple[Callable, Callable | None, Callable]] = {
    "rmse": (lambda t, p: F.pow(t - p, F.lit(2.0)), None, F.sqrt),
    "aae": (lambda t, p: F.abs(t - p), None, lambda x: x),
    "avg_err": (lambda t, p: (t != p).cast("double"), None, lambda x: x),
    "altMAPE": (lambda t, p: F.abs(t - p), lambda t, p: F.abs(t), lambda x: 100 * x),
}


def metric(name: str, truth: Column, prediction: Column, over=None, sums: Callable[[Column], Column] | None = None) -> Column:
    """A named metric as an aggregate, or over a window; rows where truth or prediction is null don't count.

    sums, where given, adds the terms up instead of a sum over the window.
    """
    if name not in METRICS:
        raise ValueError(f"unknown metric {name}; known: {sorted(METRICS)}")
    top, bottom, last = METRICS[name]
    both = truth.isNotNull() & prediction.isNotNull()
    put = lambda c: c.over(over) if over is not None else c
    sums = sums or (lambda c: put(F.sum(c)))
    total = sums(F.when(both, top(truth, prediction)))
    if bottom is None:
        return last(total / put(F.count(F.when(both, 1))))
    under = sums(F.when(both, bottom(truth, prediction)))
    return F.when(under > 0, last(total) / F.when(under > 0, under)).otherwise(0.0)


def multistep(name: str, truth: Column, predictions: dict[int, Column]) -> Column:
    """The mean of a metric over prediction steps; predictions holds, by step, what was predicted for the row that many rows ago."""
    parts = [metric(name, truth, p) for _, p in sorted(predictions.items())]
    return sum(parts[1:], parts[0]) / len(parts)


# The kinds of inference, and those of them that are made of a record about a later one.
KINDS = ["None", "TemporalNextStep", "TemporalClassification", "NontemporalClassification", "TemporalAnomaly", "NontemporalAnomaly", "TemporalMultiStep", "NontemporalMultiStep", "MultiStep"]
TEMPORAL = ["TemporalNextStep", "TemporalClassification", "TemporalAnomaly", "TemporalMultiStep", "NontemporalMultiStep"]


def is_temporal(kind: str) -> bool:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of inference {kind}; known: {KINDS}")
    return kind in TEMPORAL


def shifted(kind: Column) -> Column:
    """Whether inferences of a kind are shifted before they are held against the truth; null for unknown kinds."""
    return F.when(kind.isin(*KINDS), kind.isin(*TEMPORAL))


def label(name: str, element: str, field: str, **params) -> str:
    return ":".join([element, name, *(f"{k}={params[k]}" for k in sorted(params)), f"field={field}"])


def manage(rows: DataFrame, keys: list[str], chunk: str, order: list[str], specs: list[dict], steps: int = 1) -> DataFrame:
    """keys, label, value: every metric of a list over a stream, in one pass.

    A spec names the inference `element`, its `kind` (of KINDS), the `metric`, the `field` (the truth) and the column of its
    `prediction`; `params` go into the label. Predictions of temporal kinds are held against the record `steps` later of the
    same keys, in a total order that `chunk` rises with; those of the others against their own record.
    """
    late = sorted({s["prediction"] for s in specs if is_temporal(s["kind"])})
    if late:
        rows = trailing(rows, keys, chunk, order, steps, {f"__{c}": (lambda w, c=c: F.lag(c, steps).over(w)) for c in late}, late)
    held = {s["prediction"]: f"__{s['prediction']}" for s in specs if is_temporal(s["kind"])}
    names = [label(s["metric"], s["element"], s["field"], **s.get("params", {})) for s in specs]
    values = [metric(s["metric"], F.col(s["field"]), F.col(held[s["prediction"]] if is_temporal(s["kind"]) else s["prediction"])) for s in specs]
    wide = rows.groupBy(*keys).agg(*[v.cast("double").alias(f"m{i}") for i, v in enumerate(values)])
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"m{i}").alias("value")) for i, n in enumerate(names)])
    return wide.select(*keys, F.explode(pairs).alias("__m")).select(*keys, "__m.label", "__m.value")


def score_table(rows: DataFrame, truth: str, prediction: str, names: list[str], by: list[str]) -> DataFrame:
    """One pass over rows: all metrics by group."""
    return rows.groupBy(*by).agg(*[metric(n, F.col(truth), F.col(prediction)).alias(n) for n in names])
