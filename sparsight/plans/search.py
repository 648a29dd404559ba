"""Search for model parameters: variables of a particle swarm, generations, grids, a genetic algorithm.

Controls are small and live on the driver; evaluating candidates is the work, and each candidate is a task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the swarm: inertia, pull to the own best, pull to the swarm's best, range of the random factors.
INERTIA, OWN_PULL, SWARM_PULL, RANDOM = 0.25, 0.25, 1.0, (0.8, 1.2)


@dataclass
class FloatVariable:
    low: float
    high: float
    step: float | None = None
    position: float = math.nan
    velocity: float = 0.0
    best: float = math.nan
    best_error: float = math.inf

    def __post_init__(self):
        if math.isnan(self.position):
            self.position = (self.low + self.high) / 2
            self.velocity = (self.high - self.low) / 5
        self.best = self.position if math.isnan(self.best) else self.best

    @property
    def value(self):
        x = self.position if self.step is None else self.low + round((self.position - self.low) / self.step) * self.step
        return min(self.high, max(self.low, x))

    def move(self, swarm_best: float | None, rng: np.random.Generator):
        v = self.velocity * INERTIA + rng.uniform(*RANDOM) * OWN_PULL * (self.best - self.value)
        if swarm_best is not None:
            v += rng.uniform(*RANDOM) * SWARM_PULL * (swarm_best - self.value)
        self.velocity = v
        self.position = min(self.high, max(self.low, self.position + v))
        return self.value

    def agitate(self, rng: np.random.Generator) -> None:
        self.velocity += (rng.choice([-1, 1])) * (self.high - self.low) / 5 * 1.5

    def push_from(self, others: list[float], rng: np.random.Generator) -> None:
        """Goes where the others are not: the grid point farthest from all of them."""
        if others:
            grid = np.linspace(self.low, self.high, 4 * len(others) + 1)
            gaps = np.abs(grid[:, None] - np.array(others)[None, :]).min(axis=1)
            self.position = float(grid[int(np.argmax(gaps))])

    def seen(self, error: float) -> None:
        if error < self.best_error:
            self.best, self.best_error = self.value, error


@dataclass
class IntVariable(FloatVariable):
    step: float | None = 1

    @property
    def value(self):
        return int(round(min(self.high, max(self.low, self.position))))


@dataclass
class ChoiceVariable:
    """Picks by roulette over the inverted mean errors of what each choice scored so far."""

    choices: list
    scores: dict = field(default_factory=dict)
    position: int = 0
    best: object = None
    best_error: float = math.inf

    @property
    def value(self):
        return self.choices[self.position]

    def move(self, swarm_best, rng: np.random.Generator):
        means = np.array([np.mean(self.scores[c]) if self.scores.get(c) else np.nan for c in self.choices])
        if np.isnan(means).all():
            p = np.full(len(means), 1 / len(means))
        else:
            means = np.where(np.isnan(means), np.nanmean(means), means)
            weights = means.max() + means.min() - means
            p = weights / weights.sum() if weights.sum() > 0 else np.full(len(means), 1 / len(means))
        self.position = int(rng.choice(len(self.choices), p=p))
        return self.value

    def agitate(self, rng: np.random.Generator) -> None:
        self.position = int(rng.integers(len(self.choices)))

    def push_from(self, others: list, rng: np.random.Generator) -> None:
        free = [i for i, c in enumerate(self.choices) if c not in others]
        self.position = free[0] if free else self.position

    def seen(self, error: float) -> None:
        self.scores.setdefault(self.value, []).append(error)
        if error < self.best_error:
            self.best, self.best_error = self.value, error


def evaluate(spark: SparkSession, candidates: list[dict], error: Callable[[dict], float]) -> list[float]:
    """The error of every candidate, a task each; NaN counts as infinite."""
    import json

    rows = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(candidates)], "i int, settings string").repartition(max(1, len(candidates)), "i")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"i": f.i, "error": [float(error(json.loads(s))) for s in f.settings]})

    found = {r.i: r.error for r in rows.mapInPandas(run, "i int, error double").collect()}
    return [math.inf if math.isnan(found[i]) else found[i] for i in range(len(candidates))]


def swarm(spark: SparkSession, variables: dict[str, Callable[[], object]], error: Callable[[dict], float], particles: int = 8, generations: int = 12, patience: int = 5, seed: int = 42) -> DataFrame:
    """generation, particle, settings, error of a particle swarm; it ends early once so many generations bring nothing better."""
    rng, swarm_best, best_error, stale, log = np.random.default_rng(seed), {}, math.inf, 0, []
    flock = [{k: make() for k, make in variables.items()} for _ in range(particles)]
    for n, one in enumerate(flock):
        for k, v in one.items():
            v.push_from([flock[m][k].value for m in range(n)], rng)
    for generation in range(generations):
        candidates = [{k: v.value for k, v in one.items()} for one in flock]
        errors = evaluate(spark, candidates, error)
        improved = False
        for n, (one, settings, e) in enumerate(zip(flock, candidates, errors)):
            log.append((generation, n, str(sorted(settings.items())), e))
            for v in one.values():
                v.seen(e)
            if e < best_error:
                best_error, swarm_best, improved = e, settings, True
        stale = 0 if improved else stale + 1
        if stale >= patience:
            break
        for one in flock:
            for k, v in one.items():
                if stale == patience - 1:
                    v.agitate(rng)
                v.move(swarm_best.get(k), rng)
    return spark.createDataFrame(log, "generation int, particle int, settings string, error double")


def best_by_generation(log: DataFrame) -> DataFrame:
    """The least error of each generation, and of all up to it."""
    per = log.groupBy("generation").agg(F.min("error").alias("error"), F.min_by("settings", "error").alias("settings"))
    return per.withColumn("best_so_far", F.min("error").over(Window.orderBy("generation")))  # one row a generation


def matured(log: DataFrame, particles: int) -> DataFrame:
    """Generations that are complete, and whose predecessors are."""
    done = log.groupBy("generation").agg((F.count(F.lit(1)) >= particles).alias("full"))
    return done.withColumn("matured", F.min("full").over(Window.orderBy("generation"))).select("generation", "matured")


def terminated(log: DataFrame, tolerance: float, still: int) -> DataFrame:
    """swarm, ended: swarms whose best has not changed for so many generations or lies a tolerance above the best of all."""
    per = log.groupBy("swarm", "generation").agg(F.min("error").alias("e"))
    w = Window.partitionBy("swarm").orderBy("generation")
    run = per.withColumn("best", F.min("e").over(w)).withColumn("back", F.lag("best", still).over(w))
    last = run.groupBy("swarm").agg(F.max_by(F.struct("best", "back"), "generation").alias("l"))
    all_ = last.agg(F.min("l.best").alias("top"))
    return last.crossJoin(all_).select("swarm", ((F.col("l.best") == F.col("l.back")) | (F.col("l.best") > (1 + tolerance) * F.col("top"))).alias("ended"))


def grid(**values) -> list[dict]:
    return [dict(zip(values, row)) for row in itertools.product(*values.values())]


def grids(rows: DataFrame, key: str, **values: Column) -> DataFrame:
    """key and a column for each name: every combination of the settings' values, arrays of a row, as rows of that key."""
    out = rows.select(key, *[v.alias(f"__{name}") for name, v in values.items()])
    for name in values:
        out = out.withColumn(name, F.explode(f"__{name}")).drop(f"__{name}")
    return out


def grid_errors(rows: DataFrame, error: Callable[[dict], Column], **values) -> DataFrame:
    """settings, error: the mean error over rows of every combination of settings, all in one pass; their number is the grid's."""
    cells = grid(**values)
    found = rows.agg(*[F.avg(error(c)).alias(f"e{k}") for k, c in enumerate(cells)])
    listed = F.array(*[F.struct(F.lit(",".join(f"{n}={c[n]}" for n in sorted(c))).alias("settings"), F.col(f"e{k}").alias("error")) for k, c in enumerate(cells)])
    return found.select(F.explode(listed).alias("s")).select("s.settings", "s.error")


def grid_search(spark: SparkSession, error: Callable[[dict], float], **values) -> DataFrame:
    cells = grid(**values)
    return spark.createDataFrame([(str(sorted(c.items())), e) for c, e in zip(cells, evaluate(spark, cells, error))], "settings string, error double")


def combinations(rows: DataFrame, column: str, k: int) -> DataFrame:
    """All k-element sets of a small column's values, ascending."""
    out = rows.select(F.array(column).alias("c"), F.col(column).alias("__last"))
    for _ in range(k - 1):
        out = out.join(rows.select(F.col(column).alias("__next")), F.col("__next") > F.col("__last")).select(F.array_append("c", F.col("__next")).alias("c"), F.col("__next").alias("__last"))
    return out.select("c")


def genetic(fitness: Callable[[np.ndarray], float], bits: int, population: int = 40, generations: int = 60, elite: int = 2, crossover: float = 0.7, mutation: float = 0.01, seed: int = 42) -> tuple[np.ndarray, float]:
    """The fittest bit string of a genetic algorithm: an elite stays, parents by roulette, one cut, bit flips."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2, (population, bits))
    for _ in range(generations):
        score = np.array([fitness(g) for g in pool])
        order = np.argsort(-score, kind="stable")
        weights = score - score.min() + 1e-12
        parents = pool[rng.choice(population, (population - elite, 2), p=weights / weights.sum())]
        cut = np.where(rng.random(population - elite) < crossover, rng.integers(1, bits, population - elite), bits)
        children = np.where(np.arange(bits)[None, :] < cut[:, None], parents[:, 0], parents[:, 1])
        children ^= rng.random(children.shape) < mutation
        pool = np.vstack([pool[order[:elite]], children])
    score = np.array([fitness(g) for g in pool])
    return pool[int(np.argmax(score))], float(score.max())


def divide_intervals(a: dict[str, float], b: dict[str, float]) -> float:
    """How often one aggregation interval holds another; months and seconds don't mix."""
    months = {"years": 12, "months": 1}
    seconds = {"weeks": 604800, "days": 86400, "hours": 3600, "minutes": 60, "seconds": 1, "milliseconds": 1e-3, "microseconds": 1e-6}
    ma, mb = (sum(v * months[k] for k, v in x.items() if k in months) for x in (a, b))
    sa, sb = (sum(v * seconds[k] for k, v in x.items() if k in seconds) for x in (a, b))
    if ma and sa or mb and sb or bool(ma) != bool(mb):
        raise ValueError("intervals of months can't be divided by intervals of seconds")
    return ma / mb if mb else sa / sb


def field_sprints(spark: SparkSession, fields: list[str], error: Callable[[dict], float], base: list[str] | None = None, most_fields: int = 5, least_gain: float = 0.0, branches: int = 3) -> DataFrame:
    """sprint, fields, error, contribution: which input fields a model should have, grown a field a sprint.

    The first sprint scores every field alone (with the base fields). Each later one adds single fields to the best
    combinations of the sprint before, and drops fields that contributed less than least_gain per cent; it ends when no
    larger combination is better. error gets {"fields": [...]}.
    """
    base, log, best, alive = list(base or []), [], math.inf, [f for f in fields if f not in (base or [])]
    level = [tuple(sorted({*base, f})) for f in alive]
    for sprint in range(most_fields):
        level = sorted(set(level))
        if not level:
            break
        errors = evaluate(spark, [{"fields": list(c)} for c in level], error)
        start = max(best if best < math.inf else max(e for e in errors if e < math.inf) if any(e < math.inf for e in errors) else 1e-5, 1e-5)
        gains = {c: (start - e) * 100 / start for c, e in zip(level, errors)}
        log += [(sprint, list(c), e, gains[c]) for c, e in zip(level, errors)]
        if min(errors) >= best:
            break
        best = min(errors)
        top = [c for _, c in sorted(zip(errors, level))[:branches]]
        if sprint == 0:
            alive = [f for f in alive if any(f in c and g >= least_gain for c, g in gains.items())]
        level = [tuple(sorted({*c, f})) for c in top for f in alive if f not in c]
    return spark.createDataFrame(log, "sprint int, fields array<string>, error double, contribution double")


#: Which encoder a field's type gets, and the metrics of a kind of prediction.
FIELD_ENCODERS = {"float": "random", "int": "random", "boolean": "scalar", "string": "category", "timestamp": "date", "coord": "coordinate", "geo": "geo"}


def experiment(fields: list[dict], predicted: str, steps: tuple[int, ...] = (1,), window: int = 1000, categorical: bool | None = None, **parameters) -> dict:
    """The settings of an experiment from a list of fields (name, type, perhaps low and high): encoders, metrics, parameters."""
    by_name = {f["name"]: f for f in fields}
    if predicted not in by_name:
        raise ValueError(f"{predicted} is none of the fields")
    categorical = by_name[predicted]["type"] == "string" if categorical is None else categorical
    encoders = {}
    for f in fields:
        kind = FIELD_ENCODERS.get(f["type"], "random")
        if kind == "random" and "low" in f and "high" in f:
            kind = "scalar"
        encoders[f["name"]] = {"kind": kind, **{k: f[k] for k in ("low", "high") if k in f}}
    names = ["avg_err"] if categorical else ["aae", "altMAPE"]
    metrics = [{"name": n, "field": predicted, "steps": list(steps), "window": window} for n in names]
    return {"encoders": encoders, "predicted": predicted, "metrics": metrics, "optimise": f"{names[-1]}:window={window}:field={predicted}", "parameters": parameters}


def results_by_generation(reports: DataFrame) -> DataFrame:
    """generation, models, error, best of reports(params, generation, error, reported, orphan).

    Of reports on the same parameters the newest counts; orphans, whose worker was lost, don't. Maxima are taken before
    rows move, so parameters that are reported again and again make no hot key.
    """
    newest = reports.where(~F.col("orphan")).groupBy("params").agg(F.max_by(F.struct("generation", "error"), F.struct("reported", -F.col("error"), -F.col("generation"))).alias("r")).select("params", "r.*")
    best = F.min(F.struct("error", "params"))
    return newest.groupBy("generation").agg(F.count(F.lit(1)).alias("models"), best.alias("b")).select("generation", "models", F.col("b.error").cast("bigint").alias("error"), F.col("b.params").alias("best"))


def useless(swarms: DataFrame, least_gain: float) -> DataFrame:
    """fields, error, useless: combinations of fields that gain less than so many per cent on the best of their parts.

    Fields are different ones. Combinations meet by the fields that they share; a part is one that shares all it has.
    """
    named = swarms.select("fields", F.explode("fields").alias("__field"))
    parts = swarms.select(F.col("fields").alias("__part"), F.col("error").alias("__before"), F.explode("fields").alias("__field"))
    met = named.join(parts, "__field").where(F.size("fields") > F.size("__part")).groupBy("fields", "__part", "__before").agg(F.count(F.lit(1)).alias("__n"))
    least = met.where(F.col("__n") == F.size("__part")).groupBy("fields").agg(F.min("__before").alias("__before"))
    best = swarms.join(least, "fields", "left")
    return best.select("fields", "error", F.coalesce((F.col("__before") - F.col("error")) * 100 < least_gain * F.col("__before"), F.lit(False)).alias("useless"))
