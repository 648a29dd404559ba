"""Sparse bit arrays and array kernels as column expressions.

A bit array is an ARRAY<INT> of its sorted on-bits; its width is known to the caller. Dense arrays are arrays of numbers.
Nulls follow Spark: a null array gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# -- sets of on-bits -------------------------------------------------------------------------------------------------
def unique(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def contains_all(a: Column, probe: Column) -> Column:
    """True for an empty probe."""
    return F.size(F.array_except(probe, a)) == 0


def contains_any(a: Column, probe: Column) -> Column:
    return F.size(F.array_intersect(a, probe)) > 0


def set_compare(a: Column, b: Column) -> Column:
    """struct(both, left, right)."""
    return F.struct(intersection(a, b).alias("both"), difference(a, b).alias("left"), difference(b, a).alias("right"))


def to_dense(bits: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains(bits, i.cast("int")).cast("int"))


def to_sparse(dense: Column) -> Column:
    return F.filter(F.transform(dense, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())


def cells_to_columns(cells: Column, per_column: int) -> Column:
    return unique(F.transform(cells, lambda c: F.floor(c / per_column).cast("int")))


def columns_to_cells(columns: Column, per_column: int) -> Column:
    return F.flatten(F.transform(columns, lambda c: F.sequence(c * per_column, c * per_column + (per_column - 1))))


def digits_to_bits(text: Column, separator: str = ",") -> Column:
    return F.transform(F.split(text, separator), lambda s: F.trim(s).cast("int"))


# -- arithmetic ------------------------------------------------------------------------------------------------------
def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Element-wise; a zero divisor counts as one."""
    return F.zip_with(a, b, lambda x, y: x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def rounded_divide(a: Column, b: Column, scale: int) -> Column:
    return F.transform(divide(a, b), lambda x: F.round(x, scale))


def dense_or(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("int"))


def dense_and(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("int"))


def modulo(a: Column, n) -> Column:
    """Never negative."""
    return F.transform(a, lambda x: F.pmod(x, F.lit(n)))


def clip(a: Column, low, high) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def maximum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def minimum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def raise_by(a: Column, amount, only: Column | None = None) -> Column:
    """Adds amount to all elements, or to those at the positions in `only`."""
    if only is None:
        return F.transform(a, lambda x: x + F.lit(amount))
    return F.transform(a, lambda x, i: F.when(F.array_contains(only, i), x + F.lit(amount)).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(multiply(a, b), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def variance(a: Column) -> Column:
    """Of the population."""
    return F.aggregate(a, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda t, x: F.struct((t.s + x).alias("s"), (t.q + x * x).alias("q")), lambda t: t.q / F.size(a) - F.pow(t.s / F.size(a), 2))


def exp(a: Column) -> Column:
    return F.transform(a, lambda x: F.exp(x))


def power(a: Column, p) -> Column:
    return F.transform(a, lambda x: F.pow(x, F.lit(p)))


def absolute(a: Column) -> Column:
    return F.transform(a, lambda x: F.abs(x))


def differences(a: Column) -> Column:
    """x[i+1] - x[i]."""
    return F.zip_with(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, F.size(a) - 1), lambda y, x: y - x)


def running_sum(a: Column) -> Column:
    empty = F.array().cast("array<double>")
    return F.aggregate(a, empty, lambda s, x: F.concat(s, F.array(x + F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0)))))


# -- positions -------------------------------------------------------------------------------------------------------
def gather(a: Column, at: Column) -> Column:
    return F.transform(at, lambda i: F.get(a, i))


def replace_at(a: Column, at: Column, value) -> Column:
    return F.transform(a, lambda x, i: F.when(F.array_contains(at, i), F.lit(value)).otherwise(x))


def where_set(a: Column, test, value) -> Column:
    """Elements that pass test become value: the conditional sets (less, greater, or equal)."""
    return F.transform(a, lambda x: F.when(test(x), F.lit(value)).otherwise(x))


def count_where(a: Column, test) -> Column:
    return F.size(F.filter(a, test))


def argmax(a: Column) -> Column:
    """The first position of the largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def argsort(a: Column, descending: bool = False) -> Column:
    """Positions by value, ties by position."""
    sign = -1 if descending else 1
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct((x * sign).alias("v"), i.alias("i")))), lambda s: s.i)


def greatest_positions(a: Column, n: int) -> Column:
    return F.slice(argsort(a, descending=True), 1, n)


def interleave(a: Column, b: Column) -> Column:
    return F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))


def reshape(a: Column, width: int) -> Column:
    """Rows of `width` elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda r: F.slice(a, r * width + 1, width))


def as_text(a: Column, separator: str = ",") -> Column:
    return F.concat_ws(separator, a.cast("array<string>"))


# -- grids -----------------------------------------------------------------------------------------------------------
def coordinates(index: Column, dimensions: list[int]) -> Column:
    """Row-major flat index to coordinates."""
    out, rest = [], 1
    for size in reversed(dimensions):
        out.append(F.pmod(F.floor(index / rest), F.lit(size)).cast("int"))
        rest *= size
    return F.array(*reversed(out))


def flat_index(coordinate: Column, dimensions: list[int]) -> Column:
    index = F.lit(0)
    for k, size in enumerate(dimensions):
        index = index * size + coordinate[k]
    return index


def neighbourhood(index: Column, radius: int, dimensions: list[int], wrap: bool = False) -> Column:
    """Sorted flat indices of the box around an index, cut at the borders or wrapped around."""
    at = coordinates(index, dimensions)
    found = F.array(F.lit(0))
    for k, size in enumerate(dimensions):
        if wrap:
            axis = F.array_distinct(modulo(F.sequence(at[k] - radius, at[k] + radius), size))
        else:
            axis = F.sequence(F.greatest(at[k] - radius, F.lit(0)), F.least(at[k] + radius, F.lit(size - 1)))
        found = _product(found, axis, size)
    return F.array_sort(found)


def _product(found: Column, axis: Column, size: int) -> Column:
    return F.flatten(F.transform(found, lambda f: F.transform(axis, lambda x: f * size + x)))


# -- shapes, ranges, matrices ----------------------------------------------------------------------------------------
def tail(a: Column) -> Column:
    """All but the first element."""
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def rotate(a: Column, by: int) -> Column:
    """Elements moved by so many places towards the end, those that fall off at the front."""
    return F.transform(a, lambda x, i: F.get(a, F.pmod(i - by, F.size(a)).cast("int")))


def float_range(start: Column, stop: Column, step: float) -> Column:
    """start, start + step, ... below stop."""
    count = F.greatest(F.ceil((stop - start) / step).cast("int"), F.lit(0))
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), 1, count), lambda i: start + i * F.lit(float(step)))


def linear_range(start: Column, stop: Column, n: int) -> Column:
    """n values from start to stop at equal distances, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (stop - start) * i / float(max(n - 1, 1)))


def transpose(rows: Column) -> Column:
    return F.transform(rows[0], lambda _, j: F.transform(rows, lambda r: F.get(r, j)))


def matrix_vector(rows: Column, v: Column) -> Column:
    return F.transform(rows, lambda r: dot(r, v))


def matrix_matrix(left: Column, right: Column) -> Column:
    return F.transform(left, lambda r: F.transform(transpose(right), lambda c: dot(r, c)))


# -- seeded random numbers: the same for equal seeds and keys, in any engine that has MD5 ------------------------------
def _digest(seed, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed, *keys: Column) -> Column:
    """A double from 0 (included) to 1, from 48 bits of the digest of the seed and the keys."""
    return F.conv(F.substring(_digest(seed, *keys), 1, 12), 16, 10).cast("double") / float(2**48)


def gaussian(seed, *keys: Column) -> Column:
    """A standard normal number by the polar formula over two uniform ones."""
    return F.sqrt(-2 * F.log(1 - uniform(f"{seed}a", *keys))) * F.cos(2 * F.pi() * uniform(f"{seed}b", *keys))


def choice(a: Column, seed, *keys: Column) -> Column:
    return F.get(a, F.floor(uniform(seed, *keys) * F.size(a)).cast("int"))


def shuffled(a: Column, seed, *keys: Column) -> Column:
    """a in the order of the digests of its positions."""
    ranked = F.transform(a, lambda x, i: F.struct(_digest(seed, *keys, i).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda s: s.x)


def sample(a: Column, n: int, seed, *keys: Column) -> Column:
    """n elements without replacement; all, if there are fewer."""
    return F.slice(shuffled(a, seed, *keys), 1, n)
