"""One stream of MT19937 numbers, made in parts: every partition jumps ahead to its own place, so that partitioning changes nothing.

The generator's step is linear over bits, so n steps are a polynomial in one step, reduced by the step's own polynomial of
degree 19937. That polynomial is found once from the stream (Berlekamp and Massey); t^n comes by repeated squaring. Applied
to a state, a polynomial is the exclusive or of the states that its powers lead to, which are windows of one sequence.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of MT19937: words of a state, the distance of the middle word, the twist's constant, bits of a state.
WORDS, MIDDLE, TWIST, BITS = 624, 397, 0x9908B0DF, 19937


def seeded(seed: int) -> np.ndarray:
    """The state's words after seeding with one number."""
    return np.random.RandomState(seed & 0xFFFFFFFF).get_state()[1].astype(np.uint32)


def _words(state: np.ndarray, n: int) -> np.ndarray:
    """The sequence of words that a state begins, its own included."""
    x = np.empty(max(n, WORDS), np.uint32)
    x[:WORDS] = state
    at = WORDS
    while at < n:  # a word rests on those 624, 623 and 227 before it
        k = min(WORDS - MIDDLE, n - at)
        y = (x[at - WORDS : at - WORDS + k] & np.uint32(0x80000000)) | (x[at - WORDS + 1 : at - WORDS + 1 + k] & np.uint32(0x7FFFFFFF))
        x[at : at + k] = x[at - WORDS + MIDDLE : at - WORDS + MIDDLE + k] ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), np.uint32(TWIST), np.uint32(0))
        at += k
    return x[:n]


@functools.cache
def step_polynomial() -> int:
    """The polynomial of least degree that the generator's step is a root of; bit k stands for t^k."""
    bits = (_words(seeded(5489), 2 * BITS + 64)[1:] & np.uint32(1)).tolist()
    c, b, length, since, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = (seen << 1) | bit  # bit j of seen is what came j steps ago
        if (c & seen & ((1 << (length + 1)) - 1)).bit_count() & 1:
            c, old = c ^ (b << since), c
            if 2 * length <= n:
                length, b, since = n + 1 - length, old, 0
        since += 1
    if length != BITS:
        raise RuntimeError(f"degree {length}")
    return int(format(c, f"0{BITS + 1}b")[::-1], 2)  # coefficients of what came before, turned into powers of the step


def _reduced(g: int, p: int) -> int:
    while (over := g.bit_length() - 1 - BITS) >= 0:
        g ^= p << over
    return g


@functools.cache
def power(n: int) -> int:
    """t^n, reduced."""
    p, g = step_polynomial(), 1
    for bit in bin(n)[2:]:
        g = _reduced(int("0".join(bin(g)[2:]), 2), p)  # a square has the same coefficients, a zero between each two
        if bit == "1":
            g = _reduced(g << 1, p)
    return g


def ahead(state: np.ndarray, n: int) -> np.ndarray:
    """The state after n steps of a word each, but for bits of its first word that no later word rests on."""
    if n < BITS:
        return _words(state, n + WORDS)[n:]
    g = power(n)
    windows = np.lib.stride_tricks.sliding_window_view(_words(state, BITS + WORDS), WORDS)
    used = np.flatnonzero(np.array([int(b) for b in bin(g)[:1:-1]], dtype=np.uint8))
    out = np.zeros(WORDS, np.uint32)
    for a in range(0, len(used), 1024):
        out ^= np.bitwise_xor.reduce(windows[used[a : a + 1024]], axis=0)
    return out


def raw(seed: int, first: int, n: int) -> np.ndarray:
    """Numbers first to first + n of the stream of a seed, 32 bits each."""
    generator = np.random.MT19937()
    generator.state = {"bit_generator": "MT19937", "state": {"key": ahead(seeded(seed), first), "pos": WORDS}}
    return generator.random_raw(n)


def numbers(spark: SparkSession, seed: int, n: int, partitions: int | None = None) -> DataFrame:
    """i, bits, uniform: the first n numbers of the stream of a seed, of 32 bits, and divided by 2^32; the same for any partitioning."""
    def make(batches):
        place = None
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            if place is None or ids[0] != place[1]:
                generator = np.random.MT19937()
                generator.state = {"bit_generator": "MT19937", "state": {"key": ahead(seeded(seed), int(ids[0])), "pos": WORDS}}
                place = [generator, 0]
            place[1] = int(ids[-1]) + 1
            bits = place[0].random_raw(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bits.astype(np.int64))], names=["i", "bits"])

    rows = spark.range(0, n, numPartitions=partitions) if partitions else spark.range(n)
    return rows.mapInArrow(make, "i bigint, bits bigint").select("i", "bits", (F.col("bits") / float(2**32)).alias("uniform"))
