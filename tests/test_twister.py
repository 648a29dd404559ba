import numpy as np
import pytest

from sparsight.sources import records, twister


def test_the_step_polynomial_has_its_known_shape():
    p = twister.step_polynomial()
    assert p.bit_length() - 1 == 19937 and p.bit_count() == 135 and p & 1


@pytest.mark.parametrize("first", [0, 1, 623, 624, 19_936, 19_937, 50_000, 1_234_567])
def test_any_place_of_the_stream(first):
    want = np.random.RandomState(42)
    want.randint(0, 2**32, first, dtype=np.uint32)
    assert twister.raw(42, first, 700).tolist() == want.randint(0, 2**32, 700, dtype=np.uint32).tolist()


def test_jumps_add_up():
    a = twister.ahead(twister.ahead(twister.seeded(7), 10**12), 10**6)
    b = twister.ahead(twister.seeded(7), 10**12 + 10**6)
    assert a[1:].tolist() == b[1:].tolist() and (a[0] ^ b[0]) & 0x80000000 == 0


def test_partitions_make_one_stream(spark):
    # the first numbers of the published generator for the seed 5489
    assert [r.bits for r in twister.numbers(spark, 5489, 5, 3).orderBy("i").collect()] == [3499211612, 581869302, 3890346734, 3586334585, 545404204]
    frames = [twister.numbers(spark, 42, 60_000, parts).orderBy("i").collect() for parts in (1, 5)]
    assert frames[0] == frames[1] == records.read(spark, "twister", seed=42, n=60_000).orderBy("i").collect()
    assert np.allclose([r.uniform for r in frames[0][:3]], np.random.RandomState(42).randint(0, 2**32, 3, dtype=np.uint32) / 2**32)
