import random

import brute_force as brute
import pytest

from tidewatch.llm import simhash
from tidewatch.llm.components import components


@pytest.mark.parametrize("bits", [1, 4, 7, 10])
def test_links_reach_their_radius(spark, bits):
    """Pairs at the radius, their differences spread over all segments, and pairs one bit beyond it."""
    rng = random.Random(bits)
    fps = set()
    for i in range(40):
        base = rng.getrandbits(64)
        first = rng.randrange(64)
        apart = [(first + 64 * k // (bits + i % 2)) % 64 for k in range(bits + i % 2)]
        fps |= {base, base ^ sum(1 << b for b in apart)}
    long = lambda x: x - (1 << 64) if x >> 63 else x
    want = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= bits)
    assert sorted({len(g) for g in want.values()}) == [1, 2]
    roots = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(long(f),) for f in fps], "fp bigint"), bits)).collect()}
    assert all(roots.get(long(f), long(f)) == min(map(long, want[f])) for f in fps)


def test_a_radius_beyond_the_fingerprint_is_refused():
    with pytest.raises(ValueError):
        simhash.segments(64)
