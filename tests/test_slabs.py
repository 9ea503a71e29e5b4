"""Sparse slabs against the loop over planes."""

import random

import pytest

from gridloom.operators import partitions


def plain(planes, slabs, least):
    share = -(-sum(planes.values()) // slabs)
    first, last = min(planes), max(planes) + 1
    cuts, held = [first], 0
    for z, n in sorted(planes.items()):
        held += n
        if held >= share and len(cuts) < slabs:
            cuts.append(z + 1)
            held = 0
    cuts += [last] * (slabs + 1 - len(cuts))
    for k in range(slabs - 1, 0, -1):
        cuts[k] = min(cuts[k], cuts[k + 1] - least)
    for k in range(1, slabs):
        cuts[k] = max(cuts[k], cuts[k - 1] + least)
    return list(zip(cuts[:-1], cuts[1:], strict=True))


@pytest.mark.parametrize("slabs", [1, 2, 5])
def test_slabs_are_those_of_the_loop(spark, slabs):
    rng = random.Random(slabs)
    for _ in range(3):
        planes = {z: rng.choice([1, 1, 2, 30, 400]) for z in rng.sample(range(-20, 60), 30)}
        rows = [(x, 0, z) for z, n in planes.items() for x in range(n)]
        cells = spark.createDataFrame(rows, "x int, y int, z int")
        assert partitions.sparse_bounds(cells, slabs, 2) == plain(planes, slabs, 2)
    counts = {r.z: r.upto for r in partitions.running_counts(cells).collect()}
    assert counts == {z: sum(n for y, n in planes.items() if y <= z) for z in planes}
    with pytest.raises(ValueError, match="too few planes"):
        partitions.sparse_bounds(cells.limit(0), slabs)
