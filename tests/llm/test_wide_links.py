"""The search over wide fingerprints finds every pair within its distance."""

from functools import partial

import numpy as np
import pytest

from meshlark.llm import simhash
from meshlark.operators.components import connected_components


def turned(fp, bits):
    out = fp.copy()
    for b in bits:
        out[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return out


@pytest.mark.parametrize(("tile", "few"), [(1 << 18, 1500), (1 << 18, 3), (64, 1500)])
def test_every_pair_at_the_distance_is_linked(spark, tile, few, monkeypatch):
    """300 pairs of 38 to 42 bits, and a group of copies that differ a little: components as by brute force."""
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(3)
    first = rng.integers(0, 2**64, (300, simhash.WIDE), dtype=np.uint64)
    fps = [*first, *(turned(f, rng.choice(256, 38 + i % 5, replace=False)) for i, f in enumerate(first)), *(turned(first[0], rng.choice(256, 10, replace=False)) for _ in range(150))]
    fps = np.unique(np.array(fps), axis=0)
    close = np.bitwise_count(fps[:, None] ^ fps[None]).sum(-1, dtype=np.int64) <= simhash.WIDE_DISTANCE
    want = np.arange(len(fps))
    while not np.array_equal(least := np.where(close, want[None], len(fps)).min(1), want):
        want = least
    keys = simhash.wide_keys(fps)
    columns = [f"w{i}" for i in range(simhash.WIDE)]
    signed = fps.view(np.int64).tolist()
    frame = spark.createDataFrame([(n, *w) for n, w in enumerate(signed)], f"node long, {', '.join(f'{c} long' for c in columns)}")
    dealt = spark.createDataFrame([(k, n, *w) for n, w in enumerate(signed) for k in keys[n].tolist()], f"key long, node long, {', '.join(f'{c} long' for c in columns)}")
    links = simhash.block_links(dealt, partial(simhash.wide_links, distance=simhash.WIDE_DISTANCE), tile, frame)
    got = np.arange(len(fps))
    for r in connected_components(links).collect():
        got[r.node] = r.component
    assert len(set(want.tolist())) < 500 and got.tolist() == want.tolist()
