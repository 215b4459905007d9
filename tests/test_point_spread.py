"""Point-spread estimates against scenes of a known width."""

import math

import numpy as np
import pytest

from framequery.operators import point_spread as ps
from framequery.plans import catalog


def softened(depth, sigma):
    return 0.8 * np.vectorize(lambda d: 0.5 * (1 + math.erf(d / sigma / 2**0.5)))(depth)


def grid(side=120):
    y, x = np.mgrid[:side, :side].astype(float)
    return x - side / 2, y - side / 2


@pytest.mark.parametrize("sigma", [1.0, 1.5, 2.5])
def test_limb_tells_the_width(sigma):
    x, y = grid()
    found = ps.limb_spread(softened(32.3 - np.hypot(x - 2, y + 3), sigma))
    assert abs(found["sigma"] - sigma) < 0.45 and abs(found["cx"] - 62) < 0.1 and abs(found["cy"] - 57) < 0.1 and abs(found["radius"] - 32.3) < 2.5


@pytest.mark.parametrize("sigma", [1.0, 2.0, 3.0])
@pytest.mark.parametrize("turn", [0.0, 0.3, 1.2])
def test_edge_tells_the_width(sigma, turn):
    x, y = grid()
    plane = softened(x * np.cos(turn) + y * np.sin(turn) + 3, sigma)
    assert ps.limb_spread(plane) is None
    found = ps.edge_spread(plane)
    assert abs(found["sigma"] - sigma) < 0.5 and found["wobble"] < 12
    assert abs((found["x"] - 60) * np.cos(turn) + (found["y"] - 60) * np.sin(turn) + 3) < 1.5


def test_scenes_without_a_limb_or_an_edge_give_nothing():
    x, y = grid()
    rng = np.random.default_rng(2)
    cropped = softened(32.0 - np.hypot(x - 45, y), 1.0)
    striped = softened(32.0 - np.hypot(x, y), 1.0) * (0.5 + 0.5 * np.sin(np.hypot(x, y) / 2))
    for plane in (np.zeros((120, 120)), np.full((120, 120), 0.5), cropped, striped, np.ones((8, 8))):
        assert ps.limb_spread(plane) is None
    for plane in (np.zeros((120, 120)), np.full((120, 120), 0.5), rng.random((120, 120)), np.where(x > 0, 1.0, 0.0), np.ones((8, 8))):
        assert ps.edge_spread(plane) is None


def test_candidates_are_the_steepest_crests():
    x, _ = grid()
    plane = softened(x, 1.0)
    gx, gy = ps._gradient(plane)
    at = ps.edge_candidates(plane, gx, gy)
    assert len(at) == 50 and set(at[:, 1]) == {60} and at[:, 0].min() >= 16


def test_the_cascade_takes_discs_then_edges(spark):
    rows = catalog.queries()["rg08_point_spread"](spark, "/root/testdata/sf0.001").collect()
    assert {r.frame_idx % 3: r.spread_of for r in rows} == {0: "limb", 1: "edge", 2: None}
    assert all((r.sigma is None) == (r.spread_of is None) for r in rows)
