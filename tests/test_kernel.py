"""The 3-D kernel: layers against plain loops, fields against exact ones, and every part of a step."""

import math

import numpy as np
import pytest
from test_dynamics import block, go, particles, start

from driftspark import enums
from driftspark.operators import kernel

RNG = np.random.default_rng(5)


def deep(kind, levels=6, steps=3, u=0.0, v=0.0, w=0.0, depth=10.0, n=9, **more):
    """The lattice with a bottom, a tide that rises by 0.2 a step, and levels of one kind."""
    b = block(n, steps=steps)
    nodes = len(b.x)
    b.depth = np.full(nodes, depth) if np.isscalar(depth) else depth(b.x, b.y)
    b.tide = np.array([np.full(nodes, 0.2 * t) for t in range(steps)])
    b.kind, shape = kind, (steps, nodes, levels)
    s = np.linspace(0, 1, levels) ** 2
    if kind == kernel.SIGMA:
        b.sigma = s
    elif kind == kernel.SLAYER:
        b.z = -b.depth[None, :, None] + s * (b.tide + b.depth)[:, :, None]
    else:
        b.levels = np.linspace(-12, 0, levels)
        b.bottom = np.clip(np.searchsorted(b.levels, -b.depth, "right") - 1, 0, levels - 2)
    fill = lambda f: f(b) if callable(f) else np.full(shape, f)
    b.u, b.v, b.w = fill(u), fill(v), fill(w)
    for name, value in more.items():
        setattr(b, name, value)
    return b


def some(b, m=400):
    x, y = RNG.uniform(-0.95, 0.95, (2, m))
    cell = b.find(x, y)
    return cell, b.barycentric(cell, x, y), x, y, RNG.uniform(-12, 1, m)


def test_find_is_the_smallest_triangle_that_holds_the_point():
    b = block(7)
    x, y = np.concatenate([RNG.uniform(-1.2, 1.2, (2, 300)), [[0, -1, 1, np.nan], [0, -1, 1, 0]]], axis=1)
    want = [next((k for k in range(len(b.tri)) if b.barycentric(np.array([k]), np.array([p]), np.array([q])).min() > -1e-9), -1) for p, q in zip(x, y)]
    assert b.find(x, y).tolist() == want


@pytest.mark.parametrize("kind", [kernel.SIGMA, kernel.SLAYER, kernel.FIXED_Z])
@pytest.mark.parametrize("t", [0.0, 0.4, 1.7])
def test_layers_hold_their_particles(kind, t):
    b = deep(kind, depth=lambda x, y: 6 + 4 * x + y)
    cell, bc, x, y, z = some(b)
    moving = np.full(len(x), enums.MOVING)
    nz, zf, fast, q, status, tide, depth = b.layer(cell, bc, z, moving, t)
    assert depth == pytest.approx(6 + 4 * x + y) and tide == pytest.approx(0.2 * t)
    assert (q >= -depth - 1e-9).all() and (q <= tide + 1e-9).all()
    inside = (z > -depth) & (z < tide) & (status == enums.MOVING)
    assert q[inside] == pytest.approx(z[inside])
    assert ((zf > -0.05) & (zf < 1.05)).all() and (nz >= 0).all()
    if kind == kernel.FIXED_Z:
        assert (status == enums.MOVING).all()
    else:
        under = -depth + (tide + depth) * (np.linspace(0, 1, 6) ** 2)[nz]
        over = -depth + (tide + depth) * (np.linspace(0, 1, 6) ** 2)[nz + 1]
        assert (under + zf * (over - under))[inside] == pytest.approx(q[inside], abs=2e-3)
        low = z < -depth
        assert (status[low] == enums.ON_BOTTOM).all() and q[low] == pytest.approx(-depth[low])
        bed = inside & (nz == 0)
        rough = 0.0003 / (over - under)[bed]
        assert fast[bed] == pytest.approx(np.log((zf[bed] + rough) / rough) / np.log((1 + rough) / rough))
    stranded = b.layer(cell, bc, z, np.full(len(x), enums.STRANDED), t)
    assert (stranded[4] == enums.STRANDED).all() and (stranded[1] == 0).all()


def test_a_linear_field_comes_back_exactly():
    b = deep(kernel.SIGMA)
    z = -10 + b.sigma * (10 + b.tide[:, :, None])
    f = 1 + 2 * b.x[:, None] - b.y[:, None] + 0.0 * z
    cell, bc, x, y, q = some(b)
    nz, zf, *_ = b.layer(cell, bc, q, np.full(len(x), enums.MOVING), 0.5)
    assert b.deep(f, cell, bc, 0.5, nz, zf) == pytest.approx(1 + 2 * x - y)
    height = b.deep(z, cell, bc, 0.0, *b.layer(cell, bc, q, np.full(len(x), enums.MOVING), 0.0)[:2])
    inside = (q > -9.99) & (q < -0.01)
    assert height[inside] == pytest.approx(q[inside], abs=2e-3)


def test_a_ragged_bottom_lifts_the_levels():
    b = deep(kernel.FIXED_Z, depth=lambda x, y: 6 + 5 * x)
    f = np.broadcast_to(np.arange(6.0), b.u.shape).copy()
    cell, bc, x, y, q = some(b)
    nz, zf, *_ = b.layer(cell, bc, q, np.full(len(x), enums.MOVING), 0.0)
    nodes = b.tri[cell]
    want = [sum(bc[m, i] * ((1 - zf[i]) * max(b.bottom[nodes[i, m]], nz[i]) + zf[i] * max(b.bottom[nodes[i, m]], nz[i] + 1)) for m in range(3)) for i in range(len(x))]
    assert b.deep(f, cell, bc, 0.0, nz, zf) == pytest.approx(np.array(want))


def run(b, steps, z, n=1, x=0.1, y=0.1, per=1.0, status=enums.MOVING, **rules):
    cell, x, y, s = (np.repeat(v, n) for v in start(b, [x], [y]))
    p = particles(cell, x, y, np.full(n, status), z=np.full(n, float(z)), max_age=np.full(n, rules.pop("max_age", math.inf)))
    return [({c: v.copy() for c, v in now.items()}, there) for now, there in b.advance(p, steps, per, kernel.Rules(**rules))]


@pytest.mark.parametrize("order", [1, 2, 4])
def test_vertical_velocity_and_fall(order):
    b = deep(kernel.SLAYER, steps=4, w=0.01, dt=10.0)
    assert run(b, 3, -5, order=order)[-1][0]["z"][0] == pytest.approx(-5 + 3 * 10 * 0.01)
    assert run(b, 3, -5, order=order, fall=-0.03)[-1][0]["z"][0] == pytest.approx(-5 - 3 * 10 * 0.02)
    sunk = run(b, 3, -9.5, fall=-0.05)[-1][0]
    assert sunk["status"][0] == enums.ON_BOTTOM and sunk["z"][0] == pytest.approx(-10)


def test_the_bottom_slows_as_a_logarithm_says():
    b = deep(kernel.SIGMA, u=lambda b: np.broadcast_to(np.array([0, 1.0, 1, 1, 1, 1]), b.tide.shape + (6,)).copy())
    z1, h = b.sigma[1] * 10.0, 0.1
    u, _, _ = b.speed(*(v[:1] for v in start(b, [0.0], [0.0])[:3]), np.array([-10 + h]), np.array([enums.MOVING]), 0.0, kernel.Rules())
    assert u[0] == pytest.approx(math.log(h / 0.0003 + 1) / math.log(z1 / 0.0003 + 1), rel=1e-6)


def test_resuspension_comes_after_the_state_is_told():
    b = deep(kernel.SIGMA, steps=4)
    b.friction = np.full(b.tide.shape, 0.02)
    told = run(b, 2, -10, n=200, critical=0.01, seed=4)
    assert (told[0][0]["status"] == enums.ON_BOTTOM).all() and (told[1][0]["z"] > -10).all() and (told[1][0]["status"] == enums.MOVING).mean() > 0.9
    rise = told[1][0]["z"] + 10 - 0.0003
    assert np.sqrt((rise**2).mean()) == pytest.approx(math.sqrt(2 * 0.4 * 0.0003 / (1 - 2 / math.pi) * 0.02), rel=0.2)
    assert (run(b, 2, -10, n=9, critical=0.03)[-1][0]["status"] == enums.ON_BOTTOM).all()


def test_stranding_and_wetting():
    b = deep(kernel.SIGMA, steps=5)
    b.dry = np.zeros((5, len(b.tri)))
    b.dry[1:3] = 1
    states = [now["status"][0] for now, _ in run(b, 4, -1, strand=True)]
    assert states == [enums.STRANDED, enums.STRANDED, enums.MOVING, enums.ON_BOTTOM]  # where the water left it


def test_ages_end_and_the_dead_are_told_once():
    b = deep(kernel.SIGMA, steps=6)
    told = run(b, 5, -1, max_age=2.0)
    assert [now["status"].tolist() for now, _ in told] == [[10], [10], [10], [-5], []]


def test_culling_and_rates():
    b = deep(kernel.SIGMA, steps=6)
    told = run(b, 1, -1, n=4000, cull=0.25)[0][0]
    assert 850 < (told["status"] == enums.DEAD).sum() < 1150
    told = run(b, 1, -1, n=4000, cull_rate=0.5)[0][0]
    assert abs((told["status"] == enums.DEAD).mean() - (1 - math.exp(-0.5))) < 0.03


def test_splitting_keeps_numbers_apart():
    b = deep(kernel.SIGMA, steps=6)
    told = run(b, 3, -1, n=200, split=1.0)
    assert [len(now["id"]) for now, _ in told] == [400, 800, 1600]
    last = told[-1][0]
    assert len(set(last["id"].tolist())) == 1600 and set(last["born"].tolist()) == {0, 1, 2, 3}
    assert (last["parent"] != kernel.NONE).sum() == 1400


def test_settling_and_leaving():
    b = deep(kernel.SIGMA, steps=9, u=0.0)
    told = [now["status"][0] for now, _ in run(b, 6, -1, settle=[(-1, -1), (1, -1), (1, 1), (-1, 1)], settle_time=2.0)]
    assert told == [0, 0, 0, 10, 0, 0]


def test_floats_follow_the_tide():
    b = deep(kernel.SLAYER, steps=4)
    assert [now["z"][0] for now, _ in run(b, 3, -1, floats=True)] == pytest.approx([0.2, 0.4, 0.6])


def test_a_failed_walk_is_searched_for_and_dies_outside(monkeypatch):
    monkeypatch.setattr(kernel, "MAX_WALK", 1)
    b = block(steps=3, u=lambda x, y, t: 0.7, v=lambda x, y, t: 0.0)
    cell, x, y, s = go(b, *start(b, [-0.5, 0.5], [0.1, 0.1]), 1, 1.0, order=1)
    assert s.tolist() == [enums.MOVING, enums.DEAD] and x[0] == pytest.approx(0.2) and cell[0] == b.find(x[:1], y[:1])[0]


def test_vertical_walk_spreads():
    b = deep(kernel.SIGMA, steps=3, depth=1000.0)
    z = run(b, 10, -500, n=4000, per=0.1, spread_z=0.5)[-1][0]["z"]
    assert np.var(z) == pytest.approx(2 * 0.5 * 1.0, rel=0.1)
    b.a_z = np.broadcast_to(np.linspace(0.1, 0.1, 6), b.u.shape).copy()
    b.a_z_slope = b.slope(b.a_z)
    z = run(b, 10, -500, n=4000, per=0.1, use_profile=True)[-1][0]["z"]
    assert np.var(z) == pytest.approx(2 * 0.1 * 1.0, rel=0.1)


def test_swimming_against_the_current():
    b = block(steps=3, u=lambda x, y, t: 0.1, v=lambda x, y, t: 0.0)
    x = go(b, *(np.repeat(v, 500) for v in start(b, [0.0], [0.0])), 1, 1.0, order=1, swim=0.1, swim_focus=1e6)[1]
    assert x == pytest.approx(0.0, abs=1e-3)


def test_degrees():
    b = block(steps=3, u=lambda x, y, t: 1000.0, v=lambda x, y, t: 1000.0)
    b.degrees = True
    _, x, y, _ = go(b, *start(b, [0.0], [0.5]), 1, 1.0, order=1)
    assert x[0] == pytest.approx(1000 * math.cos(math.radians(0.5)) / 111000) and y[0] == pytest.approx(0.5 + 1000 / 111000)
