"""The step kernel: many steps of many particles, in 2-D or 3-D, on a block of the mesh and of some steps of its fields.

Particles don't meet, so a partition of them is stepped on its own: no shuffle between steps.  The kernel walks a
particle from cell to cell, so that it stops at the first closed edge on its way.  The block goes out as a broadcast
if it is at most ``BLOCK_MB``; larger fields are stepped by joins (``dynamics.step_by_joins``), which hold nothing but
rows.

One step, from time t to t + dt:

0. what follows the state that was told last: resuspension, and the death of age;
1. what moves gets its own velocity (fall, swimming, random walk), which holds for the whole step;
2. Runge-Kutta of order 1, 2 or 4, each part of it with a search for cell and layer;
3. the search at the new place: what meets a closed edge, a dry cell or a bad place goes back to where it was, a walk
   that does not end is searched for anew and dies if that fails; the layer clips z to the water and tells what lies
   on the bottom;
4. splitting, culling, settling, floating; then the layers of those that these have moved;
5. dry cells strand particles, wet ones free them;
6. the state is given out, a dead particle's once more, as dead; then it is left out.

Random numbers depend on the seed, the step and the particle's number alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark import enums
from driftspark.session import ship

#: A field block larger than this is not broadcast.
BLOCK_MB = 200
TOLERANCE, MAX_WALK = 1e-3, 500
#: In cells at the mesh's edge, where what is beyond must not pass for within.
AT_EDGE = 1e-9
SIGMA, SLAYER, FIXED_Z = "sigma", "slayer", "fixed_z"


@dataclass
class Rules:
    """What a step does besides moving with the water."""

    order: int = 4
    use_open: bool = False
    block_dry: bool = True
    spread: float = 0.0
    spread_z: float = 0.0
    use_profile: bool = False
    fall: float = 0.0
    swim: float = 0.0
    swim_focus: float = 1.0
    critical: float | None = None
    basic_lift: bool = False
    strand: bool = False
    floats: bool = False
    cull: float = 0.0
    cull_statuses: tuple = (enums.MOVING, enums.ON_BOTTOM)
    cull_every: int = 1
    cull_rate: float = 0.0
    split: float = 0.0
    split_statuses: tuple = (enums.MOVING,)
    split_every: int = 1
    split_ages: tuple = (0.0, math.inf)
    settle: list = field(default_factory=list)
    settle_chance: float = 1.0
    settle_time: float = 0.0
    seed: int = 0
    direction: int = 1
    z0: float = 0.0003
    least_depth: float = 0.25
    density: float = 1025.0

    def draw(self, step: int, ids: np.ndarray, what: int) -> np.ndarray:
        """A number in (0, 1) by seed, step, particle and purpose."""
        with np.errstate(over="ignore"):
            h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((self.seed * 1_000_003 + step) & 0xFFFFFFFF)
            g = h + np.uint64(what) * np.uint64(0xD1B54A32D192ED03)
            g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            g = (g ^ (g >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return (((g ^ (g >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)

    def normal(self, step: int, ids: np.ndarray, what: int) -> np.ndarray:
        return np.sqrt(-2 * np.log(self.draw(step, ids, 2 * what))) * np.cos(2 * np.pi * self.draw(step, ids, 2 * what + 1))


#: Purposes of random numbers.
WALK_X, WALK_Y, WALK_Z, HEADING, LIFT = 1, 2, 3, 4, 5
CULL, CULL_RATE, SPLIT, SETTLE = 101, 102, 103, 104

#: Columns of a state.
STATE = (
    "id long, nt long, grp long, born long, max_age double, settled long, parent long, tri long, x double, y double, z double, status long, "
    "tide double, water_depth double, nz int, zf double"
)
COLUMNS = [(c.split()[0], {"long": np.int64, "double": np.float64, "int": np.int32}[c.split()[1]]) for c in STATE.split(", ")]
#: Of columns that the start has not, and of nulls.
NONE = -(1 << 62)
EMPTY = {"max_age": math.inf, "settled": NONE, "parent": NONE, "grp": 0, "z": 0.0, "tide": 0.0, "water_depth": 0.0, "nz": 0, "zf": 0.0}


@dataclass
class Block:
    """A mesh and some steps of its fields: u, v by (step, node) or (step, node, level); first: the first step's number.

    3-D: w, depth (node), tide (step, node), kind and what it asks for: sigma (level), z (step, node, level), or levels
    (level); bottom: each node's first level, where the bottom is ragged.  dry: (step, tri), 0 or 1.
    friction: (step, node).  a_z: (step, node, level).
    """

    x: np.ndarray
    y: np.ndarray
    tri: np.ndarray
    adjacency: np.ndarray
    u: np.ndarray
    v: np.ndarray
    first: int
    dt: float
    dry: np.ndarray | None = None
    w: np.ndarray | None = None
    depth: np.ndarray | None = None
    tide: np.ndarray | None = None
    kind: str | None = None
    sigma: np.ndarray | None = None
    z: np.ndarray | None = None
    levels: np.ndarray | None = None
    bottom: np.ndarray | None = None
    friction: np.ndarray | None = None
    a_z: np.ndarray | None = None
    degrees: bool = False

    def __post_init__(self):
        (x0, x1, x2), (y0, y1, y2) = self.x[self.tri].T, self.y[self.tri].T
        det = (x0 - x2) * (y1 - y2) - (x1 - x2) * (y0 - y2)
        self.t = np.stack([(y1 - y2) / det, (x2 - x1) / det, (y2 - y0) / det, (x0 - x2) / det, x2, y2])
        n, m = np.nonzero(self.adjacency < 0)
        rim = np.zeros(len(self.x), bool)
        rim[self.tri[n, (m + 1) % 3]] = rim[self.tri[n, (m + 2) % 3]] = True
        self.tolerance = np.where(rim[self.tri].any(1), AT_EDGE, TOLERANCE)
        self._bins = None
        self.a_z_slope = None if self.a_z is None else self.slope(self.a_z)

    # -- where

    def barycentric(self, cell: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        t = self.t[:, cell]
        b0 = t[0] * (x - t[4]) + t[1] * (y - t[5])
        b1 = t[2] * (x - t[4]) + t[3] * (y - t[5])
        return np.stack([b0, b1, 1 - b0 - b1])

    def find(self, x: np.ndarray, y: np.ndarray, tolerance: float = AT_EDGE) -> np.ndarray:
        """The smallest triangle that holds each point, -1 where none does: by cells of a regular grid."""
        if self._bins is None:
            low, high = np.array([self.x.min(), self.y.min()]), np.array([self.x.max(), self.y.max()])
            size = max(float((high - low).max()) / max(1.0, math.sqrt(len(self.tri))), 1e-12)
            corner = np.stack([self.x[self.tri], self.y[self.tri]])
            a = np.floor((corner.min(2).T - low - tolerance) / size).astype(np.int64)
            n = np.floor((corner.max(2).T - low + tolerance) / size).astype(np.int64) - a + 1
            tri = np.repeat(np.arange(len(self.tri)), n.prod(1))
            nth = np.arange(len(tri)) - np.repeat(np.cumsum(n.prod(1)) - n.prod(1), n.prod(1))
            wide = int(np.floor((high[0] - low[0]) / size)) + 3
            key = (a[tri, 0] + nth % n[tri, 0] + 1) + (a[tri, 1] + nth // n[tri, 0] + 1) * wide
            order = np.lexsort((tri, key))
            self._bins = low, size, wide, key[order], tri[order]
        low, size, wide, keys, tris = self._bins
        out = np.full(len(x), -1)
        good = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        bx, by = np.floor((x[good] - low[0]) / size), np.floor((y[good] - low[1]) / size)
        inside = (bx >= -1) & (bx < wide - 1) & (by >= -1) & (by <= 2**31)
        good = good[inside]
        key = (bx[inside] + 1 + (by[inside] + 1) * wide).astype(np.int64)
        at, end = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
        while len(good):
            left = at < end
            good, at, end = good[left], at[left], end[left]
            if not len(good):
                break
            hit = self.barycentric(tris[at], x[good], y[good]).min(0) > -tolerance
            out[good[hit]] = tris[at[hit]]
            good, at, end = good[~hit], at[~hit] + 1, end[~hit]
        return out

    def walk(self, cell: np.ndarray, x: np.ndarray, y: np.ndarray, step: float, block_dry: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From each cell across the face of the smallest coordinate until inside: cell, coordinates, search status."""
        cell = cell.copy()
        status = np.where(np.isfinite(x) & np.isfinite(y), enums.CELL_OK, enums.BAD_COORD)
        b = self.barycentric(cell, x, y)
        todo = np.flatnonzero((status == enums.CELL_OK) & (b.min(0) <= -self.tolerance[cell]))
        closed = self.dry_index(step) > 128 if block_dry and self.dry is not None and len(todo) else None
        for _ in range(MAX_WALK):
            if not len(todo):
                break
            face = b[:, todo].argmin(0)
            ahead = self.adjacency[cell[todo], face]
            dry = np.zeros(len(todo), bool) if closed is None else (ahead >= 0) & closed[np.maximum(ahead, 0)]
            status[todo] = np.where(ahead == enums.OPEN_EDGE, enums.HIT_OPEN, np.where(ahead < 0, enums.HIT_DOMAIN, np.where(dry, enums.HIT_DRY, enums.CELL_OK)))
            go = (ahead >= 0) & ~dry
            todo = todo[go]
            cell[todo] = ahead[go]
            b[:, todo] = self.barycentric(cell[todo], x[todo], y[todo])
            todo = todo[b[:, todo].min(0) <= -self.tolerance[cell[todo]]]
        else:
            status[todo] = enums.FAILED
        return cell, b, status

    # -- when

    def weights(self, t: float) -> tuple[int, int, float]:
        """Steps before and after a time (in steps from the block's first), and the weight of the later one."""
        k = max(0, min(int(math.floor(t)), len(self.u) - 2))
        return k, min(k + 1, len(self.u) - 1), t - k

    def dry_index(self, t: float) -> np.ndarray:
        """By triangle, 0 to 255."""
        k, l, s = self.weights(t)
        return np.floor(255 * ((1 - s) * self.dry[k] + s * self.dry[l]))

    # -- values

    def flat(self, f: np.ndarray, cell: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """A field by (step, node), or (node), at places."""
        nodes = self.tri[cell].T
        if f.ndim == 1:
            return (b * f[nodes]).sum(0)
        k, l, s = self.weights(t)
        return (1 - s) * (b * f[k][nodes]).sum(0) + s * (b * f[l][nodes]).sum(0)

    def deep(self, f: np.ndarray, cell: np.ndarray, b: np.ndarray, t: float, nz: np.ndarray, zf: np.ndarray) -> np.ndarray:
        """A field by (step, node, level) at places in layer nz, zf of the way up it; a ragged bottom lifts the levels of its nodes."""
        nodes = self.tri[cell].T
        k, l, s = self.weights(t)
        below, above = np.broadcast_to(nz, nodes.shape), np.broadcast_to(nz + 1, nodes.shape)
        if self.bottom is not None:
            below, above = np.maximum(below, self.bottom[nodes]), np.maximum(above, self.bottom[nodes])
        at = lambda g: (1 - zf) * g[nodes, below] + zf * g[nodes, above]
        return (b * ((1 - s) * at(f[k]) + s * at(f[l]))).sum(0)

    def value(self, f: np.ndarray, cell, b, t, nz, zf) -> np.ndarray:
        return self.deep(f, cell, b, t, nz, zf) if f.ndim == 3 else self.flat(f, cell, b, t)

    def heights(self, t: float) -> np.ndarray:
        """Of each node's levels, at the step before t."""
        k, _, _ = self.weights(t)
        if self.kind == SLAYER:
            return self.z[k]
        if self.kind == FIXED_Z:
            return np.broadcast_to(self.levels, (len(self.x), len(self.levels)))
        return -self.depth[:, None] + self.sigma * np.maximum(self.tide[k] + self.depth, 0.01)[:, None]

    def slope(self, f: np.ndarray, z0: float = 0.0003) -> np.ndarray:
        """d/dz by level, to the next one; the top has that below it."""
        out = np.zeros_like(f)
        for k in range(len(f)):
            dz = np.diff(self.heights(float(k)), axis=1)
            out[k, :, :-1] = np.where(dz > z0, np.diff(f[k], axis=1) / np.where(dz > z0, dz, 1), 0.0)
        out[:, :, -1] = out[:, :, -2]
        return out

    # -- how deep

    def layer(self, cell, b, z, status, t: float, z0: float = 0.0003, least: float = 0.25):
        """Layer, place in it, the same for velocities (logarithmic on the bottom), z in the water, status, tide, depth."""
        n = len(cell)
        tide = self.flat(self.tide, cell, b, t) if self.tide is not None else np.zeros(n)
        depth = self.flat(self.depth, cell, b, t) if self.depth is not None else np.zeros(n)
        if self.kind is None:
            return np.zeros(n, np.int32), np.zeros(n), np.zeros(n), z, status, tide, depth
        stranded = status == enums.STRANDED
        status = status.copy()
        low = -depth
        nodes = self.tri[cell].T
        if self.kind == SIGMA:
            q = np.minimum(np.maximum(z, low), tide)
            total = np.maximum(np.abs(tide - low), least)
            f = np.clip(np.abs(q - low) / total, 0.0, 0.9999)
            nz = np.clip(np.searchsorted(self.sigma, f, "right") - 1, 0, len(self.sigma) - 2)
            zf = (f - self.sigma[nz]) / (self.sigma[nz + 1] - self.sigma[nz])
            status[status == enums.ON_BOTTOM] = enums.MOVING
            bed, touches = nz == 0, f < z0 / total
            fast = np.where(bed, logarithmic(zf, (self.sigma[1] - self.sigma[0]) * total, z0), zf)
            rest = bed & touches
            fast[rest], q[rest], status[rest] = 0.0, low[rest], enums.ON_BOTTOM
            deepest = np.zeros(n, np.int64)
        elif self.kind == SLAYER:
            k, l, s = self.weights(t)
            top = self.z.shape[2] - 1
            first = self.bottom[nodes] if self.bottom is not None else np.zeros_like(nodes)
            level = np.maximum(np.arange(top + 1)[:, None, None], first)
            height = (b * ((1 - s) * self.z[k][nodes, level] + s * self.z[l][nodes, level])).sum(1)
            deepest = np.minimum(first.min(0), top - 1)
            here = np.arange(n)
            low = height[deepest, here]
            q = np.minimum(np.maximum(z, low), height[top])
            nz = np.clip((height <= q).sum(0) - 1, deepest, top - 1)
            under, over = height[nz, here], height[nz + 1, here]
            thick = over - under
            zf = np.where(thick < z0, 0.0, (q - under) / np.where(thick < z0, 1.0, thick))
            status[status == enums.ON_BOTTOM] = enums.MOVING
            bed = nz == deepest
            rest = bed & (q < under + z0)
            q, status = np.where(rest, under, q), np.where(rest, enums.ON_BOTTOM, status)
            fast = np.where(bed, np.where(thick < z0, 0.0, logarithmic(zf, np.maximum(thick, z0), z0)), zf)
        else:
            top = len(self.levels) - 1
            first = self.bottom[nodes] if self.bottom is not None else np.zeros_like(nodes)
            deepest = np.minimum(first.min(0), top - 1)
            q = np.minimum(np.maximum(z, low), tide)
            nz = np.clip(np.searchsorted(self.levels, q, "right") - 1, 0, top - 1)
            over = np.where(nz < top - 1, self.levels[nz + 1], tide)
            zf = (q - self.levels[nz]) / np.where(over > self.levels[nz], over - self.levels[nz], 1.0)
            bed = nz <= deepest
            nz = np.maximum(nz, deepest)
            thick = np.maximum(self.levels[deepest + 1] - low, z0)
            zf = np.where(bed, (q - low) / thick, zf)
            fast = np.where(bed, logarithmic(zf, thick, z0), zf)
        nz, q = np.where(stranded, deepest, nz), np.where(stranded, low, q)
        zf, fast = np.where(stranded, 0.0, zf), np.where(stranded, 0.0, fast)
        return nz.astype(np.int32), zf, fast, q, np.where(stranded, enums.STRANDED, status), tide, depth

    # -- steps

    def advance(self, p: dict[str, np.ndarray], steps: int, per_field: float, rules: Rules, base: int = 0, offset: float = 0.0):
        """Yields the particles after each step, in arrays that the next step writes to.  p: the columns of STATE; nt: the step before which each waits.

        per_field: steps of the field in one step; negative: backwards from the block's end.  offset: the first step's
        time in the block; base: its number.
        """
        dt = self.dt * per_field
        age_step = abs(dt)
        t = offset if per_field > 0 else float(len(self.u) - 1) - offset
        for n in range(steps):
            step, here = base + n, p["nt"] <= base + n
            # what comes after the last state was told, so that a block may begin with any
            self._lift(p, here, t, step, rules, age_step)
            p["status"][here & (p["status"] > enums.DEAD) & ((step - p["born"]) * age_step > p["max_age"])] = enums.DEAD
            moving = np.flatnonzero((p["status"] == enums.MOVING) & here)
            last = {c: p[c][moving] for c in ("x", "y", "z", "tri")}
            if len(moving):
                x, y, z, cell, found, b = self._moved(p, moving, t, per_field, dt, rules, step)
            t += per_field
            if len(moving):
                self._arrive(p, moving, last, x, y, z, cell, found, rules)
            alive = np.flatnonzero((p["status"] >= enums.ALIVE) & here)
            self._layers(p, alive, t, rules)
            p = self._modified(p, alive, t, step, age_step, rules)
            here = p["nt"] <= step
            alive = np.flatnonzero((p["status"] >= enums.ALIVE) & here)
            if rules.strand and self.dry is not None:
                dry = self.dry_index(t)[p["tri"][alive]] > 128
                s = p["status"][alive]
                p["status"][alive] = np.where((s >= enums.STATIONARY) & dry, enums.STRANDED, np.where((s == enums.STRANDED) & ~dry, enums.MOVING, s))
            out = dict(p)
            out["nt"] = np.where(here, step + 1, p["nt"])
            yield out, here
            if (p["status"] <= enums.DEAD).any():
                keep = p["status"] > enums.DEAD
                p = {c: v[keep] for c, v in p.items()}

    def speed(self, cell, x, y, z, status, t: float, rules: Rules, last: tuple | None = None):
        """u, v, w at places; where the search fails, at the last good place."""
        near, b, found = self.walk(cell, x, y, t, rules.block_dry)
        bad = found != enums.CELL_OK
        if bad.any():
            x0, y0, z0 = last if last is not None else (x, y, z)
            near[bad] = cell[bad]
            b[:, bad] = self.barycentric(cell[bad], x0[bad], y0[bad])
            z = np.where(bad, z0, z)
        if self.kind is None:
            return self.flat(self.u, near, b, t), self.flat(self.v, near, b, t), np.zeros(len(x))
        nz, zf, fast, z, _, _, _ = self.layer(near, b, z, status, t, rules.z0, rules.least_depth)
        if self.bottom is not None:
            fast = zf  # on a ragged bottom the plain place counts
        return tuple(np.zeros(len(x)) if f is None else self.deep(f, near, b, t, nz, fast) for f in (self.u, self.v, self.w))

    def _moved(self, p, moving, t, per_field, dt, rules: Rules, step: int):
        x, y, z, cell, ids = (p[c][moving] for c in ("x", "y", "z", "tri", "id"))
        status = p["status"][moving]
        own = self._own_velocity(x, y, z, cell, status, t, ids, step, abs(dt), rules)
        scale = (np.cos(np.radians(y)) / 111000.0, 1 / 111000.0) if self.degrees else (1.0, 1.0)

        def at(k, part):
            return x + part * dt * (k[0] + own[0]) * scale[0], y + part * dt * (k[1] + own[1]) * scale[1], z + part * dt * (k[2] + own[2])

        ks = [self.speed(cell, x, y, z, status, t, rules)]
        for part in {1: (), 2: (0.5,), 4: (0.5, 0.5, 1.0)}[rules.order]:
            ks.append(self.speed(cell, *at(ks[-1], part), status, t + part * per_field, rules, (x, y, z)))
        weights = {1: (1,), 2: (0, 1), 4: (1 / 6, 1 / 3, 1 / 3, 1 / 6)}[rules.order]
        x, y, z = at([sum(w * k[i] for w, k in zip(weights, ks)) for i in range(3)], 1.0)
        near, b, found = self.walk(cell, x, y, t + per_field, rules.block_dry)
        return x, y, z, near, found, b

    def _own_velocity(self, x, y, z, cell, status, t, ids, step, dt, rules: Rules):
        n = len(x)
        own = [np.zeros(n), np.zeros(n), np.zeros(n)]
        if self.kind is not None:
            own[2] += rules.direction * rules.fall
        if rules.swim:
            u, v, _ = self.speed(cell, x, y, z, status, t, rules)
            heading = np.arctan2(-v, -u) + rules.normal(step, ids, HEADING) / math.sqrt(rules.swim_focus)
            own[0] += rules.swim * np.cos(heading)
            own[1] += rules.swim * np.sin(heading)
        if rules.spread:
            walk = math.sqrt(2 * dt * rules.spread) / dt
            own[0] += walk * rules.normal(step, ids, WALK_X)
            own[1] += walk * rules.normal(step, ids, WALK_Y)
        if self.kind is not None and rules.use_profile and self.a_z is not None:
            b = self.barycentric(cell, x, y)
            nz, zf, *_ = self.layer(cell, b, z, status, t, rules.z0, rules.least_depth)
            a, slope = (self.deep(f, cell, b, t, nz, zf) for f in (self.a_z, self.a_z_slope))
            own[2] += slope + np.sqrt(2 * dt * np.abs(a)) / dt * rules.normal(step, ids, WALK_Z)
        elif self.kind is not None and rules.spread_z:
            own[2] += math.sqrt(2 * dt * rules.spread_z) / dt * rules.normal(step, ids, WALK_Z)
        return own

    def _arrive(self, p, moving, last, x, y, z, cell, found, rules: Rules) -> None:
        """Puts what has moved to its new place, or back."""
        lost = found == enums.FAILED
        if lost.any():
            again = self.find(x[lost], y[lost])
            cell[lost] = np.where(again >= 0, again, cell[lost])
            found = found.copy()
            found[lost] = np.where(again >= 0, enums.CELL_OK, enums.FAILED)
            p["status"][moving[found == enums.FAILED]] = enums.DEAD
        out = (found == enums.HIT_OPEN) & rules.use_open
        good = (found == enums.CELL_OK) | out
        for c, new in (("x", x), ("y", y), ("z", z)):
            p[c][moving] = np.where(good, new, last[c])
        p["tri"][moving] = np.where(found == enums.CELL_OK, cell, last["tri"])
        p["status"][moving[out]] = enums.OUTSIDE_OPEN

    def _layers(self, p, rows, t, rules: Rules) -> None:
        if not len(rows) or (self.kind is None and self.tide is None and self.depth is None):
            return
        cell = p["tri"][rows]
        b = self.barycentric(cell, p["x"][rows], p["y"][rows])
        nz, zf, _, z, status, tide, depth = self.layer(cell, b, p["z"][rows], p["status"][rows], t, rules.z0, rules.least_depth)
        for c, new in (("nz", nz), ("zf", zf), ("z", z), ("status", status), ("tide", tide), ("water_depth", depth)):
            p[c][rows] = new

    def _modified(self, p, alive, t, step, age_step, rules: Rules):
        """Splitting, culling, settling, floating."""
        ids, status = p["id"], p["status"]
        if rules.cull and (step + 1) % rules.cull_every == 0:
            chosen = alive[np.isin(status[alive], rules.cull_statuses) & (rules.draw(step, ids[alive], CULL) <= rules.cull)]
            status[chosen] = enums.DEAD
        if rules.cull_rate:
            rate = rules.cull_rate * age_step
            chance = rate if rate <= 1e-3 else 1 - math.exp(-rate)
            status[alive[(status[alive] >= enums.STATIONARY) & (rules.draw(step, ids[alive], CULL_RATE) <= chance)]] = enums.DEAD
        if rules.settle:
            inside = alive[in_polygon(p["x"][alive], p["y"][alive], rules.settle)]
            chosen = inside[(status[inside] == enums.MOVING) & (rules.draw(step, ids[inside], SETTLE) < rules.settle_chance)]
            status[chosen] = enums.STATIONARY
            p["settled"][chosen] = step + 1
            still = np.flatnonzero((status == enums.STATIONARY) & (p["settled"] != NONE))
            freed = still[(step + 1 - p["settled"][still]) * age_step > rules.settle_time]
            status[freed] = enums.MOVING
            p["settled"][freed] = NONE
        if rules.floats:
            p["z"][alive] = p["tide"][alive]
            self._layers(p, alive[status[alive] >= enums.ALIVE], t, rules)
        if rules.split and (step + 1) % rules.split_every == 0:
            age = (step + 1 - p["born"][alive]) * age_step
            can = np.isin(status[alive], rules.split_statuses) & (age >= rules.split_ages[0]) & (age <= rules.split_ages[1])
            chosen = alive[can & (rules.draw(step, ids[alive], SPLIT) <= rules.split)]
            child = {c: v[chosen].copy() for c, v in p.items()}
            child["parent"], child["born"] = ids[chosen].copy(), np.full(len(chosen), step + 1)
            child["id"] = child_ids(ids[chosen], step)
            child["status"][:] = enums.MOVING
            p = {c: np.concatenate([v, child[c]]) for c, v in p.items()}
        return p

    def _lift(self, p, here, t, step, rules: Rules, dt: float) -> None:
        """Resuspension of what the last state tells to lie on the bottom."""
        if rules.critical is None or self.friction is None:
            return
        rows = np.flatnonzero((p["status"] == enums.ON_BOTTOM) & here)
        cell = p["tri"][rows]
        b = self.barycentric(cell, p["x"][rows], p["y"][rows])
        friction = self.flat(self.friction, cell, b, t)
        lifted = friction >= rules.critical
        rows, friction = rows[lifted], friction[lifted]
        jump = np.abs(rules.normal(step, p["id"][rows], LIFT))
        if rules.basic_lift:
            up = math.sqrt(2 * dt * rules.spread_z) * jump
        else:
            up = rules.z0 + np.sqrt(2 * 0.4 * rules.z0 * dt / (1 - 2 / math.pi) * friction) * jump
        p["z"][rows] = -p["water_depth"][rows] + up
        p["status"][rows] = enums.MOVING


def logarithmic(zf: np.ndarray, thick: np.ndarray, z0: float) -> np.ndarray:
    """The place in a bottom layer at which a linear profile has what a logarithmic one has at zf."""
    rough = z0 / thick
    return (np.log(zf + rough) - np.log(rough)) / (np.log(1.0 + rough) - np.log(rough))


def in_polygon(x: np.ndarray, y: np.ndarray, ring: list[tuple[float, float]]) -> np.ndarray:
    """Crossings of a ray to the right, modulo 2."""
    ring = [*ring, ring[0]] if tuple(ring[0]) != tuple(ring[-1]) else ring
    odd = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        level = (y > min(y1, y2)) & (y <= max(y1, y2)) & (x <= max(x1, x2))
        if x1 != x2 and y1 != y2:
            level &= x <= x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        odd ^= level
    return odd


def child_ids(ids: np.ndarray, step: int) -> np.ndarray:
    """Numbers of children, by parent and step; above 2^61, where no released particle's is."""
    with np.errstate(over="ignore"):
        g = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1) * np.uint64(0xD1B54A32D192ED03)
        g = (g ^ (g >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(27)
    return ((g >> np.uint64(3)) | np.uint64(1 << 61)).view(np.int64)


# -- in Spark

def _particles(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns of STATE, copies that may be written to."""
    names, out = batch.schema.names, {}
    for name, kind in COLUMNS:
        if name in names:
            column = batch.column(names.index(name))
            out[name] = np.array(column.fill_null(EMPTY[name]) if name in EMPTY and column.null_count else column, dtype=kind)
        elif name == "born":
            out[name] = np.array(batch.column(names.index("nt")), dtype=kind)
        else:
            out[name] = np.full(batch.num_rows, EMPTY[name], kind)
    return out


def _record(p: dict[str, np.ndarray], rows: np.ndarray) -> pa.RecordBatch:
    arrays = []
    for name, _ in COLUMNS:
        v = p[name][rows]
        gone = v == NONE if name in ("settled", "parent") else np.isinf(v) if name == "max_age" else None
        arrays.append(pa.array(v, mask=gone))
    return pa.record_batch(arrays, [name for name, _ in COLUMNS])


def _stepped(broadcast, steps: int, per_field: float, every: int, base: int, offset: float, rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = broadcast.value
        for batch in batches:
            for n, (now, there) in enumerate(block.advance(_particles(batch), steps, per_field, rules, base, offset), 1):
                if n % every == 0 or n == steps:
                    rows = np.flatnonzero(there)
                else:  # a death is told when it comes
                    rows = np.flatnonzero(there & (now["status"] <= enums.DEAD))
                if len(rows):
                    yield _record(now, rows)

    return run


#: Columns of node and of field that a block may hold, beside x, y, u and v.
NODE_FIELDS, STEP_FIELDS = ("depth", "bottom"), ("w", "tide", "z", "friction", "a_z")


def field_block(node: DataFrame, tri: DataFrame, adj: DataFrame, field: DataFrame, first: int, last: int, dt: float, kind: str | None = None, axis=None, dry: DataFrame | None = None, degrees: bool = False) -> Block | None:
    """Mesh and steps first to last of a field as arrays; None if they take more than BLOCK_MB.

    node: node, x, y, and depth, bottom where there are; field: nt, node, u, v, and w, tide, z, friction, a_z; u, v, w, z
    and a_z are arrays by level in 3-D.  axis: the fractions of a sigma grid, or the levels of a fixed one.
    dry: nt, tri, is_dry.
    """
    names = [c for c in ("u", "v", *STEP_FIELDS) if c in field.columns]
    nodes, cells, steps = node.count(), tri.count(), last - first + 1
    rows = field.where(F.col("nt").between(first, last))
    deep = {c for c in names if dict(field.dtypes)[c].startswith("array")}
    levels = max([len(axis) if axis is not None else 1, *(rows.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)) for c in sorted(deep)]).first() if deep else [])])
    numbers = nodes * (steps * sum(levels if c in deep else 1 for c in names) + 4) + cells * (6 + (steps if dry is not None else 0))
    if numbers * 8 / 1e6 > BLOCK_MB:
        return None
    n = node.orderBy("node").toPandas()
    t = tri.join(adj, "tri").orderBy("tri").toPandas()
    place = {v: i for i, v in enumerate(n.node.tolist())}
    f = rows.select("nt", "node", *names).toArrow()
    at = (f["nt"].to_numpy() - first) * nodes + np.array([place[v] for v in f["node"].to_pylist()], np.int64)
    if len(at) != steps * nodes or len(np.unique(at)) != len(at):
        raise ValueError(f"the field has {len(at)} rows of {steps * nodes} in steps {first} to {last}: each node once in each step")
    got = {}
    for c in names:
        flat = f[c].combine_chunks()
        wide = (flat.flatten() if c in deep else flat).to_numpy(zero_copy_only=False).astype(float)
        wide = wide.reshape(len(at), -1)
        out = np.empty((steps * nodes, wide.shape[1]))
        out[at] = wide
        got[c] = out.reshape(steps, nodes, -1) if c in deep else out.reshape(steps, nodes)
    more = {c: n[c].to_numpy(np.int64 if c == "bottom" else float) for c in NODE_FIELDS if c in n}
    if dry is not None:
        d = dry.where(F.col("nt").between(first, last)).select("nt", "tri", "is_dry").toArrow()
        order = {v: i for i, v in enumerate(t.tri.tolist())}
        more["dry"] = np.zeros((steps, cells))
        more["dry"][d["nt"].to_numpy() - first, [order[v] for v in d["tri"].to_pylist()]] = d["is_dry"].to_numpy().astype(float)
    if kind == SIGMA:
        more["sigma"] = np.asarray(axis, float)
    elif kind == FIXED_Z:
        more["levels"] = np.asarray(axis, float)
    corners = np.vectorize(place.__getitem__, otypes=[np.int64])(t[["n0", "n1", "n2"]].to_numpy())
    return Block(n.x.to_numpy(float), n.y.to_numpy(float), corners, t[["adj0", "adj1", "adj2"]].to_numpy(np.int64), got.pop("u"), got.pop("v"), first, dt, kind=kind, degrees=degrees, **got, **more)


def step_block(state: DataFrame, block: Block, steps: int, per_field: float = 1.0, every: int = 1, base: int = 0, offset: float = 0.0, rules: Rules | None = None, **how) -> DataFrame:
    """States (STATE) of all particles after each ``every`` steps and after the last, counted from step ``base``.

    state: id, nt, tri, x, y, status, and any of STATE.  A particle's nt is the step at which it begins; rows come for
    later steps only, and of a death at its step.  how: rules, by name.
    """
    ship(state.sparkSession)
    sent = state.sparkSession.sparkContext.broadcast(block)
    own = state.select([name for name, _ in COLUMNS if name in state.columns])
    return own.mapInArrow(_stepped(sent, steps, per_field, every, base, offset, rules or Rules(**how)), STATE)


#: What evaluate() gives.
VALUES = "id long, tri long, nz int, zf double, zfv double, z double, status long, tide double, water_depth double, u double, v double, w double, friction double, dry double"


def _evaluated(broadcast, t: float, rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = broadcast.value
        for batch in batches:
            p = _particles(batch)
            start = p["tri"] if (p["tri"] >= 0).all() else block.find(p["x"], p["y"])
            cell, b, found = block.walk(np.maximum(start, 0), p["x"], p["y"], t, False)
            good = (found == enums.CELL_OK) & (start >= 0)
            p = {c: v[good] for c, v in p.items()}
            cell, b = cell[good], b[:, good]
            nz, zf, fast, z, status, tide, depth = block.layer(cell, b, p["z"], p["status"], t, rules.z0, rules.least_depth)
            deep = zf if block.bottom is not None else fast
            none = np.zeros(len(cell))
            u, v, w, friction = (none if f is None else block.value(f, cell, b, t, nz, deep) for f in (block.u, block.v, block.w, block.friction))
            dry = none if block.dry is None else block.dry_index(t)[cell]
            cols = (p["id"], cell, nz, zf, fast, z, status, tide, depth, u, v, w, friction, dry)
            kinds = [np.int64 if k == "long" else np.int32 if k == "int" else np.float64 for _, k in (c.split() for c in VALUES.split(", "))]
            yield pa.record_batch([pa.array(np.asarray(c).astype(k)) for c, k in zip(cols, kinds)], [c.split()[0] for c in VALUES.split(", ")])

    return run


def evaluate(points: DataFrame, block: Block, t: float, rules: Rules | None = None) -> DataFrame:
    """VALUES at given points (id, nt, tri, x, y, z, status) and a time in steps from the block's first; tri: a cell to walk from, -1 for none.

    Points off the mesh give no row.
    """
    ship(points.sparkSession)
    sent = points.sparkSession.sparkContext.broadcast(block)
    own = points.select([name for name, _ in COLUMNS if name in points.columns])
    return own.mapInArrow(_evaluated(sent, t, rules or Rules()), VALUES)
