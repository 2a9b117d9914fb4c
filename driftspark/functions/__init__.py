"""Column expressions: bins, selections and particle properties.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftspark import enums


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def bin_of(x, origin: float, width: float) -> Column:
    """Half-open bins: floor((x - origin) / width)."""
    return F.floor((c(x) - origin) / width).cast("long")


def within(x, low: float, high: float) -> Column:
    """Half-open range, as bins are."""
    return (c(x) >= low) & (c(x) < high)


def between(x, low: float, high: float) -> Column:
    """A range with both its ends, as selections are."""
    return (c(x) >= low) & (c(x) <= high)


def has_status(statuses: list[int], column: str = "status") -> Column:
    """An empty list selects all."""
    return F.col(column).isin(statuses) if statuses else F.lit(True)


def alive(column: str = "status") -> Column:
    return F.col(column) >= enums.ALIVE


def near_seabed(z, depth, height: float) -> Column:
    return c(z) <= -c(depth) + height


def near_surface(z, tide, height: float) -> Column:
    return c(z) >= c(tide) - height


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone, however rows are dealt: 52 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c(k).cast("string") for k in keys])
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(13)), 16, 10).cast("long") / float(1 << 52)


def normal(seed: int, *keys) -> Column:
    """Box-Muller on two such numbers."""
    u = 1 - uniform(seed, *keys)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, *keys))


def bernoulli(p: float, seed: int, *keys) -> Column:
    return uniform(seed, *keys) <= p


def age(t, released) -> Column:
    """Signed: negative when going backwards."""
    return c(t) - c(released)


def decay(age_, start: float = 1.0, scale: float = 86400.0, sign: int = -1) -> Column:
    """start * exp(-|age| / scale); sign +1 is back-growth."""
    return start * F.exp(sign * F.abs(c(age_)) / scale)


def total_depth(tide, depth) -> Column:
    """At a particle."""
    return F.abs(c(tide) + c(depth))


def total_depth_field(tide, depth, least: float = 0.25) -> Column:
    """At a node: never less than the least depth."""
    return F.greatest(c(tide) + c(depth), F.lit(least))


def fractional_depth(z, tide, depth, least: float = 0.25) -> Column:
    total = total_depth(tide, depth)
    return F.when(total < least, 0.0).otherwise((c(depth) + c(z)) / F.greatest(total, F.lit(least)))


def speed(u, v) -> Column:
    return F.sqrt(c(u) * c(u) + c(v) * c(v))


def rouse(settling, friction_velocity) -> Column:
    return F.try_divide(c(settling), 0.4 * c(friction_velocity))


def stress_velocity(tx, ty, density: float = 1025.0) -> Column:
    return F.sqrt(speed(tx, ty) / density)


def friction_velocity(u, v, dz, z0: float = 0.0003) -> Column:
    """0.4 * speed / ln((dz + z0) / z0); none where the cell is no higher than the roughness."""
    return F.when(c(dz) > z0, 0.4 * speed(u, v) / F.ln((c(dz) + z0) / z0)).otherwise(0.0)


def log_layer(fraction, dz, z0: float = 0.0003) -> Column:
    """The weight of the top of the bottom cell under a logarithmic profile."""
    return F.when(c(dz) > z0, F.ln((c(fraction) * c(dz) + z0) / z0) / F.ln((c(dz) + z0) / z0)).otherwise(0.0)


def lookup(array, x) -> Column:
    """The last place (from 0) of a rising array that is no larger than x, with room for one more above."""
    array = c(array)
    return F.least(F.greatest(F.size(F.filter(array, lambda s: s <= c(x))) - 1, F.lit(0)), F.size(array) - 2)


def linear(x, x0, x1, y0, y1) -> Column:
    """The left value where the two places are the same."""
    dx = c(x1) - c(x0)
    return F.when(F.abs(dx) > 1e-6, c(y0) + (c(x) - c(x0)) * F.try_divide(c(y1) - c(y0), dx)).otherwise(c(y0))


def degrees_per_metre(latitude, mode: str = "reference") -> tuple[Column, Column]:
    """Of longitude and latitude; ``reference`` multiplies by the cosine, ``corrected`` divides by it."""
    cos = F.cos(F.radians(c(latitude)))
    return (cos / 111000.0 if mode == "reference" else F.try_divide(F.lit(1.0), 111000.0 * cos)), F.lit(1 / 111000.0)


def quantize(x, low: float, high: float) -> Column:
    """To 16 bits after clipping."""
    return F.round((F.least(F.greatest(c(x), F.lit(low)), F.lit(high)) - low) / (high - low) * 65534.0 - 32767.0).cast("short")


def dequantize(q, low: float, high: float) -> Column:
    return (c(q) + 32767.0) / 65534.0 * (high - low) + low


def dry_index(dry0, dry1, weight) -> Column:
    """0 to 255; dry above 128."""
    return F.floor(255 * ((1 - c(weight)) * c(dry0) + c(weight) * c(dry1))).cast("int")


def side(px, py, x1, y1, x2, y2) -> Column:
    """Whether the ray from a point to the right crosses an edge: ymin < y <= ymax, to the left of the crossing."""
    px, py, x1, y1, x2, y2 = map(c, (px, py, x1, y1, x2, y2))
    cross = x1 + (py - y1) * F.try_divide(x2 - x1, y2 - y1)
    return (py > F.least(y1, y2)) & (py <= F.greatest(y1, y2)) & (px <= F.greatest(x1, x2)) & ((x1 == x2) | (px <= cross))
