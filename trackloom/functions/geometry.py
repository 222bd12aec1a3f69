"""Column expressions for angles, points and scalings. All run inside code generation; none is a UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def not_nan(x: Column) -> Column:
    """NaN becomes NULL: the rule for everything that comes in."""
    return F.when(~F.isnan(x), x)


def modrange(x: Column | str, lo: float, hi: float) -> Column:
    """Wrap into [lo, hi)."""
    return F.pmod(_col(x) - lo, F.lit(hi - lo)) + lo


def mod2pi(x: Column | str) -> Column:
    """Wrap into [-pi, pi)."""
    return modrange(x, -PI, PI)


def rotate(x: Column, y: Column, theta: Column) -> tuple[Column, Column]:
    """Coordinates in a frame turned by theta."""
    c, s = F.cos(theta), F.sin(theta)
    return x * c + y * s, y * c - x * s


def polar(ox: Column, oy: Column, angle: Column, dist: Column) -> tuple[Column, Column]:
    """The point at a distance and angle from an origin."""
    return ox + dist * F.cos(angle), oy + dist * F.sin(angle)


def zscore(x: Column | str, mean: Column | str | float, sd: Column | str | float) -> Column:
    """NULL where the deviation is 0."""
    return F.try_divide(_col(x) - _col(mean), _col(sd))


def unzscore(z: Column | str, mean: Column | str | float, sd: Column | str | float) -> Column:
    return _col(z) * _col(sd) + _col(mean)


def odd_root(x: Column | str, root: int = 3) -> Column:
    x = _col(x)
    return F.signum(x) * F.pow(F.abs(x), F.lit(1.0 / root))


def odd_power(x: Column | str, root: int = 3) -> Column:
    x = _col(x)
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(root)))


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Into [lo, hi]; NULL stays NULL (least and greatest alone would skip it)."""
    x = _col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def signed_sqrt(x: Column | str, limit: float) -> Column:
    """Square root of the clipped size, with the sign."""
    x = clip(x, -limit, limit)
    return F.signum(x) * F.sqrt(F.abs(x))


def signed_square(x: Column | str) -> Column:
    x = _col(x)
    return F.signum(x) * x * x


def cos_sin_to_angle(c: Column, s: Column, least_norm: float = 1e-6) -> Column:
    """Angle of (cos, sin); 0 where the pair is too short to have one."""
    return F.when(F.hypot(c, s) < least_norm, F.lit(0.0)).otherwise(F.atan2(s, c))


def dct_rows(n: int) -> list[list[float]]:
    """The orthonormal DCT-II of length n: row k is sqrt(2/n) cos(pi (2 i + 1) k / 2n), row 0 divided by sqrt 2."""
    return [[math.sqrt((1.0 if k == 0 else 2.0) / n) * math.cos(PI * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


def dct(values: list[Column]) -> list[Column]:
    """DCT of columns (the look-aheads of one feature)."""
    return [sum((v * w for v, w in zip(values[1:], row[1:])), values[0] * row[0]) for row in dct_rows(len(values))]


def idct(values: list[Column]) -> list[Column]:
    """Inverse of dct: the matrix is orthonormal, so its transpose."""
    rows = dct_rows(len(values))
    return [sum((v * rows[k][i] for k, v in enumerate(values[1:], 1)), values[0] * rows[0][i]) for i in range(len(values))]


def circle_line(px: Column, py: Column, dx: Column, dy: Column, radius: float) -> tuple[Column, Column]:
    """Distances along direction (dx, dy) from a point to the circle about the origin: forward hit, then the other one.

    NULL where the line misses the circle.
    """
    a, b, c = dx * dx + dy * dy, px * dx + py * dy, px * px + py * py - radius * radius
    root = F.when(b * b - a * c >= 0, F.sqrt(F.greatest(b * b - a * c, F.lit(0.0))))
    far, near = F.try_divide(root - b, a), F.try_divide(-root - b, a)
    swap = (far < 0) & (near >= 0)
    return F.when(swap, near).otherwise(far), F.when(swap, far).otherwise(near)


def circle_rotation(x: Column, y: Column, cx: float, cy: float) -> Column:
    """Angle about a fitted centre."""
    return F.atan2(y - cy, x - cx)


def ellipse(sxx: Column, sxy: Column, syy: Column, nsig: float = 2.0) -> tuple[Column, Column, Column]:
    """Half axes and angle of the ellipse of a 2 x 2 covariance, in closed form."""
    mid, off = (sxx + syy) / 2, F.hypot((sxx - syy) / 2, sxy)
    return F.sqrt(mid + off) * nsig, F.sqrt(F.greatest(mid - off, F.lit(0.0))) * nsig, F.atan2(2 * sxy, sxx - syy) / 2


def head_points(hx: Column, hy: Column, angle: Column, half_width: Column, height: Column) -> dict[str, tuple[Column, Column]]:
    """Eyes to the left and right of the head's base, and the antenna ahead of it."""
    return {"left": polar(hx, hy, angle, half_width), "right": polar(hx, hy, angle, -half_width), "front": polar(hx, hy, angle + PI / 2, height)}


def bin_of(x: Column | str, edges: list[float] | Column, nan_to_last: bool = False) -> Column:
    """Number of the bin whose lower edge is the last at or below x, within 0 .. K-1; NULL stays NULL (or goes last)."""
    x = _col(x)
    e = edges if isinstance(edges, Column) else F.array(*[F.lit(float(v)) for v in edges])
    k = F.size(e) - 2
    b = F.greatest(F.least(F.size(F.filter(e, lambda v: v <= x)) - 1, k), F.lit(0)).cast("int")
    return F.when(x.isNotNull(), b).otherwise(k.cast("int") if nan_to_last else None)
