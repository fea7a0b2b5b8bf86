"""Rigid frames, cameras and motion as column expressions.

Vectors are arrays of 3 doubles, matrices arrays of 9 (row by row), transforms arrays of 16.  ``T_a_b``
takes points of frame b to frame a.  Vehicle frame: x forward, y left, z up; camera: x right, y down, z ahead.
An invalid result is null.  Functions use their arguments several times: where results feed further
functions, put them into columns first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions import settings as S


def vec(*xs) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return reduce(lambda x, y: x + y, [at(a, i) * at(b, i) for i in range(n)])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    return F.array(*[at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))])


def unit(a: Column) -> Column:
    return F.array(*[F.try_divide(at(a, i), norm(a)) for i in range(3)])


def rot(axis: str, angle: Column) -> Column:
    """Rotation about one axis."""
    c, s, o, z = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    rows = {"x": (o, z, z, z, c, -s, z, s, c), "y": (c, z, s, z, o, z, -s, z, c), "z": (c, -s, z, s, c, z, z, z, o)}
    return F.array(*rows[axis])


def product3(a: Column, b: Column) -> Column:
    return F.array(*[reduce(lambda x, y: x + y, [at(a, 3 * i + k) * at(b, 3 * k + j) for k in range(3)]) for i in range(3) for j in range(3)])


def transposed(a: Column) -> Column:
    return F.array(*[at(a, 3 * j + i) for i in range(3) for j in range(3)])


def det(a: Column) -> Column:
    rows = [F.slice(a, 3 * i + 1, 3) for i in range(3)]
    return dot(rows[0], cross(rows[1], rows[2]))


def is_rotation(r: Column, tol: float = 1e-6) -> Column:
    """Whether a matrix is orthogonal with determinant 1, to a tolerance."""
    p = product3(r, transposed(r))
    near = [F.abs(at(p, 3 * i + j) - (1.0 if i == j else 0.0)) < tol for i in range(3) for j in range(3)]
    return reduce(lambda x, y: x & y, near) & (F.abs(det(r) - 1.0) < tol)


def from_axis_angle(axis: Column, angle: Column) -> Column:
    """Rotation about any axis; null for an axis of no length."""
    u, c, s = unit(axis), F.cos(angle), F.sin(angle)
    x, y, z = (at(u, i) for i in range(3))
    v = 1.0 - c
    return F.array(c + x * x * v, x * y * v - z * s, x * z * v + y * s, y * x * v + z * s, c + y * y * v, y * z * v - x * s, z * x * v - y * s, z * y * v + x * s, c + z * z * v)


def angle_of(r: Column) -> Column:
    """The angle of a rotation, 0 to pi."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (at(r, 0) + at(r, 4) + at(r, 8) - 1.0) / 2.0)))


def from_quaternion(q: Column) -> Column:
    """Rotation of a quaternion (w, x, y, z) of any length but 0."""
    n = F.sqrt(dot(q, q, 4))
    w, x, y, z = (F.try_divide(at(q, i), n) for i in range(4))
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def to_quaternion(r: Column) -> Column:
    """Unit quaternion with w >= 0, by the largest of the four squares."""
    m = [[at(r, 3 * i + j) for j in range(3)] for i in range(3)]
    squares = [1 + m[0][0] + m[1][1] + m[2][2], 1 + m[0][0] - m[1][1] - m[2][2], 1 - m[0][0] + m[1][1] - m[2][2], 1 - m[0][0] - m[1][1] + m[2][2]]
    a, b, c = m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]
    d, e, f = m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]
    table = [(squares[0], a, b, c), (a, squares[1], d, e), (b, d, squares[2], f), (c, e, f, squares[3])]
    most = F.greatest(*squares)
    q = reduce(lambda acc, k: F.when(squares[k] == most, F.array(*[x / (2.0 * F.sqrt(most)) for x in table[k]])).otherwise(acc), range(3, -1, -1), F.lit(None).cast("array<double>"))
    return F.when(at(q, 0) < 0, F.transform(q, lambda x: -x)).otherwise(q)


def transform_of(r: Column, t: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*[x for i in range(3) for x in (at(r, 3 * i), at(r, 3 * i + 1), at(r, 3 * i + 2), at(t, i))], zero, zero, zero, one)


def rotation_of(t: Column) -> Column:
    return F.array(*[at(t, 4 * i + j) for i in range(3) for j in range(3)])


def translation_of(t: Column) -> Column:
    return F.array(*[at(t, 4 * i + 3) for i in range(3)])


def inverted(t: Column) -> Column:
    """The inverse of a rigid transform."""
    back = transposed(rotation_of(t))
    return transform_of(back, F.transform(rotated(back, translation_of(t)), lambda x: -x))


def composed(*ts: Column) -> Column:
    """Product of transforms, left to right."""
    def two(a: Column, b: Column) -> Column:
        return F.array(*[reduce(lambda x, y: x + y, [at(a, 4 * i + k) * at(b, 4 * k + j) for k in range(4)]) for i in range(4) for j in range(4)])

    return reduce(two, ts)


def rotated(r: Column, v: Column) -> Column:
    return F.array(*[dot(F.slice(r, 3 * i + 1, 3), v) for i in range(3)])


def moved(t: Column, p: Column) -> Column:
    """A point taken to the other frame."""
    r = rotated(rotation_of(t), p)
    return F.array(*[at(r, i) + at(t, 4 * i + 3) for i in range(3)])


def planar(x: Column, y: Column, yaw: Column) -> Column:
    return transform_of(rot("z", yaw), F.array(x, y, F.lit(0.0)))


def yaw_of(t: Column) -> Column:
    return F.atan2(at(t, 4), at(t, 0))


def wrapped(angle: Column) -> Column:
    """An angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def looking_at(eye: Column, target: Column, up: Column) -> Column:
    """Pose of a camera at ``eye`` that looks at ``target``; null if it looks along ``up`` or nowhere."""
    ahead = unit(F.array(*[at(target, i) - at(eye, i) for i in range(3)]))
    side = cross(ahead, up)
    right = unit(side)
    down = cross(ahead, right)
    r = F.array(*[x for i in range(3) for x in (at(right, i), at(down, i), at(ahead, i))])
    return F.when(norm(side) > 1e-9, transform_of(r, eye))


def projected(p: Column, fx: float, fy: float, cx: float, cy: float, size: tuple[int, int] | None = None, skew: float = 0.0) -> Column:
    """Pixel of a point in camera coordinates; null behind the camera or outside the image."""
    x, y, z = (at(p, i) for i in range(3))
    u, v = F.try_divide(fx * x + skew * y, z) + cx, F.try_divide(fy * y, z) + cy
    ok = z > 1e-6
    if size:
        ok = ok & (u >= 0) & (u < size[0]) & (v >= 0) & (v < size[1])
    return F.when(ok, F.array(u, v))


def unprojected(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Point of a pixel at a depth along the optical axis."""
    return F.array((u - cx) / fx * depth, (v - cy) / fy * depth, depth)


def pixel_ray(t_veh_cam: Column, u: Column, v: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Direction of a pixel's ray in the vehicle frame."""
    return rotated(rotation_of(t_veh_cam), F.array((u - cx) / fx, (v - cy) / fy, F.lit(1.0)))


def on_ground(eye: Column, ray: Column, most: float) -> Column:
    """Where a ray meets z = 0; null at or above the horizon, behind, or beyond ``most``."""
    far = F.try_divide(-at(eye, 2), at(ray, 2))
    p = F.array(*[at(eye, i) + far * at(ray, i) for i in range(2)], F.lit(0.0))
    return F.when((at(ray, 2) < 0) & (far > 0) & (F.hypot(far * at(ray, 0), far * at(ray, 1)) <= most), p)


def curved(curvature: Column, s: Column) -> tuple[Column, Column, Column]:
    """x, y and heading after a way ``s`` of constant curvature; by series where the turn is tiny."""
    a = curvature * s
    small = F.abs(a) < 1e-4
    x = F.when(small, s * (1 - a * a / 6)).otherwise(F.try_divide(F.sin(a), curvature))
    y = F.when(small, s * (a / 2 - a * a * a / 24)).otherwise(F.try_divide(1 - F.cos(a), curvature))
    return x, y, a


def curvature_of(yaw_rate: Column, speed: Column) -> Column:
    """Yaw rate over speed; 0 for a standing vehicle."""
    return F.when(F.abs(speed) < 1e-6, 0.0).otherwise(F.try_divide(yaw_rate, speed))


def is_moving(speed: Column) -> Column:
    return F.abs(speed) >= S.LEAST_SPEED


def depth_bucket(distance: Column) -> Column:
    """The first bucket within its tolerance; null for none."""
    out = F.lit(None).cast("double")
    for b in reversed(S.DEPTH_BUCKETS):
        out = F.when(F.abs(distance - b) <= S.DEPTH_TOLERANCE * b, F.lit(b)).otherwise(out)
    return out


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation (error under 1e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def gaussian_contact(gap: Column, sigma: Column, floor: float = 0.02, least: float = 1e-3) -> Column:
    """Probability that a gap known to ``sigma`` is closed; small ones are 0."""
    p = normal_cdf(-gap / F.greatest(sigma, F.lit(floor)))
    return F.when(p < least, 0.0).otherwise(p)


# Depth from one view of the ground
def ground_sigma(eye: Column, ray_up: Column, ray_down: Column, most: float = float("inf")) -> Column:
    """Half the distance of the ground points of two rays a pixel error apart; infinite where either misses the ground."""
    a, b = on_ground(eye, ray_up, most), on_ground(eye, ray_down, most)
    return F.coalesce(F.hypot(at(a, 0) - at(b, 0), at(a, 1) - at(b, 1)) / 2, F.lit(float("inf")))


def height_over(eye: Column, ray: Column, x: Column, y: Column) -> Column:
    """Height of the point of a ray that is nearest in plan to ``(x, y)``; null for a vertical ray."""
    dx, dy = at(ray, 0), at(ray, 1)
    along = F.try_divide((x - at(eye, 0)) * dx + (y - at(eye, 1)) * dy, dx * dx + dy * dy)
    return at(eye, 2) + along * at(ray, 2)


def pushed(eye: Column, x: Column, y: Column, by: Column) -> tuple[Column, Column]:
    """A ground point moved away from the eye, in plan, by a distance."""
    dx, dy = x - at(eye, 0), y - at(eye, 1)
    far = F.hypot(dx, dy)
    return x + F.try_divide(dx, far) * by, y + F.try_divide(dy, far) * by


def planned_sigma(distance: Column, base: float = 0.05, per_m: float = 0.03) -> Column:
    return base + per_m * distance


# Planes: unit normal and offset, n . p + d = 0
def plane_distance(normal: Column, d: Column, p: Column) -> Column:
    return dot(normal, p) + d


def on_plane(normal: Column, d: Column, p: Column) -> Column:
    """Foot of the perpendicular from a point."""
    return F.array(*[at(p, i) - plane_distance(normal, d, p) * at(normal, i) for i in range(3)])


def tilt_deg(normal: Column, up: Column) -> Column:
    """Angle between a plane's normal and a direction, whichever way the normal points."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(normal, unit(up))))))


# Joints
def from_rpy(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Rotation by fixed axes: roll about x, then pitch about y, then yaw about z."""
    return product3(product3(rot("z", yaw), rot("y", pitch)), rot("x", roll))


def joint_motion(kind: str, axis: Column, q: Column, low: float, high: float, slack: float = 1e-9) -> Column:
    """Transform of a joint's child at ``q``; null outside the limits of a revolute or prismatic joint.  A fixed one doesn't move."""
    zero = F.array(*[F.lit(0.0)] * 3)
    still = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    if kind in ("revolute", "continuous"):
        out = transform_of(from_axis_angle(axis, q), zero)
    elif kind == "prismatic":
        out = transform_of(still, F.transform(unit(axis), lambda x: x * q))
    elif kind == "fixed":
        return transform_of(still, zero)
    else:
        raise ValueError(f"unknown joint {kind}")
    return out if kind == "continuous" else F.when(q.between(low - slack, high + slack), out)
