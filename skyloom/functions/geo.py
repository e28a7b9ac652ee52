"""Column functions of the projections: cube-sphere faces, equirectangular and gnomonic maps, camera geometry.

Five conventions of cube faces are kept apart, since they differ in axes, warp and sampling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0

# fixed values: direction of a face's point (u, v), each component as (constant, u, v); y up, longitude atan2(x, z)
FACES_Y_UP = {
    "px": ((1, 0, 0), (0, 0, -1), (0, -1, 0)),
    "nx": ((-1, 0, 0), (0, 0, -1), (0, 1, 0)),
    "py": ((0, 1, 0), (1, 0, 0), (0, 0, 1)),
    "ny": ((0, 1, 0), (-1, 0, 0), (0, 0, -1)),
    "pz": ((0, 1, 0), (0, 0, -1), (1, 0, 0)),
    "nz": ((0, -1, 0), (0, 0, -1), (-1, 0, 0)),
}
# fixed values: z up, longitude atan2(y, x), in the order of the strip
FACES_Z_UP = {
    "+X": ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    "-X": ((-1, 0, 0), (0, -1, 0), (0, 0, 1)),
    "+Y": ((0, -1, 0), (1, 0, 0), (0, 0, 1)),
    "-Y": ((0, 1, 0), (-1, 0, 0), (0, 0, 1)),
    "+Z": ((0, -1, 0), (0, 0, -1), (1, 0, 0)),
    "-Z": ((0, -1, 0), (0, 0, 1), (-1, 0, 0)),
}
# fixed values: y up, longitude atan2(z, x), no warp
FACES_PLAIN = {
    "posx": ((1, 0, 0), (0, 0, -1), (0, -1, 0)),
    "negx": ((-1, 0, 0), (0, 0, -1), (0, 1, 0)),
    "posy": ((0, 1, 0), (1, 0, 0), (0, 0, 1)),
    "negy": ((0, 1, 0), (-1, 0, 0), (0, 0, -1)),
    "posz": ((0, 1, 0), (0, 0, -1), (1, 0, 0)),
    "negz": ((0, -1, 0), (0, 0, -1), (-1, 0, 0)),
}


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def wrap(c: Column, n: float) -> Column:
    return c - n * F.floor(c / n)


def direction(faces: dict, face: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    out = []
    for axis in range(3):
        parts = [(name, terms[axis]) for name, terms in faces.items()]
        c = F.lit(None).cast("double")
        for name, (k, a, b) in parts:
            c = F.when(face == name, k + a * u + b * v).otherwise(c)
        out.append(c)
    return out[0], out[1], out[2]


def warp(c: Column) -> Column:
    """Equal-angle spacing of a face's coordinate in -1..1."""
    return F.tan(math.pi / 4 * c)


def spherify(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point of the unit cube bulged onto the sphere."""

    def one(a: Column, b: Column, c: Column) -> Column:
        return a * F.sqrt(F.greatest(1 - b * b / 2 - c * c / 2 + b * b * c * c / 3, F.lit(0.0)))

    return one(x, y, z), one(y, z, x), one(z, x, y)


def lonlat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Degrees of a y-up direction."""
    r = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-10))
    return F.degrees(F.atan2(x, z)), F.degrees(F.asin(clamp(y / r, -1, 1)))


def equirect_pixel(lon: Column, lat: Column, width: int, height: int) -> tuple[Column, Column]:
    """Source pixel with wrapped columns and clamped rows."""
    px = (lon + 180) / 360 * width - 0.5
    return wrap(px, width), clamp((90 - lat) / 180 * height - 0.5, 0, height - 1)


def face_uv(lon: Column, lat: Column, offset: float = 2.0) -> tuple[Column, Column, Column]:
    """Face 0 to 5 (ties go to X, then Y, then Z) and u, v in 0..1 of a point whose latitude is moved by an offset; z up."""
    la, lo = F.radians(lat + offset), F.radians(lon)
    x, y, z = F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)
    x, y, z = F.round(x, 9), F.round(y, 9), F.round(z, 9)
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    on_x, on_y = (ax >= ay) & (ax >= az), (ay >= ax) & (ay >= az)
    face = F.when(on_x, F.when(x > 0, 0).otherwise(1)).when(on_y, F.when(y > 0, 2).otherwise(3)).otherwise(F.when(z > 0, 4).otherwise(5))
    u = F.when(on_x, F.when(x > 0, y).otherwise(-y) / ax).when(on_y, F.when(y > 0, -x).otherwise(x) / ay).otherwise(y / az)
    v = F.when(on_x, -z / ax).when(on_y, -z / ay).otherwise(F.when(z > 0, x).otherwise(-x) / az)
    return face, F.bround((u + 1) / 2, 6), F.bround((v + 1) / 2, 6)


def gnomonic(lon: Column, lat: Column, lon0: Column, lat0: Column, radius: float = EARTH) -> tuple[Column, Column, Column]:
    """Plane x, y about a centre and cos of the angle from it; the sphere stands in for the ellipsoid's datum."""
    la, la0, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    c = F.sin(la0) * F.sin(la) + F.cos(la0) * F.cos(la) * F.cos(d)
    x = radius * F.cos(la) * F.sin(d) / c
    y = radius * (F.cos(la0) * F.sin(la) - F.sin(la0) * F.cos(la) * F.cos(d)) / c
    return x, y, c


def stretch_latitude(y: Column, ratio: float = 0.6, split: float = 0.5) -> Column:
    """Piecewise linear: |y| up to `ratio` maps to the middle `split`, the rest to what is left."""
    a = F.abs(y)
    inner, outer = a * split / ratio, split + (a - ratio) * (1 - split) / (1 - ratio)
    return F.signum(y) * clamp(F.when(a <= ratio, inner).otherwise(outer), 0, 1)


def local_offset(lon: Column, lat: Column, lon0: Column, lat0: Column, radius: float = 6371000.0) -> tuple[Column, Column]:
    """Metres east and north of a point nearby."""
    return radius * F.radians(lon - lon0) * F.cos(F.radians(lat0)), radius * F.radians(lat - lat0)


def orbit(yaw: Column, pitch: Column, radius: Column) -> tuple[Column, Column, Column]:
    y, p = F.radians(yaw), F.radians(pitch)
    return radius * F.cos(p) * F.cos(y), radius * F.sin(p), radius * F.cos(p) * F.sin(y)


def ray_sphere(origin: tuple[Column, ...], ray: tuple[Column, ...], radius: float = 5.0) -> tuple[Column, tuple[Column, ...]]:
    """Distance along a unit ray to the sphere's near side, null on a miss, and the point."""
    b = sum((o * d for o, d in zip(origin[1:], ray[1:], strict=True)), origin[0] * ray[0])
    c = sum((o * o for o in origin[1:]), origin[0] * origin[0]) - radius * radius
    disc = b * b - c
    t = F.when(disc >= 0, -b - F.sqrt(F.greatest(disc, F.lit(0.0))))
    t = F.when(t >= 0, t)
    return t, tuple(o + t * d for o, d in zip(origin, ray, strict=True))


def zoom_level(distance: Column, low: int = 8, high: int = 15) -> Column:
    return clamp(F.floor(high - F.log2(F.greatest(distance, F.lit(1e-6)) * 16)), low, high).cast("int")


def zoom_depth(area: Column) -> Column:
    """Administrative depth for a box of so many square degrees."""
    return F.when(area > 50, 0).when(area > 10, 1).when(area > 2, 2).otherwise(3)


def kelvin_alpha(t: Column) -> Column:
    """Cloud opacity of a brightness temperature; 0 where there is none."""
    return F.when(t > 100, F.pow(clamp((276 - t) / 91, 0, 1), 0.7)).otherwise(F.lit(0.0))


def to_byte(c: Column) -> Column:
    """0..1 to 0..255, cut off, not rounded."""
    return F.floor(F.round(c * 255, 6)).cast("long")


def pixel_window(low: Column, high: Column, whole: Column | float, start: Column | float, size: int) -> tuple[Column, Column]:
    """First and last pixel of a span on a raster of `size` pixels that begins at `start` and is `whole` long."""
    return (clamp(F.floor(F.round((low - start) / whole * size, 6)), 0, size).cast("int"), clamp(F.floor(F.round((high - start) / whole * size, 6)), 0, size).cast("int"))
