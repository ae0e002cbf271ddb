"""Scalar column functions: coordinates, projections, keys, text, bits, JSON, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres in a unit.
METRES = {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "us_ft": 1200.0 / 3937.0}
# Bits of a match record's flags.
FLAGS = {"inlier": 1, "track": 2, "masked": 4, "guided": 8}


def similarity(x: Column, y: Column, z: Column, scale: float, r: list[float], t: list[float]) -> list[Column]:
    """scale R p + t, R by rows."""
    return [scale * (r[3 * k] * x + r[3 * k + 1] * y + r[3 * k + 2] * z) + t[k] for k in range(3)]


def project(x: Column, y: Column, z: Column, fu: float, fv: float, cu: float, cv: float) -> tuple[Column, Column]:
    """Image place of a point in camera coordinates; null at or behind the camera."""
    ahead = z > 0
    return F.when(ahead, fu * x / z + cu), F.when(ahead, fv * y / z + cv)


def visible(u: Column, v: Column, width: float, height: float) -> Column:
    return F.coalesce((u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))


def unproject(u: Column, v: Column, depth: Column, fu: float, fv: float, cu: float, cv: float) -> list[Column]:
    return [(u - cu) * depth / fu, (v - cv) * depth / fv, depth]


def disparity_depth(disparity: Column, focal: float, baseline: float) -> Column:
    return F.when(disparity > 0, focal * baseline / disparity)


def ray_plane(origin: list[Column], direction: list[Column], z: float) -> list[Column]:
    """Where a ray meets a level plane ahead of it; nulls if it doesn't."""
    s = (z - origin[2]) / direction[2]
    ok = (direction[2] != 0) & (s > 0)
    return [F.when(ok, o + s * d) for o, d in zip(origin, direction)]


def ray_sphere(origin: list[Column], direction: list[Column], radius: float) -> Column:
    """Distance along a ray to a sphere around the origin (nearest ahead), null if it misses."""
    a = sum((d * d for d in direction[1:]), direction[0] * direction[0])
    b = 2 * sum((o * d for o, d in zip(origin[1:], direction[1:])), origin[0] * direction[0])
    c = sum((o * o for o in origin[1:]), origin[0] * origin[0]) - radius * radius
    disc = b * b - 4 * a * c
    near, far = (-b - F.sqrt(disc)) / (2 * a), (-b + F.sqrt(disc)) / (2 * a)
    return F.when(disc >= 0, F.when(near > 0, near).when(far > 0, far))


def body_fixed(lat: Column, lon: Column, radius: Column) -> list[Column]:
    """Planetocentric degrees and radius to metres."""
    la, lo = F.radians(lat), F.radians(lon)
    return [radius * F.cos(la) * F.cos(lo), radius * F.cos(la) * F.sin(lo), radius * F.sin(la)]


def map_projection(kind: str, lat: Column, lon: Column, radius: float, lon0: float = 0.0) -> tuple[Column, Column]:
    """Sphere to map: equirectangular, sinusoidal, mercator, stereographic (north)."""
    la, lo = F.radians(lat), F.radians(lon - lon0)
    if kind == "equirectangular":
        return radius * lo, radius * la
    if kind == "sinusoidal":
        return radius * lo * F.cos(la), radius * la
    if kind == "mercator":
        return radius * lo, radius * F.log(F.tan(F.lit(0.7853981633974483) + la / 2))
    if kind == "stereographic":
        k = 2 * radius * F.tan(F.lit(0.7853981633974483) - la / 2)
        return k * F.sin(lo), -k * F.cos(lo)
    raise ValueError(f"unknown projection {kind}")


def metres(value: Column, unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, k in METRES.items():
        out = F.when(F.lower(F.trim(unit)) == name, value * k).otherwise(out)
    return out


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(FLAGS[name])) != 0


def numbers(text: Column) -> Column:
    """All numbers written in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))


def ends_with_any_case(text: Column, suffix: Column) -> Column:
    return F.endswith(F.lower(text), F.lower(suffix))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as text, nulls shown, with a separator that is escaped within."""
    parts = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("\u0000")), r"\|", "||") for c in columns]
    return F.sha2(F.concat_ws("|;", *parts), 256)


def calibrated(score: Column, low: float, high: float) -> Column:
    """Scores between two anchors to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / (high - low)))


def plane_weight(d: Column, most: float, curvature: Column, most_curvature: float, least: float) -> Column:
    """Quality of a point-to-plane association, at least least."""
    def part(x: Column, m: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - x / m))

    return F.greatest(F.lit(least), part(d, most) * part(curvature, most_curvature))


def utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (north of the equator) on WGS 84, by the sixth-order series in the third flattening."""
    # The ellipsoid, the scale on the central meridian and the false easting.
    a, f, k0, e0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    la, lo = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    c = 2 * n**0.5 / (1 + n)
    t = F.sinh(F.atanh(F.sin(la)) - c * F.atanh(c * F.sin(la)))
    xi, eta = F.atan2(t, F.cos(lo)), F.atanh(F.sin(lo) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, s in enumerate(series, 1):
        east = east + s * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + s * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return e0 + k0 * radius * east, k0 * radius * north
