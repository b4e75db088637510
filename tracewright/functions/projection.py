"""Map projection and pose arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS84 ellipsoid and the UTM scale and false origin.
RADIUS, E2, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 0.00669438, 0.9996, 500000.0, 10000000.0
EP2 = E2 / (1 - E2)
#: Radius of great-circle lengths.
SPHERE = 6371000.0
#: Coefficients of the meridian arc, for phi and the sines of its even multiples.
ARC = (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024, 15 * E2**2 / 256 + 45 * E2**3 / 1024, 35 * E2**3 / 3072)
E1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
#: The same for the footpoint latitude.
FOOT = (3 / 2 * E1 - 27 / 32 * E1**3, 21 / 16 * E1**2 - 55 / 32 * E1**4, 151 / 96 * E1**3, 1097 / 512 * E1**4)
BANDS = "CDEFGHJKLMNPQRSTUVWXX"


def utm_zone(lat: Column, lon: Column) -> Column:
    """The zone number, with the exceptions of south-west Norway and Svalbard."""
    plain = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    svalbard = (lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42)
    return (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
        .when(svalbard & (lon < 9), 31).when(svalbard & (lon < 21), 33).when(svalbard & (lon < 33), 35).when(svalbard, 37)
        .otherwise(plain).cast("int")
    )


def utm_letter(lat: Column) -> Column:
    """The latitude band, null outside 80 S to 84 N."""
    return F.when(lat.between(-80, 84), F.substring(F.lit(BANDS), (F.floor((lat + 80) / 8) + 1).cast("int"), F.lit(1)))


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in the given zone; in the south northings count from the false origin."""
    phi = F.radians(lat)
    return _planar(lat, phi, F.radians(lon - (zone * 6 - 183)), F.sin(phi), F.cos(phi), F.tan(phi))


def _planar(lat: Column, phi: Column, d: Column, sin: Column, cos: Column, tan: Column) -> tuple[Column, Column]:
    t, c, a = tan * tan, EP2 * cos * cos, cos * d
    n = RADIUS / F.sqrt(1 - E2 * sin * sin)
    m = RADIUS * (ARC[0] * phi - ARC[1] * F.sin(2 * phi) + ARC[2] * F.sin(4 * phi) - ARC[3] * F.sin(6 * phi))
    x = SCALE * n * (a + (1 - t + c) * F.pow(a, F.lit(3)) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * F.pow(a, F.lit(5)) / 120) + FALSE_EAST
    y = SCALE * (m + n * tan * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, F.lit(4)) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * F.pow(a, F.lit(6)) / 720))
    return x, y + F.when(lat < 0, FALSE_NORTH).otherwise(0.0)


def utm_points(points: Column, zone: Column, lat, lon) -> Column:
    """An array's points as x, y of the zone; lat and lon get them from an element. In steps, as a lambda works out each value as often as it is named."""
    angles = F.transform(points, lambda p: F.struct(lat(p).alias("lat"), F.radians(lat(p)).alias("phi"), F.radians(lon(p) - (zone * 6 - 183)).alias("d")))
    known = F.transform(angles, lambda p: F.struct(p["lat"], p["phi"], p["d"], F.sin(p["phi"]).alias("sin"), F.cos(p["phi"]).alias("cos"), F.tan(p["phi"]).alias("tan")))
    return F.transform(known, lambda p: F.struct(*(v.alias(n) for n, v in zip("xy", _planar(*(p[c] for c in ("lat", "phi", "d", "sin", "cos", "tan"))), strict=True))))


def to_latlon(x: Column, y: Column, zone: Column, north: Column | bool = True) -> tuple[Column, Column]:
    """Latitude and longitude of a point of the given zone."""
    phi = _foot(y, north)
    return _geographic(x, phi, F.sin(phi), F.cos(phi), F.tan(phi), zone)


def latlon_points(points: Column, zone: Column, north: Column | bool = True) -> Column:
    """An array's points (x, y) as lat, lon, in steps (see utm_points)."""
    feet = F.transform(points, lambda p: F.struct(p["x"].alias("x"), _foot(p["y"], north).alias("phi")))
    known = F.transform(feet, lambda p: F.struct(p["x"], p["phi"], F.sin(p["phi"]).alias("sin"), F.cos(p["phi"]).alias("cos"), F.tan(p["phi"]).alias("tan")))
    return F.transform(known, lambda p: F.struct(*(v.alias(n) for n, v in zip(("lat", "lon"), _geographic(*(p[c] for c in ("x", "phi", "sin", "cos", "tan")), zone), strict=True))))


def _foot(y: Column, north: Column | bool) -> Column:
    """The footpoint latitude."""
    south = F.when(F.lit(north) if isinstance(north, bool) else north, 0.0).otherwise(FALSE_NORTH)
    mu = (y - south) / SCALE / (RADIUS * ARC[0])
    phi = mu
    for i, k in enumerate(FOOT):
        phi = phi + k * F.sin(2 * (i + 1) * mu)
    return phi


def _geographic(x: Column, phi: Column, sin: Column, cos: Column, tan: Column, zone: Column) -> tuple[Column, Column]:
    t, c, w = tan * tan, EP2 * cos * cos, 1 - E2 * sin * sin
    n, r = RADIUS / F.sqrt(w), RADIUS * (1 - E2) / F.pow(w, F.lit(1.5))
    d = (x - FALSE_EAST) / (n * SCALE)
    lat = phi - n * tan / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * F.pow(d, F.lit(4)) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * F.pow(d, F.lit(6)) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, F.lit(3)) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * F.pow(d, F.lit(5)) / 120) / cos
    return F.degrees(lat), F.degrees(lon) + (zone * 6 - 183)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * SPHERE * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def heading_deg(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Compass heading of a quaternion, one decimal, from 0 up to 360."""
    yaw = F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))
    return F.round(F.pmod(90 - yaw, F.lit(360.0)), 1)


def ground_speed(vx: Column, vy: Column) -> Column:
    return F.round(F.sqrt(vx * vx + vy * vy), 2)


def rigid_transform(x: Column, y: Column, z: Column, m: list[list[float]], flat: float | None = None) -> tuple[Column, Column, Column]:
    """The point under the 4x4 matrix m; flat, if given, is the new z."""
    moved = [m[i][0] * x + m[i][1] * y + m[i][2] * z + m[i][3] for i in range(3)]
    return moved[0], moved[1], moved[2] if flat is None else F.lit(float(flat))


def degree_margin(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """A tenth of the larger extent."""
    return F.greatest(max_lat - min_lat, max_lon - min_lon) * 0.1


def circle_polygon(lat: Column, lon: Column, radius: Column, n: int) -> Column:
    """n + 1 points (lat, lon) of a closed ring about a point."""
    turn = 2 * math.pi / n

    def point(i: Column) -> Column:
        return F.struct(
            (lat + F.degrees(radius * F.cos(i * turn) / SPHERE)).alias("lat"),
            (lon + F.degrees(radius * F.sin(i * turn) / (SPHERE * F.cos(F.radians(lat))))).alias("lon"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(n)), point)


def length_label(metres: Column) -> Column:
    """'12.3 m', or 'x.xx km' above a kilometre."""
    return F.when(metres > 1000, F.format_string("%.2f km", metres / 1000)).otherwise(F.format_string("%.1f m", metres))
