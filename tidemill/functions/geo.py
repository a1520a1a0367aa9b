"""Geohashes of 52 bits, longitude on even bits, and great-circle distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
STEPS = 26
MAX_LAT = 85.05112878
MAX_LON = 180.0
EARTH_RADIUS = 6372797.560856
METRES = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}


def spread(x: Column) -> Column:
    """The bits of x at the even places."""
    return F.conv(F.regexp_replace(F.bin(x), "(.)", "0$1"), 2, 10).cast("long")


def squash(x: Column) -> Column:
    """The bits of x at the even places, next to each other."""
    return F.conv(F.regexp_replace(F.lpad(F.bin(x), 2 * STEPS + 2, "0"), ".(.)", "$1"), 2, 10).cast("long")


def cell(value: Column, least: float, most: float) -> Column:
    return F.floor((value - least) / (most - least) * float(1 << STEPS)).cast("long")


def encode(lon: Column, lat: Column) -> Column:
    """The 52-bit hash of a position."""
    return spread(cell(lon, -MAX_LON, MAX_LON)).bitwiseOR(F.shiftleft(spread(cell(lat, -MAX_LAT, MAX_LAT)), 1))


def centre(index: Column, least: float, most: float) -> Column:
    return (index.cast("double") + 0.5) / float(1 << STEPS) * (most - least) + least


def decode(code: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of the hash's cell."""
    return centre(squash(code), -MAX_LON, MAX_LON), centre(squash(F.shiftrightunsigned(code, 1)), -MAX_LAT, MAX_LAT)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """Haversine."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return 2.0 * EARTH_RADIUS * F.asin(F.sqrt(h)) / METRES[unit]


def search(points: DataFrame, lon: float, lat: float, radius: float, unit: str = "m") -> DataFrame:
    """points (member, code) within radius of a position, with lon, lat and dist in unit; a band of latitudes is cut out first."""
    x, y = decode(F.col("code"))
    metres = radius * METRES[unit]
    band = F.degrees(F.lit(metres / EARTH_RADIUS)) + 1e-6
    near = points.withColumn("lon", x).withColumn("lat", y).where(F.abs(F.col("lat") - lat) <= band)
    near = near.withColumn("dist", distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"), unit))
    return near.where(F.col("dist") <= radius)
