"""Spherical geometry as column expressions (degrees in, kilometres out)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raincourier.settings import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def destination_point(lat: Column, lon: Column, bearing: Column, km: Column):
    """(lat, lon) reached after `km` along a bearing."""
    arc, b, phi = km / EARTH_RADIUS_KM, F.radians(bearing), F.radians(lat)
    sin_phi2 = F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(b)
    turn = F.atan2(F.sin(b) * F.sin(arc) * F.cos(phi), F.cos(arc) - F.sin(phi) * sin_phi2)
    return F.degrees(F.asin(sin_phi2)), lon + F.degrees(turn)


def unit_vector(lat: Column, lon: Column):
    """The point on the unit sphere; straight-line distance there is monotone
    in great-circle distance, which is what the grid joins rely on."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def chord_of_km(km: Column) -> Column:
    return 2 * F.sin(F.least(km / (2 * EARTH_RADIUS_KM), F.lit(1.5707963267948966)))


def intermediate_point(lat1, lon1, lat2, lon2, fraction):
    """(lat, lon) a fraction of the way along the great circle; the start
    point when both ends coincide."""
    arc = haversine_km(lat1, lon1, lat2, lon2) / EARTH_RADIUS_KM
    x1, y1, z1 = unit_vector(lat1, lon1)
    x2, y2, z2 = unit_vector(lat2, lon2)
    a = F.try_divide(F.sin((1 - fraction) * arc), F.sin(arc))
    b = F.try_divide(F.sin(fraction * arc), F.sin(arc))
    x, y, z = a * x1 + b * x2, a * y1 + b * y2, a * z1 + b * z2
    lat = F.degrees(F.atan2(z, F.hypot(x, y)))
    lon = F.degrees(F.atan2(y, x))
    return F.when(arc == 0, lat1).otherwise(lat), F.when(arc == 0, lon1).otherwise(lon)


def polyline_length_km(points: Column) -> Column:
    """Length of an array<struct<lat, lon>>."""
    legs = F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]),
    )
    return F.aggregate(legs, F.lit(0.0), lambda acc, leg: acc + leg)
