"""Spherical geometry, tile addresses and climate by latitude, as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in radians of points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1 - lon2)))))


def unit_vector(lat: Column, lon: Column) -> Column:
    a, b = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z"))


def cell_size_m(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column, width: Column, height: Column) -> Column:
    """Mean of both spacings in metres, 90 where the bounds say nothing."""
    dy = (max_lat - min_lat) / height * 111320
    dx = (max_lon - min_lon) / width * 111320 * F.cos(F.radians((min_lat + max_lat) / 2))
    size = (dx + dy) / 2
    return F.when(size < 1e-3, 90.0).otherwise(size)


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + 180) / 360 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    a = F.radians(lat)
    return F.floor((1 - F.log(F.tan(a) + 1 / F.cos(a)) / math.pi) / 2 * F.pow(F.lit(2.0), zoom)).cast("long")


def smoothstep(x: Column, lo: float, hi: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    return t * t * (3 - 2 * t)


def precipitation(lat: Column, water: Column) -> Column:
    """Mean annual precipitation in mm.  Fixed values: 1560, 968; 560, 28, 128; 420, 50, 450; 160; 60; 0.55."""
    a = F.abs(lat)
    dry = F.greatest(2 - water / 0.55, F.lit(1.0))
    base = 1560 * F.exp(-a * a / 968) - 560 * F.exp(-F.pow(a - 28, 2) / 128) * dry + 420 * F.exp(-F.pow(a - 50, 2) / 450) + 160
    return F.greatest(base, F.lit(60.0)) * water / 0.55


def seasonality(lat: Column, map_mm: Column) -> Column:
    return F.pow(F.abs(lat) / 90, 0.7) * (1 - 0.8 * F.least(map_mm / 2500, F.lit(1.0)))


def glacial(lat: Column, slider: float) -> Column:
    a = F.abs(lat)
    return F.when(a >= 90 - 25 * slider, "Active").when(a >= 90 - 50 * slider, "Former").otherwise("None")


def thermal_age(km: Column, land: Column) -> Column:
    """Age of the crust from its distance to the nearest active boundary."""
    clamp = lambda x, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), x))
    return F.when(land, clamp(km / 2500, 0.3)).otherwise(clamp(km / 7000, 0.0))
