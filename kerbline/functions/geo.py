"""Geometry on points (x, y) and on arrays of struct<x, y>."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

EARTH_M = 6_371_008.8
# WGS84.
A, INVERSE_F = 6_378_137.0, 298.257223563


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres: within 0.6 % of the ellipsoid, for pruning and bounds."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_M)


@F.pandas_udf(T.DoubleType())
def geodesic_m(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Metres on the WGS84 ellipsoid by Vincenty's inverse formula; null where it doesn't converge."""
    f = 1 / INVERSE_F
    b = A * (1 - f)
    l1, l2 = np.radians(lat1.to_numpy(float)), np.radians(lat2.to_numpy(float))
    u1, u2 = np.arctan((1 - f) * np.tan(l1)), np.arctan((1 - f) * np.tan(l2))
    diff = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    lam = diff.copy()
    with np.errstate(all="ignore"):
        for _ in range(60):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s)
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 == 0, 0.0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2)
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = diff + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done[~np.isnan(new)].all():
                break
        k = cos2 * (A**2 - b**2) / b**2
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        delta = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        out = np.where(sin_s == 0, 0.0, b * big * (sigma - delta))
    return pd.Series(np.where(done | (sin_s == 0), out, np.nan))


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def to_utm(lon: pd.Series, lat: pd.Series, zone: pd.Series) -> pd.DataFrame:
    """Transverse Mercator (Krueger series) of a UTM zone, north."""
    n = 1 / (2 * INVERSE_F - 1)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    phi, lam = np.radians(lat.to_numpy(float)), np.radians(lon.to_numpy(float) - (zone.to_numpy(float) * 6 - 183))
    e = 2 * np.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t**2))
    x, y = eta.copy(), xi.copy()
    for j, a in enumerate(alpha, 1):
        x += a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y += a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return pd.DataFrame({"x": 500_000 + 0.9996 * radius * x, "y": 0.9996 * radius * y})


def plausible_lonlat(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-90, 90)


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def boxes_meet(xmin: Column, ymin: Column, xmax: Column, ymax: Column, box: tuple[float, float, float, float]) -> Column:
    return (xmin <= box[2]) & (xmax >= box[0]) & (ymin <= box[3]) & (ymax >= box[1])


def planar_length(line: Column, lon_scale: Column | float = 1.0) -> Column:
    """Length of a line in its own units, x scaled (by cos(lat) for degrees)."""
    scale = lon_scale if isinstance(lon_scale, Column) else F.lit(float(lon_scale))
    pairs = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.hypot((b["x"] - a["x"]) * scale, b["y"] - a["y"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(t, x, y, d): the nearest point of a segment to a point, its fraction and distance."""
    length2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), length2))), F.lit(0.0))
    x, y = ax + t * (bx - ax), ay + t * (by - ay)
    return F.struct(t.alias("t"), x.alias("x"), y.alias("y"), F.hypot(px - x, py - y).alias("d"))


def bearing_deg(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(bx - ax, by - ay)) + 360.0, F.lit(360.0))


def undirected_angle(first: Column, second: Column) -> Column:
    """0 to 90 degrees between two bearings, whichever way they point."""
    d = F.pmod(F.abs(first - second), F.lit(180.0))
    return F.least(d, 180.0 - d)


def side_of(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, dead_band: float = 0.5) -> Column:
    """1 left, -1 right, 0 within the dead band of the line through a and b."""
    offset = F.try_divide((bx - ax) * (py - ay) - (by - ay) * (px - ax), F.hypot(bx - ax, by - ay))
    return F.when(F.abs(offset) <= dead_band, 0).otherwise(F.signum(offset).cast("int"))


def densified(line: Column, spacing: float) -> Column:
    """Points every spacing units along each vertex pair, with the pair's bearing; explode it for samples."""
    pairs = F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def points(p: Column) -> Column:
        a, b = p["a"], p["b"]
        n = F.greatest(F.lit(1), F.ceil(F.hypot(b["x"] - a["x"], b["y"] - a["y"]) / spacing)).cast("int")
        at = bearing_deg(a["x"], a["y"], b["x"], b["y"])
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((a["x"] + (b["x"] - a["x"]) * i / n).alias("x"), (a["y"] + (b["y"] - a["y"]) * i / n).alias("y"), at.alias("bearing")))

    return F.flatten(F.transform(pairs, points))


def cut_points(start: Column, end: Column, fractions: Column) -> Column:
    """Pieces (from, to) of [start, end] cut at fractions of it."""
    inner = F.array_sort(F.array_distinct(F.filter(fractions, lambda f: (f > 1e-9) & (f < 1 - 1e-9))))
    stops = F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0)))
    return F.transform(F.sequence(F.lit(1), F.size(stops) - 1), lambda i: F.struct((start + (end - start) * F.get(stops, i - 1)).alias("from"), (start + (end - start) * F.get(stops, i)).alias("to")))


def geometry_issue(line: Column) -> Column:
    """Why a line can't be used, or null."""
    return (
        F.when(line.isNull(), "missing").when(F.size(line) == 0, "empty").when(F.size(line) < 2, "single_point")
        .when(F.exists(line, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])), "not_finite")
        .when(planar_length(line) == 0, "zero_length")
    )
