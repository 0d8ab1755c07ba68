"""Distances between points in degrees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
# The WGS-84 ellipsoid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere of the mean earth radius; null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def vincenty_m(lon1, lat1, lon2, lat2, rounds: int = 60) -> np.ndarray:
    """Metres on the WGS-84 ellipsoid by Vincenty's inverse formula, for whole arrays."""
    b = (1 - WGS84_F) * WGS84_A
    u1, u2 = (np.arctan((1 - WGS84_F) * np.tan(np.radians(np.asarray(x, float)))) for x in (lat1, lat2))
    span = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    lam = span.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.sqrt((c2 * sl) ** 2 + (c1 * s2 - s1 * c2 * cl) ** 2)
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * sl / sin_s)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a == 0, 0.0, cos_s - 2 * s1 * s2 / np.where(cos2_a == 0, 1, cos2_a))
            c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
            new = span + (1 - c) * WGS84_F * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-12
            lam = new
            if done:
                break
    k = cos2_a * (WGS84_A**2 - b**2) / b**2
    big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    ds = big_b * sin_s * (mid + big_b / 4 * (cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
    return b * big_a * (sigma - ds)


def vincenty(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """``vincenty_m`` by Arrow batches; null where a coordinate is."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(vincenty_m(a, b, c, d)).where(a.notna() & b.notna() & c.notna() & d.notna())

    return run(lon1, lat1, lon2, lat2)


METHODS = {"haversine": haversine, "vincenty": vincenty}
