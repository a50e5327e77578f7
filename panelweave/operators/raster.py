"""Raster algebra over long pixel tables (pixel, x, y, date, bands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Land-cover classes that can burn, the class that cannot, the land mask value.
BURNABLE = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14)
WATER_CLASS, LAND = 17, 2
SMALL_DENOMINATOR_KM2 = 50.0


def burnable(cover: str = "lc", land: str = "lw") -> Column:
    return F.col(cover).isin(*BURNABLE) & (F.col(land) == LAND) & (F.col(cover) != WATER_CLASS)


def exact_year(cover: DataFrame, year: int) -> DataFrame:
    """The land cover of just that year; raises if there is none, never falls back to another."""
    out = cover.where(F.col("year") == year)
    if out.isEmpty():
        raise ValueError(f"no land cover for {year}")
    return out


def burnable_union(cover: DataFrame, pixel: str = "pixel") -> DataFrame:
    """(pixel, in_union): burnable in any year."""
    return cover.groupBy(pixel).agg(F.bool_or(burnable()).alias("in_union"))


def burned_any(images: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly OR over images: one row a pixel and month."""
    return images.groupBy(*keys).agg((F.max("burn_date") > 0).alias("burned"))


def zonal(pixels: DataFrame, region: list[str], mask: Column) -> DataFrame:
    """Unweighted area and count of the pixels under a mask, by region."""
    return pixels.groupBy(*region).agg(F.coalesce(F.sum(F.when(mask, F.col("area"))), F.lit(0.0)).alias("area_km2"), F.count_if(mask).alias("pixel_count"))


def good_bits(qc: str, bits: int = 3) -> Column:
    return F.col(qc).bitwiseAND(bits) == 0


def monthly_composite(obs: DataFrame, keys: list[str], value: str = "dn", qc: str = "qc") -> DataFrame:
    """Mean and number of good observations in degrees Celsius."""
    return obs.where(good_bits(qc)).groupBy(*keys).agg(F.avg(0.02 * F.col(value) - 273.15).alias("celsius"), F.count(F.lit(1)).alias("n"))


def burned_rows(zones: DataFrame) -> DataFrame:
    """Fractions with their zero-denominator flags, any-burn flag, small-denominator flag."""
    a = F.col("area_km2")
    frac = lambda d: F.when(F.col(d) > 0, a / F.col(d))
    return zones.withColumns({
        "burned_frac_union": frac("burnable_union"), "burned_frac_annual": frac("burnable_annual"), "zero_union_den_flag": (F.col("burnable_union") == 0).cast("int"), "zero_annual_den_flag": (F.col("burnable_annual") == 0).cast("int"),
        "ba_any": (a > 0).cast("int"), "small_denominator": (F.col("burnable_union") < SMALL_DENOMINATOR_KM2).cast("int"),
    })


def local_against_national(zones: DataFrame, keys: list[str], area: str = "area_km2") -> DataFrame:
    """Adds the national area of the month, and whether it is positive where the zone's is 0."""
    nat = zones.groupBy(*keys).agg(F.sum(area).alias("national_km2"))
    return zones.join(nat, keys).withColumn("zero_local_but_national", ((F.col(area) == 0) & (F.col("national_km2") > 0)).cast("int"))
