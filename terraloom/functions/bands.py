"""Column functions on bands: masks, scaling, indices, classes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of the scene classification that hide the ground; bits of the quality band (dilated cloud and cirrus are not tested).
HIDDEN_SCL, QA_BITS = (3, 8, 9, 10, 11), (2, 3, 4)
# Factor and summand by product.
SCALES = {"landsat": (0.0000275, -0.2), "sentinel2": (0.0001, 0.0), "lst_c": (0.02, -273.15), "et": (0.1, 0.0), "biomass_c": (0.47, 0.0)}


def clear_bits(qa: Column, bits: Sequence[int] = QA_BITS) -> Column:
    """True where all the bits are 0; null for a null."""
    mask = 0
    for b in bits:
        mask |= 1 << b
    return qa.bitwiseAND(F.lit(mask)) == 0


def scaled(x: Column, product: str) -> Column:
    a, b = SCALES[product]
    return x * a + b


def clamped(x: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def ratio(a: Column, b: Column, guard: float = 0.0) -> Column:
    """(a - b) / (a + b + guard); null where the denominator is zero."""
    return F.try_divide(a - b, a + b + guard)


def indices(blue: Column, green: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> dict[str, Column]:
    """The eight spectral indices."""
    return {
        "ndvi": ratio(nir, red), "ndwi": ratio(green, nir), "ndbi": ratio(swir1, nir), "nbr": ratio(nir, swir2), "mndwi": ratio(green, swir1),
        "evi": F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1),
        "bsi": F.try_divide(swir1 + red - nir - blue, swir1 + red + nir + blue),
        "savi": F.try_divide(1.5 * (nir - red), nir + red + 0.5),
    }


def priority(rules: Sequence[tuple[Column, int]], default: int) -> Column:
    """Rules in rising priority: the last one that holds decides. A null condition doesn't hold."""
    out = F.lit(default)
    for cond, value in rules:
        out = F.when(cond, F.lit(value)).otherwise(out)
    return out


def remapped(x: Column, codes: Mapping[int, int]) -> Column:
    """Null where the code isn't listed."""
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in sorted(codes.items()) for v in kv)), x)


def class_value(cls: Column, values: Mapping[int, float], default: float = 0.0) -> Column:
    return F.coalesce(remapped(cls, values), F.lit(default))


def guarded_percent(a: Column, b: Column) -> Column:
    """a of b in percent, 0 where b isn't positive."""
    return F.when(b > 0, F.try_divide(a, b) * 100).otherwise(0.0)


#: What the main run adds to the denominators of its four indices.
GUARD = 0.0001


def guarded_indices(green: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> dict[str, Column]:
    """Four indices with GUARD in the denominator: a dark cell has a value near zero instead of none."""
    return {"ndvi": ratio(nir, red, GUARD), "ndwi": ratio(green, nir, GUARD), "ndbi": ratio(swir1, nir, GUARD), "nbr": ratio(nir, swir2, GUARD)}


def clear_scene(scl: Column) -> Column:
    """True where the scene classification doesn't hide the ground; null for a null."""
    return ~scl.isin(*HIDDEN_SCL)


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def fractional_year(ts: Column) -> Column:
    return F.year(ts) + (F.month(ts) - 1) / 12.0


def pixel_area_ha(width: Column, height: Column, latitude: Column | None = None) -> Column:
    """Hectares of a pixel given in degrees: kilometres a degree of longitude shrink with the latitude (7 degrees if not given)."""
    lat = F.lit(7.0) if latitude is None else latitude
    return F.abs(width) * 111.320 * F.cos(F.radians(lat)) * F.abs(height) * 110.574 * 100


def square_ha(side: Column | float) -> Column:
    """Hectares of a square pixel whose side is in metres."""
    return F.lit(side) * F.lit(side) / 10000.0


def hillshade(slope: Column, aspect: Column, azimuth: float = 270.0, elevation: float = 45.0) -> Column:
    """Light on a slope, 0 to 255; slope and aspect in degrees."""
    s, zenith = F.radians(slope), math.radians(90.0 - elevation)
    light = math.cos(zenith) * F.cos(s) + math.sin(zenith) * F.sin(s) * F.cos(math.radians(azimuth) - F.radians(aspect))
    return F.greatest(light, F.lit(0.0)) * 255


# Least tree cover of dense and of secondary forest; least water occurrence and settlement code of the reference map.
DENSE, SECONDARY, WATER, URBAN = 60, 30, 50, 22


def standing(cover: Column, loss: Column, year: int, low: int, high: int | None = None, after: bool = False) -> Column:
    """Tree cover from low to below high without a loss before the year (`after`: up to the year)."""
    kept = (loss == 0) | ((loss > year - 2000) if after else (loss >= year - 2000))
    return (cover >= low) & (kept if high is None else (cover < high) & kept)


def reference_class(cover: Column, loss: Column, water: Column, settled: Column, year: int, mangrove: Column | None = None) -> Column:
    """The reference map: pastures, then secondary and dense forest, urban, water, mangroves; the last that holds decides."""
    rules = [(standing(cover, loss, year, SECONDARY, DENSE), 2), (standing(cover, loss, year, DENSE), 1), (settled >= URBAN, 6), (water >= WATER, 5)]
    return priority(rules + ([(mangrove >= 1, 8)] if mangrove is not None else []), 3)


def training_class(cover: Column, loss: Column, water: Column, settled: Column, year: int) -> Column:
    """Labels by rule, 0 where none holds: forests last, so that they beat water and towns."""
    dense, secondary = standing(cover, loss, year, 60, after=True), standing(cover, loss, year, 30, 60, after=True)
    wet, town = water > 80, settled >= 20
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return priority([(no(dense) & no(secondary) & no(wet) & no(town) & (cover < 30), 3), (wet, 5), (town, 6), (secondary, 2), (dense, 1)], 0)


def export_class(cover: Column, loss: Column, gain: Column, water: Column, settled: Column, ndvi: Column, year: int) -> Column:
    """The map that is published: tree cover up to 2016, with its index of greenness after; forests beat water and towns."""
    lost = (loss > 0) & (loss <= year - 2000)
    dense = (cover >= 60) & ~lost
    if year > 2016:
        dense = dense | (ndvi > 0.6) | ((gain == 1) & (cover >= 30))
    elif year == 2016:
        dense = dense | ((gain == 1) & ~lost & (cover >= 40))
    dense = F.coalesce(dense, F.lit(False))
    secondary = F.coalesce(((cover >= 25) & (cover < 60) & ~lost) | ((ndvi >= 0.35) & (ndvi < 0.6)), F.lit(False)) & ~dense
    wet, town = F.coalesce(water > 80, F.lit(False)), F.coalesce(settled >= 22, F.lit(False))
    return priority([(~dense & ~secondary & ~wet & ~town, 3), (wet, 5), (town, 6), (secondary, 2), (dense, 1)], 0)


def class_name(cls: Column, names: Mapping[int, str], prefix: str = "C") -> Column:
    """A class's name, or the prefix and its number."""
    return F.coalesce(remapped(cls, names), F.concat(F.lit(prefix), cls.cast("string")))


def mask_invalid(x: Column, valid: Column) -> Column:
    """x where valid holds, else null."""
    return F.when(valid, x)
