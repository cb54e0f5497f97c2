"""Dimension tables of the land-cover domain. Names, pools, look-ups and bounds must equal published ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Period key, year, first day, last day (the end of a scan is exclusive).
PERIODS = [("pre_acuerdo", 2013, "2012-01-01", "2014-12-31"), ("transicion", 2016, "2015-01-01", "2017-06-30"), ("post_acuerdo_1", 2020, "2019-01-01", "2021-06-30"), ("post_acuerdo_2", 2024, "2023-01-01", "2024-12-31")]
# Class id and name.
CLASSES = {1: "Dense forest", 2: "Secondary forest", 3: "Pastures", 4: "Crops", 5: "Water", 6: "Urban", 7: "Bare soil", 8: "Mangroves"}
# Carbon pools by class, Mg C per hectare, and their standard errors: above ground, below ground, soil, dead.
POOLS = {1: (155.0, 39.0, 65.0, 22.0), 2: (65.0, 16.0, 55.0, 10.0), 3: (5.0, 3.0, 35.0, 0.5), 4: (12.0, 3.0, 38.0, 0.5), 5: (0.0, 0.0, 0.0, 0.0), 6: (2.0, 0.0, 18.0, 0.0), 7: (0.0, 0.0, 15.0, 0.0), 8: (90.0, 25.0, 120.0, 12.0)}
POOL_ERRORS = {1: (20.0, 10.0, 15.0, 6.0), 2: (15.0, 5.0, 12.0, 4.0), 3: (2.0, 1.0, 8.0, 0.3), 4: (4.0, 1.0, 9.0, 0.3), 5: (0.0, 0.0, 0.0, 0.0), 6: (1.0, 0.0, 5.0, 0.0), 7: (0.0, 0.0, 4.0, 0.0), 8: (25.0, 8.0, 30.0, 4.0)}
#: Carbon density by class, all pools, and its standard error.
CARBON = {k: sum(v) for k, v in POOLS.items()}
CARBON_SE = {k: sum(x * x for x in v) ** 0.5 for k, v in POOL_ERRORS.items()}
# Fixed values by class: crop coefficient, recharge share, cover factor, habitat suitability, sensitivity to threats.
KC = {1: 1.0, 2: 0.85, 3: 0.60, 4: 0.70, 5: 1.20, 6: 0.30, 7: 0.15, 8: 0.90}
RECHARGE = {1: 0.35, 2: 0.30, 3: 0.15, 4: 0.18, 5: 0.0, 6: 0.05, 7: 0.10, 8: 0.25}
COVER = {1: 0.001, 2: 0.01, 3: 0.10, 4: 0.15, 5: 0.0, 6: 0.0, 7: 0.50, 8: 0.002}
HABITAT = {1: 1.0, 2: 0.7, 3: 0.2, 4: 0.15, 5: 0.6, 6: 0.0, 7: 0.0, 8: 0.95}
SENSITIVITY = {1: 0.8, 2: 0.7, 3: 0.3, 4: 0.2, 5: 0.5, 6: 0.0, 7: 0.0, 8: 0.85}
# Codes of the external land-cover map and classes; the agreement check reads code 5 as secondary forest.
EXTERNAL = {3: 1, 4: 2, 5: 8, 6: 2, 11: 2, 12: 3, 13: 3, 15: 3, 18: 4, 19: 4, 20: 4, 21: 4, 24: 6, 25: 7, 26: 5, 29: 7, 30: 7, 33: 5}
EXTERNAL_CHECK = EXTERNAL | {5: 2}
# Bands by sensor, and their common names.
LANDSAT_BANDS = {"SR_B2": "blue", "SR_B3": "green", "SR_B4": "red", "SR_B5": "nir", "SR_B6": "swir1", "SR_B7": "swir2"}
SENTINEL_BANDS = {"B2": "blue", "B3": "green", "B4": "red", "B8": "nir", "B11": "swir1", "B12": "swir2"}
# Municipalities by sub-region.
MUNICIPALITIES = {
    "antioquia_eje_bananero": ["Apartado", "Carepa", "Chigorodo", "Turbo"],
    "antioquia_norte": ["Necoclí", "San Juan de Uraba", "Arboletes", "San Pedro de Uraba"],
    "antioquia_sur": ["Mutata", "Dabeiba"],
    "antioquia_atrato": ["Murindo", "Vigia del Fuerte"],
    "choco_darien": ["Acandi", "Unguia", "Riosucio"],
}
# Forests of the hotspot and regression steps, and those of the zonal report.
FOREST, ZONAL_FOREST = (1, 2, 8), (1, 2)
# West, south, east, north.
STUDY_WINDOW = (-77.2, 7.0, -75.8, 8.9)
# Trees of the main run and of the configuration, least rows of a leaf, share of rows a tree, seed.
TREES, CONFIGURED_TREES, LEAF, BAG, SEED = 200, 500, 5, 0.632, 42
# Half widths of the approximate intervals of areas as shares, by class; default error of carbon.
AREA_CI, CARBON_ERROR = {1: 0.15, 2: 0.17, 8: 0.18}, 0.167


def periods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERIODS, "period string, year int, start string, stop string").selectExpr("period", "year", "cast(start AS date) AS start", "cast(stop AS date) AS stop")


def classes(spark: SparkSession) -> DataFrame:
    """Class, name, and what the look-ups say of it."""
    rows = [(k, name, *POOLS[k], CARBON[k], CARBON_SE[k], KC[k], RECHARGE[k], COVER[k], HABITAT[k], SENSITIVITY[k]) for k, name in CLASSES.items()]
    return spark.createDataFrame(rows, "class_id int, name string, c_above double, c_below double, c_soil double, c_dead double, carbon double, carbon_se double, kc double, recharge double, cover double, habitat double, sensitivity double")


def municipalities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, m) for r, every in MUNICIPALITIES.items() for m in every], "subregion string, municipality string")


def sql_case(column: str, values: Mapping[int, float], default: str = "0") -> str:
    """A look-up as SQL text, for engines without this table."""
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {float(v)!r}::DOUBLE" for k, v in values.items()) + f" ELSE {default} END"
