"""Climate records: masks, static layers and derived values of soil moisture series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.functions.scalars import absolute_moisture, absolute_noise


def record_masks(df: DataFrame, ssf: str | None = None, frozen: tuple[str, float] | None = None, snow: tuple[str, float] | None = None) -> DataFrame:
    """Keep surface states below 2 and probabilities strictly below their limits."""
    if ssf:
        df = df.where(F.col(ssf) < 2)
    for limit in (frozen, snow):
        if limit:
            df = df.where(F.col(limit[0]) < limit[1])
    return df


def index_series(df: DataFrame, columns: list[str], ssf: str = "ssf", most: float = 100) -> DataFrame:
    """Soil-water-index series: unfrozen rows (state at most 1), values above ``most`` are NULL."""
    return df.where(F.col(ssf) <= 1).withColumns({c: F.when(F.col(c) <= most, F.col(c)) for c in columns})


def with_absolute(df: DataFrame, sm: str, noise: str, porosity: str) -> DataFrame:
    return df.withColumns({"abs_sm": absolute_moisture(F.col(sm), F.col(porosity)), "abs_sm_noise": absolute_noise(F.col(noise), F.col(porosity))})


def warnings(topo: Column, wetland: Column, limit: float = 50) -> dict[str, Column]:
    return {"topo_warning": topo >= limit, "wetland_warning": wetland >= limit}


def land_only(grid: DataFrame, flag: str = "land_flag") -> DataFrame:
    return grid.where(F.col(flag) == 1)


#: Scale factors of the soil water index and of its quality flags.
INDEX_SCALE = {"swi": 0.5, "flag": 0.5, "ssf": 1.0}


def scaled_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """Stored counts as values, where the reader has not scaled them: ``SWI*`` and ``QFLAG*`` by one half, others as they are."""
    of = lambda c: INDEX_SCALE["swi"] if c.upper().startswith("SWI") else INDEX_SCALE["flag"] if c.upper().startswith("QFLAG") else INDEX_SCALE["ssf"]
    return df.withColumns({c: F.col(c) * of(c) for c in columns})
