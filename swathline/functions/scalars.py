"""Scalar functions of the measurement domain as column expressions (all inside generated code)."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def get_bit(c: Column, pos: int) -> Column:
    """Bit ``pos`` (from 1)."""
    return F.getbit(c.cast("bigint"), F.lit(pos - 1)).cast("int")


def set_bit(c: Column, pos: int, value: int = 1) -> Column:
    """Bit ``pos`` (from 1) set to ``value``."""
    bit = 1 << (pos - 1)
    return c.cast("bigint").bitwiseOR(F.lit(bit)) if value else c.cast("bigint").bitwiseAND(F.lit(~bit))


def db2lin(c: Column) -> Column:
    return F.pow(F.lit(10.0), c / 10.0)


def lin2db(c: Column) -> Column:
    """NULL for values that have no logarithm."""
    return F.when(c > 0, 10.0 * F.log10(c))


def window_radius(window: str, half_power_radius: float) -> float:
    """Radius at which a window's weight is one half at ``half_power_radius``."""
    kind = window.lower()
    if kind == "hamming":
        return math.pi * half_power_radius / math.acos((0.5 - 0.54) / 0.46)
    if kind == "boxcar":
        return half_power_radius
    raise ValueError(f"unknown window {window!r}")


def window_weight(window: str, radius: float, distance: Column) -> Column:
    kind = window.lower()
    if kind == "hamming":
        return 0.54 + 0.46 * F.cos(F.lit(math.pi / radius) * distance)
    if kind == "boxcar":
        return F.when(distance <= radius, 1.0).otherwise(0.0)
    raise ValueError(f"unknown window {window!r}")


def normalised(weight: Column, *group: str) -> Column:
    """A weight over the sum of its group's weights; a group is needed, as one sum over all rows is one task."""
    if not group:
        raise ValueError("name the columns whose weights sum to one")
    return weight / F.sum(weight).over(Window.partitionBy(*group))


def cds_time(day: Column, millisecond: Column) -> Column:
    """Days and milliseconds since 2000-01-01 as a time."""
    epoch = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(day.cast("int"), F.lit(0), F.lit(0), millisecond.cast("decimal(18,6)") / 1000)


def julian_day(day: Column, millisecond: Column) -> Column:
    return F.lit(2451544.5) + day + millisecond / 86_400_000.0


def seconds_2000(seconds: Column) -> Column:
    """Seconds since 2000-01-01 as a time."""
    epoch = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def parts_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.make_timestamp_ntz(year, month, day, hour, minute, second)


def wrap_longitude(lon: Column) -> Column:
    """[0, 360) to [-180, 180)."""
    return F.when(lon >= 180, lon - 360).otherwise(lon)


def wrap_azimuth(azimuth: Column) -> Column:
    """(-180, 180) to [0, 360)."""
    return F.when(azimuth < 0, azimuth + 360).otherwise(azimuth)


def cell_number(lon: Column, lat: Column, size: float = 5.0) -> Column:
    """Number of the square cell, south to north within west to east; the top and right edges belong inside."""
    n_lat, n_lon = int(180 / size), int(360 / size)
    column = F.least(F.floor((lon + 180) / size), F.lit(n_lon - 1))
    row = F.least(F.floor((lat + 90) / size), F.lit(n_lat - 1))
    return (column * n_lat + row).cast("int")


def swath_indicator(node: Column, nodes: int) -> Column:
    """0 for the left swath, 1 for the right: nodes beyond half of 82 or 42."""
    if nodes not in (82, 42):
        raise ValueError(f"a line has 82 or 42 nodes, not {nodes}")
    return (node > nodes // 2).cast("int")


def line_number(row: Column, nodes: int) -> Column:
    return F.floor(row / nodes).cast("int")


def node_number(row: Column, nodes: int) -> Column:
    return (F.pmod(row, F.lit(nodes)) + 1).cast("int")


def descending_pass(track_azimuth: Column) -> Column:
    return (track_azimuth < 270).cast("int")


def orbit_number(time_us: Column, first_orbit: Column, start_us: Column, length_us: int = 6_082_000_000) -> Column:
    """The first orbit's number, one more past its end (orbits last 6082 s)."""
    return first_orbit + F.when(time_us > start_us + length_us, 1).otherwise(0)


def absolute_moisture(relative: Column, porosity: Column) -> Column:
    """Percent of saturation to volume."""
    return relative / 100.0 * porosity


def absolute_noise(noise: Column, porosity: Column) -> Column:
    return F.sqrt(F.pow(noise, 2) * F.pow(porosity / 100.0, 2))


def stacked(*beams: Column) -> Column:
    """Beams as one array."""
    return F.array(*beams)


#: Positions of satellite numbers by the platform number of each format.
SAT_BY_MESSAGE = (0, 0, 0, 4, 3, 5)
SAT_BY_NATIVE = (4, 3, 5)
SAT_BY_NETCDF = (0, 4, 3, 5)
#: Satellite letter to number.
SAT_BY_LETTER = {"A": 3, "B": 4, "C": 5}
#: Names of a spacecraft to (satellite, platform, letter, number).
SPACECRAFT = {
    "METOPA": ("METOPA", "Metop", "A", 3),
    "METOPB": ("METOPB", "Metop", "B", 4),
    "METOPC": ("METOPC", "Metop", "C", 5),
    "METOP-A": ("METOPA", "Metop", "A", 3),
    "METOP-B": ("METOPB", "Metop", "B", 4),
    "METOP-C": ("METOPC", "Metop", "C", 5),
    "METOP-SG B1": ("METOP-SGB1", "Metop-SG", "B1", 6),
    "METOP-SG B2": ("METOP-SGB2", "Metop-SG", "B2", 7),
    "METOP-SG B3": ("METOP-SGB3", "Metop-SG", "B3", 8),
}


def spacecraft(name: str) -> tuple[str, str, str, int]:
    if name not in SPACECRAFT:
        raise RuntimeError(f"spacecraft {name} is unknown, known are {', '.join(SPACECRAFT)}")
    return SPACECRAFT[name]


def lookup(c: Column, table) -> Column:
    """Value by key (dict) or by position from 0 (tuple); NULL where there is none."""
    if isinstance(table, dict):
        return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]
    return F.get(F.array(*[F.lit(v) for v in table]), c)


def parse_size(text: str) -> int:
    """Bytes of a size such as 4GB."""
    units = {"TB": 10**12, "GB": 10**9, "MB": 10**6, "KB": 10**3, "B": 1}
    t = text.strip().upper()
    for unit, factor in units.items():
        if t.endswith(unit):
            return int(float(t[: -len(unit)]) * factor)
    return int(t)
