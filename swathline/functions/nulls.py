"""One null model: every coding of "missing" becomes SQL NULL at the scan, and comes back only in sinks.

Fixed values (the codes of the source formats):
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fill value by column type: smallest value of signed integers, -999999 of floats.
FILL_BY_TYPE = {
    "tinyint": -(2**7),
    "smallint": -(2**15),
    "int": -(2**31),
    "bigint": -(2**63),
    "float": -999999.0,
    "double": -999999.0,
}
#: Fill value of unsigned source types, held in the next wider signed type.
FILL_BY_UNSIGNED = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}
#: Anything of larger magnitude is the missing code of binary messages.
LARGE = 1.0e37
#: Missing floats of old cell files, and the height code.
OLD_CELL_FLOOR = -2147483600.0
HEIGHT_CODE = 999999.0


def reading(c: Column) -> Column:
    """A float reading as double: NaN, |x| > 1e37 and -999999 become NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) <= LARGE) & (d != -999999.0), d)


def height(c: Column) -> Column:
    """A height as double: NaN, 999999 and above, -2147483600 and below become NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (d < HEIGHT_CODE) & (d > OLD_CELL_FLOOR), d)


def EPOCH() -> Column:
    """The time that codes "missing"."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def instant(c: Column) -> Column:
    """A time, where the epoch itself codes "missing"."""
    return F.when(c != EPOCH(), c)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time without zone (taken as UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def decode_fill(c: Column, kind: str, fill: float | int | None = None) -> Column:
    """NULL in place of the fill value of ``kind``; NaN is missing in any float."""
    fill = FILL_BY_TYPE[kind] if fill is None else fill
    keep = c != F.lit(fill).cast(kind)
    return F.when(keep & ~F.isnan(c) if kind in ("float", "double") else keep, c)


def encode_fill(c: Column, kind: str, fill: float | int | None = None) -> Column:
    """The fill value of ``kind`` in place of NULL, for sinks."""
    return F.coalesce(c, F.lit(FILL_BY_TYPE[kind] if fill is None else fill).cast(kind))
