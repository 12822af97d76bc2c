"""Quality flags: bit tables compiled to expressions, one condition per bit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathline.functions.scalars import get_bit

#: Severity (0, 1, 2) of each bit of the five flag bytes of formats up to 12.
SEVERITY = {
    "rf1": [1, 1, 2, 1, 2],
    "rf2": [2, 2],
    "pl": [2, 2, 2, 2],
    "gen1": [0, 2],
    "gen2": [1, 0, 2],
}
#: Severity of each bit of the one flag field of format 13.
SEVERITY_13 = [1, 1, 2, 1, 2, 2, 2, 1, 2, 2, 2, 0, 1, 2, 0, 1, 0, 2, 0, 0]
#: Bit of an old flag byte -> bit of the one flag field (both from 0).
REMAP = {
    "rf1": {0: 0, 1: 1, 2: 2, 3: 3, 4: 4},
    "rf2": {0: 5, 1: 6, 2: 7},
    "pl": {1: 8, 2: 9, 3: 10, 4: 11},
    "gen1": {0: 12, 1: 13, 6: 14},
    "gen2": {0: 15, 1: 16, 2: 17, 3: 18},
}


def _worst(parts: list[Column], any_known: Column) -> Column:
    return F.when(any_known, F.greatest(F.lit(0), F.lit(0), *parts))


def severity(bytes_: Mapping[str, Column], ignore_noise: bool = False) -> Column:
    """The worst severity of the set bits of the old flag bytes; NULL bytes count as no flag, all NULL as NULL."""
    parts = []
    for name, c in bytes_.items():
        for bit, s in enumerate(SEVERITY[name]):
            if s and not (ignore_noise and name == "rf2" and bit == 1):
                parts.append(F.when(get_bit(c, bit + 1) == 1, s).otherwise(0))
    return _worst(parts, F.coalesce(*bytes_.values()).isNotNull())


def severity_13(field: Column, ignore_noise: bool = False) -> Column:
    """The worst severity of the set bits of the one flag field; spare bits count nothing."""
    parts = [F.when(get_bit(field, bit + 1) == 1, s).otherwise(0) for bit, s in enumerate(SEVERITY_13) if s and not (ignore_noise and bit == 6)]
    return _worst(parts, field.isNotNull())


def flag_field(bytes_: Mapping[str, Column]) -> Column:
    """The one flag field from the old flag bytes."""
    bits = [F.coalesce(get_bit(c, old + 1), F.lit(0)).cast("bigint") * (1 << new) for name, c in bytes_.items() for old, new in REMAP[name].items()]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out
