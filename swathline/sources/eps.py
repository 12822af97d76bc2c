"""Native EPS products: record layouts compiled from a format description, lines times nodes as rows.

The description (an XML file of the format's publisher) is given by its path; nothing of it is kept here. Files
are read whole by one task each, decoded in bulk by numpy, and flattened to a row per node.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions import scalars
from swathline.sources.formats import GRH

#: Type name of the description -> stored type.
TYPES = {
    "boolean": "u1", "enumerated": "u1", "bitfield": "u1", "integer1": "i1", "uinteger1": "u1", "integer2": ">i2", "uinteger2": ">u2",
    "integer": ">i4", "uinteger": ">u4", "integer4": ">i4", "uinteger4": ">u4", "integer8": ">i8",
}
#: Short time is days and milliseconds since 2000-01-01, long time has microseconds besides.
SHORT_TIME = [("day", ">u2"), ("ms", ">u4")]
LONG_TIME = [*SHORT_TIME, ("us", ">u2")]
#: Record classes.
MPHR, MDR = 1, 8


@dataclass(frozen=True)
class Item:
    """A field of a record: its stored type, shape and scale."""

    name: str
    kind: object
    shape: tuple[int, ...]
    scale: float

    @property
    def is_time(self) -> bool:
        return isinstance(self.kind, list)


def _power(text: str | None) -> float:
    if not text:
        return 1.0
    base, _, exponent = text.partition("^")
    return float(base) ** float(exponent or 1)


def _item(node: ET.Element) -> Item:
    name, shape = node.get("name", ""), []
    while node.tag == "array":
        shape.append(int(node.get("length", "1")))
        node = next(c for c in node if c.tag in ("array", "field"))
    kind = node.get("type", "")
    if kind in ("time", "longtime"):
        return Item(name, SHORT_TIME if kind == "time" else LONG_TIME, tuple(shape), 1.0)
    if kind == "string":
        return Item(name, f"S{node.get('length', '1')}", tuple(shape), 1.0)
    if kind != "bitfield" and int(node.get("length", "1")) > 1:
        shape.append(int(node.get("length", "1")))
    return Item(name, TYPES[kind], tuple(shape), _power(node.get("scaling-factor")))


def compile_record(xml: str, record: str = "mdr", subclass: int | None = None) -> list[Item]:
    """The fields of a record (the one of a subclass, or the first) in order."""
    for node in ET.fromstring(xml).iter(record):
        if subclass is None or int(node.get("subclass", "-1")) == subclass:
            return [_item(c) for c in node if c.tag in ("field", "array")]
    raise ValueError(f"the description has no {record}" + (f" of subclass {subclass}" if subclass is not None else ""))


def record_dtype(items: Sequence[Item]) -> np.dtype:
    return np.dtype([(i.name, np.dtype(i.kind), i.shape) if i.shape else (i.name, np.dtype(i.kind)) for i in items])


def missing_code(kind: np.dtype) -> int | None:
    """Signed: the smallest value; unsigned: the largest; bytes have none."""
    if kind.kind == "i" and kind.itemsize > 1:
        return int(np.iinfo(kind).min)
    if kind.kind == "u" and kind.itemsize > 1:
        return int(np.iinfo(kind).max)
    return None


def _decoded(v: np.ndarray, item: Item) -> np.ndarray:
    out = v.astype(np.float64)
    code = missing_code(np.dtype(item.kind))
    if code is not None:
        out[v == code] = np.nan
    return out / item.scale


def read_lines(spark: SparkSession, path: str, xml: str, nodes: int, subclass: int | None = None) -> DataFrame:
    """A row per line and node: file, product_type, format_major_version, spacecraft, line_num, node_num, times, and
    the fields in lower case (those of shape (nodes, k) as arrays; missing codes, before scaling, are NULL/NaN)."""
    items = [i for i in compile_record(xml, "mdr", subclass) if not (isinstance(i.kind, str) and i.kind.startswith("S"))]
    kind = record_dtype(compile_record(xml, "mdr", subclass))
    cols = ["file string", "product_type string", "format_major_version int", "spacecraft string", "line_num int", "node_num int"]
    for i in items:
        name = i.name.lower()
        if i.is_time:
            cols.append(f"`{name}` timestamp_ntz")
        elif i.shape in ((), (nodes,)):
            cols.append(f"`{name}` double")
        else:
            cols.append(f"`{name}` array<double>")
    schema = ", ".join(cols)
    layout = [(i.name, i.kind, i.shape, i.scale) for i in items]
    descr = kind.descr

    def text_of(header: str, name: str) -> str | None:
        for line in header.splitlines():
            key, _, value = line.partition("=")
            if key.strip() == name:
                return value.strip() or None
        return None

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record = np.dtype(descr)
        for pdf in batches:
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                at, bodies, header = 0, [], ""
                while at + GRH.itemsize <= len(raw):
                    h = np.frombuffer(raw, GRH, 1, at)[0]
                    size = int(h["record_size"])
                    if size < GRH.itemsize or at + size > len(raw):
                        break
                    body = raw[at + GRH.itemsize : at + size]
                    if h["record_class"] == MPHR:
                        header = bytes(body).decode("ascii", "replace")
                    elif h["record_class"] == MDR and len(body) == record.itemsize and (subclass is None or h["record_subclass"] == subclass):
                        bodies.append(bytes(body))
                    at += size
                if not bodies:
                    continue
                lines = np.frombuffer(b"".join(bodies), record)
                n = len(lines)
                version = text_of(header, "FORMAT_MAJOR_VERSION")
                out = {
                    "file": file, "product_type": text_of(header, "PRODUCT_TYPE"), "format_major_version": int(version) if version and version.isdigit() else None,
                    "spacecraft": text_of(header, "SPACECRAFT_ID"), "line_num": np.repeat(np.arange(n), nodes), "node_num": np.tile(np.arange(1, nodes + 1), n),
                }
                for name, stored, shape, scale in layout:
                    v = lines[name]
                    if isinstance(stored, list):
                        us = v["day"].astype(np.int64) * 86_400_000_000 + v["ms"].astype(np.int64) * 1000 + (v["us"].astype(np.int64) if "us" in v.dtype.names else 0)
                        out[name.lower()] = np.repeat(np.datetime64("2000-01-01", "us") + us.astype("timedelta64[us]"), nodes)
                        continue
                    v = _decoded(v, Item(name, stored, shape, scale))
                    if shape == ():
                        out[name.lower()] = np.repeat(v, nodes)
                    elif shape == (nodes,):
                        out[name.lower()] = v.reshape(-1)
                    elif shape[:1] == (nodes,):
                        out[name.lower()] = list(v.reshape(n * nodes, -1))
                    else:
                        flat = v.reshape(n, -1)
                        out[name.lower()] = [row for row in flat for _ in range(nodes)]
                yield pd.DataFrame(out, index=range(n * nodes))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, schema)


def canonical(df: DataFrame, names: dict[str, str], nodes: int, longitude: str = "longitude", azimuth: str | None = None) -> DataFrame:
    """Canonical names, longitudes in [-180, 180), azimuths (an array) in [0, 360), and the swath indicator."""
    nan = lambda c: F.when(~F.isnan(c), c)
    kinds = dict(df.dtypes)
    out = df.select(*[nan(F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in kinds.items()])
    out = out.withColumn(longitude, scalars.wrap_longitude(F.col(longitude)))
    if azimuth:
        out = out.withColumn(azimuth, F.transform(azimuth, scalars.wrap_azimuth))
    if "swath_indicator" not in out.columns:
        out = out.withColumn("swath_indicator", scalars.swath_indicator(F.col("node_num"), nodes))
    return out.withColumnsRenamed(names)


def beams(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """A row per beam (for, mid, aft) of the three-beam fields."""
    keep = [c for c in df.columns if c not in fields]
    beam = F.element_at(F.array(F.lit("for"), F.lit("mid"), F.lit("aft")), F.col("_i") + 1)
    out = df.select(*keep, F.posexplode(F.arrays_zip(*fields)).alias("_i", "_b"))
    return out.select(*keep, beam.alias("beam"), *[F.col(f"_b.{f}").alias(f) for f in fields])


def satellite(spacecraft: Column) -> Column:
    """Satellite number of a spacecraft id such as M01."""
    return scalars.lookup(F.regexp_extract(spacecraft, r"(\d+)$", 1).try_cast("int") - 1, scalars.SAT_BY_NATIVE)
