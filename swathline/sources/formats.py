"""Readers and sinks by format. Formats of missing libraries fail with a clear ImportError when used."""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.functions import nulls

#: Canonical name -> (BUFR level 2, EPS level 2, NetCDF level 2) source names are given by the
#: caller's maps; the canonical types are these.
CANONICAL = {
    "location_id": "bigint", "time": "timestamp_ntz", "lon": "double", "lat": "double", "sat_id": "int", "as_des_pass": "int", "swath_indicator": "int",
    "sm": "double", "sm_noise": "double", "sm_sens": "double", "sig40": "double", "sig40_noise": "double", "slope40": "double", "slope40_noise": "double",
    "dry_sig40": "double", "wet_sig40": "double", "corr_flag": "int", "proc_flag": "int", "agg_flag": "int", "snow_prob": "int", "frozen_prob": "int", "wetland": "int", "topo": "int",
}


def generic(df: DataFrame, fields: dict[str, tuple[str, str, float | None, float]]) -> DataFrame:
    """Canonical columns from {canonical: (source, type, fill, scale)}: fill becomes NULL, then scale and cast."""
    out = []
    for name, (source, kind, fill, scale) in fields.items():
        c = F.col(source)
        c = nulls.decode_fill(c, dict(df.dtypes)[source], fill) if fill is not None else c
        out.append((c * scale if scale != 1 else c).cast(kind).alias(name))
    return df.select(*out)


def split_beams(df: DataFrame, column: str) -> DataFrame:
    """An array of three beams as <column>_for, _mid, _aft."""
    return df.select("*", *[F.get(F.col(column), i).alias(f"{column}_{b}") for i, b in enumerate(("for", "mid", "aft"))]).drop(column)


def suffix_beams(df: DataFrame) -> DataFrame:
    """fore_x, mid_x, aft_x renamed to x_for, x_mid, x_aft."""
    ends = {"fore_": "_for", "mid_": "_mid", "aft_": "_aft"}
    return df.withColumnsRenamed({c: c[len(p) :] + e for c in df.columns for p, e in ends.items() if c.startswith(p)})


def by_beam(parts: dict[str, DataFrame]) -> DataFrame:
    """One table with a ``beam`` column from a table per beam."""
    out = None
    for beam, df in parts.items():
        df = df.withColumn("beam", F.lit(beam))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, paths: Sequence[str], schema: str, time: str | None = None, start=None, end=None) -> DataFrame:
    """CSV with a heading and a given schema; the period is closed."""
    df = spark.read.schema(schema).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(list(paths))
    if time:
        kind = dict(df.dtypes)[time]
        df = df.where(F.col(time).between(F.lit(str(start)).cast(kind), F.lit(str(end)).cast(kind)))
    return df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def scaled(c: Column, scale: float, fill: int, kind: str = "int") -> Column:
    """A value as scaled integer with a fill value, for sinks."""
    return F.coalesce(F.round(c / scale).cast(kind), F.lit(fill).cast(kind))


def write_steps(df: DataFrame, path: str, step: str = "step_start", mode: str = "overwrite") -> None:
    """A folder per time step."""
    df.repartition(step).write.mode(mode).partitionBy(step).parquet(path)


def need(module: str, what: str):
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"{what} needs the Python module {module} on driver and executors") from e


# --- binary records ---------------------------------------------------------------------------------------


def read_fixed(spark: SparkSession, path: str, dtype: np.dtype, header: int = 0, schema: str | None = None) -> DataFrame:
    """Files of fixed-size binary records (any byte order), after ``header`` bytes; file name and row number added."""
    fields = [(n, dtype[n]) for n in dtype.names]
    kinds = {"i": "bigint", "u": "bigint", "f": "double"}
    ddl = schema or ", ".join(f"{n} {kinds[t.base.kind] if t.shape == () else f'array<{kinds[t.base.kind]}>'}" for n, t in fields)
    spec = dtype.descr

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype([tuple(d) for d in spec])
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                body = memoryview(raw)[header:]
                rec = np.frombuffer(body[: len(body) // kind.itemsize * kind.itemsize], kind)
                cols = {n: (list(rec[n].astype(np.float64 if kind[n].base.kind == "f" else np.int64)) if kind[n].shape else rec[n].astype(np.float64 if kind[n].kind == "f" else np.int64)) for n in kind.names}
                yield pd.DataFrame({"file": name, "row": np.arange(len(rec)), **cols})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, f"file string, row bigint, {ddl}")


#: Sizes and names of an EPS record header (GRH): class, instrument group, subclass, its version, size, start and stop.
GRH = np.dtype([("record_class", "u1"), ("instrument_group", "u1"), ("record_subclass", "u1"), ("record_subclass_version", "u1"), ("record_size", ">u4"), ("start_day", ">u2"), ("start_ms", ">u4"), ("stop_day", ">u2"), ("stop_ms", ">u4")])


def read_eps_records(spark: SparkSession, path: str) -> DataFrame:
    """Native EPS files as their records: file, record_no, header fields and the body (binary)."""
    ddl = "file string, record_no int, record_class int, instrument_group int, record_subclass int, record_subclass_version int, record_size bigint, start_day int, start_ms bigint, body binary"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows, at, no = [], 0, 0
                while at + GRH.itemsize <= len(raw):
                    h = np.frombuffer(raw, GRH, 1, at)[0]
                    size = int(h["record_size"])
                    if size < GRH.itemsize:
                        break
                    rows.append((name, no, int(h["record_class"]), int(h["instrument_group"]), int(h["record_subclass"]), int(h["record_subclass_version"]), size, int(h["start_day"]), int(h["start_ms"]), bytes(raw[at + GRH.itemsize : at + size])))
                    at, no = at + size, no + 1
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ddl.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, ddl)


def product_header(body: Column, name: str) -> Column:
    """A field of a main product header record (lines NAME = VALUE)."""
    return F.nullif(F.trim(F.regexp_extract(F.decode(body, "US-ASCII"), rf"(?m)^{name}\s*=\s*(.*?)\s*$", 1)), F.lit(""))


def read_netcdf(spark: SparkSession, path: str, variables: Sequence[str], schema: str, dim: str = "obs") -> DataFrame:
    """Point variables along ``dim`` of NetCDF files, one row per element; sentinels and scales are decoded by the library."""
    need("netCDF4", "reading NetCDF")
    names = list(variables)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import netCDF4

        for pdf in batches:
            for raw in pdf["content"]:
                with netCDF4.Dataset("memory", memory=raw) as nc:
                    n = len(nc.dimensions[dim])
                    yield pd.DataFrame({v: np.ma.filled(np.broadcast_to(nc[v][:], (n,)).astype(float), np.nan) for v in names})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, schema)


def read_any(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Dispatch by extension (a trailing .gz is looked through)."""
    ext = path.removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if ext == "parquet":
        return spark.read.parquet(path)
    if ext == "csv":
        return read_csv(spark, [path], **kw)
    if ext in ("nat", "eps"):
        return read_eps_records(spark, path)
    if ext == "nc":
        return read_netcdf(spark, path, **kw)
    if ext in ("bfr", "bufr", "buf", "grib", "grb"):
        need("eccodes", f"reading {ext}")
        raise NotImplementedError(f"{ext} files are landed as Parquet first")
    if ext in ("h5", "hdf5"):
        need("h5py", "reading HDF5")
        raise NotImplementedError("HDF5 files are landed as Parquet first")
    raise ValueError(f"unknown file format .{ext}")


def schema_of(kinds: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in kinds.items()))
