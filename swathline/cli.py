"""Job mains: ``python -m swathline.cli <command>`` or through spark-submit.

Inputs and outputs are Parquet folders in the canonical schema (location_id, time, lon, lat, measurements).
"""

from __future__ import annotations

import argparse
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions import nulls
from swathline.operators import aggregate, convert, grids, select, stack
from swathline.session import get_session

_UNITS = {"S": 1, "T": 60, "H": 3600, "D": 86400, "W": 7 * 86400}
#: How the variables of a swath are resampled by default; others take the nearest value.
RESAMPLE = {
    "time": "nn", "as_des_pass": "nn", "swath_indicator": "nn", "surface_flag": "nn", "surface_flag_source": "nn",
    "surface_soil_moisture": "idw", "surface_soil_moisture_noise": "idw", "surface_soil_moisture_sensitivity": "idw",
    "backscatter40": "idw", "slope40": "idw", "curvature40": "idw", "snow_cover_probability": "idw", "frozen_soil_probability": "idw",
    "topographic_complexity": "idw", "wetland_fraction": "idw", "subsurface_scattering_prob": "idw",
    "correction_flag": "bitwise_or", "backscatter40_flag": "bitwise_or",
}
#: The same variable under its long name.
RESAMPLE["subsurface_scattering_probability"] = RESAMPLE["subsurface_scattering_prob"]


def step_seconds(text: str) -> int:
    """Seconds of a step such as 1D or 12H."""
    m = re.fullmatch(r"(\d+)\s*([STHDW])", text.strip().upper())
    if not m:
        raise ValueError(f"a step is a number with S, T, H, D or W, not {text!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


def aggregate_swaths(df: DataFrame, start: str, end: str, step: str, how: str, masks: aggregate.Masks | None, values: Sequence[str]) -> DataFrame:
    """Masked aggregation per location and step; steps of 1M or 1Y follow the calendar."""
    has = lambda c: c if c in df.columns else None
    if masks:
        df = aggregate.masked(df, "surface_soil_moisture", masks, has("frozen_soil_probability"), has("snow_cover_probability"), has("subsurface_scattering_probability"), has("surface_soil_moisture_sensitivity"), has("surface_flag"))
    order = F.struct("time", *[c for c in ("obs_id", "sat_id") if c in df.columns])
    calendar = {"1M": "month", "1Y": "year"}.get(step.upper())
    if calendar:
        rows = select.in_period(df, start, end, closed="left").withColumn("step_start", F.date_trunc(calendar, F.col("time")).cast("timestamp_ntz"))
    else:
        us = lambda t: F.unix_micros(F.lit(t).cast("timestamp"))
        a, b = df.sparkSession.range(1).select(us(start), us(end)).first()
        width = step_seconds(step) * 1_000_000
        rows = aggregate.time_steps(df, nulls.micros(F.col("time")), a, width, b)
        rows = rows.withColumn("step_start", F.timestamp_micros(F.col("step_no") * width + a).cast("timestamp_ntz")).drop("step_no")
    return aggregate.by_step(rows, ["step_start", "location_id"], [v for v in values if v in df.columns], how, order)


def regrid_steps(spark: SparkSession, df: DataFrame, grid: DataFrame, degrees: float, values: Sequence[str]) -> DataFrame:
    pixels = grids.regular(spark, degrees).select(F.col("gpi").alias("pixel"), "lat", "lon")
    lut = grids.lookup_table(pixels, "pixel", grid, "gpi")
    return grids.regrid(lut, "pixel", "gpi", df, "location_id", list(values), ["time"])


def build() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="swathline")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("aggregate", help="mask and aggregate swaths per location and time step")
    for name in ("input", "output", "start", "end", "step", "how"):
        a.add_argument(name)
    a.add_argument("--grid", help="grid table with gpi, lat, lon, cell")
    a.add_argument("--no-mask", action="store_true")
    for name, default in (("frozen", 90.0), ("snow", 90.0), ("subsurface", 10.0), ("sensitivity", 1.0)):
        a.add_argument(f"--{name}", type=float, default=default)
    r = sub.add_parser("regrid", help="nearest grid point of each pixel of a regular grid")
    for name in ("input", "output", "grid"):
        r.add_argument(name)
    r.add_argument("degrees", type=float)
    s = sub.add_parser("resample", help="values of the nearest observations at target points")
    for name in ("input", "output", "targets"):
        s.add_argument(name)
    s.add_argument("--neighbours", type=int, default=6)
    s.add_argument("--radius", type=float, default=10_000)
    t = sub.add_parser("stack", help="swaths into cell folders")
    for name in ("input", "output", "grid"):
        t.add_argument(name)
    t.add_argument("--start")
    t.add_argument("--end")
    t.add_argument("--cells", type=int, nargs="*")
    c = sub.add_parser("convert", help="cell folders into another representation")
    for name in ("input", "output"):
        c.add_argument(name)
    c.add_argument("form", choices=["indexed", "contiguous", "point"])
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = build().parse_args(argv)
    spark = spark or get_session(f"swathline-{args.command}")
    df = spark.read.parquet(args.input)
    keys = {"location_id", "time", "lon", "lat", "cell", "sat_id", "obs_id", "step_start"}
    values = [n for n, k in df.dtypes if n not in keys and k in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if args.command == "aggregate":
        masks = None if args.no_mask else aggregate.Masks(args.frozen, args.snow, args.subsurface, args.sensitivity)
        out = aggregate_swaths(df, args.start, args.end, args.step, args.how, masks, values)
        if args.grid:
            g = spark.read.parquet(args.grid).select("gpi", "lat", "lon")
            out = out.join(g, F.col("location_id") == F.col("gpi"), "left").drop("gpi")
        out.write.mode("overwrite").partitionBy("step_start").parquet(args.output)
    elif args.command == "regrid":
        regrid_steps(spark, df, spark.read.parquet(args.grid), args.degrees, [*values, "time"]).write.mode("overwrite").parquet(args.output)
    elif args.command == "resample":
        methods = {v: RESAMPLE.get(v, "nn") for v in values}
        rows = df.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("_obs", F.xxhash64("location_id", "time"))
        grids.resample(spark.read.parquet(args.targets), "target", rows, "_obs", methods, args.neighbours, args.radius).write.mode("overwrite").parquet(args.output)
    elif args.command == "stack":
        if args.start and args.end:
            df = select.in_period(df, args.start, args.end)
        out = stack.with_cell(df, spark.read.parquet(args.grid))
        stack.write_cells(select.by_cells(out, args.cells) if args.cells else out, args.output)
    else:
        inst = [c for c in ("cell", "lon", "lat") if c in df.columns]
        rest = [c for c in df.columns if c not in (*inst, "location_id")]
        if args.form == "contiguous":
            convert.to_contiguous(df, "location_id", rest, ["time"], inst).write.mode("overwrite").partitionBy(*[c for c in inst if c == "cell"]).parquet(args.output)
        elif args.form == "indexed":
            o, loc = convert.to_indexed(df, "location_id", inst, ["time"])
            o.write.mode("overwrite").parquet(f"{args.output}/observations")
            loc.write.mode("overwrite").parquet(f"{args.output}/locations")
        else:
            (convert.contiguous_to_point(df) if "series" in df.columns else df).write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
