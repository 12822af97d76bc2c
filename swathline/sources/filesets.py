"""Sets of files: lists by period, one object per file, per-file extents, and what a step's file is called."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.operators.nearby import cube_edge, great_circle, morton3, sphere, usable_degrees
from swathline.sources.catalog import file_time

#: Letters of the satellites in file names -> numbers of the chronological lists.
LIST_NUMBER = {"a": 2, "b": 1, "c": 3}
#: Radius of the sphere on which files are matched with places.
FILE_REACH_M = 15_000.0


def days(start: date, end: date) -> Iterator[date]:
    """Each day from the start up to, but without, the end; none if the end is not after the start."""
    while start < end:
        yield start
        start += timedelta(days=1)


def parse_day(text: str) -> datetime:
    """A day written as YYYYMMDD; ValueError for anything else."""
    if len(text) != 8 or not text.isdigit():
        raise ValueError(f"a day is written YYYYMMDD, not {text!r}")
    return datetime.strptime(text, "%Y%m%d")


def search_function(search: Callable[..., Sequence[str]], values: Callable[..., tuple[Mapping, Mapping]]) -> Callable[..., Sequence[str]]:
    """A search by the caller's own arguments: ``values`` makes the placeholders of names and folders of them."""
    return lambda *args, **kw: search(*values(*args, **kw))


def common_files(lists: Sequence[Sequence[str]]) -> list[str]:
    """The files of all lists, in the order of the first, each once; none of no lists."""
    rest = [set(x) for x in lists[1:]]
    return [f for f in dict.fromkeys(lists[0] if lists else ()) if all(f in r for r in rest)]


class FileSet:
    """Named files with the functions that read and write one; tables are read as one plan, objects one by one."""

    def __init__(self, names: Sequence[str], reader: Callable[[str], DataFrame], writer: Callable[[DataFrame, str], None] | None = None, keep: int = 0):
        self.names, self.reader, self.writer, self.keep = list(names), reader, writer, keep
        self._kept: dict[str, DataFrame] = {}

    def read_file(self, name: str) -> DataFrame:
        """One file; the last ``keep`` files read stay in memory (first in, first out)."""
        if name in self._kept:
            return self._kept[name]
        df = self.reader(name)
        if self.keep:
            while len(self._kept) >= self.keep:
                self._kept.pop(next(iter(self._kept))).unpersist()
            self._kept[name] = df.persist()
        return df

    def iter_read(self) -> Iterator[DataFrame]:
        return (self.read_file(n) for n in self.names)

    def read(self) -> DataFrame | None:
        """All files by column name; None without files."""
        out = None
        for df in self.iter_read():
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def write(self, tables: Iterable[DataFrame]) -> None:
        """One table a name, in order; ValueError unless there are as many of both."""
        tables = list(tables)
        if self.writer is None or len(tables) != len(self.names):
            raise ValueError(f"{len(tables)} tables for {len(self.names)} files")
        for df, name in zip(tables, self.names, strict=True):
            self.writer(df, name)

    def newest_first(self) -> list[str]:
        return sorted(self.names, reverse=True)


def files_near(points: DataFrame, file: str, targets: DataFrame, reach_m: float = FILE_REACH_M) -> DataFrame:
    """The files with any point (lat, lon) within the reach of any target point (lat, lon).

    Both sides are brought down to space cubes before they meet: a file has a row a cube, and distances are
    computed only in cubes that hold targets. Points without usable coordinates are near nothing.
    """
    edge = cube_edge(reach_m)
    place = lambda df, *keep: df.select(*keep, usable_degrees(F.col("lat"), -90, 90).alias("lat"), usable_degrees(F.col("lon"), -180, 360).alias("lon")).dropna(subset=["lat", "lon"]).distinct()
    cell = lambda v: F.floor((v + 6_371_000.0 + edge) / edge).cast("bigint")
    at = place(points, file)
    at = at.withColumn("_code", morton3(*[cell(v) for v in sphere(F.col("lat"), F.col("lon"))]))
    near = place(targets)
    for a, v in zip("xyz", sphere(F.col("lat"), F.col("lon")), strict=True):
        near = near.withColumn(f"_{a}", F.sequence(cell(v - reach_m), cell(v + reach_m)))
    for a in "xyz":
        near = near.withColumn(f"_{a}", F.explode(f"_{a}"))
    near = near.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), morton3(F.col("_x"), F.col("_y"), F.col("_z")).alias("_near"))
    close = great_circle(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= reach_m
    return at.join(near, (F.col("_code") == F.col("_near")) & close, "left_semi").select(file).distinct()


def by_file(df: DataFrame, name: str, pattern: str = r"_([0-9]{14})_", satellite: str = r"-([A-Z])[,_]") -> DataFrame:
    """Each row with its file's start (the date in its name) and satellite letter; NULL for names without."""
    sat = F.nullif(F.regexp_extract(F.col(name), satellite, 1), F.lit(""))
    return df.withColumn("file_start", file_time(F.col(name), pattern)).withColumn("file_satellite", sat)


def step_name(product: str, grid: str, how: str | None, period: str, start: Column) -> Column:
    """The file of a time step: product, grid, aggregate (``data`` for none), period and its start."""
    return F.concat(F.lit(f"{product}_{grid}_{how or 'data'}_{period}_"), F.date_format(start, "yyyyMMddHHmmss"))


def micro_degrees(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Coordinates as whole millionths of a degree (int), as sinks store them; missing ones are the smallest int."""
    code = lambda c: F.coalesce(F.when(~F.isnan(c), F.round(F.col(c).cast("double") * 1_000_000)).cast("int"), F.lit(-(2**31)))
    return df.withColumns({lat: code(lat), lon: code(lon)})


def combined_attributes(parts: Sequence[Mapping[str, object]], keep: Sequence[str] = ("grid_mapping_name", "featureType")) -> dict[str, object]:
    """Metadata that all parts with it agree on; of several parts only the names in ``keep``."""
    out: dict[str, object] = {}
    bad: set[str] = set()
    for p in parts:
        for k, v in p.items():
            if k in out and out[k] != v:
                bad.add(k)
            out.setdefault(k, v)
    return {k: v for k, v in out.items() if k not in bad and (len(parts) < 2 or k in keep)}


def to_cell_names(df: DataFrame) -> DataFrame:
    """A swath's names as cells have them (longitude -> lon, latitude -> lat, altitude -> alt); ``alt`` unknown if absent."""
    df = df.withColumnsRenamed({"longitude": "lon", "latitude": "lat", "altitude": "alt"})
    return df if "alt" in df.columns else df.withColumn("alt", F.lit(None).cast("float"))
