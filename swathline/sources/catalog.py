"""Products and files: name templates, dates in names, and which files a period needs.

Products are registered by their owner (or read from a table of patterns); a file's date comes from its name, so
a period prunes files before any is opened. On tables the same is a partition column ``file_time``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.operators.compact import pattern_regex


@dataclass(frozen=True)
class FilenameTemplate:
    """Root, name pattern and named subfolder patterns with {placeholders}."""

    root: str
    name: str
    folders: Mapping[str, str] = field(default_factory=dict)

    def subfolder(self, values: Mapping[str, Mapping[str, str]]) -> str:
        return "/".join(p.format(**values.get(k, {})) for k, p in self.folders.items())

    def basename(self, values: Mapping[str, str]) -> str:
        return self.name.format(**values)

    def filename(self, values: Mapping[str, str], folders: Mapping[str, Mapping[str, str]] | None = None) -> str:
        parts = [self.root, self.subfolder(folders or {}), self.basename(values)]
        return "/".join(p.rstrip("/") for p in parts if p)


class ChronFiles:
    """Files of a template whose names carry a date."""

    def __init__(self, template: FilenameTemplate, date_format: str, name_values: Callable[..., Mapping[str, str]], folder_values: Callable[..., Mapping[str, Mapping[str, str]]] | None = None, date_field: str = "date"):
        self.template, self.date_format, self.date_field = template, date_format, date_field
        self.name_values, self.folder_values = name_values, folder_values or (lambda t: {})

    def date_of(self, path: str) -> datetime:
        rx = ""
        for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", self.template.name):
            rx += re.escape(text) + (("(.+?)" if name == self.date_field else ".+?") if name else "")
        m = re.search(rx + "$", path.rsplit("/", 1)[-1])
        if not m:
            raise ValueError(f"no date in {path}")
        return datetime.strptime(m.group(1)[: len(datetime(2000, 1, 1).strftime(self.date_format))], self.date_format)

    def glob(self, spark: SparkSession, pattern: str) -> list[str]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
        return sorted(s.getPath().toString() for s in found)

    def search_date(self, spark: SparkSession, day: datetime, **kw) -> list[str]:
        files = self.glob(spark, self.template.filename(self.name_values(day, **kw), self.folder_values(day)))
        return sorted(files, key=lambda f: (self.date_of(f), f))

    def search_period(self, spark: SparkSession, start: datetime, end: datetime, step: timedelta = timedelta(days=1), end_inclusive: bool = True, **kw) -> list[str]:
        """Files of [start, end), or up to the end's own step; each once, in order."""
        stop, t, seen = end + step if end_inclusive else end, start, {}
        while t < stop:
            for f in self.search_date(spark, t, **kw):
                d = self.date_of(f)
                if start <= d < stop:
                    seen[f] = None
            t += step
        return list(seen)

    def read_period(self, spark: SparkSession, start: datetime, end: datetime, reader: Callable[[Sequence[str]], DataFrame], time: str, buffer: timedelta = timedelta(days=1), **kw) -> DataFrame | None:
        """Rows of [start, end] from the files of the widened period."""
        files = self.search_period(spark, start - buffer, end + buffer, **kw)
        return reader(files).where(F.col(time).between(F.lit(str(start)).cast("timestamp_ntz"), F.lit(str(end)).cast("timestamp_ntz"))) if files else None


def file_time(name: Column, pattern: str = r"([0-9]{14})", fmt: str = "yyyyMMddHHmmss") -> Column:
    """The date in a file name; NULL without one."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.lit(fmt)).cast("timestamp_ntz")


def prune_period(files: DataFrame, name: str, start: str, end: str, delta_s: int = 86400, end_inclusive: bool = True) -> DataFrame:
    """Files whose date lies in [start, end), the end widened by the step if it is inclusive."""
    stop = F.lit(end).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(delta_s if end_inclusive else 0)))
    return files.withColumn("file_time", file_time(F.col(name))).where((F.col("file_time") >= F.lit(start).cast("timestamp_ntz")) & (F.col("file_time") < stop))


def batches_by_bytes(files: Sequence[tuple[str, int]], most: int) -> Iterable[list[str]]:
    """Batches of files of at most ``most`` bytes, never empty; a larger file is a batch of its own."""
    batch, size = [], 0
    for name, n in files:
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(name)
        size += n
    if batch:
        yield batch


@dataclass(frozen=True)
class Product:
    """A product: its file-name pattern, folders, grid and the transforms of its rows."""

    product_id: str
    pattern: str
    grid: str
    folders: Mapping[str, str] = field(default_factory=dict)
    preprocess: Callable[[DataFrame], DataFrame] = lambda df: df
    postprocess: Callable[[DataFrame], DataFrame] = lambda df: df


class Catalog:
    """Products by id, whatever the case; the first registered pattern that fits a file names its product."""

    def __init__(self) -> None:
        self._products: dict[str, Product] = {}

    def register(self, product: Product) -> None:
        self._products[product.product_id.upper()] = product

    def get(self, product_id: str) -> Product:
        if product_id.upper() not in self._products:
            raise ValueError(f"unknown product {product_id}, known are {', '.join(self._products)}")
        return self._products[product_id.upper()]

    def product_of(self, filename: str) -> str:
        for p in self._products.values():
            if re.match(pattern_regex(p.pattern, {}), filename):
                return p.product_id
        raise ValueError(f"{filename} fits no product")

    def product_column(self, name: Column) -> Column:
        """The product of each file name, NULL for none."""
        return F.coalesce(*[F.when(name.rlike(pattern_regex(p.pattern, {})), F.lit(p.product_id)) for p in self._products.values()], F.lit(None).cast("string"))
