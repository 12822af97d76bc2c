"""One handle for an observation set whatever its representation: kind and key names travel with the tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.operators import convert, select

KINDS = ("point", "indexed", "contiguous", "incomplete", "orthogonal")


@dataclass(frozen=True)
class Series:
    """``data`` in the form ``kind``; ``places`` is the table of instances of the indexed form."""

    data: DataFrame
    kind: str
    key: str
    fields: tuple[str, ...]
    sort: tuple[str, ...] = ("time",)
    instance_vars: tuple[str, ...] = ()
    places: DataFrame | None = None

    def __post_init__(self) -> None:
        self.verify()

    def verify(self) -> None:
        """RuntimeError if the table lacks what its kind needs."""
        need = {
            "point": {self.key, *self.fields, *self.sort, *self.instance_vars}, "indexed": {"location_index", *self.fields, *self.sort}, "contiguous": {self.key, "series", "row_size"},
            "incomplete": {self.key, "row_size", *self.fields}, "orthogonal": {self.key, *self.sort[:1], *self.fields},
        }
        if self.kind not in KINDS:
            raise ValueError(f"a representation is one of {', '.join(KINDS)}, not {self.kind!r}")
        lacks = need[self.kind] - set(self.data.columns)
        if lacks or (self.kind == "indexed" and (self.places is None or "location_index" not in self.places.columns)):
            raise RuntimeError(f"no {self.kind} form: {', '.join(sorted(lacks)) or 'the table of locations'} is missing")

    def tagged(self) -> DataFrame:
        """The data with the kind and the instance's role in the columns' metadata."""
        role = {"cf_role": "timeseries_id", "representation": self.kind}
        return self.data.withMetadata(self.key, role) if self.key in self.data.columns else self.data.withMetadata("location_index", {**role, "instance_dimension": self.key})

    def to_point(self) -> Series:
        if self.kind == "point":
            return self
        if self.kind == "indexed":
            data = convert.indexed_to_point(self.data, self.places)
        elif self.kind == "contiguous":
            data = convert.contiguous_to_point(self.data)
        elif self.kind == "incomplete":
            first = self.fields[0]
            part = convert.incomplete_to_contiguous(self.data, list(self.fields), lambda v: v.isNull())
            data = convert.contiguous_to_point(part).where(F.col(first).isNotNull())
        else:
            data = self.data
        return replace(self, data=data, kind="point", places=None)

    def to_indexed(self) -> Series:
        if self.kind == "indexed":
            return self
        obs, places = convert.to_indexed(self.to_point().data, self.key, list(self.instance_vars), list(self.sort))
        return replace(self, data=obs, kind="indexed", places=places)

    def to_contiguous(self, part: Column | None = None) -> Series:
        if self.kind == "contiguous":
            return self
        return replace(self, data=convert.to_contiguous(self.to_point().data, self.key, list(self.fields), list(self.sort), list(self.instance_vars), part), kind="contiguous", places=None)

    def to_incomplete(self) -> Series:
        """Padding is NULL; the first field must not be NULL where there is an observation."""
        data = self.to_contiguous().data
        kinds = {f.name: f.dataType.simpleString() for f in data.schema["series"].dataType.elementType.fields}
        return replace(self, data=convert.to_incomplete(data, list(self.fields), {f: F.lit(None).cast(kinds[f]) for f in self.fields}), kind="incomplete", places=None)

    def to_orthogonal(self, strict: bool = True) -> Series:
        element = self.sort[0]
        values = [f for f in self.fields if f != element]
        return replace(self, data=convert.to_orthogonal(self.to_point().data, self.key, element, values, strict=strict), kind="orthogonal", fields=tuple(values), places=None, instance_vars=())

    def save(self, path: str) -> None:
        """Write an indexed set: observations, places and what the handle knows; ValueError for other formats."""
        if not path.endswith(".parquet"):
            raise ValueError(f"a set is saved as .parquet, not {path}")
        me = self.to_indexed()
        spark = me.data.sparkSession
        me.data.write.mode("overwrite").parquet(f"{path}/observations")
        me.places.write.mode("overwrite").parquet(f"{path}/places")
        told = {"key": me.key, "fields": me.fields, "sort": me.sort, "instance_vars": me.instance_vars}
        spark.createDataFrame([(json.dumps(told),)], "told string").coalesce(1).write.mode("overwrite").text(f"{path}/told")

    @staticmethod
    def from_file(spark: SparkSession, path: str) -> Series:
        if not path.endswith(".parquet"):
            raise ValueError(f"a set is saved as .parquet, not {path}")
        told = json.loads(spark.read.text(f"{path}/told").first()[0])
        lists = {k: tuple(told[k]) for k in ("fields", "sort", "instance_vars")}
        return Series(spark.read.parquet(f"{path}/observations"), "indexed", told["key"], places=spark.read.parquet(f"{path}/places"), **lists)

    @staticmethod
    def detect(data: DataFrame, key: str, element: str = "time") -> str:
        """The kind of a table by its columns: RuntimeError if it is none."""
        has = set(data.columns)
        if "location_index" in has:
            return "indexed"
        if key not in has:
            raise RuntimeError(f"neither location_index nor {key} is there")
        if "series" in has:
            return "contiguous"
        if "row_size" in has:
            return "incomplete"
        if element not in has:
            raise RuntimeError(f"no {element}: the table has no observations")
        return "point"

    def sel(self, ids: DataFrame | Sequence[int]) -> Series:
        """Instances by id, in any form; absent ids are ignored."""
        if self.kind == "indexed":
            return self.to_point().sel(ids).to_indexed()
        return replace(self, data=select.by_ids(self.data, ids, self.key))

    def apply(self, func: Callable, schema: str) -> DataFrame:
        """A caller's function of pandas frames per instance."""
        return self.to_point().data.groupBy(self.key).applyInPandas(func, schema)

    def append(self, other: Series) -> Series:
        """Both sets as one indexed set; shared locations are the first set's."""
        a, b = self.to_indexed(), other.to_indexed()
        obs, places = convert.append(a.data, a.places, b.data, b.places, self.key)
        return replace(a, data=obs, places=places)
