"""Tiny files into few well-sized ones, without losing or doubling records.

A table is a folder of Parquet files, written in generations (one folder for each write, by partition inside it),
and a manifest of numbered versions that names the generations each partition consists of. Readers follow the
manifest, so what a writer has not published, or left behind when it was killed, is no part of the table.
Writers take no locks: they write a generation of their own and publish the next version by an exclusive rename.
Who loses the race looks at the newer version and goes on from it, or fails with ``Conflict`` if that has changed
what was read.

Compaction takes a version as its snapshot, finds the partitions with more than ``min_files`` small files and those
that were added to since they were last rewritten (their files can hold copies, whatever their sizes), and rewrites
only these, each into as many files as its bytes need. The overwrite is dynamic: the partitions that the rewrite
writes are replaced, all others stay, and so do the old files until ``vacuum`` (an overwrite in place would take them
from under the readers of the snapshot).

``parse_files`` reads tiny delimited files that lie in rows; ``pattern_regex`` compiles file-name patterns.

Defined results: content NULL or empty holds no records; a line is a record if it has four fields, whole
location and time, and either fits nothing else (headings, comments, cut-off lines are left out); both line
endings and the separators comma, semicolon and tab are known; a file whose name fits no pattern, or a name of
NULL, belongs nowhere; equal (partition, key) rows are one record: one of them as a whole, that with the fewest NULLs,
of these the one of the smallest order; an empty table has no files and nothing to compact; a partition of NULL is one.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathline.session import delete_path, publish

TARGET_BYTES = 128 << 20
MIN_FILES = 2
#: Ends of the names of generations that were appended, and of those that hold one record per key.
_APPEND, _COMPACT = "-a", "-c"
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer has changed the table."""


def pattern_regex(pattern: str, given: dict[str, str]) -> str:
    """A file-name pattern as a regular expression for whole names: ``given`` placeholders are literal, ``date``
    is fourteen digits, any other is one or more characters except an underscore."""
    out = ""
    for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", pattern):
        quoted = re.sub(r"([^\w,-])", r"\\\1", text)
        out += quoted
        if name:
            out += re.sub(r"([^\w,-])", r"\\\1", given[name]) if name in given else "[0-9]{14}" if name == "date" else "[^_]+"
    return f"^{out}$"


def parse_files(files: DataFrame, name: str, content: str, order: str, patterns: Sequence[tuple[int, str]], partition: str) -> DataFrame:
    """The records of tiny files: partition, location_id, time_s, backscatter40, sm, order (file, line).

    ``patterns``: (partition value, regular expression) of each collection; a name may fit several.
    """
    fits = F.array_compact(F.array(*[F.when(F.col(name).rlike(rx), F.lit(p)) for p, rx in patterns]))
    lines = files.select(F.explode(fits).alias(partition), F.col(order).cast("bigint").alias("_file"), F.posexplode(F.split(F.col(content), r"\r?\n")).alias("_line", "_text"))
    parts = F.split("_text", r"[,;\t]", -1)
    rows = lines.select(partition, "_file", "_line", parts.alias("_p")).where(F.size("_p") == 4)
    field = lambda i: F.trim(F.col("_p")[i])
    t = field(1)
    seconds = (
        F.when(t.rlike("^[0-9]{14}$"), F.unix_seconds(F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss"))))
        .when(t.rlike("^[0-9]{1,12}$"), t.try_cast("bigint"))
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), F.unix_seconds(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))))
    )
    number = lambda i: F.when(~F.isnan(field(i).try_cast("double")), field(i).try_cast("double"))
    rows = rows.select(
        partition, F.when(field(0).rlike("^[0-9]{1,18}$"), field(0).try_cast("bigint")).alias("location_id"), seconds.alias("time_s"),
        number(2).alias("backscatter40"), number(3).alias("sm"), F.coalesce(F.try_add(F.try_multiply(F.col("_file"), F.lit(1 << 24)), F.col("_line")), F.col("_file")).alias("_order"))
    return rows.where(F.col("location_id").isNotNull() & F.col("time_s").isNotNull())


class PartitionedTable:
    """A partitioned Parquet table with versions."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, partition: str):
        self.spark, self.root, self.partition = spark, root.rstrip("/"), partition
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._jvm = spark.sparkContext._jvm

    def _path(self, *parts: str):
        p = self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    # versions ----------------------------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        fs, p = self._path("_versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def version(self) -> int:
        """The newest published version; 0 for a new table."""
        return max(self._versions(), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """Partition folder -> its generations, those of appends after the one of the last rewrite."""
        version = self.version() if version is None else version
        if not version:
            return {}
        fs, p = self._path("_versions", f"{version}.json")
        stream = fs.open(p)
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)["partitions"]

    def _publish(self, version: int, what: str, partitions: dict[str, list[str]]) -> bool:
        return publish(self.spark, f"{self.root}/_versions/{version}.json", json.dumps({"version": version, "what": what, "partitions": partitions}))

    def _files(self, folder: str) -> dict[str, int]:
        fs, p = self._path("data", folder)
        return {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")}

    def listing(self, version: int | None = None) -> dict[str, dict[str, int]]:
        """Partition folder -> file -> bytes of a version, as the manifest names them."""
        return {k: {f"{g}/{n}": b for g in gens for n, b in self._files(f"{g}/{k}").items()} for k, gens in self.manifest(version).items()}

    # reading and writing -----------------------------------------------------------------------------------

    def _rows(self, partitions: dict[str, list[str]]) -> DataFrame:
        by_gen: dict[str, list[str]] = {}
        for k, gens in partitions.items():
            for g in gens:
                by_gen.setdefault(g, []).append(k)
        if not by_gen:
            return self.spark.createDataFrame([], self.schema)
        # The folder of a generation that is used whole is one path.
        whole = {g for g, ks in by_gen.items() if {s for s in self._folders(g)} == set(ks)}
        paths = [f"{self.root}/data/{g}" for g in whole] + [f"{self.root}/data/{g}/{k}" for g, ks in by_gen.items() if g not in whole for k in ks]
        fields = T.StructType([T.StructField("gen", T.StringType()), *self.schema.fields])
        return self.spark.read.schema(fields).option("basePath", f"{self.root}/data").parquet(*sorted(paths)).select(self.schema.fieldNames())

    def _folders(self, gen: str) -> list[str]:
        fs, p = self._path("data", gen)
        return [s.getPath().getName() for s in fs.listStatus(p) if "=" in s.getPath().getName()] if fs.exists(p) else []

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given."""
        return self._rows(self.manifest(version))

    def _write(self, df: DataFrame, kind: str) -> tuple[str, list[str]]:
        """A generation of its own; its name and the partitions in it."""
        gen = f"gen={int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}{kind}"
        df.select(self.schema.fieldNames()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(self._path("data", gen)[1].toString())
        return gen, self._folders(gen)

    def append(self, df: DataFrame, expected: int | None = None) -> int:
        """Add rows as they come (many small files); ``expected``: the version the rows were made from.

        Returns the new version. Without ``expected``, appends go on from whatever version is there by then.
        """
        if expected is not None and expected != self.version():
            raise Conflict(f"version {expected} was read, {self.version()} is there")
        gen, folders = self._write(df, _APPEND)
        while True:
            now = self.version() if expected is None else expected
            partitions = self.manifest(now)
            if self._publish(now + 1, "append", partitions | {k: [*partitions.get(k, []), gen] for k in folders}):
                return now + 1
            if expected is not None:
                raise Conflict(f"version {now + 1} has been written by another")

    def compact(self, keys: Sequence[str], order: str, min_files: int = MIN_FILES, target_bytes: int = TARGET_BYTES) -> dict[str, int]:
        """Rewrite the partitions with more than ``min_files`` files below half the target and those added to since
        their last rewrite; one record per key.

        Returns the number of files each rewritten partition was cut into at most. A partition that another writer
        rewrites meanwhile is a ``Conflict``; what others append meanwhile stays appended.
        """
        now = self.version()
        before = self.manifest(now)
        todo = {}
        for k, gens in before.items():
            sizes = [b for g in gens for b in self._files(f"{g}/{k}").values()]
            n = max(1, -(-sum(sizes) // target_bytes))
            if any(not g.endswith(_COMPACT) for g in gens) or len(sizes) > n and sum(b < target_bytes // 2 for b in sizes) > min_files:
                todo[k] = n
        if not todo:
            return {}
        rows = self._rows({k: before[k] for k in todo})
        rest = [c for c in self.schema.fieldNames() if c not in (*keys, order, self.partition)]
        # Copies are combined before any row moves; then each output file is one task's.
        nulls = sum([F.col(c).isNull().cast("int") for c in rest], F.lit(0))
        best = F.struct(nulls.alias("nulls"), F.col(order).isNull().alias("last"), F.col(order).alias("order"))
        one = rows.groupBy(self.partition, *keys).agg(F.min_by(F.struct(*[F.col(c) for c in (order, *rest)]), best).alias("_one")).select(self.partition, *keys, "_one.*")
        files = [(None if v == _NO_VALUE else v, n) for v, n in ((self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(k.split("=", 1)[1]), n) for k, n in todo.items())]
        files = self.spark.createDataFrame(files, "_part string, _n int")
        one = one.join(files, F.col(self.partition).cast("string").eqNullSafe(F.col("_part")), "left")
        one = one.withColumn("_file", F.pmod(F.xxhash64(*keys), F.coalesce("_n", F.lit(1))).cast("int"))
        gen, folders = self._write(one.repartition(sum(todo.values()), self.partition, "_file").drop("_part", "_n").sortWithinPartitions(self.partition, "_file", *keys), _COMPACT)
        while True:
            there = self.manifest(now)
            if any(there.get(k, [])[: len(before[k])] != before[k] for k in todo):
                raise Conflict("a partition has been rewritten since the snapshot")
            new = {k: ([gen] if k in folders else []) + gens[len(before[k]) :] if k in todo else gens for k, gens in there.items()}
            if self._publish(now + 1, "compact", {k: g for k, g in new.items() if g}):
                return todo
            now = self.version()

    def vacuum(self, keep_versions: int = 1, older_than_s: int = 86_400) -> list[str]:
        """Delete the generations that none of the last versions names and that are older than a writer may take."""
        kept = {g for v in self._versions()[-keep_versions:] for gens in self.manifest(v).values() for g in gens}
        fs, p = self._path("data")
        gens = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        past = [g for g in gens if g not in kept and int(g.split("=")[1].split("-")[0]) < (time.time() - older_than_s) * 1000]
        for g in past:
            delete_path(self.spark, f"{self.root}/data/{g}")
        return past
