"""Nested semi-structured records as related flat tables, by Dewey labels.

Every node of a record has the ordinals of the path that leads to it as its label: the record is ``1``, its
second line ``1.2``, that line's first node ``1.2.1``. A label cut by its last ordinal is the parent's, so rows
of any two tables are linked by (record, label) without counters or joins, and labels are made where the record
lies: no shuffle at all. Nodes are grouped into tables by their schema path (names without ordinals).

Records stay binary JSON values (VARIANT) inside the JVM; any list may be absent, null, empty, hold nulls, or be
replaced by its only element.

Defined results: a record that is NULL, empty or cannot be parsed has no rows in any table; a null element keeps
its ordinal but has no row; a lone element has ordinal 1; fields of an unexpected type are NULL; equal record
ids give equal labels (repeated records give repeated rows); other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """A table of nodes: its name, the list that holds them in the parent, and (path, type) of its columns."""

    table: str
    items: str
    columns: Mapping[str, tuple[str, str]] = field(default_factory=dict)


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def body(raw: Column, wrapper: str = "PRODUCT") -> Column:
    """The record's object; a wrapper around it may be an object or JSON text of its own."""
    whole = F.try_parse_json(raw)
    inner = F.try_variant_get(whole, f"$.{wrapper}", "variant")
    text = F.try_variant_get(whole, f"$.{wrapper}", "string")
    return F.when(inner.isNull(), whole).when(F.schema_of_variant(inner) == "STRING", F.try_parse_json(text)).otherwise(inner)


def elements(v: Column, name: str) -> Column:
    """The list ``name`` of an object as an array; a lone element stands for a list of one."""
    many = F.try_variant_get(v, f"$.{name}", "array<variant>")
    one = F.try_variant_get(v, f"$.{name}", "variant")
    return F.coalesce(many, F.when(~F.is_variant_null(one), F.array(one)))


def header_value(v: Column, header: str, name: str) -> Column:
    """A header field, the header being an object, key/value entries or lines of text; trimmed, upper case."""
    plain = F.try_variant_get(v, f"$.{header}.{name}", "string")
    entries = F.coalesce(
        F.try_variant_get(v, f"$.{header}", "array<struct<key:string,value:string>>"),
        F.array(F.try_variant_get(v, f"$.{header}", "struct<key:string,value:string>")))
    entry = F.filter(entries, lambda e: F.trim(e["key"]) == name)
    line = F.regexp_extract(F.try_variant_get(v, f"$.{header}", "string"), rf"(?m)^[ \t]*{name}[ \t]*=[ \t]*(.*?)[ \t\r]*$", 1)
    found = F.coalesce(plain, F.try_element_at(entry, F.lit(1))["value"], line)
    return F.nullif(F.upper(F.trim(found)), F.lit(""))


def flatten(df: DataFrame, record: str, value: Column, levels: Sequence[Level], root: Mapping[str, Column] | None = None) -> dict[str, DataFrame]:
    """The tables of the records in ``value`` (VARIANT): ``records`` with the ``root`` columns, one for each level.

    Every table has the record's id, ``dewey``, ``parent`` (NULL for records) and ``ordinals``.
    """
    top = df.select(F.col(record), value.alias("_v")).where(F.col("_v").isNotNull())
    top = top.where(_is_object(F.col("_v"))).select(record, "_v", *[c.alias(n) for n, c in (root or {}).items()])
    names = list(root or {})
    tables = {"records": top.select(record, F.lit("1").alias("dewey"), F.lit(None).cast("string").alias("parent"), F.array(F.lit(1)).alias("ordinals"), *names)}
    at = top.select(record, "_v", F.array(F.lit(1)).alias("_o"), *names)
    for lv in levels:
        at = at.select(record, "_o", *names, F.posexplode(elements(F.col("_v"), lv.items)).alias("_p", "_v"))
        at = at.where(F.col("_v").isNotNull()).where(_is_object(F.col("_v")))
        at = at.select(record, "_v", F.concat("_o", F.array(F.col("_p") + 1)).alias("_o"), *names)
        dewey = F.array_join(F.transform("_o", lambda i: i.cast("string")), ".")
        parent = F.array_join(F.transform(F.slice("_o", 1, F.size("_o") - 1), lambda i: i.cast("string")), ".")
        tables[lv.table] = at.select(
            record, dewey.alias("dewey"), parent.alias("parent"), F.col("_o").alias("ordinals"), *names,
            *[F.try_variant_get("_v", path, kind).alias(c) for c, (path, kind) in lv.columns.items()])
    return tables


def label_nodes(df: DataFrame, record: str, value: Column, max_depth: int = 8) -> DataFrame:
    """Every node of every record, whatever its schema: dewey, parent, schema path, kind and scalar value.

    Fields of an object get the ordinals of their names in order; elements of a list those of their places.
    Nodes below ``max_depth`` stay inside their ancestor's ``value`` as JSON text.
    """
    at = df.select(F.col(record), value.alias("_v"), F.lit("1").alias("dewey"), F.lit(None).cast("string").alias("parent"), F.lit("$").alias("path")).where(F.col("_v").isNotNull())
    levels, spark = [], df.sparkSession
    for depth in range(max_depth + 1):
        kind = F.schema_of_variant("_v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        kind = F.regexp_extract(kind, "^[A-Z]+", 0)
        text = F.when(~nested | (F.lit(depth) == max_depth), F.coalesce(F.try_variant_get("_v", "$", "string"), F.when(~F.is_variant_null("_v"), F.to_json("_v"))))
        levels.append(at.select(record, "dewey", "parent", "path", kind.alias("kind"), text.alias("value")))
        if depth < max_depth:
            view = f"_swathline_{uuid.uuid4().hex}"
            at.createOrReplaceTempView(view)
            # A generator call; the record never leaves its row.
            at = spark.sql(f"SELECT n.`{record}`, e.value AS _v, concat(n.dewey, '.', e.pos + 1) AS dewey, n.dewey AS parent, "
                           "concat(n.path, CASE WHEN e.key IS NULL THEN '[]' ELSE concat('.', e.key) END) AS path "
                           f"FROM {view} n, LATERAL variant_explode(n._v) e")
            spark.catalog.dropTempView(view)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out
