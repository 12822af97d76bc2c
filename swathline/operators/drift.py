"""Records whose fields drift between files: one consistent table, and a report of every change.

Tagged-union inference: every record is read as names with tagged values (no schema, no sampling); the tags of
a file's field are fused by a combining aggregation, keeping each alternative type. Names are brought to their
canonical ones first. A field whose alternatives conflict keeps a typed branch for each and gets one canonical
conversion, to the narrowest type that all its values convert to without loss.

Files of a stream are compared with the file before: a field of a file with the row before of its stream and field,
which is either of the file before or tells that the field is new. Rows of a shard (``shard_span`` numbers of a stream)
are compared among themselves; last rows and known types are carried over borders by a scan of one row a shard.
Neither a stream's files nor a field's history is held by one task.

Defined results: a payload that is NULL, empty or no JSON object has no fields (its file still counts); an
unlisted name stands for itself; several names of one field in a file are a set, and sets are compared; of
several types in one file decimal takes in integer, and any other mixture is text; files of equal number are
one file (of the smallest id); a field with only nulls has no type.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathline.operators import flatten
from swathline.session import cut

#: Tags from narrow to wide.
KINDS = ("boolean", "integer", "decimal", "text")


def kind_of(v: Column) -> Column:
    """Tag of a JSON value as written: integer, decimal, text, boolean, or NULL for a null."""
    s = F.schema_of_variant(v)
    whole = F.regexp_extract(s, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(s == "VOID", F.lit(None).cast("string"))
        .when(s == "BIGINT", "integer")
        .when(s == "STRING", "text")
        .when(s.startswith("DECIMAL") & ~s.endswith(",0)"), "decimal")
        .when((whole != "") & (F.coalesce(whole.try_cast("int"), F.lit(0)) >= 19), "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "decimal")
        .when(s == "BOOLEAN", "boolean")
        .otherwise("text")
    )


def _exploded(df: DataFrame, keep: list[str], payload: str, outer: bool = False) -> DataFrame:
    """The kept columns, name and value (VARIANT) of every field; ``outer``: a row without name for no fields."""
    view = f"_swathline_{uuid.uuid4().hex}"
    df.select(*keep, F.try_parse_json(F.col(payload)).alias("_v")).createOrReplaceTempView(view)
    kept = "".join(f"r.`{k}`, " for k in keep)
    made = f"variant_explode{'_outer' if outer else ''}"
    rows = df.sparkSession.sql(f"SELECT {kept}e.key AS name, e.value AS _v FROM {view} r, LATERAL {made}(r._v) e" + ("" if outer else " WHERE e.key IS NOT NULL"))
    df.sparkSession.catalog.dropTempView(view)
    return rows


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``field``: the canonical name of ``name``; the names are joined by size, they grow with names, not records."""
    known = names.select(F.col("field_name").alias("_n"), F.col("canonical").alias("_c")).dropDuplicates(["_n"])
    return rows.join(known, F.col("name") == F.col("_n"), "left").withColumn("field", F.coalesce("_c", "name")).drop("_n", "_c")


def as_text(v: Column) -> Column:
    """A JSON value as text, NULL for a null; objects and lists as JSON."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.when(~F.is_variant_null(v), F.to_json(v)))


def tagged_fields(df: DataFrame, keep: list[str], payload: str, names: DataFrame) -> DataFrame:
    """One row per record and field: the kept columns, name, field (canonical), kind, and the value as text."""
    rows = _named(_exploded(df, keep, payload), names)
    return rows.select(*keep, "name", "field", kind_of(F.col("_v")).alias("kind"), as_text(F.col("_v")).alias("value"))


def path_types(df: DataFrame, payload: str) -> DataFrame:
    """Every path of the payloads, nested ones too, with each alternative type and how often it occurs."""
    return flatten.label_nodes(df.select(F.lit(0).alias("_r"), F.col(payload)), "_r", F.try_parse_json(F.col(payload))).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def _fused(kinds: Column) -> Column:
    n = F.size(kinds)
    return (
        F.when(n == 0, F.lit(None).cast("string")).when(n == 1, kinds[0])
        .when((n == 2) & F.array_contains(kinds, "integer") & F.array_contains(kinds, "decimal"), "decimal").otherwise("text")
    )


def file_fields(df: DataFrame, stream: str, seq: str, file: str, payload: str, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files (stream, seq, file), and one row for each file and field: stream, seq, field, names, kind."""
    base = df.where(F.col(stream).isNotNull() & F.col(seq).isNotNull())
    base = base.select(F.col(stream).alias("stream"), F.col(seq).cast("bigint").alias("seq"), F.col(file).alias("file"), payload)
    tags = _exploded(base, ["stream", "seq", "file"], payload, outer=True)
    tags = tags.select("stream", "seq", "file", "name", F.when(F.col("name").isNotNull(), kind_of(F.col("_v"))).alias("kind"))
    # A file's names and types are few; its records are combined before anything moves, and payloads are read once.
    tags = cut(tags.groupBy("stream", "seq", "name", "kind").agg(F.min("file").alias("file")))
    fields = _named(tags.where("name IS NOT NULL"), names).groupBy("stream", "seq", "field").agg(F.array_sort(F.collect_set("name")).alias("names"), _fused(F.collect_set("kind")).alias("kind"))
    return tags.groupBy("stream", "seq").agg(F.min("file").alias("file")), fields


def _carried(rows: DataFrame, keys: list[str], ends: DataFrame) -> DataFrame:
    """Rows with the columns of their shard's end row; no key is NULL, so the rows stay where the windows had them."""
    at = {k: f"_e_{k}" for k in [*keys, "_shard"]}
    same = F.lit(True)
    for k, e in at.items():
        same = same & (F.col(k) == F.col(e))
    return rows.join(ends.withColumnsRenamed(at), same, "left").drop(*at.values())


def _neighbours(files: DataFrame, shard_span: int) -> DataFrame:
    """Each file with the number before it and the number and id after it in its stream."""
    me = F.struct("seq", "file")
    rows = files.withColumn("_shard", F.floor(F.col("seq") / shard_span).cast("bigint"))
    inside, over = Window.partitionBy("stream", "_shard").orderBy("seq"), Window.partitionBy("stream").orderBy("_shard")
    ends = rows.groupBy("stream", "_shard").agg(F.min(me).alias("a"), F.max(me).alias("z"))
    ends = ends.select("stream", "_shard", F.lag("z").over(over).alias("z"), F.lead("a").over(over).alias("a"))
    rows = _carried(rows.withColumns({"p": F.lag(me).over(inside), "n": F.lead(me).over(inside)}), ["stream"], ends)
    return rows.select("stream", "seq", "file", F.coalesce("p", "z")["seq"].alias("prev"), F.coalesce("n", "a").alias("next"))


def schema_changes(df: DataFrame, stream: str, seq: str, file: str, payload: str, names: DataFrame, shard_span: int = 4096) -> DataFrame:
    """file id, field, change (added, removed, renamed, retyped) against the file before in the stream."""
    files, fields = file_fields(df, stream, seq, file, payload, names)
    links = _neighbours(files, shard_span).withColumnsRenamed({"stream": "f_stream", "seq": "f_seq"})
    rows = fields.join(links, (F.col("stream") == F.col("f_stream")) & (F.col("seq") == F.col("f_seq"))).drop("f_stream", "f_seq")
    rows = cut(rows.withColumn("_shard", F.floor(F.col("seq") / shard_span).cast("bigint")))
    keys = ["stream", "field"]
    inside = Window.partitionBy(*keys, "_shard").orderBy("seq")
    so_far, over = inside.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy("_shard")
    me = F.struct("seq", "names", "kind")
    # What is known after a row: its type, or nothing where a field begins without one; NULL where it stays as it was.
    known = lambda row, fresh: F.when(fresh | row["kind"].isNotNull(), F.struct(row["kind"].alias("kind")))
    follows = lambda before, prev: before.isNotNull() & before["seq"].eqNullSafe(prev)
    rows = rows.withColumn("p", F.lag(me).over(inside))
    rows = rows.withColumn("_m", F.when(F.col("p").isNotNull(), known(me, ~follows(F.col("p"), F.col("prev")))))
    rows = rows.withColumns({"_k": F.last("_m", ignorenulls=True).over(so_far), "_next": F.lead("seq").over(inside)})
    ends = rows.groupBy(*keys, "_shard").agg(
        F.min_by(F.struct("seq", "kind", "prev"), "seq").alias("a"), F.max_by(me, "seq").alias("z"), F.max_by("_m", F.when(F.col("_m").isNotNull(), F.col("seq"))).alias("m"))
    ends = ends.withColumns({"_p": F.lag("z").over(over), "_n": F.lead("a").over(over)["seq"]})
    ends = ends.withColumn("_first", known(F.col("a"), ~follows(F.col("_p"), F.col("a.prev"))))
    ends = ends.withColumn("_c", F.last(F.coalesce("m", "_first"), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    rows = _carried(rows, keys, ends.select(*keys, "_shard", "_p", "_n", "_first", "_c"))
    before = F.coalesce("p", "_p")
    same = follows(before, F.col("prev"))
    # The first row of a shard is known to its followers by its own state, if it has one.
    state = F.when(F.col("p").isNull(), F.col("_c")).otherwise(F.coalesce("_k", "_first", "_c"))
    mark = lambda cond, what, f: F.when(cond, F.struct(f.alias("file"), F.lit(what).alias("change")))
    last = F.col("next").isNotNull() & ~F.coalesce("_next", "_n").eqNullSafe(F.col("next")["seq"])
    change = F.array_compact(F.array(
        mark(F.col("prev").isNotNull() & ~same, "added", F.col("file")), mark(same & (F.col("names") != before["names"]), "renamed", F.col("file")),
        mark(same & (F.col("kind") != state["kind"]), "retyped", F.col("file")), mark(last, "removed", F.col("next")["file"])))
    return rows.select("field", F.explode(change).alias("_c")).select(F.col("_c.file").alias(file), "field", F.col("_c.change").alias("change"))


def union_types(tags: DataFrame) -> DataFrame:
    """Per field the alternatives with their counts, and the canonical type all values convert to."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    as_double = F.col("value").try_cast("double")
    agg = tags.groupBy("field").agg(
        *[n(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], n(F.col("kind").isNull()).alias("n_null"),
        n(F.col("kind").isNotNull()).alias("n"), n(F.col("kind").isNotNull() & F.col("value").rlike(r"^[+-]?[0-9]{1,18}$")).alias("whole"),
        n(F.col("kind").isNotNull() & as_double.isNotNull()).alias("real"), n(F.col("kind").isNotNull() & F.lower("value").isin("true", "false")).alias("truth"))
    kind = F.when(F.col("n") == 0, F.lit(None).cast("string")).when(F.col("truth") == F.col("n"), "boolean").when(F.col("whole") == F.col("n"), "integer").when(F.col("real") == F.col("n"), "decimal").otherwise("text")
    return agg.select("field", *[f"n_{k}" for k in KINDS], "n_null", kind.alias("canonical_type"))


def typed_branches(tags: DataFrame, keep: list[str]) -> DataFrame:
    """The consistent table in long form: a typed branch for each alternative, and the canonical conversion."""
    types = union_types(tags).select(F.col("field").alias("_f"), "canonical_type")
    v, k = F.col("value"), F.col("kind")
    return tags.join(types, F.col("field") == F.col("_f"), "left").select(
        *keep, "field", "name", "kind", "canonical_type",
        F.when(k == "integer", v.try_cast("bigint")).alias("as_integer"), F.when(k == "decimal", v.try_cast("double")).alias("as_decimal"),
        F.when(k == "boolean", v.try_cast("boolean")).alias("as_boolean"), F.when(k == "text", v).alias("as_text"),
        F.when(F.col("canonical_type").isin("integer", "decimal"), v.try_cast("double")).alias("number"),
        F.when(F.col("canonical_type") == "boolean", v.try_cast("boolean")).alias("truth"), F.when(F.col("canonical_type") == "text", v).alias("text"))


def _at(payload: str, name: str) -> Column:
    """The value of one top-level name of ``_v``, as text."""
    if "'" in name and '"' in name:  # no path can name it
        return F.try_element_at(F.from_json(F.col(payload), "map<string,string>"), F.lit(name))
    q = '"' if "'" in name else "'"
    return as_text(F.try_variant_get("_v", f"$[{q}{name}{q}]", "variant"))


def record_table(df: DataFrame, keep: list[str], payload: str, names: DataFrame) -> DataFrame:
    """The consistent table: a row for each row of ``df``, those without fields too, one column per field in its
    canonical type. Every record is projected where it lies; nothing is shuffled but the counts of names and types.

    Of several values of a field in a record (names of one field) the first by name is the value; all that are not
    null make the branch ``<field>_values`` of texts, which only fields with such records have. Fields named as one
    of ``keep`` end in ``_field``.
    """
    tags = tagged_fields(df, [], payload, names)
    sql = {"integer": "bigint", "decimal": "double", "boolean": "boolean", "text": "string", None: "string"}
    types = [(r["field"], sql[r["canonical_type"]]) for r in union_types(tags).orderBy("field").collect()]  # one row per field
    said: dict[str, list[str]] = {}
    for r in tags.select("field", "name").distinct().collect():  # one row per name
        said.setdefault(r["field"], []).append(r["name"])
    clash = {k.lower() for k in keep}
    name = lambda f: f"{f}_field" if f.lower() in clash else f
    rows = df.select(*keep, payload, F.try_parse_json(F.col(payload)).alias("_v"))
    values = {f: F.array_compact(F.array(*[_at(payload, n) for n in sorted(said[f])])) for f, _ in types}
    shared = [f for f, _ in types if len(said[f]) > 1]
    most = rows.agg(*[F.max(F.size(values[f])).alias(str(i)) for i, f in enumerate(shared)]).first() if shared else []
    several = {f for f, n in zip(shared, most, strict=True) if (n or 0) > 1}
    cols = [F.get(values[f], F.lit(0)).try_cast(t).alias(name(f)) for f, t in types]
    return rows.select(*keep, *cols, *[F.when(F.size(values[f]) > 0, values[f]).alias(f"{name(f)}_values") for f, _ in types if f in several])
