"""The queries of the general data problems over the shared tables (see TESTDATA.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathline.functions import nulls
from swathline.operators import compact, drift, flatten, gapfill, nearby, spikes
from swathline.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time(name: str = "time"):
    return nulls.micros(nulls.instant(F.col(name)))


def p1_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible reading with the kinds that apply, its value and its source's scatter."""
    noise = spikes.Field("sig40_noise", nulls.reading(F.col("sig40_noise")), 0.0, float("inf"))
    beam = spikes.Field("f_backscatter", nulls.reading(F.col("f_backscatter")), -50.0, 50.0)
    alt = spikes.Field("alt", nulls.height(F.col("alt")), -450.0, 9000.0)
    obs = spikes.implausible_readings(table(spark, sf_dir, "observations"), ["collection_id", "location_id"], _time(), "obs_id", [beam, noise])
    ers = spikes.implausible_readings(table(spark, sf_dir, "ers_cells"), ["location_id"], _time(), "ers_id", [alt])
    return obs.unionByName(ers)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field and row id of every implausible reading."""
    return p1_flags(spark, sf_dir).select("field", "rec_id")


def _grid_input(spark: SparkSession, sf_dir: str):
    steps = table(spark, sf_dir, "cell_collections").select(F.col("collection_id").alias("c"), (F.col("grid_step_h").cast("bigint") * 3600).alias("step_s"))
    obs = table(spark, sf_dir, "observations").select("collection_id", "location_id", "time", "surface_soil_moisture")
    rows = obs.join(steps, F.col("collection_id") == F.col("c")).drop("c")
    seconds = F.floor(_time() / 1_000_000).cast("bigint")
    return rows, ["collection_id", "location_id"], seconds, F.col("step_s"), nulls.reading(F.col("surface_soil_moisture"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps without a usable reading between a source's first and last step."""
    gaps = gapfill.missing_steps(*_grid_input(spark, sf_dir))
    return gaps.select("collection_id", "location_id", (F.col("_step") * F.col("_w")).alias("step_start_s"))


def p3_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series with gaps filled linearly (rounded, as sums depend on their order)."""
    s = gapfill.regular_series(*_grid_input(spark, sf_dir), fill="linear")
    return s.select("collection_id", "location_id", "step_start_s", "n_readings", F.round("value", 4).alias("value"), F.round("filled", 4).alias("filled"), "missing")


EPS_LEVELS = (
    flatten.Level("lines", "MDR", {"utc_day": ("$.UTC_LINE_NODES.DAY", "bigint"), "utc_ms": ("$.UTC_LINE_NODES.MS", "bigint"), "abs_line_number": ("$.ABS_LINE_NUMBER", "bigint")}),
    flatten.Level("nodes", "NODES", {"latitude": ("$.LATITUDE", "double"), "longitude": ("$.LONGITUDE", "double"), "soil_moisture": ("$.SOIL_MOISTURE.VALUE", "double"), "soil_moisture_error": ("$.SOIL_MOISTURE.ERROR", "double")}),
    flatten.Level("beams", "BEAMS", {"beam": ("$.BEAM", "string"), "sigma0": ("$.SIGMA0", "double"), "kp": ("$.KP", "double"), "f_usable": ("$.FLAGS.F_USABLE", "int"), "f_land": ("$.FLAGS.F_LAND", "double")}),
)
EPS_AUX = flatten.Level("aux", "SPHR.AUX", {"name": ("$.NAME", "string"), "version": ("$.VERSION", "string")})
#: Header fields of the records alone, besides those that all tables have.
EPS_HEADER = {"format_minor_version": "int", "instrument_model": "string", "orbit_start": "bigint", "processing_level": "string", "product_name": "string", "sensing_start": "string"}


def eps_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The flat tables of the nested products: records, lines, nodes, beams, and aux (the list in the SPHR)."""
    v = F.col("_v")
    header = lambda name: flatten.header_value(v, "MPHR", name)
    root = {"product_type": F.coalesce(header("PRODUCT_TYPE"), F.lit("NONE")), "format_major_version": header("FORMAT_MAJOR_VERSION").try_cast("int"), "spacecraft_id": header("SPACECRAFT_ID")}
    more = {n: header(n.upper()).try_cast(t) for n, t in EPS_HEADER.items()} | {"n_lines": F.try_variant_get(v, "$.SPHR.N_LINES", "bigint")}
    flat = lambda levels, columns: flatten.flatten(table(spark, sf_dir, "eps_products"), "rec_id", flatten.body(F.col("raw")), levels, columns)
    return flat(EPS_LEVELS, root) | {"records": flat((), root | more)["records"], "aux": flat((EPS_AUX,), root)["aux"]}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each beam object, by its ordinals."""
    o = F.col("ordinals")
    return eps_tables(spark, sf_dir)["beams"].select("rec_id", "product_type", o[1].alias("mdr_no"), o[2].alias("node_no"), o[3].alias("beam_no"))


def _p4(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return eps_tables(spark, sf_dir)[name].drop("ordinals")

    query.__doc__ = f"The flat table of {name}."
    return query


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of locations at most one kilometre apart."""
    return nearby.within_distance(table(spark, sf_dir, "locations"), "location_id", "lat", "lon", 1000.0).select("location_id_a", "location_id_b")


def p5_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5-degree cell that holds each location, the cells given as boxes."""
    loc = table(spark, sf_dir, "locations")
    west, south = F.floor(F.col("cell") / 36) * 5 - 180, F.pmod("cell", F.lit(36)) * 5 - 90
    boxes = loc.select("cell").dropna().distinct().select("cell", south.alias("lat_min"), (south + 5).alias("lat_max"), west.alias("lon_min"), (west + 5).alias("lon_max"))
    return nearby.containing_region(loc, "location_id", "lat", "lon", boxes, "cell")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a field from one file of a stream to the next."""
    return drift.schema_changes(table(spark, sf_dir, "l2_records"), "stream", "file_seq", "file_id", "payload", table(spark, sf_dir, "field_names"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.tagged_fields(table(spark, sf_dir, "l2_records"), ["file_id", "rec_no"], "payload", table(spark, sf_dir, "field_names"))


def p6_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's alternative types with counts, and its canonical type."""
    return drift.union_types(_tags(spark, sf_dir))


def p6_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as one long table with typed branches and canonical conversions."""
    return drift.typed_branches(_tags(spark, sf_dir), ["file_id", "rec_no"])


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as one wide table under canonical names and types."""
    return drift.record_table(table(spark, sf_dir, "l2_records"), ["file_id", "rec_no"], "payload", table(spark, sf_dir, "field_names"))


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path of the payloads with its alternative JSON types and their counts."""
    return drift.path_types(table(spark, sf_dir, "l2_records"), "payload")


RECORD = "collection_id int, location_id bigint, time_s bigint, backscatter40 double, sm double, _order bigint"


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted records of the tiny files: landed as they are, compacted, read again."""
    coll = table(spark, sf_dir, "cell_collections").select("collection_id", "fn_pattern", "sat").dropna().collect()  # ten rows at any scale
    patterns = [(r["collection_id"], compact.pattern_regex(r["fn_pattern"], {"sat": r["sat"]})) for r in coll]
    found = compact.parse_files(table(spark, sf_dir, "swath_files"), "file_name", "content", "file_id", patterns, "collection_id")
    landed = compact.PartitionedTable(spark, scratch_path(spark, "swaths"), RECORD, "collection_id")
    landed.append(found)
    landed.compact(["location_id", "time_s"], "_order")
    return landed.read()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection, location and time of each record in the compacted files."""
    return p7_records(spark, sf_dir).select("collection_id", "location_id", "time_s")


_STEPS = """
WITH r AS (
  SELECT o.collection_id, o.location_id, c.grid_step_h * 3600 AS w, floor(epoch_us(o.time) / 1000000)::BIGINT AS t, o.surface_soil_moisture::DOUBLE AS v
  FROM observations o JOIN cell_collections c USING (collection_id)
  WHERE o.location_id IS NOT NULL AND o.time IS NOT NULL AND o.time <> TIMESTAMP '1970-01-01' AND o.surface_soil_moisture IS NOT NULL
    AND NOT isnan(o.surface_soil_moisture) AND abs(o.surface_soil_moisture) <= 1e37 AND o.surface_soil_moisture <> -999999),
s AS (SELECT collection_id, location_id, w, floor(t / w)::BIGINT AS step, count(*) AS n, avg(v) AS v FROM r GROUP BY ALL),
g AS (SELECT *, lead(step) OVER p AS nxt, lead(v) OVER p AS nv FROM s WINDOW p AS (PARTITION BY collection_id, location_id ORDER BY step)),
m AS (SELECT collection_id, location_id, w, unnest(range(step + 1, nxt)) AS step, step AS a, nxt AS b, v AS va, nv AS vb FROM g WHERE nxt > step + 1)
"""

QUERIES = {"p1_found": p1_found, "p1_flags": p1_flags, "p3_found": p3_found, "p3_series": p3_series,
           "p4_found": p4_found, "p4_records": _p4("records"), "p4_lines": _p4("lines"), "p4_nodes": _p4("nodes"), "p4_beams": _p4("beams"), "p4_aux": _p4("aux"),
           "p5_found": p5_found, "p5_regions": p5_regions, "p6_found": p6_found, "p6_types": p6_types, "p6_branches": p6_branches, "p6_table": p6_table, "p6_paths": p6_paths, "p7_found": p7_found}
_PLACES = """
WITH p AS (SELECT DISTINCT location_id AS id, lat, lon FROM locations
           WHERE location_id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 360 AND NOT isnan(lat) AND NOT isnan(lon))
"""
_EPS = r"""
WITH j AS (SELECT rec_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM eps_products),
b AS (SELECT rec_id, CASE json_type(j, '$.PRODUCT') WHEN 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$.PRODUCT') THEN (j ->> '$.PRODUCT')::JSON END
  WHEN 'OBJECT' THEN j -> '$.PRODUCT' ELSE j END AS v FROM j WHERE json_type(j) = 'OBJECT'),
e AS (SELECT rec_id, v, unnest(CASE WHEN json_type(v, '$.MPHR') = 'ARRAY' THEN from_json(v -> '$.MPHR', '["JSON"]') ELSE [NULL::JSON] END) AS e FROM b),
""" + "h AS (SELECT rec_id, " + ", ".join(
    rf"""max(nullif(upper(trim(CASE json_type(v, '$.MPHR') WHEN 'OBJECT' THEN v ->> '$.MPHR.{n}'
    WHEN 'ARRAY' THEN CASE WHEN e ->> '$.key' = '{n}' THEN e ->> '$.value' END
    ELSE regexp_extract(v ->> '$.MPHR', '(?:^|\n){n} *= *([^\n]*)', 1) END)), '')) AS {n}"""
    for n in ("PRODUCT_TYPE", "FORMAT_MAJOR_VERSION", "SPACECRAFT_ID", *[x.upper() for x in EPS_HEADER])) + """,
  max(CASE WHEN json_type(v, '$.SPHR.N_LINES') IN ('BIGINT', 'UBIGINT') THEN (v ->> '$.SPHR.N_LINES')::BIGINT END) AS n_lines FROM e GROUP BY rec_id),
r AS (SELECT rec_id, coalesce(PRODUCT_TYPE, 'NONE') AS product_type, try_cast(FORMAT_MAJOR_VERSION AS INT) AS format_major_version, SPACECRAFT_ID AS spacecraft_id FROM h),
""" + ",\n".join(
    f"""{t} AS (SELECT rec_id, unnest(l) AS v, generate_subscripts(l, 1) AS no, dewey AS parent, dewey || '.' || generate_subscripts(l, 1) AS dewey FROM (
  SELECT rec_id, {d} AS dewey, CASE json_type(v, '$.{n}') WHEN 'ARRAY' THEN from_json(v -> '$.{n}', '["JSON"]') WHEN 'OBJECT' THEN [v -> '$.{n}'] ELSE [] END AS l FROM {f}))"""
    for t, n, f, d in (("m", "MDR", "b", "'1'"), ("n", "NODES", "m", "dewey"), ("k", "BEAMS", "n", "dewey"), ("x", "SPHR.AUX", "b", "'1'")))


def _flat_sql(level: flatten.Level, rows: str) -> str:
    kinds = {"bigint": ("BIGINT", "'BIGINT', 'UBIGINT'"), "int": ("INT", "'BIGINT', 'UBIGINT'"), "double": ("DOUBLE", "'BIGINT', 'UBIGINT', 'DOUBLE'"), "string": ("VARCHAR", "'VARCHAR'")}
    cols = "".join(f", CASE WHEN json_type(v, '{path}') IN ({kinds[k][1]}) THEN (v ->> '{path}')::{kinds[k][0]} END AS {c}" for c, (path, k) in level.columns.items())
    return _EPS + f"SELECT rec_id, dewey, parent, product_type, format_major_version, spacecraft_id{cols} FROM {rows} JOIN r USING (rec_id) WHERE json_type(v) = 'OBJECT'"


_TAGS = """
WITH r AS (SELECT file_id, rec_no, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM l2_records),
k AS (SELECT file_id, rec_no, p, unnest(json_keys(p)) AS name FROM r WHERE json_type(p) = 'OBJECT'),
t AS (SELECT file_id, rec_no, name, coalesce(canonical, name) AS field, json_type(p, '$."' || name || '"') AS j, p ->> ('$."' || name || '"') AS value FROM k LEFT JOIN field_names ON field_name = name),
u AS (SELECT file_id, rec_no, field, name, value, CASE WHEN j IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' WHEN j = 'DOUBLE' THEN 'decimal' WHEN j = 'BOOLEAN' THEN 'boolean' WHEN j = 'NULL' THEN NULL ELSE 'text' END AS kind FROM t),
y AS (SELECT field, count(*) FILTER (kind = 'boolean') AS n_boolean, count(*) FILTER (kind = 'integer') AS n_integer, count(*) FILTER (kind = 'decimal') AS n_decimal, count(*) FILTER (kind = 'text') AS n_text,
  count(*) FILTER (kind IS NULL) AS n_null,
  CASE WHEN count(kind) = 0 THEN NULL WHEN count(*) FILTER (kind IS NOT NULL AND lower(value) IN ('true', 'false')) = count(kind) THEN 'boolean'
    WHEN count(*) FILTER (kind IS NOT NULL AND regexp_full_match(value, '[+-]?[0-9]{1,18}')) = count(kind) THEN 'integer'
    WHEN count(*) FILTER (kind IS NOT NULL AND try_cast(value AS DOUBLE) IS NOT NULL) = count(kind) THEN 'decimal' ELSE 'text' END AS canonical_type FROM u GROUP BY field)
"""
SQL: dict[str, str] = {
    "p4_records": _EPS + "SELECT rec_id, '1' AS dewey, NULL::VARCHAR AS parent, r.product_type, r.format_major_version, r.spacecraft_id, " + ", ".join(
        f"try_cast(h.{n.upper()} AS {t.upper().replace('STRING', 'VARCHAR')}) AS {n}" for n, t in EPS_HEADER.items()) + ", h.n_lines FROM h JOIN r USING (rec_id)",
    **{f"p4_{lv.table}": _flat_sql(lv, rows) for lv, rows in zip((*EPS_LEVELS, EPS_AUX), "mnkx", strict=True)},
    "p6_types": _TAGS + "SELECT * FROM y",
    "p6_branches": _TAGS + """
SELECT file_id, rec_no, field, name, kind, canonical_type, CASE WHEN kind = 'integer' THEN value::BIGINT END AS as_integer, CASE WHEN kind = 'decimal' THEN value::DOUBLE END AS as_decimal,
  CASE WHEN kind = 'boolean' THEN value::BOOLEAN END AS as_boolean, CASE WHEN kind = 'text' THEN value END AS as_text,
  CASE WHEN kind IS NOT NULL AND canonical_type IN ('integer', 'decimal') THEN try_cast(value AS DOUBLE) END AS number,
  CASE WHEN kind IS NOT NULL AND canonical_type = 'boolean' THEN try_cast(value AS BOOLEAN) END AS truth, CASE WHEN kind IS NOT NULL AND canonical_type = 'text' THEN value END AS text
FROM u JOIN y USING (field)""",
    "p6_paths": """
WITH r AS (SELECT payload::JSON AS p FROM l2_records WHERE json_valid(payload)),
k AS (SELECT p, unnest(json_keys(p)) AS name FROM r WHERE json_type(p) = 'OBJECT'),
t AS (SELECT '$' AS path, json_type(p) AS j, NULL AS v FROM r UNION ALL SELECT '$.' || name, json_type(p, '$."' || name || '"'), p ->> ('$."' || name || '"') FROM k)
SELECT path, CASE WHEN j IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' WHEN j = 'VARCHAR' THEN 'STRING' WHEN j = 'NULL' THEN 'VOID' WHEN j = 'DOUBLE' THEN 'DECIMAL' ELSE j END AS kind, count(*) AS n FROM t GROUP BY ALL""",
    "p4_found": r"""
WITH j AS (SELECT rec_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM eps_products),
b AS (SELECT rec_id, CASE json_type(j, '$.PRODUCT') WHEN 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$.PRODUCT') THEN (j ->> '$.PRODUCT')::JSON END
  WHEN 'OBJECT' THEN j -> '$.PRODUCT' ELSE j END AS v FROM j WHERE json_type(j) = 'OBJECT'),
e AS (SELECT rec_id, v, unnest(CASE WHEN json_type(v, '$.MPHR') = 'ARRAY' THEN from_json(v -> '$.MPHR', '["JSON"]') ELSE [NULL::JSON] END) AS e FROM b),
h AS (SELECT rec_id, coalesce(max(nullif(upper(trim(CASE json_type(v, '$.MPHR') WHEN 'OBJECT' THEN v ->> '$.MPHR.PRODUCT_TYPE'
    WHEN 'ARRAY' THEN CASE WHEN e ->> '$.key' = 'PRODUCT_TYPE' THEN e ->> '$.value' END
    ELSE regexp_extract(v ->> '$.MPHR', '(?:^|\n)PRODUCT_TYPE *= *([^\n]*)', 1) END)), '')), 'NONE') AS product_type FROM e GROUP BY rec_id),
m AS (SELECT rec_id, unnest(l) AS v, generate_subscripts(l, 1) AS mdr_no FROM (SELECT rec_id, CASE json_type(v, '$.MDR') WHEN 'ARRAY' THEN from_json(v -> '$.MDR', '["JSON"]') WHEN 'OBJECT' THEN [v -> '$.MDR'] ELSE [] END AS l FROM b)),
n AS (SELECT rec_id, mdr_no, unnest(l) AS v, generate_subscripts(l, 1) AS node_no FROM (SELECT rec_id, mdr_no, CASE json_type(v, '$.NODES') WHEN 'ARRAY' THEN from_json(v -> '$.NODES', '["JSON"]') WHEN 'OBJECT' THEN [v -> '$.NODES'] ELSE [] END AS l FROM m)),
k AS (SELECT rec_id, mdr_no, node_no, unnest(l) AS v, generate_subscripts(l, 1) AS beam_no FROM (SELECT rec_id, mdr_no, node_no, CASE json_type(v, '$.BEAMS') WHEN 'ARRAY' THEN from_json(v -> '$.BEAMS', '["JSON"]') WHEN 'OBJECT' THEN [v -> '$.BEAMS'] ELSE [] END AS l FROM n))
SELECT rec_id, product_type, mdr_no::INT AS mdr_no, node_no::INT AS node_no, beam_no::INT AS beam_no FROM k JOIN h USING (rec_id) WHERE json_type(v) = 'OBJECT'""",
    "p6_found": r"""
WITH r AS (SELECT stream, file_seq, file_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM l2_records WHERE stream IS NOT NULL AND file_seq IS NOT NULL),
k AS (SELECT stream, file_seq, p, unnest(json_keys(p)) AS name FROM r WHERE json_type(p) = 'OBJECT'),
t AS (SELECT stream, file_seq, name, coalesce(canonical, name) AS field, json_type(p, '$."' || name || '"') AS j FROM k LEFT JOIN field_names ON field_name = name),
u AS (SELECT stream, file_seq, field, name, CASE WHEN j IN ('BIGINT', 'UBIGINT', 'HUGEINT') THEN 'integer' WHEN j = 'DOUBLE' THEN 'decimal' WHEN j = 'BOOLEAN' THEN 'boolean' WHEN j = 'NULL' THEN NULL ELSE 'text' END AS kind FROM t),
f AS (SELECT stream, file_seq, field, string_agg(DISTINCT name, ',' ORDER BY name) AS names, CASE WHEN count(DISTINCT kind) = 1 THEN max(kind) WHEN count(DISTINCT kind) = 2 AND bool_and(coalesce(kind, 'integer') IN ('integer', 'decimal')) THEN 'decimal' WHEN count(DISTINCT kind) > 1 THEN 'text' END AS kind FROM u GROUP BY ALL),
g AS (SELECT stream, file_seq, min(file_id) AS file_id FROM r GROUP BY ALL),
h AS (SELECT *, lag(file_seq) OVER (PARTITION BY stream ORDER BY file_seq) AS prev FROM g),
c AS (SELECT f.*, h.file_id, h.prev, b.names AS was FROM f JOIN h USING (stream, file_seq) LEFT JOIN f b ON b.stream = f.stream AND b.field = f.field AND b.file_seq = h.prev),
d AS (SELECT *, sum(CASE WHEN was IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY stream, field ORDER BY file_seq) AS run FROM c),
l AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY stream, field, run ORDER BY file_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM d)
SELECT file_id, field, 'added' AS change FROM l WHERE prev IS NOT NULL AND was IS NULL
UNION ALL SELECT file_id, field, 'renamed' FROM l WHERE was <> names
UNION ALL SELECT file_id, field, 'retyped' FROM l WHERE was IS NOT NULL AND kind <> known
UNION ALL SELECT h.file_id, b.field, 'removed' FROM h JOIN f b ON b.stream = h.stream AND b.file_seq = h.prev ANTI JOIN f ON f.stream = h.stream AND f.file_seq = h.file_seq AND f.field = b.field""",
    "p7_found": r"""
WITH c AS (SELECT collection_id, '^' || regexp_replace(regexp_replace(replace(replace(fn_pattern, '.', '[.]'), '{sat}', sat), '\{date\}', '[0-9]{14}', 'g'), '\{[a-z]+[0-9]*\}', '[^_]+', 'g') || '$' AS rx FROM cell_collections),
l AS (SELECT c.collection_id, unnest(string_split_regex(f.content, '\r?\n')) AS line FROM swath_files f JOIN c ON regexp_matches(f.file_name, c.rx)),
p AS (SELECT collection_id, string_split_regex(line, '[,;\t]') AS p FROM l),
r AS (SELECT collection_id, p[1] AS loc, p[2] AS t FROM p WHERE len(p) = 4 AND regexp_matches(p[1], '^[0-9]+$'))
SELECT DISTINCT collection_id, loc::BIGINT AS location_id,
  CASE WHEN regexp_matches(t, '^[0-9]{14}$') THEN epoch(strptime(t, '%Y%m%d%H%M%S'))::BIGINT
       WHEN regexp_matches(t, '^[0-9]+$') THEN t::BIGINT ELSE epoch(strptime(t, '%Y-%m-%dT%H:%M:%SZ'))::BIGINT END AS time_s
FROM r WHERE regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$')""",
    "p5_found": _PLACES + """
SELECT a.id AS location_id_a, b.id AS location_id_b FROM p a JOIN p b ON a.id < b.id AND abs(a.lat - b.lat) < 0.01
WHERE 2 * 6371000 * asin(sqrt(least(1.0, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) <= 1000""",
    "p5_regions": _PLACES + """
, c AS (SELECT DISTINCT cell FROM locations WHERE cell IS NOT NULL),
q AS (SELECT id, lat, CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END AS lon FROM p)
SELECT q.id AS location_id, c.cell FROM q JOIN c ON c.cell = (floor((q.lon + 180) / 5) * 36 + floor((q.lat + 90) / 5))::INT WHERE q.lat < 90""",
    "p3_found": _STEPS + "SELECT collection_id, location_id, step * w AS step_start_s FROM m",
    "p3_series": _STEPS + """
SELECT collection_id, location_id, step * w AS step_start_s, n AS n_readings, round(v, 4) AS value, round(v, 4) AS filled, false AS missing FROM s
UNION ALL SELECT collection_id, location_id, step * w, 0, NULL, round(va + (vb - va) * ((step - a) / (b - a)), 4), true FROM m""",
}
