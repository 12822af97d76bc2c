"""General data operators against brute force on small fixtures, with the hard cases of each."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.functions import nulls
from swathline.operators import compact, drift, flatten, gapfill, nearby, spikes
from swathline.operators.sharding import last_before
from swathline.plans import problems
from swathline.session import scratch_path

T0 = datetime(2007, 1, 1)


# --- implausible readings -----------------------------------------------------------------------------------


def _readings(spark, rows):
    return spark.createDataFrame(rows, "src int, extra string, t timestamp_ntz, id bigint, v float")


def _flag(df, **options):
    field = spikes.Field("v", nulls.reading(F.col("v")), -50.0, 50.0)
    got = spikes.implausible_readings(df, ["src"], nulls.micros(nulls.instant(F.col("t"))), "id", [field], **options)
    return {r["rec_id"]: (r["impossible"], r["stuck"], r["spike"]) for r in got.collect()}


def _noisy(seed, n, src=1, start=0):
    rng = random.Random(seed)
    return [(src, "x", T0 + timedelta(hours=i), start + i, float(np.float32(rng.gauss(0, 1)))) for i in range(n)]


def _set(rows, i, v):
    rows[i] = (*rows[i][:4], v)


def _mixed():
    rows = _noisy(1, 400)
    _set(rows, 50, 40.0)
    _set(rows, 100, 60.0)
    for i in (150, 151, 152):
        _set(rows, i, -30.0 + i / 1000)
    for i in range(200, 230):
        _set(rows, i, rows[i][4] + 35)
    for i in range(300, 309):
        _set(rows, i, 0.25)
    _set(rows, 350, 1.7e38)
    _set(rows, 351, float("nan"))
    _set(rows, 352, None)
    return rows


def test_spikes_kinds(spark):
    got = _flag(_readings(spark, _mixed()))
    assert got[50] == (False, False, True)
    assert got[100][0]
    assert all(got[i] == (False, False, True) for i in (150, 151, 152))
    assert not any(i in got for i in range(200, 230)), "a level that lasts is no spike"
    assert all(got[i][1] for i in range(300, 309))
    assert set(got) == {50, 100, 150, 151, 152, *range(300, 309)}


def test_spikes_chunked_like_whole(spark):
    rows = _mixed() + _noisy(2, 300, 2, 1000) + [(3, "x", T0, 5000 + i, 7.0 if i % 50 else 8.0) for i in range(300)]
    df = _readings(spark, rows)
    assert _flag(df) == _flag(df, max_group_rows=100, chunk_rows=40)


def test_spikes_edges(spark):
    assert _flag(_readings(spark, [])) == {}
    constant = [(1, None, T0 + timedelta(hours=i), i, 5.0) for i in range(20)]
    assert _flag(_readings(spark, constant)) == {}, "a constant source has no stuck readings"
    rows = [(1, "x", None, 1, 99.0), (None, "x", T0, 2, 99.0), (1, "x", datetime(1970, 1, 1), 3, 99.0), (1, "x", T0, 4, 99.0)]
    assert _flag(_readings(spark, rows)) == {4: (True, False, False)}


def test_normal_reading_between_spikes(spark):
    rows = _noisy(3, 200)
    _set(rows, 90, 45.0)
    _set(rows, 92, 46.0)
    assert set(_flag(_readings(spark, rows))) == {90, 92}


# --- regular grid -------------------------------------------------------------------------------------------


def _gap_rows():
    rng = random.Random(4)
    rows = [(s, rng.randrange(-40, 400) * 1000 + rng.randrange(1000), rng.choice([1.0, 2.0, None, float("nan")]), 3600 * (1 + s % 3)) for s in range(6) for _ in range(40)]
    return [*rows, rows[0], rows[0], (99, 5, None, 3600), (None, 5, 1.0, 3600), (98, None, 1.0, 3600), (97, 5, 1.0, None)]


def test_gaps_brute_force(spark):
    rows = _gap_rows()
    df = spark.createDataFrame(rows, "s int, t bigint, v double, w int")
    exp = set()
    steps = {}
    for s, t, v, w in rows:
        if None not in (s, t, v, w) and not math.isnan(v):
            steps.setdefault((s, w), set()).add(t // w)
    for (s, w), have in steps.items():
        exp |= {(s, k) for k in range(min(have), max(have)) if k not in have}
    for span in (4096, 3):
        got = gapfill.missing_steps(df, ["s"], F.col("t"), F.col("w"), nulls.reading(F.col("v")), shard_steps=span)
        assert {(r["s"], r["_step"]) for r in got.collect()} == exp


def test_series_fill(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 10, 3.0), (1, 40, 9.0)], "s int, t bigint, v double")
    got = gapfill.regular_series(df, ["s"], F.col("t"), F.lit(10), F.col("v"), "linear", 2).orderBy("step_start_s").collect()
    assert [(r["step_start_s"], r["missing"], r["filled"]) for r in got] == [(0, False, 1.0), (10, False, 3.0), (20, True, 5.0), (30, True, 7.0), (40, False, 9.0)]
    last = gapfill.regular_series(df, ["s"], F.col("t"), F.lit(10), F.col("v"), "last", 2).orderBy("step_start_s").collect()
    assert [r["filled"] for r in last] == [1.0, 3.0, 3.0, 3.0, 9.0]
    assert gapfill.regular_series(df.where("false"), ["s"], F.col("t"), F.lit(10), F.col("v")).count() == 0
    with pytest.raises(ValueError):
        gapfill.regular_series(df, ["s"], F.col("t"), F.lit(10), F.col("v"), "mean")


def test_crowded_cubes_salted_on_both_sides(spark):
    rng = random.Random(11)
    rows = [(i, 10 + rng.random() / 60, 20 + rng.random() / 60) for i in range(120)] + [(500, 10.001, 20.001), (501, 10.001, 20.001), (502, None, 1.0)]
    df = spark.createDataFrame(rows, "p int, lat double, lon double")
    plain = {tuple(r)[:2] for r in nearby.within_distance(df, "p", "lat", "lon", 500.0).collect()}
    salted = [tuple(r)[:2] for r in nearby.within_distance(df, "p", "lat", "lon", 500.0, max_cell_rows=7).collect()]
    assert len(salted) == len(plain) > 100 and set(salted) == plain and (500, 501) in plain


def test_gaps_of_one_source_of_many_shards(spark):
    """Only summaries are ordered by source: the window over whole sources reads two steps a shard."""
    rng = random.Random(5)
    at = sorted(rng.sample(range(-3000, 30_000), 2_000))
    df = spark.createDataFrame([(1, t * 60, 1.0) for t in at], "src int, t bigint, v double")
    gaps = gapfill.missing_steps(df, ["src"], F.col("t"), F.lit(60), F.col("v"), shard_steps=16)
    assert sorted(r["_step"] for r in gaps.collect()) == sorted(set(range(at[0], at[-1] + 1)) - set(at))
    windows = [w for w in gaps._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in w]
    assert len(windows) == 2 and sum("_shard" in w.split("], [")[1] for w in windows) == 1
    whole = next(w for w in windows if "_shard" not in w.split("], [")[1])
    assert "_last" in whole


# --- nested records -----------------------------------------------------------------------------------------

_LEVELS = (flatten.Level("lines", "MDR"), flatten.Level("nodes", "NODES"), flatten.Level("beams", "BEAMS", {"s": ("$.S", "double")}))


def test_scatter_chunked_like_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, k * 1_000 + i, float(round(x, 2)), 60.0) for k in (1, 2) for i, x in enumerate(rng.normal(0, 1, 501 - k))]
    rows += [(1, 9_000 + k, 9_000 + k, 99.0, 99.0) for k in range(3)]
    df = spark.createDataFrame(rows, "k int, t bigint, i bigint, a double, b double")
    fields = [spikes.Field("a", F.col("a"), -50.0, 50.0), spikes.Field("b", F.col("b"), -50.0, 50.0)]
    runs = [{(r["field"], r["rec_id"]): r["scatter"] for r in spikes.implausible_readings(df, ["k"], F.col("t"), "i", fields, **o).collect()} for o in ({}, {"max_group_rows": 100, "chunk_rows": 70})]
    assert runs[0] and runs[0] == runs[1]


def test_spike_towards_the_median():
    """A slow swing of uncorrelated steps; the spike leads back to the median, so its residual is small."""
    rng = np.random.default_rng(1)
    x = 9 * np.sin(np.arange(4_000) * 2 * np.pi / 2_000) + rng.normal(0, 1, 4_000)
    x[499:502] = 9, -2, 9
    seg = np.zeros(len(x), np.int64)
    scatter, _ = spikes.fit(seg, x, 1)
    assert abs(x[500]) < 3 * scatter[0]
    assert np.flatnonzero(spikes.spikes(seg, x, scatter, np.zeros(1))).tolist() == [500]


def test_flatten(spark):
    plain = {"MPHR": {"PRODUCT_TYPE": " smr "}, "MDR": [None, {"NODES": {"BEAMS": [{"S": 1.5}, None, {"S": "x"}]}}, {"NODES": [{"BEAMS": []}, {"BEAMS": None}, {}]}]}
    records = [
        (1, json.dumps(plain)), (2, json.dumps({"PRODUCT": json.dumps({"MPHR": [{"key": "PRODUCT_TYPE", "value": "szo"}], "MDR": {"NODES": [{"BEAMS": {"S": 2}}]}})})),
        (3, json.dumps({"PRODUCT": {"MPHR": "A = 1\nPRODUCT_TYPE   = smo \n"}})), (4, json.dumps(plain)[:-9]), (5, ""), (6, None), (7, "[1, 2]"), (8, json.dumps({"MPHR": None, "MDR": []})),
    ]
    df = spark.createDataFrame(records, "rec_id bigint, raw string")
    root = {"kind": F.coalesce(flatten.header_value(F.col("_v"), "MPHR", "PRODUCT_TYPE"), F.lit("NONE"))}
    t = flatten.flatten(df, "rec_id", flatten.body(F.col("raw")), _LEVELS, root)
    assert {(r["rec_id"], r["kind"]) for r in t["records"].collect()} == {(1, "SMR"), (2, "SZO"), (3, "SMO"), (8, "NONE")}
    assert {(r["rec_id"], r["dewey"], r["parent"], r["s"]) for r in t["beams"].collect()} == {(1, "1.2.1.1", "1.2.1", 1.5), (1, "1.2.1.3", "1.2.1", None), (2, "1.1.1.1", "1.1.1", 2.0)}
    for child, parent in (("beams", "nodes"), ("nodes", "lines"), ("lines", "records")):
        have = {(r["rec_id"], r["dewey"]) for r in t[parent].collect()}
        assert all((r["rec_id"], r["parent"]) in have for r in t[child].collect())
    assert flatten.flatten(df.where("false"), "rec_id", flatten.body(F.col("raw")), _LEVELS)["beams"].count() == 0


def test_eps_records_whole(spark, tmp_path):
    """All header fields and the SPHR, whatever the shape of header and list."""
    head = {"PRODUCT_TYPE": "szo", "FORMAT_MINOR_VERSION": 0, "INSTRUMENT_MODEL": " 1", "ORBIT_START": "42109", "PROCESSING_LEVEL": "02", "PRODUCT_NAME": "SCAX_1", "SENSING_START": "20070309073842Z"}
    aux = [{"NAME": "WET", "VERSION": "3"}, None, {"NAME": "DRY", "VERSION": "4"}]
    raws = [json.dumps({"MPHR": h, "SPHR": {"N_LINES": 2, "AUX": a}}) for h, a in (
        (head, aux), ([{"key": k, "value": v} for k, v in head.items()], aux[0]), ("\n".join(f"{k} = {v}" for k, v in head.items()), []))]
    raws += [json.dumps({"PRODUCT": raws[0]}), "{}", None]
    spark.createDataFrame(list(enumerate(raws)), "rec_id bigint, raw string").write.parquet(f"{tmp_path}/eps_products.parquet")
    found = problems.eps_tables(spark, str(tmp_path))
    got = {r["rec_id"]: tuple(r[c] for c in (*problems.EPS_HEADER, "n_lines")) for r in found["records"].collect()}
    whole = (0, "1", 42109, "02", "SCAX_1", "20070309073842Z", 2)
    assert got == {0: whole, 1: whole, 2: whole, 3: whole, 4: (None,) * 7}
    both = [("1.1", "1", "WET", "3"), ("1.3", "1", "DRY", "4")]
    got = sorted((r["rec_id"], r["dewey"], r["parent"], r["name"], r["version"]) for r in found["aux"].collect())
    assert got == [(0, *both[0]), (0, *both[1]), (1, *both[0]), (3, *both[0]), (3, *both[1])]


def test_label_nodes(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": null}], "c": "x"}'), (2, "{")], "i bigint, raw string")
    got = {(r["dewey"], r["parent"], r["path"], r["kind"], r["value"]) for r in flatten.label_nodes(df, "i", F.try_parse_json("raw")).collect()}
    assert ("1.1.2.1", "1.1.2", "$.a[].b", "VOID", None) in got and ("1.2", "1", "$.c", "STRING", "x") in got and len(got) == 6


# --- points -------------------------------------------------------------------------------------------------


def _far(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("cap", [20_000, 5])
def test_within_distance(spark, cap):
    rng = random.Random(6)
    rows = []
    for i, (la, lo) in enumerate([(0, 0), (89.999, 10), (-89.9995, 50), (45, 179.999), (45, -180), (10, 359.999)] * 12):
        rows.append((i, la + rng.uniform(-0.008, 0.008) if abs(la) < 89 else max(-90.0, min(90.0, la + rng.uniform(-0.0005, 0.0005))), lo + rng.uniform(-0.008, 0.008) if abs(la) < 89 else rng.uniform(-180, 180)))
    rows = [(i, la, lo + 360 if lo < -180 else lo - 360 if lo > 360 else lo) for i, la, lo in rows]
    dirty = [(900, None, 1.0), (901, 1.0, -999999.0), (902, float("nan"), 1.0), (903, 1.7e38, 1.0), rows[0]]
    exp = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if _far(a, b) <= 1000}
    df = spark.createDataFrame(rows + dirty, "p bigint, lat double, lon double")
    got = nearby.within_distance(df, "p", "lat", "lon", 1000.0, cap).collect()
    assert len(got) == len(exp) and {(r["p_a"], r["p_b"]) for r in got} == exp
    assert nearby.within_distance(df.where("false"), "p", "lat", "lon", 1000.0).count() == 0


def test_containing_region(spark):
    rng = random.Random(8)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 360)) for i in range(300)]
    boxes = [(0, -10.0, 10.0, 170.0, -170.0), (1, 0.0, 5.0, 0.0, 5.0), (2, -90.0, 90.0, -20.0, 40.0), (3, 3.0, 3.5, 3.0, 3.2)]
    exp = set()
    for i, la, lo in pts:
        lo = (lo + 180) % 360 - 180
        for r, a, b, w, e in boxes:
            inside = (w <= lo < e) if w <= e else (lo >= w or lo < e)
            if a <= la < b and inside:
                exp.add((i, r))
    got = nearby.containing_region(spark.createDataFrame(pts, "p int, lat double, lon double"), "p", "lat", "lon", spark.createDataFrame(boxes, "r int, lat_min double, lat_max double, lon_min double, lon_max double"), "r")
    assert {(x["p"], x["r"]) for x in got.collect()} == exp


# --- drifting schemas ---------------------------------------------------------------------------------------


def test_schema_changes(spark):
    names = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("a", "a")], "field_name string, canonical string")
    rows = [
        (10, "s", 1, '{"a1": 1, "x": 1.5}'), (11, "s", 3, '{"a1": null, "x": 1.5}'), (11, "s", 3, '{"x": 2}'), (12, "s", 7, '{"a2": "5", "y": true}'),
        (13, "s", 8, None), (14, "s", 9, '{"a2": true}'), (15, "s", 5000, '{"a2": 4}'), (20, "t", 1, "broken {"), (21, "t", 2, '{"x": 1}'), (22, None, 1, '{"x": 1}'),
    ]
    df = spark.createDataFrame(rows, "f bigint, st string, sq int, payload string")
    exp = {(12, "a", "renamed"), (12, "a", "retyped"), (12, "x", "removed"), (12, "y", "added"), (13, "a", "removed"), (13, "y", "removed"), (14, "a", "added"), (15, "a", "retyped"), (21, "x", "added")}
    for span in (4096, 2):
        got = [tuple(r) for r in drift.schema_changes(df, "st", "sq", "f", "payload", names, span).collect()]
        assert sorted(got) == sorted(exp)
    assert drift.schema_changes(df.where("false"), "st", "sq", "f", "payload", names).count() == 0


def test_consistent_table(spark):
    names = spark.createDataFrame([("n", "num")], "field_name string, canonical string")
    df = spark.createDataFrame([(1, '{"n": "4", "b": true}'), (2, '{"num": 5.5, "b": "x"}'), (3, '{"n": null}')], "id int, payload string")
    tags = drift.tagged_fields(df, ["id"], "payload", names)
    types = {r["field"]: r["canonical_type"] for r in drift.union_types(tags).collect()}
    assert types == {"num": "decimal", "b": "text"}
    wide = {r["id"]: (r["num"], r["b"]) for r in drift.record_table(df, ["id"], "payload", names).collect()}
    assert wide == {1: (4.0, "true"), 2: (5.5, "x"), 3: (None, None)}


def test_record_table_keeps_all(spark):
    """Records without fields, repeated records and second names of a field."""
    names = spark.createDataFrame([("num", "num"), ("n2", "num")], "field_name string, canonical string")
    rows = [(1, '{"num": 9, "n2": 10}'), (2, None), (3, "[]"), (4, "{}"), (5, '{"num": 3}'), (5, '{"num": 3}'), (None, '{"n2": 4}')]
    df = spark.createDataFrame(rows, "id int, payload string")
    got = [(r["id"], r["num"], r["num_values"]) for r in drift.record_table(df, ["id"], "payload", names).collect()]
    exp = [(1, 10, ["10", "9"]), (2, None, None), (3, None, None), (4, None, None), (5, 3, ["3"]), (5, 3, ["3"]), (None, 4, ["4"])]
    assert sorted(got, key=str) == sorted(exp, key=str)
    assert drift.record_table(df.where("id = 2"), ["id"], "payload", names).collect() == [(2,)]


def test_last_before(spark):
    rng = random.Random(9)
    rows = [(k, o, rng.choice([None, rng.randrange(100)])) for k in (1, None) for o in rng.sample(range(-50, 200), 60)]
    df = spark.createDataFrame(rows, "k int, o bigint, v int")
    exp = set()
    for k, o, _ in rows:
        before = [v for kk, oo, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]) if oo < o and v is not None]
        exp.add((k, o, before[-1] if before else None))
    assert {(r["k"], r["o"], r["p"]) for r in last_before(df, ["k"], "o", {"p": F.col("v")}, 7).collect()} == exp


# --- small files --------------------------------------------------------------------------------------------


def test_pattern():
    import re

    rx = compact.pattern_regex("QER_{sat}_{placeholder}_{date}_n25.nc", {"sat": "E"})
    assert re.match(rx, "QER_E_X1_20070221070051_n25.nc")
    for bad in ("QER_ZE_X1_20070221070051_n25.nc", "QER_E_X_1_20070221070051_n25.nc", "QER_E_X1_2007022107005_n25.nc", "QER_E_X1_20070221070051_n25xnc", "QER_E_X1_20070221070051_n25.nc4"):
        assert not re.match(rx, bad)


def test_parse_and_compact(spark):
    text = "location_id,time,backscatter40,sm\r\n5,2007-01-01T00:00:10Z,-1.5,\r\n5;1167609610;-1.5;3\n# note\n\n7\t20070101000010\t-2\tNaN\n8,20070101000010,-2\n9,x,1,2\n,5,1,2"
    files = spark.createDataFrame([(1, "A_1", text), (2, "A_2", text), (3, "B_1", None), (4, None, text), (5, "A_3", ""), (6, "zA_1", text)], "f bigint, n string, c string")
    rows = compact.parse_files(files, "n", "c", "f", [(1, "^A_[^_]+$"), (2, "^B_[^_]+$")], "part")
    t = compact.PartitionedTable(spark, scratch_path(spark, "t"), "part int, location_id bigint, time_s bigint, backscatter40 double, sm double, _order bigint", "part")
    t.append(rows)
    t.append(rows.repartition(3))
    other = spark.createDataFrame([(2, 1, 1, 0.0, 0.0, 1)], t.schema)
    t.append(other)
    before = t.listing()
    assert len(before["part=1"]) > 2
    with pytest.raises(compact.Conflict):
        t.append(other, expected=1)
    done = t.compact(["location_id", "time_s"], "_order")
    assert list(done) == ["part=1", "part=2"] and t.version() == 4
    after = t.listing()
    assert len(after["part=1"]) == 1
    assert {(r["location_id"], r["time_s"], r["sm"]) for r in t.read().where("part = 1").collect()} == {(5, 1167609610, 3.0), (7, 1167609610, None)}
    assert t.read(3).count() > t.read().count()  # the snapshot's files stay for its readers
    assert t.compact(["location_id", "time_s"], "_order") == {}  # nothing was added since
    t.append(other)
    assert list(t.compact(["location_id", "time_s"], "_order")) == ["part=2"]
    assert {k: v for k, v in t.listing().items() if k == "part=1"} == {"part=1": after["part=1"]}
    assert t.vacuum() == [] and t.vacuum(older_than_s=-60) and t.read().count() == 3


ROW = "part string, location_id bigint, time_s bigint, backscatter40 double, sm double, _order bigint"


def _folder(spark):
    return compact.PartitionedTable(spark, scratch_path(spark, "t"), ROW, "part")


@pytest.mark.parametrize("target", [1000, 1 << 27])
def test_compact_one_record_a_key_at_any_file_size(spark, target):
    """Copies go whatever the sizes of the files they lie in; NULL partitions and odd names too."""
    rng = random.Random(3)
    rows = [(rng.choice(["a b", "x/y=%", None]), rng.randrange(40), rng.randrange(3), 1.0, rng.choice([None, 2.0]), i) for i in range(600)]
    t = _folder(spark)
    t.append(spark.createDataFrame(rows[:400], ROW).repartition(4))
    t.append(spark.createDataFrame(rows[400:], ROW))
    t.compact(["location_id", "time_s"], "_order", target_bytes=target)
    got = [(r["part"], r["location_id"], r["time_s"]) for r in t.read().collect()]
    assert len(got) == len(set(got)) and set(got) == {r[:3] for r in rows}


def test_compact_keeps_whole_records(spark):
    t = _folder(spark)
    t.append(spark.createDataFrame([("a", 1, 1, None, 5.0, 1), ("a", 1, 1, 3.0, 7.0, 2), ("a", 1, 1, 4.0, 8.0, 3), ("a", 2, 1, None, None, None)], ROW))
    t.compact(["location_id", "time_s"], "_order")
    assert {tuple(r)[:5] + (r["part"],) for r in t.read().select("location_id", "time_s", "backscatter40", "sm", "_order", "part").collect()} == {(1, 1, 3.0, 7.0, 2, "a"), (2, 1, None, None, None, "a")}
    empty = _folder(spark)
    assert empty.read().count() == 0 and empty.compact(["location_id"], "_order") == {}


def test_table_survives_killed_writers_and_races(spark):
    row = spark.createDataFrame([("a", 1, 1, 3.0, 7.0, 2)], ROW)
    t = _folder(spark)
    t.append(row)
    t._write(row, "-a")  # killed before it published
    assert t.read().count() == 1 and t.append(row) == 2 and t.read().count() == 2
    # An append during a compaction stays appended; another rewrite of the same files is a conflict.
    other, write = compact.PartitionedTable(spark, t.root, ROW, "part"), t._write
    t._write = lambda *a: (write(*a), other.append(row))[0]
    t.compact(["location_id", "time_s"], "_order")
    assert t.version() == 4 and t.read().count() == 2
    t._write = lambda *a: (write(*a), other.compact(["location_id", "time_s"], "_order"))[0]
    with pytest.raises(compact.Conflict):
        t.compact(["location_id", "time_s"], "_order")
    assert t.read().count() == 1
