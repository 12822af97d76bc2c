"""The representation handle, and native EPS products made up here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swathline.operators.series import Series
from swathline.sources import eps
from swathline.sources.formats import GRH

ROWS = [(10, 1.0, 0, 0.0), (10, 1.0, 1, 1.0), (20, 2.0, 0, 2.0), (30, 3.0, 2, 3.0), (30, 3.0, 0, 4.0), (30, 3.0, 1, 5.0)]


def _series(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "id bigint, lon double, time int, v double")
    return Series(df, "point", "id", ("time", "v"), ("time",), ("lon",))


def _key(s):
    return sorted((r["id"], r["time"], r["v"]) for r in s.to_point().data.collect())


def test_every_form_and_back(spark):
    s = _series(spark)
    want = _key(s)
    for form in (s.to_indexed(), s.to_contiguous(), s.to_incomplete(), s.to_contiguous().to_indexed(), s.to_indexed().to_contiguous()):
        assert _key(form) == want, form.kind
    sizes = {r["id"]: r["row_size"] for r in s.to_contiguous().data.collect()}
    assert sizes == {10: 2, 20: 1, 30: 3}
    padded = {r["id"]: list(r["v"]) for r in s.to_incomplete().data.collect()}
    assert padded == {10: [0.0, 1.0, None], 20: [2.0, None, None], 30: [4.0, 5.0, 3.0]}
    assert s.to_orthogonal(strict=False).data.count() == 9
    with pytest.raises(ValueError):
        s.to_orthogonal()
    cut = s.to_contiguous(part=F.floor(F.col("time") / 2))
    assert _key(cut) == want and cut.data.count() == 4


def test_selection_append_apply(spark):
    s = _series(spark)
    want = sorted((r[0], r[2], r[3]) for r in ROWS if r[0] in (10, 30))
    for form in (s, s.to_indexed(), s.to_contiguous()):
        assert _key(form.sel([30, 10, 99])) == want
    both = s.append(_series(spark, [(20, 9.0, 5, 7.0), (6599999, 4.0, 0, 8.0)]))
    places = {r["id"]: (r["location_index"], r["lon"]) for r in both.places.collect()}
    assert places == {10: (0, 1.0), 20: (1, 2.0), 30: (2, 3.0), 6599999: (3, 4.0)}
    means = s.apply(lambda p: p.groupby("id", as_index=False)["v"].mean(), "id bigint, v double")
    assert {(r["id"], r["v"]) for r in means.collect()} == {(10, 0.5), (20, 2.0), (30, 4.0)}


def test_verify_and_tags(spark):
    s = _series(spark)
    assert s.tagged().schema["id"].metadata["cf_role"] == "timeseries_id"
    with pytest.raises(RuntimeError):
        Series(s.data.drop("v"), "point", "id", ("time", "v"))
    with pytest.raises(RuntimeError):
        Series(s.data, "indexed", "id", ("time", "v"))
    with pytest.raises(ValueError):
        Series(s.data, "cube", "id", ("time", "v"))


XML = """<format><mdr subclass="2"><delimiter name="d"/>
<field name="UTC_LINE" type="time" length="6"/><field name="AZI" type="uinteger2" scaling-factor="10^2"/>
<array name="LONGITUDE" length="42"><field type="integer4" scaling-factor="10^6"/></array>
<array name="SIG" length="42"><array length="3"><field type="integer4" scaling-factor="10^6"/></array></array>
<array name="FLAG" length="42"><field type="bitfield" length="8"/></array></mdr></format>"""


def _record(cls, sub, body):
    h = np.zeros(1, GRH)
    h["record_class"], h["record_subclass"], h["record_size"] = cls, sub, GRH.itemsize + len(body)
    return h.tobytes() + body


def test_native_lines(spark, tmp_path):
    kind = eps.record_dtype(eps.compile_record(XML, "mdr", 2))
    line = np.zeros(2, kind)
    line["UTC_LINE"]["day"], line["UTC_LINE"]["ms"] = 366, [1000, 2500]
    line["AZI"] = [9000, 65535]
    line["LONGITUDE"] = 200_000_000
    line["LONGITUDE"][0, 5] = np.iinfo(np.int32).min
    line["SIG"] = -12_500_000
    line["SIG"][1, 41, 2] = np.iinfo(np.int32).min
    line["FLAG"][1] = 7
    head = b"PRODUCT_TYPE                  = SMR\nFORMAT_MAJOR_VERSION          =    12\nSPACECRAFT_ID                 = M02\n"
    raw = _record(eps.MPHR, 0, head) + b"".join(_record(eps.MDR, 2, x.tobytes()) for x in line) + _record(eps.MDR, 2, line[0].tobytes())[:-3]
    (tmp_path / "a.nat").write_bytes(raw)
    df = eps.canonical(eps.read_lines(spark, str(tmp_path / "a.nat"), XML, 42, 2), {"longitude": "lon", "sig": "sigma0"}, 42)
    rows = {(r["line_num"], r["node_num"]): r for r in df.withColumn("sat_id", eps.satellite(F.col("spacecraft"))).collect()}
    assert len(rows) == 84
    a, b = rows[(0, 1)], rows[(1, 42)]
    assert (a["product_type"], a["format_major_version"], a["sat_id"], a["azi"], a["lon"], a["swath_indicator"]) == ("SMR", 12, 3, 90.0, -160.0, 0)
    assert str(a["utc_line"]) == "2001-01-01 00:00:01" and rows[(0, 6)]["lon"] is None
    assert b["azi"] is None and b["swath_indicator"] == 1 and b["flag"] == 7 and list(b["sigma0"][:2]) == [-12.5, -12.5] and b["sigma0"][2] is None
    per_beam = eps.beams(df.select("line_num", "node_num", "sigma0"), ["sigma0"])
    assert per_beam.count() == 252 and {r["beam"] for r in per_beam.select("beam").distinct().collect()} == {"for", "mid", "aft"}
    with pytest.raises(ValueError):
        eps.compile_record(XML, "viadr")
