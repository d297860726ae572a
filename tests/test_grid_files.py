import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from tidemark.sources import grid_files as GF, grids as G

ASC = """Dataset {{}}
---
anom.anom[2][2][3]
[0][0], 1.0, NaN, 3.0
[0][1], 4.0, 5.0, 1e20
[1][0], 7.0, 8.0, 9.0
[1][1], 10.0, 11.0, 12.0

anom.time[2]
{first}, {second}

anom.lat[2]
-5.0, 0.0

anom.lon[3]
190.0, 200.0, 210.0
"""
CSV = "time,depth,latitude,longitude,anom\nUTC,m,degrees_north,degrees_east,1\n1997-03-01T00:00:00Z,0.0,-5.0,190.0,1.5\n1997-03-02T00:00:00Z,0.0,2.0,200.0,-999\nragged\n"


def hours(day):
    return (dt.date.fromisoformat(day) - dt.date(1800, 1, 1)).days * 24


@pytest.fixture
def folder(spark, tmp_path):
    at = str(tmp_path / "g")
    good = ASC.format(first=hours("1997-01-01"), second=hours("1997-02-01"))
    name = GF.file_name("anom", dt.date(1997, 1, 1), dt.date(1997, 2, 28), (-5, 0, 190, 210))
    GF.write_files(spark.createDataFrame([(name, good), ("anom_1997-03-01_1997-03-31_-5_2_190_200.csv", CSV)], "name string, text string"), at)
    return at


def test_names_tell_what_files_hold():
    name = GF.file_name("sst", dt.date(1997, 1, 1), dt.date(1997, 12, 31), (-30, 30.5, 120, 290))
    assert name == "sst_1997-01-01_1997-12-31_-30_30.5_120_290.asc"
    told = GF.bounds_of(name)
    assert told["latitude"] == (-30, 30.5) and told["longitude"] == (120, 290)
    assert told["time"][0] == dt.datetime(1997, 1, 1, tzinfo=dt.UTC).timestamp() and told["time"][1] < dt.datetime(1998, 1, 1, tzinfo=dt.UTC).timestamp()
    assert set(GF.bounds_of("a_1997-01-01_1997-12-31.csv")) == {"time"} and GF.bounds_of("other.asc") == {}
    assert GF.ranges_of([GreaterThan(("latitude",), -5), LessThanOrEqual(("latitude",), 3.5), EqualTo(("value",), 1), EqualTo(("longitude",), 190)]) == {"latitude": (-5, 3.5), "longitude": (190, 190)}


def test_both_formats_are_read(spark, folder):
    rows = GF.read_grids(spark, folder, "anom")
    found = sorted((str(r["time"].date()), r["latitude"], r["longitude"], r["value"]) for r in rows.collect())
    assert found == [
        ("1997-01-01", -5, 190, 1), ("1997-01-01", -5, 200, None), ("1997-01-01", -5, 210, 3), ("1997-01-01", 0, 190, 4), ("1997-01-01", 0, 200, 5), ("1997-01-01", 0, 210, None),
        ("1997-02-01", -5, 190, 7), ("1997-02-01", -5, 200, 8), ("1997-02-01", -5, 210, 9), ("1997-02-01", 0, 190, 10), ("1997-02-01", 0, 200, 11), ("1997-02-01", 0, 210, 12),
        ("1997-03-01", -5, 190, 1.5), ("1997-03-02", 2, 200, None),
    ]
    assert sorted(os.listdir(folder)) == ["anom_1997-01-01_1997-02-28_-5_0_190_210.asc", "anom_1997-03-01_1997-03-31_-5_2_190_200.csv"]
    box = rows.where("latitude >= 0 and longitude < 200.5 and time >= timestamp '1997-02-01'")
    assert sorted((r["latitude"], r["longitude"], r["value"]) for r in box.collect()) == [(0, 190, 10), (0, 200, 11), (2, 200, None)]


def test_a_bounded_read_opens_only_the_files_it_needs(spark, folder):
    bad = [("anom_1998-01-01_1998-01-31_-5_0_190_210.asc", "not a grid"), ("anom_1997-01-01_1997-12-31_-40_-30_190_210.asc", "nor this")]
    GF.write_files(spark.createDataFrame(bad, "name string, text string"), folder)
    rows = GF.read_grids(spark, folder, "anom")
    bounded = rows.where("time < timestamp '1997-12-31' and latitude between -5 and 5")
    assert bounded.count() == 14  # those files would raise
    assert bounded.select(F.spark_partition_id()).distinct().count() == 2
    for condition, name in (("latitude >= -5", "1998-01-01"), ("time < timestamp '1997-12-31'", "-40_-30")):
        with pytest.raises(Exception, match=name):
            rows.where(condition).count()
    assert rows.where("latitude = 80").count() == 0  # no file at all


def test_contract_violations_name_the_file(spark, tmp_path):
    cases = {"short.asc": ASC.format(first=0, second=24).replace("7.0, 8.0, 9.0", "7.0, 8.0"), "axis.asc": ASC.format(first=0, second=24).replace("anom.lat[2]", "anom.x[2]"), "names.csv": CSV.replace("anom", "sst")}
    for name, text in cases.items():
        at = str(tmp_path / name)
        GF.write_files(spark.createDataFrame([(name, text)], "name string, text string"), at)
        with pytest.raises(Exception, match=name):
            GF.read_grids(spark, at, "anom").collect()
    os.makedirs(tmp_path / "none")
    assert GF.read_grids(spark, str(tmp_path / "none"), "anom").count() == 0


def test_station_requests_are_bounded():
    ask = lambda **x: G.station_request(**{"base": "https://x", "dataset": "d", "columns": ["station", "ISO_6"], "start": "2026-07-01", "south": -5, "north": 5, "west": 190, "east": 240, "allowed": ("d",)} | x)
    assert ask() == "https://x/tabledap/d.csv?station,ISO_6&time%3E%3D2026-07-01T00%3A00%3A00Z&latitude%3E%3D-5&latitude%3C%3D5&longitude%3E%3D190&longitude%3C%3D240&orderByMax(%22station,time%22)"
    for wrong in ({"dataset": "e"}, {"columns": []}, {"columns": ["a&b"]}, {"start": "July"}, {"south": 6}):
        with pytest.raises(ValueError):
            ask(**wrong)
