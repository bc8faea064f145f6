"""End-to-end jobs on the sf0.001 stand-in feeds: feeds landed in the checkpoint folder, outputs written."""

import datetime as dt
import glob
import json
import os

from vigie.plans import jobs
from vigie.plans import queries as Q
from vigie.sources import standins as S

from .conftest import SF_SMALL as D


def _one_file(path, pattern="part-*"):
    assert os.path.isfile(path)  # the very name asked for
    files = [path] if os.path.isfile(path) else [f for f in glob.glob(os.path.join(path, pattern)) if not f.endswith(".crc")]
    assert len(files) == 1, files
    with open(files[0], "rb") as f:
        return f.read()


def test_indicator_job_writes_every_table(spark, tmpdir_path):
    out = jobs.indicator_job(spark, S.indicators_national(spark, D), S.indicators_department(spark, D),
                             S.department_geo(spark, D), S.region_geo(spark, D), tmpdir_path, Q.REGION,
                             Q.REGION_NAMES, Q.POSITIVITY_CUTS, as_of="2024-02-01 09:30:00")
    assert set(out) == {"incidence_region", "positivity_region", "occupancy_region", "indicators_region",
                        "r_latest_map", "r_history", "incidence_map", "positivity_map", "occupancy_map"}
    assert _one_file(out["occupancy_region"]).startswith(b"\xef\xbb\xbfextract_date,")
    assert _one_file(out["r_history"]).startswith(b'"extract_date","AFRICA"')
    header = _one_file(out["incidence_map"]).splitlines()[0]
    assert header.endswith(b",fill")
    landed = os.path.join(spark.conf.get("spark.checkpoint.dir"), "vigie-feeds", jobs.RUN_ID, "indicators_department")
    assert any(n.startswith("extract_date=") for n in os.listdir(landed))


def test_deaths_job_writes_dated_geojson(spark, tmpdir_path):
    out = jobs.deaths_job(spark, S.deaths_cumulative(spark, D), S.department_geo(spark, D), tmpdir_path,
                          S.DEATH_YEARS, Q.REGION_TOTAL_OF, run_date=dt.date(2024, 2, 1))
    assert out["variation"].endswith("deces_variation_2024-02-01.geojson")
    doc = json.loads(_one_file(out["variation"]))
    assert doc["type"] == "FeatureCollection"
    assert len(doc["features"]) == S.department_geo(spark, D).count()
    assert len(_one_file(out["daily"]).splitlines()) == 366


def test_department_maps_job(spark, tmpdir_path):
    out = jobs.department_maps_job(spark, S.er_visits(spark, D), S.hospital_daily(spark, D),
                                   S.icu_capacity(spark, D), S.department_geo(spark, D), tmpdir_path,
                                   Q.ER_CUTS, Q.ICU_CUTS)
    for p in out.values():
        assert len(_one_file(p).splitlines()) == 26


def test_materialize_keeps_types_and_order(spark):
    df = spark.createDataFrame([("01", 1.5), ("2A", 2.0)], "dep string, v double")
    back = jobs.materialize(spark, df, "typed_codes", ["dep"])
    assert back.schema == df.schema
    assert sorted(tuple(r) for r in back.collect()) == [("01", 1.5), ("2A", 2.0)]


def test_hospital_and_age_jobs(spark, tmpdir_path):
    out = jobs.hospital_job(spark, S.hospital_daily(spark, D), Q.REGION_AREAS, Q.REGION_TOTAL_OF,
                            Q.REGION_TOTAL_LABEL, tmpdir_path)
    lines = _one_file(out["hospital_table"]).splitlines()
    assert lines[0].startswith(b"jour,dep,hospitalisations") and lines[1].split(b",")[1] == Q.REGION_TOTAL_LABEL.encode()
    ages = jobs.age_job(spark, S.cells(spark, D, ["age"]), Q.AGE_GROUPS, tmpdir_path)
    by_day = _one_file(ages["age_share_by_day"]).splitlines()
    assert by_day[0].startswith(b"workbook,date,1-5,6-10")
    assert len(_one_file(ages["age_share_latest"]).splitlines()) >= 2


def test_run_folder_is_removed(spark):
    df = spark.createDataFrame([("01", 1.5)], "dep string, v double")
    jobs.materialize(spark, df, "gone", run_id="run-to-remove")
    folder = os.path.join(spark.conf.get("spark.checkpoint.dir"), "vigie-feeds", "run-to-remove")
    assert os.path.isdir(folder)
    jobs.remove_run(spark, "run-to-remove")
    assert not os.path.isdir(folder)
