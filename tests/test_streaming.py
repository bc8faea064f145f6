"""Incremental landing of CSV drops into a date-partitioned Parquet panel."""

import os

from vigie.sources import schemas
from vigie.streaming import land_feed


def test_land_feed_is_incremental(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "drops")
    os.makedirs(src)
    panel, ckpt = os.path.join(tmpdir_path, "panel"), os.path.join(tmpdir_path, "ckpt")
    head = "dep;sexe;jour;hosp;rea;rad;dc\n"
    with open(os.path.join(src, "d1.csv"), "w") as f:
        f.write(head + "22;0;2020-03-18;2;0;1;0\n29;0;2020-03-18;3;1;0;0\n")
    land_feed(spark, src, schemas.HOSPITAL_DAILY, panel, ckpt, "jour", sep=";", mode="append")
    assert spark.read.parquet(panel).count() == 2
    with open(os.path.join(src, "d2.csv"), "w") as f:
        f.write(head + "22;0;2020-03-19;4;1;0;0\n")
    land_feed(spark, src, schemas.HOSPITAL_DAILY, panel, ckpt, "jour", sep=";", mode="append")
    df = spark.read.parquet(panel)
    assert df.count() == 3
    assert sorted(os.listdir(panel))[:2] == ["_spark_metadata", "jour=2020-03-18"]


def test_land_feed_full_republication_replaces_dates(spark, tmpdir_path):
    import time

    src = os.path.join(tmpdir_path, "drops")
    os.makedirs(src)
    panel, ckpt = os.path.join(tmpdir_path, "panel"), os.path.join(tmpdir_path, "ckpt")
    head = "dep;sexe;jour;hosp;rea;rad;dc\n"
    with open(os.path.join(src, "full-1.csv"), "w") as f:
        f.write(head + "22;0;2020-03-18;2;0;1;0\n22;0;2020-03-19;3;1;0;0\n")
    land_feed(spark, src, schemas.HOSPITAL_DAILY, panel, ckpt, "jour", sep=";")
    time.sleep(1.1)
    # next day's full file: history again, a corrected value for 03-19, one new date
    with open(os.path.join(src, "full-2.csv"), "w") as f:
        f.write(head + "22;0;2020-03-18;2;0;1;0\n22;0;2020-03-19;4;1;0;0\n22;0;2020-03-20;5;2;0;0\n")
    land_feed(spark, src, schemas.HOSPITAL_DAILY, panel, ckpt, "jour", sep=";")
    got = sorted((str(r.jour), r.hosp) for r in spark.read.parquet(panel).collect())
    assert got == [("2020-03-18", 2), ("2020-03-19", 4), ("2020-03-20", 5)]


def test_two_drops_in_one_batch_keep_the_newest_per_date(spark, tmpdir_path):
    import time

    src = os.path.join(tmpdir_path, "drops")
    os.makedirs(src)
    panel, ckpt = os.path.join(tmpdir_path, "panel"), os.path.join(tmpdir_path, "ckpt")
    head = "dep;sexe;jour;hosp;rea;rad;dc\n"
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(head + "22;0;2020-03-18;1;0;0;0\n29;0;2020-03-18;1;0;0;0\n")
    time.sleep(1.1)
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write(head + "22;0;2020-03-18;7;0;0;0\n")
    land_feed(spark, src, schemas.HOSPITAL_DAILY, panel, ckpt, "jour", sep=";")
    got = sorted((r.dep, r.hosp) for r in spark.read.parquet(panel).collect())
    assert got == [("22", 7)]


def test_land_feed_defaults_to_the_shared_checkpoint_folder(spark, tmpdir_path):
    import glob

    src = os.path.join(tmpdir_path, "drops")
    os.makedirs(src)
    panel = os.path.join(tmpdir_path, "panel")
    with open(os.path.join(src, "d1.csv"), "w") as f:
        f.write("dep;sexe;jour;hosp;rea;rad;dc\n22;0;2020-03-18;2;0;1;0\n")
    land_feed(spark, src, schemas.HOSPITAL_DAILY, panel, None, "jour", sep=";")
    assert spark.read.parquet(panel).count() == 1
    shared = spark.conf.get("spark.checkpoint.dir")
    assert glob.glob(os.path.join(shared, "vigie-streams", "*", "offsets"))


def test_land_feed_backlog_in_bounded_batches(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "drops")
    os.makedirs(src)
    panel, ckpt = os.path.join(tmpdir_path, "panel"), os.path.join(tmpdir_path, "ckpt")
    for i in range(3):
        with open(os.path.join(src, f"d{i}.csv"), "w") as f:
            f.write(f"dep;sexe;jour;hosp;rea;rad;dc\n22;0;2020-03-1{i};{i};0;0;0\n")
    q = land_feed(spark, src, schemas.HOSPITAL_DAILY, panel, ckpt, "jour", sep=";", max_files_per_trigger=1)
    assert len(q.recentProgress) >= 3
    assert spark.read.parquet(panel).count() == 3


def test_undated_rows_are_kept_apart(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "drops")
    os.makedirs(src)
    panel, ckpt = os.path.join(tmpdir_path, "panel"), os.path.join(tmpdir_path, "ckpt")
    head = "dep;sexe;jour;hosp;rea;rad;dc\n"
    for i in (1, 2):
        with open(os.path.join(src, f"d{i}.csv"), "w") as f:
            f.write(head + f"22;0;2020-03-1{i};{i};0;0;0\n29;0;bad;{i};0;0;0\n")
        land_feed(spark, src, schemas.HOSPITAL_DAILY, panel, ckpt, "jour", sep=";")
    assert spark.read.parquet(panel).count() == 2
    lost = spark.read.parquet(panel + "-rejected")
    assert sorted(r.hosp for r in lost.collect()) == [1, 2] and "file" in lost.columns


def test_a_differing_header_fails_the_stream(spark, tmpdir_path):
    import pytest

    src = os.path.join(tmpdir_path, "drops")
    os.makedirs(src)
    with open(os.path.join(src, "d.csv"), "w") as f:
        f.write("dep;jour;sexe;hosp;rea;rad;dc\n22;2020-03-11;0;1;0;0;0\n")
    with pytest.raises(Exception):
        land_feed(spark, src, schemas.HOSPITAL_DAILY, os.path.join(tmpdir_path, "p"), os.path.join(tmpdir_path, "c"), "jour", sep=";")
