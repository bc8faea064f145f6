"""Scans and sinks on hand-written miniature files."""

import glob
import json
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigie.sinks import sink_csv, sink_geojson
from vigie.sources import list_files, scan_csv, scan_geojson, schemas

from .conftest import rows


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _read_text(dir_path, pattern):
    # one file of that name, or a folder's only part
    (f,) = [dir_path] if os.path.isfile(dir_path) else glob.glob(os.path.join(dir_path, pattern))
    with open(f, "rb") as fh:
        return fh.read()


def test_scan_csv_latin1_and_string_codes(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "dep.csv")
    text = ("extract_date,departement,libelle_dep,region,libelle_reg,tx_incid,tx_incid_couleur,tx_pos,R,"
            "taux_occupation_sae,taux_occupation_sae_couleur\n"
            "2020-07-24,01,Ain,84,Auvergne-Rhône-Alpes,5.1,vert,1.2,0.9,3.0,vert\n"
            "2020-07-24,22,Côtes-d'Armor,53,Bretagne,,,,1.1,,\n")
    _write(p, text.encode("latin-1"))
    df = scan_csv(spark, p, schemas.INDICATORS_DEPARTMENT, encoding="ISO-8859-1", mode="FAILFAST")
    got = rows(df, "departement", "libelle_dep", "tx_incid")
    assert got == [("01", "Ain", 5.1), ("22", "Côtes-d'Armor", None)]


def test_scan_csv_semicolon_many_files_with_origin(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "hosp")
    head = "dep;sexe;jour;hosp;rea;rad;dc\n"
    _write(os.path.join(d, "a.csv"), (head + "01;0;2020-03-18;2;0;1;0\n").encode())
    _write(os.path.join(d, "b.csv"), (head + "971;0;2020-03-19;5;1;0;0\n").encode())
    df = scan_csv(spark, os.path.join(d, "*.csv"), schemas.HOSPITAL_DAILY, sep=";", with_file="file", mode="FAILFAST")
    assert rows(df, "dep", "hosp", "file") == [("01", 2, "a.csv"), ("971", 5, "b.csv")]
    listing = list_files(spark, d, "*.csv")
    assert listing.count() == 2


def test_scan_geojson_feature_collection(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "dep.geojson")
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"insee_dep": "01", "insee_reg": "84", "nom_dep": "AIN",
                                           "nom_minuscules": "Ain"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"insee_dep": "2A", "insee_reg": "94", "nom_dep": "CORSE-DU-SUD",
                                           "nom_minuscules": "Corse-du-Sud"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}},
        {"type": "Feature", "properties": {"nom_dep": "separation"},
         "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
    ]}
    _write(p, json.dumps(fc, indent=2).encode())
    df = scan_geojson(spark, p, schemas.DEPARTMENT_PROPERTIES)
    assert df.columns == ["insee_dep", "insee_reg", "nom_dep", "nom_minuscules", "geometry"]
    got = {r.nom_dep: json.loads(r.geometry)["type"] for r in df.collect()}
    assert got == {"AIN": "Polygon", "CORSE-DU-SUD": "MultiPolygon", "separation": "LineString"}


def test_sink_csv_modes(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 'x,"y"', 1.5), ("b", "z", None)], "k string, g string, v double")
    sink_csv(df, os.path.join(tmpdir_path, "min"), single_file=True)
    assert b'"x,""y"""' in _read_text(os.path.join(tmpdir_path, "min"), "part-*.csv")
    assert _read_text(os.path.join(tmpdir_path, "min"), "part-*.csv").splitlines()[-1] == b"b,z,NA"
    sink_csv(df, os.path.join(tmpdir_path, "all"), quote="all", single_file=True)
    lines = _read_text(os.path.join(tmpdir_path, "all"), "part-*.csv").splitlines()
    assert lines[0] == b'"k","g","v"' and b'"a","x,""y""",1.5' in lines and b'"b","z",NA' in lines
    sink_csv(df.where("k = 'b'"), os.path.join(tmpdir_path, "none"), quote="none", single_file=True)
    assert _read_text(os.path.join(tmpdir_path, "none"), "part-*.csv").splitlines()[-1] == b"b,z,NA"
    sink_csv(df, os.path.join(tmpdir_path, "bom"), bom=True, single_file=True)
    raw = _read_text(os.path.join(tmpdir_path, "bom"), "part-*.csv")
    assert raw.startswith(b"\xef\xbb\xbfk,g,v")
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "bom"))
    assert back.count() == 2


def test_sink_csv_none_refuses_separator(spark, tmpdir_path):
    import pytest

    df = spark.createDataFrame([("x,y",)], "g string")
    with pytest.raises(Exception, match="separator"):
        sink_csv(df, os.path.join(tmpdir_path, "bad"), quote="none")


def test_geojson_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([("22", 12.5, '{"type":"Point","coordinates":[1,2]}')],
                               "dep string, taux_variation double, geometry string")
    out = os.path.join(tmpdir_path, "variation")
    sink_geojson(df, out, collection=False)
    props = T.StructType([T.StructField("dep", T.StringType()), T.StructField("taux_variation", T.DoubleType())])
    back = scan_geojson(spark, out, props, line_delimited=True)
    r = back.first()
    assert (r.dep, r.taux_variation) == ("22", 12.5)
    assert json.loads(r.geometry) == {"type": "Point", "coordinates": [1, 2]}
    lines = [ln for f in sorted(glob.glob(os.path.join(out, "part-*.txt"))) for ln in open(f, "rb").read().splitlines()]
    line = json.loads(lines[0])
    assert line["type"] == "Feature" and line["properties"]["dep"] == "22"


def test_map_layer(spark):
    from vigie.sinks import map_layer

    df = spark.createDataFrame([("01", "vert", "g"), ("02", None, "h")], "dep string, c string, geometry string")
    out = map_layer(df, "c", {"vert": "#3DE4B3", "rouge": "#D1335B"})
    assert rows(out, "dep", "fill") == [("01", "#3DE4B3"), ("02", None)]
    assert out.where(F.col("fill").isNull()).count() == 1


def test_sink_csv_bom_with_all_quoted(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    sink_csv(df, os.path.join(tmpdir_path, "bq"), quote="all", bom=True, single_file=True)
    raw = _read_text(os.path.join(tmpdir_path, "bq"), "part-*.csv")
    assert raw.startswith(b'\xef\xbb\xbf"k","v"') and b'"a",1\n' in raw


def test_geojson_feature_collection_round_trip(spark, tmpdir_path):
    rows_in = [(f"{i:02d}", float(i), f'{{"type":"Point","coordinates":[{i},0]}}') for i in range(12)]
    df = spark.createDataFrame(rows_in, "dep string, v double, geometry string").orderBy("dep")
    out = os.path.join(tmpdir_path, "fc")
    sink_geojson(df, out, collection=True)
    doc = json.loads(_read_text(out, "part-*.txt"))
    assert doc["type"] == "FeatureCollection"
    assert [f["properties"]["dep"] for f in doc["features"]] == [r[0] for r in rows_in]
    props = T.StructType([T.StructField("dep", T.StringType()), T.StructField("v", T.DoubleType())])
    back = scan_geojson(spark, out, props)
    assert sorted((r.dep, r.v) for r in back.collect()) == [(r[0], r[1]) for r in rows_in]


def test_scan_csv_detects_the_separator(spark, tmpdir_path):
    from vigie.sources.readers import detect_separator

    p = os.path.join(tmpdir_path, "hosp.csv")
    _write(p, b"dep;sexe;jour;hosp;rea;rad;dc\n22;0;2020-03-18;2;0;1;0\n")
    assert detect_separator(spark, p) == ";"
    df = scan_csv(spark, p, schemas.HOSPITAL_DAILY, sep=None, mode="FAILFAST")
    assert rows(df, "dep", "hosp") == [("22", 2)]


def test_sink_then_scan_round_trip_with_quotes(spark, tmpdir_path):
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("nom", T.StringType()),
                           T.StructField("geometry", T.StringType())])
    data = [("53", "Bretagne", '{"type":"Point","coordinates":[1,2]}'), ("11", "Île-de-France, Paris", None),
            ("01", 'say "hi"', '{"type":"LineString","coordinates":[[0,0],[1,1]]}')]
    df = spark.createDataFrame(data, schema)
    out = os.path.join(tmpdir_path, "regions")
    sink_csv(df, out, na="")
    back = scan_csv(spark, out, schema, mode="FAILFAST")
    assert sorted(tuple(r) for r in back.collect()) == sorted(data)


def test_scan_csv_takes_declared_columns_by_name(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "hosp_extra.csv")
    # more columns than declared, in another order (as later versions of the feed)
    _write(p, b"jour;dep;HospConv;sexe;rea;hosp;dc;rad\n2020-03-18;01;7;0;1;5;0;2\n")
    df = scan_csv(spark, p, schemas.HOSPITAL_DAILY, sep=";", mode="FAILFAST")
    assert df.columns == [f.name for f in schemas.HOSPITAL_DAILY.fields]
    r = df.first()
    assert (r.dep, r.sexe, r.hosp, r.rea, r.rad, r.dc) == ("01", "0", 5, 1, 2, 0)
    assert str(r.jour) == "2020-03-18"


def test_scan_csv_failfast_on_a_bad_value(spark, tmpdir_path):
    import pytest

    p = os.path.join(tmpdir_path, "bad.csv")
    _write(p, b"dep;sexe;jour;hosp;rea;rad;dc\n22;0;2020-03-18;many;0;1;0\n")
    assert scan_csv(spark, p, schemas.HOSPITAL_DAILY, sep=";").first().hosp is None
    with pytest.raises(Exception):
        scan_csv(spark, p, schemas.HOSPITAL_DAILY, sep=";", mode="FAILFAST").collect()


def test_sink_csv_writes_numbers_as_r(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 1234.0, 1e7, 0.5, float("nan"), 3)], "k string, a double, b double, c double, d double, n long")
    for quote, pattern in (("minimal", "part-*.csv"), ("all", "part-*.csv"), ("none", "part-*.csv")):
        out = os.path.join(tmpdir_path, f"num_{quote}")
        sink_csv(df, out, quote=quote, single_file=True)
        last = _read_text(out, pattern).splitlines()[-1]
        assert last.endswith(b",1234,1e+07,0.5,NaN,3"), (quote, last)


def test_quoted_line_breaks_round_trip_with_multi_line(spark, tmpdir_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("note", T.StringType())])
    data = [("a", "first line\nsecond line"), ("b", "plain")]
    out = os.path.join(tmpdir_path, "notes")
    sink_csv(spark.createDataFrame(data, schema), out)
    back = scan_csv(spark, out, schema, mode="FAILFAST", multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted(data)


def test_bom_file_reads_back_by_name(spark, tmpdir_path):
    df = spark.createDataFrame([("53", "22", 10)], "reg string, dep string, lits long")
    out = os.path.join(tmpdir_path, "cap_bom")
    sink_csv(df, out, bom=True)
    back = scan_csv(spark, out, schemas.ICU_CAPACITY, mode="FAILFAST")
    assert [tuple(r) for r in back.collect()] == [("53", "22", 10)]


def test_scan_csv_reads_na_as_missing(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cap.csv")
    _write(p, b'reg,dep,lits\n1,NA,5\nNA,"",NA\n2, a ,\n')
    assert rows(scan_csv(spark, p, schemas.ICU_CAPACITY, mode="FAILFAST")) == [(None, None, None), ("1", None, 5), ("2", " a ", None)]
    kept = scan_csv(spark, p, schemas.ICU_CAPACITY, na=("NA",))
    assert sorted(r["dep"] or "" for r in kept.collect()) == ["", "", " a "] and kept.where("dep = ''").count() == 1


def test_sink_to_scan_keeps_blanks_empty_and_null_text(spark, tmpdir_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
    data = [("1", " a "), ("2", ""), ("3", None), ("4", "NB"), ("5", 'q"q')]
    for quote in ("minimal", "all"):
        out = os.path.join(tmpdir_path, f"blanks_{quote}")
        sink_csv(spark.createDataFrame(data, schema).repartition(3), out, quote=quote)
        back = scan_csv(spark, out, schema, mode="FAILFAST", na=("NA",))
        assert sorted((tuple(r) for r in back.collect()), key=str) == sorted(data, key=str)


def test_files_with_another_column_order(spark, tmpdir_path):
    import pytest

    d = os.path.join(tmpdir_path, "drops")
    _write(os.path.join(d, "a.csv"), b"dep,lits\n22,5\n")
    _write(os.path.join(d, "b.csv"), b"lits,dep\n7,29\n")
    _write(os.path.join(d, "c.csv"), b"dep,reg\n35,53\n")
    two = [os.path.join(d, "a.csv"), os.path.join(d, "b.csv")]
    schema = T.StructType([T.StructField("dep", T.StringType()), T.StructField("lits", T.LongType())])
    with pytest.raises(Exception):
        scan_csv(spark, two, schema, mode="FAILFAST").collect()
    assert rows(scan_csv(spark, two, schema, mode="FAILFAST", align=True)) == [("22", 5), ("29", 7)]
    every = scan_csv(spark, d, schemas.ICU_CAPACITY, mode="FAILFAST", align=True, with_file="file")
    assert rows(every, "reg", "dep", "lits", "file") == [(None, "22", 5, "a.csv"), (None, "29", 7, "b.csv"), ("53", "35", None, "c.csv")]


def test_separator_detection_looks_outside_quotes_and_at_every_file(spark, tmpdir_path):
    import pytest

    from vigie.sources.readers import detect_separator

    a, b = os.path.join(tmpdir_path, "a.csv"), os.path.join(tmpdir_path, "b.csv")
    _write(a, b'"a,b,c,d";x\n1;2\n')
    _write(b, b"k,x\n1,2\n")
    assert detect_separator(spark, a) == ";"
    with pytest.raises(ValueError, match="different separators"):
        detect_separator(spark, [a, b])


def test_split_files_each_have_a_header(spark, tmpdir_path):
    df = spark.range(0, 40, numPartitions=4).select(F.col("id").cast("string").alias("k"), (F.col("id") / 4).alias("v"))
    for quote in ("minimal", "all", "none"):
        out = os.path.join(tmpdir_path, f"split_{quote}")
        sink_csv(df, out, quote=quote)
        assert len(glob.glob(os.path.join(out, "part-*.csv"))) == 4
        schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])
        assert sorted((int(r.k), r.v) for r in scan_csv(spark, out, schema, mode="FAILFAST").collect()) == [(i, i / 4) for i in range(40)]


def test_latin1_sink(spark, tmpdir_path):
    df = spark.createDataFrame([("août", 1), ("février", 2)], "m string, v long")
    sink_csv(df, os.path.join(tmpdir_path, "l1"), encoding="ISO-8859-1", single_file=True)
    assert "août,1".encode("latin-1") in _read_text(os.path.join(tmpdir_path, "l1"), "part-*.csv")
