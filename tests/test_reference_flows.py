"""Reference-format inputs end to end: files read with the scanners, pipelines
run with the reference's default parameters, results checked against a
brute-force computation in Python."""

import datetime as dt
import json
import os

from vigie.plans import composed as P
from vigie.sources import scan_csv, scan_geojson, schemas

D0 = dt.date(2020, 7, 18)
DEPS = ["22", "29", "35", "56"]


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def _files(tmp):
    visits = ["dep;date_de_passage;sursaud_cl_age_corona;nbre_pass_corona;nbre_pass_tot;nbre_hospit_corona"]
    for i in range(9):
        day = D0 + dt.timedelta(days=i)
        visits += [f"22;{day};0;{i};{10 + i};0", f"22;{day};1;1;2;0",
                   f"29;{day};0;{'' if i % 2 else 3};20;0", f"35;{day};0;;;0"]
    hosp = ["dep;sexe;jour;hosp;rea;rad;dc"]
    for i in range(9):
        day = D0 + dt.timedelta(days=i)
        for d in DEPS + ["44"]:
            k = DEPS.index(d) + 1 if d in DEPS else 9
            if i < 8:
                hosp.append(f"{d};0;{day};{10 * k + i};{k + i};{i};{k}")
            hosp.append(f"{d};1;{day};{5 * k};{k};0;0")
    lits = "reg,dep,lits\n53,22,10\n53,29,\n53,29,20\n53,35,30\n01,9A,4\n"
    geo = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"insee_dep": d, "insee_reg": r, "nom_dep": n, "nom_minuscules": n.title()},
         "geometry": {"type": "Point", "coordinates": [i, 0]}}
        for i, (d, r, n) in enumerate([("22", "53", "A"), ("29", "53", "B"), ("35", "53", "C"), ("56", "53", "D"),
                                        ("971", "01", "E"), (None, None, "separation")])]}
    paths = {k: os.path.join(tmp, k) for k in ("visits.csv", "hosp.csv", "lits.csv", "dep.geojson")}
    _write(paths["visits.csv"], "\n".join(visits) + "\n")
    _write(paths["hosp.csv"], "\n".join(hosp) + "\n")
    _write(paths["lits.csv"], lits)
    _write(paths["dep.geojson"], json.dumps(geo))
    return paths


def test_er_rate_from_semicolon_feed(spark, tmpdir_path):
    f = _files(tmpdir_path)
    visits = scan_csv(spark, f["visits.csv"], schemas.ER_VISITS, sep=";", mode="FAILFAST")
    geo = scan_geojson(spark, f["dep.geojson"], schemas.DEPARTMENT_PROPERTIES)
    out = {r.insee_dep: r for r in P.er_rate(visits, geo).collect()}
    assert set(out) == {"22", "29", "35", "56", "971"}          # separation dropped, all polygons kept
    # days 2..8 are the last 7 (the maximum is taken after the all-ages filter)
    c22, t22 = sum(range(2, 9)), sum(10 + i for i in range(2, 9))
    assert (out["22"].nbre_pass_corona, out["22"].nbre_pass_tot) == (c22, t22)
    assert out["22"].taux_pass == round(c22 / t22 * 100)
    c29 = sum(3 for i in range(2, 9) if i % 2 == 0)
    assert out["29"].taux_pass == round(c29 / 140 * 100) and out["29"].statut_passages == "orange"
    assert (out["35"].taux_pass, out["35"].statut_passages) == (0.0, "vert")   # 0/0 -> 0
    assert out["56"].taux_pass is None and out["56"].statut_passages is None


def test_icu_saturation_from_semicolon_feed(spark, tmpdir_path):
    f = _files(tmpdir_path)
    hosp = scan_csv(spark, f["hosp.csv"], schemas.HOSPITAL_DAILY, sep=";", mode="FAILFAST")
    cap = P.clean_capacity(scan_csv(spark, f["lits.csv"], schemas.ICU_CAPACITY, mode="FAILFAST"))
    geo = scan_geojson(spark, f["dep.geojson"], schemas.DEPARTMENT_PROPERTIES)
    assert {(r.reg, r.dep, r.lits) for r in cap.collect()} == {("53", "22", 10), ("53", "29", 20), ("53", "35", 30),
                                                                ("01", "971", 4)}
    out = {r.insee_dep: r for r in P.icu_saturation(hosp, cap, geo).collect()}
    # the last day (index 8) only has sexe 1: over all rows the window is days 2..8, so sexe 0 keeps 6 days
    rea = {d: round(sum(k + i for i in range(2, 8)) / 7) for k, d in enumerate(DEPS, 1)}
    reg_rea = rea["22"] + rea["29"] + rea["35"]                 # 56 has no capacity row -> its own NULL group
    assert out["22"].rea_7jrs == reg_rea and out["22"].lits == 60
    assert out["22"].taux_occup_reg == round(reg_rea / 60 * 100)
    assert out["56"].reg is None and out["56"].lits is None and out["56"].statut_rea is None
    # 56 and 44 (no polygon) both lack capacity: they form one NULL-region group (Q24)
    rea44 = round(sum(9 + i for i in range(2, 8)) / 7)
    assert out["56"].rea_7jrs == rea["56"] + rea44
    assert out["971"].rea_7jrs is None


def test_hospital_table_from_semicolon_feed(spark, tmpdir_path):
    f = _files(tmpdir_path)
    hosp = scan_csv(spark, f["hosp.csv"], schemas.HOSPITAL_DAILY, sep=";", mode="FAILFAST")
    labels = {"22": "Dep A", "29": "Dep B", "35": "Dep C", "44": "Dep X", "56": "Dep D"}
    out = P.hospital_table(hosp, labels, DEPS, "Region total").collect()
    assert len(out) == 8 * 6                                    # 8 days x (5 departments + total)
    assert out[0].jour == "18/07/2020" and out[-1].jour == "25/07/2020"
    assert [r.dep for r in out[:6]] == ["Region total", "Dep A", "Dep B", "Dep C", "Dep D", "Dep X"]
    total = [r for r in out if r.dep == "Region total" and r.jour == "18/07/2020"][0]
    assert total.hospitalisations == sum(10 * k for k in range(1, 5))
    assert total.hosp_sans_rea == sum(10 * k - k for k in range(1, 5))


def _indicator_files(tmp):
    nat = ["extract_date,tx_incid,tx_pos,taux_occupation_sae",
           "2020-07-22,5.04,1.125,3.0", "2020-07-23,5.05,NaN,2.5", "2020-07-24,5.15,1.135,"]
    dep = ["extract_date,departement,libelle_dep,region,libelle_reg,tx_incid,tx_incid_couleur,tx_pos,R,"
           "taux_occupation_sae,taux_occupation_sae_couleur"]
    rows = [("2020-07-23", "22", "Côtes-d'Armor", "53", "Bretagne", "4.0", "vert", "4.99", "0.8", "1.0", "vert"),
            ("2020-07-24", "22", "Côtes-d'Armor", "53", "Bretagne", "12.5", "orange", "5.0", "1.25", "", ""),
            ("2020-07-24", "29", "Finistère", "53", "Bretagne", "", "", "10.0", "1.25", "2.0", "vert"),
            ("2020-07-24", "01", "Ain", "84", "Auvergne-Rhône-Alpes", "60.0", "rouge", "", "", "", ""),
            ("2020-07-23", "01", "Ain", "84", "Auvergne-Rhône-Alpes", "50.0", "rouge", "3.0", "1.0", "", "")]
    dep += [",".join(r) for r in rows]
    regions = 'code,nom,geometry\n53,Bretagne,"{""type"":""Point"",""coordinates"":[1,2]}"\n' \
              '84,Auvergne-Rhône-Alpes,"{""type"":""Point"",""coordinates"":[3,4]}"\n' \
              '11,Île-de-France,"{""type"":""Point"",""coordinates"":[5,6]}"\n'
    p = {k: os.path.join(tmp, k) for k in ("nat.csv", "dep.csv", "reg.csv")}
    _write(p["nat.csv"], "\n".join(nat) + "\n")
    with open(p["dep.csv"], "wb") as fh:
        fh.write(("\n".join(dep) + "\n").encode("latin-1"))
    _write(p["reg.csv"], regions)
    return p


def test_indicator_script_flow(spark, tmpdir_path):
    from pyspark.sql import types as T

    f = _indicator_files(tmpdir_path)
    nat = scan_csv(spark, f["nat.csv"], schemas.INDICATORS_NATIONAL, mode="FAILFAST")
    dep = scan_csv(spark, f["dep.csv"], schemas.INDICATORS_DEPARTMENT, encoding="ISO-8859-1", mode="FAILFAST")
    reg = scan_csv(spark, f["reg.csv"], schemas.REGION_GEO, mode="FAILFAST")

    # NaN dropped like NA, half-even on the decimal value
    pos = {r.extract_date.day: r.p for r in P.national_series(nat, "tx_pos", 2, "p").collect()}
    assert pos == {22: 1.12, 24: 1.14}
    # Region 53 with the national comparator of the same date
    i2 = sorted(tuple(r) for r in P.regional_with_national(dep, nat, "53", "tx_incid", "d", "n", None, 1).collect())
    assert i2 == [(dt.date(2020, 7, 23), "Côtes-d'Armor", 4.0, 5.0), (dt.date(2020, 7, 24), "Côtes-d'Armor", 12.5, 5.2)]
    # I4: latest date with positivity (07-24), reference cuts 5 / 10, lower class strict
    geo = spark.createDataFrame([("22", "g22", "c"), ("29", "g29", "f"), ("35", "g35", "i")],
                                "insee_dep string, geometry string, nom_minuscules string")
    i4 = {r.code_dep: r.couleur for r in P.latest_classified(dep, geo, "tx_pos").collect()}
    assert i4 == {"22": "orange", "29": "rouge", "35": None}
    # Latest R per region on every region polygon, French date, sentence
    i5 = {r.nom: r for r in P.latest_commentary(dep, reg, as_of="2020-07-24 18:05:00").collect()}
    assert i5["Bretagne"].commentaire == ("Facteur de reproduction R de <b>1.25</b> au <b>24 juillet</b>, "
                                          "ce qui correspond au classement orange")
    assert i5["Bretagne"].classement_R == "R entre 1 et 1.5" and i5["Bretagne"].date_maj == "24 juillet, 18h"
    assert i5["Île-de-France"].commentaire == "Pas d'estimation disponible pour cette date"
    assert i5["Auvergne-Rhône-Alpes"].R is None            # its R is on 07-23, not the latest date
    assert json.loads(i5["Bretagne"].geometry) == {"type": "Point", "coordinates": [1, 2]}  # doubled quotes read
    # One row per date, one column per region
    i6 = {r.extract_date.day: (r["Bretagne"], r["Auvergne-Rhône-Alpes"])
          for r in P.history_wide(dep, ["Bretagne", "Auvergne-Rhône-Alpes"]).collect()}
    assert i6 == {23: (0.8, 1.0), 24: (1.25, None)}
    assert isinstance(dep.schema["departement"].dataType, T.StringType)
