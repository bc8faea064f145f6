"""Declared schemas of the reference's feeds (only the columns the code uses).

Codes are always STRING: zero padding and codes such as ``2A`` / ``9A`` rule
out integers, and schema inference would turn ``01`` into ``1``.
"""

from pyspark.sql import types as T

S, D, DT, L = T.StringType(), T.DoubleType(), T.DateType(), T.LongType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


INDICATORS_NATIONAL = _schema(
    ("extract_date", DT), ("tx_incid", D), ("tx_pos", D), ("taux_occupation_sae", D),
)
INDICATORS_DEPARTMENT = _schema(
    ("extract_date", DT), ("departement", S), ("libelle_dep", S), ("region", S), ("libelle_reg", S),
    ("tx_incid", D), ("tx_incid_couleur", S), ("tx_pos", D), ("R", D),
    ("taux_occupation_sae", D), ("taux_occupation_sae_couleur", S),
)
ER_VISITS = _schema(
    ("dep", S), ("date_de_passage", DT), ("sursaud_cl_age_corona", S),
    ("nbre_pass_corona", L), ("nbre_pass_tot", L), ("nbre_hospit_corona", L),
)
HOSPITAL_DAILY = _schema(
    ("dep", S), ("sexe", S), ("jour", DT), ("hosp", L), ("rea", L), ("rad", L), ("dc", L),
)
ICU_CAPACITY = _schema(("reg", S), ("dep", S), ("lits", L))
REGION_GEO = _schema(("code", S), ("nom", S), ("geometry", S))
DEPARTMENT_PROPERTIES = _schema(("insee_dep", S), ("insee_reg", S), ("nom_dep", S), ("nom_minuscules", S))


def deaths_cumulative(years=(2020, 2019, 2018)) -> T.StructType:
    """Running totals per department and day; one pair of columns per year."""
    fields = [("dep", S), ("date", DT)]
    for y in years:
        fields += [(f"dematerialise{y}", D), (f"total{y}", D)]
    return _schema(*fields)


def deaths_older_sheet(years=(2020, 2019, 2018)) -> T.StructType:
    """A sheet of the older workbook (range A5:H35): the newest year also has its paperless rate."""
    fields = [("date", DT)]
    for i, y in enumerate(years):
        fields += [(f"dematerialise{y}", D), (f"total{y}", D)] + ([(f"taux_dematerialisation{y}", D)] if i == 0 else [])
    return _schema(*fields)


CELLS = T.StructType([
    T.StructField("workbook", S, True),
    T.StructField("sheet_index", T.IntegerType(), True),
    T.StructField("sheet", S, True),
    T.StructField("row", T.IntegerType(), True),
    T.StructField("col", T.IntegerType(), True),
    T.StructField("value", S, True),
])
