"""Registered queries: each reads the driver tables of ``sf_dir``, derives the
reference's feed with Spark (``vigie.sources.standins``) and runs one
pipeline over all of it. The SQL twin of every query is in ``oracle.py``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import na_sum, strict_sum
from ..functions.numbers import number_text, round_even, to_text
from ..operators.aggregates import peak
from ..operators.columns import mutate_all, mutate_typed, select_at
from ..operators.ordered import differences, with_row_number
from ..operators.panel import decumulate, join_on, keep_present
from ..operators.reshape import pivot_map, unpivot_long, unpivot_map
from ..session import reuse
from ..operators.cells import sheet_range
from ..sinks.writers import geojson_feature, map_layer, parse_geojson_feature
from ..sources import standins as S
from . import composed as P


# Stand-in parameters for the driver tables (the reference's values are the
# pipeline defaults; these fit the stand-in distributions).
REGION = "03"                                   # EUROPE plays the region of interest
REGION_AREAS = {"03": "NATION_3", "08": "NATION_8", "13": "NATION_13", "18": "NATION_18", "973": "NATION_23"}
REGION_TOTAL_OF = ("03", "08", "13", "18")      # administrative region: four of the five
REGION_TOTAL_LABEL = "EUROPE administrative"
REGION_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
POSITIVITY_CUTS = (30.0, 36.0)
ER_CUTS = (15.0, 25.0)
ICU_CUTS = (30.0, 50.0)
AGE_GROUPS = tuple(f"{5 * b - 4}-{5 * b}" for b in range(1, 11))
DEATH_ROWS = (5, 371)                           # a whole year of daily rows
AS_OF = "2024-02-01 09:30:00"
NEW, OLD = f"total{S.DEATH_YEARS[0]}", f"total{S.DEATH_YEARS[1]}"


# Latest-month and 7-day queries first ask for the last order or event (one
# value) and read only what can matter, as a range on the raw column. What one
# plan then reads more than once is small (counts per month and nation, cell
# blocks) and goes through ``reuse``: computed once, as an eager job, when the
# session names a checkpoint folder. Everything else stays a lazy plan.

LATEST_MONTHS = (3, 36)  # months read for the latest one; a longer span only if the shorter one has no value


def _nat(spark, d):
    return S.indicators_national(spark, d)


def _dep(spark, d):
    return S.indicators_department(spark, d)


def _recent_dep(spark, d, measure):
    """The department panel from a month before its latest one with a value on."""
    last = S.last_order(spark, d)
    for months in (LATEST_MONTHS if last is not None else ()):
        start = (last.replace(day=1, hour=0, minute=0, second=0, microsecond=0) - dt.timedelta(days=31 * months - 15)).replace(day=1)
        dep = S.indicators_department(spark, d, reuse(S.orders_month_nation(spark, d, since=start)))
        # R of the first month lacks the month before
        whole = dep.where(F.col("extract_date") > F.lit(start.date()))
        if not keep_present(whole, measure).isEmpty():
            return whole
    return S.indicators_department(spark, d, reuse(S.orders_month_nation(spark, d)))


def _week(spark, d):
    """Start of the last seven days of events, None for an empty table."""
    last = S.last_event(spark, d)
    return None if last is None else last.replace(hour=0, minute=0, second=0, microsecond=0) - dt.timedelta(days=6)


def _dep_and_nat(spark, d):
    cells = reuse(S.orders_month_nation(spark, d))
    return S.indicators_department(spark, d, cells), S.indicators_national(spark, d, cells)


def _hosp(spark, d):
    return S.hospital_daily(spark, d)


def _deaths(spark, d):
    return S.deaths_cumulative(spark, d)


def _cells(spark, d, workbooks):
    return S.cells(spark, d, workbooks)


def national_series(spark: SparkSession, d: str) -> DataFrame:
    """National positivity per month, NaN/NULL dropped, rounded to 2 digits."""
    return P.national_series(_nat(spark, d), "tx_pos", 2, "tx_pos_national")


def national_occupancy(spark: SparkSession, d: str) -> DataFrame:
    """National occupancy per month, not rounded."""
    return P.national_series(_nat(spark, d), "taux_occupation_sae", None, "taux_occupation_national")


def regional_with_national(spark: SparkSession, d: str) -> DataFrame:
    """I2 (F2 P2 F1 M1 J1): departments of the region with the national value of the same month."""
    return P.regional_with_national(*_dep_and_nat(spark, d), REGION, "tx_pos",
                                    "tx_pos_departemental", "tx_pos_national", 2, 2)


def _regional_three(spark, d):
    dep, nat = _dep_and_nat(spark, d)
    incid = P.regional_with_national(dep, nat, REGION, "tx_incid", "tx_incid_departemental",
                                     "tx_incid_national", None, 1)
    pos = P.regional_with_national(dep, nat, REGION, "tx_pos", "tx_pos_departemental", "tx_pos_national", 2, 2)
    occ = P.regional_with_national(dep, nat, REGION, "taux_occupation_sae", "taux_occupation_regional",
                                   "taux_occupation_national")
    return incid, pos, occ


def combined_indicators(spark: SparkSession, d: str) -> DataFrame:
    """I7 (J2 J3): incidence, positivity and occupancy of the region's departments side by side."""
    return P.combined(_regional_three(spark, d))


def latest_snapshot_geo(spark: SparkSession, d: str) -> DataFrame:
    """I3 (F6 J4): latest incidence per department with the feed's class, on every polygon."""
    return P.latest_on_geography(_recent_dep(spark, d, "tx_incid"), S.department_geo(spark, d), "tx_incid", "tx_incid_couleur")


def latest_occupancy_geo(spark: SparkSession, d: str) -> DataFrame:
    """Latest occupancy per department with the feed's class, on every polygon."""
    return P.latest_on_geography(_recent_dep(spark, d, "taux_occupation_sae"), S.department_geo(spark, d), "taux_occupation_sae",
                                 "taux_occupation_sae_couleur")


def latest_class_geo(spark: SparkSession, d: str) -> DataFrame:
    """I4 (F6 K1 J4): latest positivity per department, class computed, on every polygon."""
    return P.latest_classified(_recent_dep(spark, d, "tx_pos"), S.department_geo(spark, d), "tx_pos", POSITIVITY_CUTS)


def r_latest_commentary(spark: SparkSession, d: str) -> DataFrame:
    """I5 (A6 F6 J4 K1 K3 T5 T8 D3 D8): latest R per region with class, legend and sentence."""
    return P.latest_commentary(_recent_dep(spark, d, "R"), S.region_geo(spark, d), as_of=AS_OF)


def r_history_wide(spark: SparkSession, d: str) -> DataFrame:
    """I6 (A6 R1): one row per month, one R column per region."""
    return P.history_wide(_dep(spark, d), REGION_NAMES)


def r_history_long(spark: SparkSession, d: str) -> DataFrame:
    """R2: the wide R history back to one row per (date, region); empty cells stay as NULL rows."""
    wide = P.history_wide(_dep(spark, d), REGION_NAMES)
    return unpivot_long(wide, ["extract_date"], names_to="libelle_reg", values_to="R")


def visits_as_text(spark: SparkSession, d: str) -> DataFrame:
    """P3 + P9: the first five columns of the visits feed by position, every value as text."""
    return mutate_all(select_at(S.er_visits(spark, d), 1, 2, 3, 4, 5), to_text)


def er_rate_7d(spark: SparkSession, d: str) -> DataFrame:
    """I8 (F3 M6 F7 A1 A5 M2 M7 K2 J5): 7-day emergency-visit share per department."""
    return P.er_rate(S.er_visits(spark, d, _week(spark, d)), S.department_geo(spark, d), 7, ER_CUTS)


def capacity_clean(spark: SparkSession, d: str) -> DataFrame:
    """I9 (T4 K4 A2): beds per (region, department) with padded, recoded codes."""
    return P.clean_capacity(S.icu_capacity(spark, d))


def icu_saturation_region(spark: SparkSession, d: str) -> DataFrame:
    """I10 (F8 A3 J6 W2 K2 J5): 7-day ICU occupancy of each region, on its departments."""
    cap = P.clean_capacity(S.icu_capacity(spark, d))
    return P.icu_saturation(S.hospital_daily(spark, d, _week(spark, d)), cap, S.department_geo(spark, d), 7, ICU_CUTS)


def deaths_variation(spark: SparkSession, d: str) -> DataFrame:
    """I11 (F1 F6 M3 M1 J4): year-on-year change of cumulative deaths at the last date."""
    return P.year_variation(_deaths(spark, d), S.department_geo(spark, d), NEW, OLD)


def deaths_daily_region(spark: SparkSession, d: str) -> DataFrame:
    """I12 (F5 A1 W1): regional running totals per date and their daily differences."""
    return P.daily_from_cumulative(_deaths(spark, d), REGION_TOTAL_OF, S.DEATH_YEARS)


def deaths_daily_department(spark: SparkSession, d: str) -> DataFrame:
    """W1 per area: daily counts from each department's running totals (window per department)."""
    y = S.DEATH_YEARS
    return decumulate(_deaths(spark, d), {f"deces_journaliers_{v}": f"total{v}" for v in y}, "date", ["dep"])


def hospital_with_total(spark: SparkSession, d: str) -> DataFrame:
    """I13 (F2 F5 M4 K5 A1 P7 U1 U3 O2 D5): hospital table with a regional total per day."""
    return P.hospital_table(reuse(_hosp(spark, d)), REGION_AREAS, REGION_TOTAL_OF, REGION_TOTAL_LABEL)


def age_share_by_day(spark: SparkSession, d: str) -> DataFrame:
    """I14 (C3 C4 C5 M1 R1 O2 D4): age-group shares, one row per block date."""
    return P.age_share_by_day(reuse(_cells(spark, d, ["age"])), AGE_GROUPS)


def age_share_transposed(spark: SparkSession, d: str) -> DataFrame:
    return P.age_share_transposed(reuse(_cells(spark, d, ["age"])), AGE_GROUPS)


def age_share_latest(spark: SparkSession, d: str) -> DataFrame:
    """I15 (C1 C2 C5 T2 T3 M1): age-group shares of the latest block."""
    return P.age_share_latest(reuse(_cells(spark, d, ["age"])))


def sheets_union(spark: SparkSession, d: str) -> DataFrame:
    """I16 (S6 U2 C1): every department sheet after the first, stacked with its name."""
    return P.deaths_from_sheets(_cells(spark, d, ["deaths"]), S.DEATH_YEARS, rows=DEATH_ROWS)


def icu_map_layer(spark: SparkSession, d: str) -> DataFrame:
    layer = icu_saturation_region(spark, d)
    return map_layer(layer, "statut_rea", P.DEPARTMENT_MAP_COLOURS,
                     keep=["insee_dep", "nom_dep", "taux_occup_reg", "statut_rea", "geometry"])


DEATH_SHEET = "03"


def deaths_sheet_range(spark: SparkSession, d: str) -> DataFrame:
    names = ["date"] + [f"{k}{y}" for y in S.DEATH_YEARS for k in ("dematerialise", "total")]
    wb = _cells(spark, d, ["deaths"]).where(F.col("workbook") == "deaths")
    last_col = chr(ord("A") + len(names) - 1)
    out = sheet_range(wb, DEATH_SHEET, f"A{DEATH_ROWS[0]}:{last_col}{DEATH_ROWS[1]}", names,
                      ["date"] + ["numeric"] * (len(names) - 1))
    return out.drop("workbook", "sheet_index", "row")


def peak_of_series(spark: SparkSession, d: str) -> DataFrame:
    """Peak and last date of the national incidence series."""
    series = P.national_series(_nat(spark, d), "tx_incid", 1, "tx_incid_national")
    return peak(series, "extract_date", "tx_incid_national")


def strict_vs_lenient_sum(spark: SparkSession, d: str) -> DataFrame:
    """Q3 Q4: sums of beds with and without missing values skipped."""
    cap = S.icu_capacity(spark, d)
    return cap.groupBy("reg", "dep").agg(
        strict_sum("lits").alias("lits_strict"),
        na_sum("lits").alias("lits_lenient"),
        F.count(F.lit(1)).alias("n_rows"),
    )


# Class legend of the positivity map, with a row for areas without data.
POSITIVITY_LEGEND = [
    ("vert", "moins de 30 %"), ("orange", "entre 30 et 36 %"), ("rouge", "plus de 36 %"), (None, "pas de donnée"),
]


def null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    """Q10 K3: positivity classes joined to their legend, NULL class matching the NULL row."""
    layer = latest_class_geo(spark, d)
    # a literal of four rows: its size bound is proven, so it is broadcast explicitly
    legend = F.broadcast(spark.createDataFrame(POSITIVITY_LEGEND, "couleur string, legende string"))
    return join_on(layer, legend, ["couleur"], how="left", na_matches="na")


def typed_mutate(spark: SparkSession, d: str) -> DataFrame:
    """Every DOUBLE column rounded to 1 digit, every DATE as text."""
    dep = _dep(spark, d)
    dep = mutate_typed(dep, (T.DoubleType,), lambda c: round_even(c, 1))
    return mutate_typed(dep, (T.DateType,), to_text)


def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """The variation layer written as GeoJSON feature text and parsed back."""
    layer = deaths_variation(spark, d)
    props = T.StructType([f for f in layer.schema.fields if f.name != "geometry"])
    text = layer.select(geojson_feature(layer).alias("feature"))
    back = text.select(parse_geojson_feature(F.col("feature"), props).alias("f"))
    return back.select("f.properties.*", "f.geometry")


def hospital_table_numbered(spark: SparkSession, d: str) -> DataFrame:
    """O2: the hospital table with each row's place in the order it is written in."""
    return P.hospital_table(reuse(_hosp(spark, d)), REGION_AREAS, REGION_TOTAL_OF, REGION_TOTAL_LABEL, number="place")


def orders_numbered(spark: SparkSession, d: str) -> DataFrame:
    """O1: every order's place by date, dearest first within a day."""
    orders = S.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return with_row_number(orders, ["day", F.col("o_totalprice").desc(), "o_orderkey"], "place", ties=False)


def event_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every event's value less that of the event before it, over all events."""
    events = S.table(spark, d, "events").select("event_id", "ts", "value")
    return differences(events, {"change": "value"}, ["ts", "event_id"], ties=False).drop("ts")


def areas_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per month with a cell per area that the feed holds, written out as ``area=value`` texts."""
    wide = pivot_map(keep_present(_dep(spark, d), "tx_pos"), ["extract_date"], "libelle_dep", "tx_pos")
    cells = F.transform(F.map_entries("cells"), lambda c: F.concat(c["key"], F.lit("="), number_text(c["value"])))
    return wide.select("extract_date", F.size("cells").alias("areas"), F.array_join(cells, ";").alias("cells"))


def areas_long(spark: SparkSession, d: str) -> DataFrame:
    """R2: the cells of ``areas_wide`` back to one row per month and area."""
    wide = pivot_map(keep_present(_dep(spark, d), "tx_pos"), ["extract_date"], "libelle_dep", "tx_pos")
    return unpivot_map(wide, "cells", "libelle_dep", "tx_pos")


ROUNDED_DIGITS = (0, 1, 2)


def prices_rounded(spark: SparkSession, d: str) -> DataFrame:
    """M1 Q7: values whose texts end in halves (.5, .25, .845, ...) rounded on the stored value, how often to each result."""
    lines = S.table(spark, d, "lineitem").select((F.col("l_quantity") * (1 + F.col("l_tax")) / 2).alias("x"))
    return lines.select(*[round_even("x", n).alias(f"x{n}") for n in ROUNDED_DIGITS]) \
        .groupBy(*[f"x{n}" for n in ROUNDED_DIGITS]).agg(F.count(F.lit(1)).alias("rows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "national_series": national_series,
    "national_occupancy": national_occupancy,
    "regional_with_national": regional_with_national,
    "latest_snapshot_geo": latest_snapshot_geo,
    "latest_occupancy_geo": latest_occupancy_geo,
    "latest_class_geo": latest_class_geo,
    "r_latest_commentary": r_latest_commentary,
    "r_history_wide": r_history_wide,
    "r_history_long": r_history_long,
    "combined_indicators": combined_indicators,
    "visits_as_text": visits_as_text,
    "er_rate_7d": er_rate_7d,
    "capacity_clean": capacity_clean,
    "icu_saturation_region": icu_saturation_region,
    "deaths_variation": deaths_variation,
    "deaths_daily_region": deaths_daily_region,
    "deaths_daily_department": deaths_daily_department,
    "hospital_with_total": hospital_with_total,
    "age_share_by_day": age_share_by_day,
    "age_share_transposed": age_share_transposed,
    "age_share_latest": age_share_latest,
    "sheets_union": sheets_union,
    "deaths_sheet_range": deaths_sheet_range,
    "icu_map_layer": icu_map_layer,
    "peak_of_series": peak_of_series,
    "strict_vs_lenient_sum": strict_vs_lenient_sum,
    "null_safe_join": null_safe_join,
    "typed_mutate": typed_mutate,
    "geojson_features": geojson_features,
    "hospital_table_numbered": hospital_table_numbered,
    "orders_numbered": orders_numbered,
    "event_changes": event_changes,
    "areas_wide": areas_wide,
    "areas_long": areas_long,
    "prices_rounded": prices_rounded,
}
