"""The reference's indicator pipelines (I1-I16) as lazy DataFrame plans.

Each function takes feed DataFrames with the schemas of
``vigie.sources.schemas`` and returns one DataFrame; nothing is collected.
Sorting is left to the sink (``sort=True``) because joins and shuffles do
not keep row order anyway.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import TRAFFIC_LIGHT, classify
from ..functions.dates import as_of_or_now, day_month, day_month_year, month_label, stamp
from ..functions.missing import fill, pct_change, present, r_divide, safe_ratio, strict_sum
from ..functions.numbers import number_text, round_even
from ..functions.text import join_text, pad_left, recode, sentence, substring_between
from ..operators.aggregates import fixed_window_mean, grouped_sums
from ..operators.cells import (
    bind_by_row, cell, cell_range, join_block_header, sheets_to_table, strided_blocks,
)
from ..operators.columns import select_as
from ..operators.ordered import with_row_number
from ..operators.panel import (
    append_total, assert_unique, decumulate, join_on, keep_present, latest, on_geography, trailing_days,
    with_comparator, with_group_totals,
)
from ..operators.reshape import pivot_wide, transpose

# Texts of the regional R map (class legend, sentence, fallback).
R_CLASS_LABELS = ("R au-dessous de 1", "R entre 1 et 1.5", "R au-dessus de 1.5")
R_SENTENCE = (
    "Facteur de reproduction R de <b>", "</b> au <b>", "</b>, ce qui correspond au classement ",
)
R_NO_ESTIMATE = "Pas d'estimation disponible pour cette date"

# Overseas department codes of the ICU capacity file and their
# current codes.
CAPACITY_RECODE = {"9A": "971", "9B": "972", "9C": "973", "9D": "974", "9F": "976"}

# Fill colours of the reference's maps, per class.
INDICATOR_COLOURS = {"vert": "#3DE4B3", "orange": "#FFCCA3", "rouge": "#D1335B"}
DEPARTMENT_MAP_COLOURS = {"vert": "seagreen1", "orange": "orange", "rouge": "red3"}

# Default class cut-offs of the reference.
POSITIVITY_CUTS = (5.0, 10.0)
R_CUTS = (1.0, 1.5)
ER_CUTS = (6.0, 10.0)
ICU_CUTS = (60.0, 80.0)


def _sorted(df: DataFrame, sort: bool, *cols: str) -> DataFrame:
    return df.orderBy(*cols) if sort else df


# ---------------------------------------------------------------- indicators

def national_series(nat: DataFrame, measure: str, digits: int | None = None, out: str | None = None,
                    date_col: str = "extract_date", sort: bool = False) -> DataFrame:
    """Date + one national measure, missing dropped, optionally rounded."""
    df = keep_present(nat.select(date_col, measure), measure)
    if digits is not None:
        df = df.withColumn(measure, round_even(measure, digits))
    return _sorted(df.withColumnRenamed(measure, out or measure), sort, date_col)


def regional_with_national(
    dep: DataFrame,
    nat: DataFrame,
    region: str,
    measure: str,
    out_dep: str,
    out_nat: str,
    digits_dep: int | None = None,
    digits_nat: int | None = None,
    sort: bool = False,
) -> DataFrame:
    """Departments of one region with the national value of the same date."""
    d = dep.where(F.col("region") == region)
    d = select_as(d, {"extract_date": "extract_date", "Departement": "libelle_dep", out_dep: measure})
    d = keep_present(d, out_dep)
    if digits_dep is not None:
        d = d.withColumn(out_dep, round_even(out_dep, digits_dep))
    comparator = national_series(nat, measure, digits_nat, out_nat)
    return _sorted(with_comparator(d, comparator, "extract_date"), sort, "extract_date")


def _department_snapshot(dep: DataFrame, measure: str, out: str, class_col: str | None) -> DataFrame:
    cols = {"extract_date": "extract_date", "code_dep": "departement", "Departement": "libelle_dep", out: measure}
    if class_col is not None:
        cols["couleur"] = class_col
    return latest(keep_present(select_as(dep, cols), out), "extract_date")


def latest_on_geography(dep: DataFrame, geo: DataFrame, measure: str, class_col: str,
                        out: str | None = None) -> DataFrame:
    """Latest value per department with the feed's class, on every polygon."""
    snap = _department_snapshot(dep, measure, out or measure, class_col)
    return on_geography(snap, geo, "code_dep", "insee_dep", ["geometry", "insee_dep", "nom_minuscules"])


def latest_classified(dep: DataFrame, geo: DataFrame, measure: str, cuts: Sequence[float] = POSITIVITY_CUTS,
                      out: str | None = None, labels: Sequence[str] = TRAFFIC_LIGHT) -> DataFrame:
    """I4: latest value per department, class computed from ``cuts``, on every polygon."""
    out = out or measure
    snap = _department_snapshot(dep, measure, out, None)
    snap = snap.withColumn("couleur", classify(out, cuts, labels))
    return on_geography(snap, geo, "code_dep", "insee_dep", ["geometry", "insee_dep", "nom_minuscules"])


def latest_commentary(dep: DataFrame, region_geo: DataFrame, cuts: Sequence[float] = R_CUTS,
                      labels: Sequence[str] = R_CLASS_LABELS, as_of=None) -> DataFrame:
    """Latest R per region on every region polygon, with class, legend and sentence.

    The class is computed after the join, so regions without an estimate get
    the fallback sentence. ``as_of`` fixes the update stamp (default: now).
    """
    r = keep_present(dep.select("extract_date", "region", "libelle_reg", "R"), "R").distinct()
    r = latest(r, "extract_date")
    j = on_geography(r, region_geo, "region", "code")
    j = j.withColumn("couleur_R", classify("R", cuts)) \
         .withColumn("classement_R", classify("R", cuts, labels)) \
         .withColumn("extract_date", month_label("extract_date"))
    said = sentence(R_SENTENCE[0], number_text("R"), R_SENTENCE[1], F.col("extract_date"),
                    R_SENTENCE[2], F.col("couleur_R"))
    j = j.withColumn("commentaire", F.when(present("R"), said).otherwise(F.lit(R_NO_ESTIMATE))) \
         .withColumn("date_maj", stamp(as_of_or_now(as_of)))
    return j.select("geometry", "extract_date", "libelle_reg", "R", "couleur_R", "classement_R", "nom",
                    "commentaire", "date_maj")


def history_wide(dep: DataFrame, areas: Sequence[str] | None, measure: str = "R",
                 area_col: str = "libelle_reg", sort: bool = False) -> DataFrame:
    """One row per date, one column per area (``areas`` lists the columns; None discovers them)."""
    long = keep_present(dep.select("extract_date", area_col, measure), measure).distinct()
    return _sorted(pivot_wide(long, ["extract_date"], area_col, measure, areas), sort, "extract_date")


def combined(tables: Sequence[DataFrame], on: Sequence[str] = ("extract_date", "Departement"),
             na_matches: str = "na") -> DataFrame:
    """Left-join chain of indicator tables on (date, department); NULL keys match as in the reference."""
    return reduce(lambda a, b: join_on(a, b, list(on), "left", na_matches), tables)


# ---------------------------------------------------------------- 7-day maps

def er_rate(visits: DataFrame, geo: DataFrame, n_days: int = 7, cuts: Sequence[float] = ER_CUTS,
            total_class: str = "0") -> DataFrame:
    """I8: share of emergency visits for the disease over the last ``n_days`` days, per department.

    The window ends at the last date of the all-ages rows (filter first,
    then the maximum, F7). Missing counts are 0; 0/0 gives a rate of 0.
    """
    # the reference selects positions 1-5 of the feed; resolved to names here
    v = visits.where(F.col("sursaud_cl_age_corona") == total_class).select(
        "dep", "date_de_passage", "sursaud_cl_age_corona", "nbre_pass_corona", "nbre_pass_tot")
    v = v.withColumn("nbre_pass_corona", fill("nbre_pass_corona", 0)) \
         .withColumn("nbre_pass_tot", fill("nbre_pass_tot", 0))
    v = trailing_days(v, "date_de_passage", n_days)
    s = grouped_sums(v, ["dep"], ["nbre_pass_corona", "nbre_pass_tot"])
    s = s.withColumn("taux_pass", safe_ratio("nbre_pass_corona", "nbre_pass_tot") * F.lit(100.0))
    s = s.withColumn("taux_pass", round_even("taux_pass"))
    s = s.withColumn("statut_passages", classify("taux_pass", cuts, closed="right"))
    return on_geography(s, _drawn_areas(geo), "dep", "insee_dep", how="left")


def _drawn_areas(geo: DataFrame) -> DataFrame:
    """Department polygons without the drawing-only separation line."""
    return geo.where(F.col("nom_dep") != "separation").select("insee_dep", "insee_reg", "nom_dep", "geometry")


def clean_capacity(capacity: DataFrame, recode_map: Mapping[str, str] = CAPACITY_RECODE) -> DataFrame:
    """Beds per (region, department) with padded and recoded department codes.

    Missing bed counts are skipped; a department with none gives 0.
    """
    c = capacity.select("reg", "dep", "lits")
    c = c.withColumn("dep", pad_left("dep", 2)).withColumn("dep", recode("dep", recode_map, keep=True))
    return grouped_sums(c, ["reg", "dep"], ["lits"], na_rm=True)


def icu_saturation(hosp: DataFrame, capacity: DataFrame, geo: DataFrame, n_days: int = 7,
                   cuts: Sequence[float] = ICU_CUTS, total_class: str = "0") -> DataFrame:
    """7-day ICU occupancy of each region against its beds, repeated on its departments.

    The window ends at the last date over *all* rows (both conditions in one
    filter, F8). ``capacity`` is the output of ``clean_capacity``; its
    department codes must be unique.
    """
    h = trailing_days(hosp.where(F.col("sexe") == total_class), "jour", n_days, anchor=hosp)
    h = h.select("dep", "rea")  # positions 1 and 5 of the reference feed
    s = fixed_window_mean(h, ["dep"], "rea", n_days, "rea_7jrs")
    s = join_on(s, assert_unique(capacity, ["dep"], "department in the capacity table"), ["dep"], "left", "na")
    s = with_group_totals(s, ["reg"], {"rea_7jrs": strict_sum("rea_7jrs"), "lits": strict_sum("lits")})
    s = s.withColumn("taux_occup_reg", r_divide("rea_7jrs", "lits") * F.lit(100.0))
    s = s.withColumn("taux_occup_reg", round_even("taux_occup_reg"))
    s = s.withColumn("statut_rea", classify("taux_occup_reg", cuts, closed="right"))
    return on_geography(s, _drawn_areas(geo), "dep", "insee_dep", how="left")


# ---------------------------------------------------------------- deaths

def year_variation(deaths: DataFrame, geo: DataFrame, new: str, old: str, digits: int = 1) -> DataFrame:
    """Percent change between two years at the last date, on every polygon."""
    d = latest(keep_present(deaths, new), "date").select("dep", "date", new, old)
    d = d.withColumn("taux_variation", pct_change(new, old)).withColumn("taux_variation", round_even("taux_variation", digits))
    return on_geography(d, geo, "dep", "insee_dep", ["insee_dep", "insee_reg", "nom_dep", "geometry"])


def daily_from_cumulative(deaths: DataFrame, areas: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Regional running totals per date and the daily counts they imply.

    Summed per date first, so the date-ordered window sees one row per date.
    """
    measures = [f"{k}{y}" for y in years for k in ("dematerialise", "total")]
    d = grouped_sums(deaths.where(F.col("dep").isin(list(areas))), ["date"], measures)
    # one row per date: a century has 36,525
    return decumulate(d, {f"deces_journaliers_{y}": f"total{y}" for y in years}, "date", bounded=True)


# ---------------------------------------------------------------- hospital

HOSPITAL_MEASURES = ("hosp", "rea", "rad", "dc", "hosp_sans_rea")


def hospital_table(hosp: DataFrame, labels: Mapping[str, str], total_of: Sequence[str], total_label: str,
                   total_class: str = "0", sort: bool = True, number: str | None = None) -> DataFrame:
    """Daily hospital counts of listed departments (relabelled) plus a total row per day.

    The total covers ``total_of``, which need not equal the listed departments.
    The date is formatted ``dd/MM/yyyy`` after sorting on the real date.
    ``number`` names a column for each row's place in that order.
    """
    with_diff = hosp.withColumn("hosp_sans_rea", F.col("hosp") - F.col("rea"))
    day_all = with_diff.where(F.col("sexe") == total_class)
    detail = day_all.where(F.col("dep").isin(list(labels))) \
        .withColumn("dep", recode("dep", labels, keep=False)).drop("sexe")
    members = day_all.where(F.col("dep").isin(list(total_of)))
    out = append_total(detail, members, ["jour"], HOSPITAL_MEASURES, "dep", total_label)
    out = select_as(out, {"jour": "jour", "dep": "dep", "hospitalisations": "hosp", "reanimations": "rea",
                          "retours_domicile": "rad", "deces": "dc", "hosp_sans_rea": "hosp_sans_rea"})
    # by day, the total row first (as it is bound first), then departments
    order = ["jour", F.col("dep") != F.lit(total_label), "dep"]
    if number:
        out = with_row_number(out, order, number, ties=False)
    elif sort:
        out = out.orderBy(*order)
    return out.withColumn("jour", day_month_year("jour"))


# ---------------------------------------------------------------- workbooks

def age_share_by_day(cells: DataFrame, groups: Sequence[str], workbook: str = "age", sheet=2,
                     label_rows: tuple[int, int] = (8, 17), date_cell: tuple[int, int] = (6, 8),
                     first_value_col: int = 14, stride: int = 7, digits: int = 1,
                     sort: bool = True) -> DataFrame:
    """One row per block date, one column per age group, shares rounded.

    Block k has its date at (date_cell row, date_cell col + stride*k) and its
    shares at rows ``label_rows`` of column ``first_value_col + stride*k``.
    """
    wb = cells.where(F.col("workbook") == workbook)
    header = strided_blocks(wb, (date_cell[0], date_cell[0]), date_cell[1], stride, sheet=sheet)
    body = strided_blocks(wb, label_rows, first_value_col, stride, sheet=sheet)
    blocks = join_block_header(body, header, "date", "date")
    labels = cell_range(wb, label_rows, (1, 1), ["groupe_age"], sheet=sheet)
    long = bind_by_row(blocks, labels).select(
        "workbook", "date", "groupe_age", F.col("value").try_cast("double").alias("part")).withColumn("part", round_even("part", digits))
    wide = pivot_wide(long, ["workbook", "date"], "groupe_age", "part", groups)
    return _sorted(wide, sort, "workbook", "date").withColumn("date", day_month("date"))


def age_share_transposed(cells: DataFrame, groups: Sequence[str], workbook: str = "age", sheet=2,
                         label_rows: tuple[int, int] = (8, 17), date_cell: tuple[int, int] = (6, 8),
                         first_value_col: int = 14, stride: int = 7, digits: int = 1) -> DataFrame:
    """I14 as the reference shapes it: one row per age group and one column per day,
    then transposed (R3) to one row per day (``date`` as ISO text) and one column per group.

    The day columns are discovered from the data (one per block, so bounded by
    the number of blocks); prefer ``age_share_by_day``, which pivots once.
    """
    wb = cells.where(F.col("workbook") == workbook)
    header = strided_blocks(wb, (date_cell[0], date_cell[0]), date_cell[1], stride, sheet=sheet)
    body = strided_blocks(wb, label_rows, first_value_col, stride, sheet=sheet)
    blocks = join_block_header(body, header, "date", "text")
    labels = cell_range(wb, label_rows, (1, 1), ["groupe_age"], sheet=sheet)
    long = bind_by_row(blocks, labels).select(
        "groupe_age", "date", F.col("value").try_cast("double").alias("part")).withColumn("part", round_even("part", digits))
    by_group = pivot_wide(long, ["groupe_age"], "date", "part", None)
    return transpose(by_group, "groupe_age", "date", groups)


def age_share_latest(cells: DataFrame, workbook: str = "age", sheet=2, label_rows: tuple[int, int] = (8, 17),
                     date_cell: tuple[int, int] = (6, 8), value_col: int = 14, digits: int = 1) -> DataFrame:
    """The latest block only: age group, its date as ``dd/MM`` text, share."""
    wb = cells.where(F.col("workbook") == workbook)
    when = cell(wb, *date_cell, name="date_text", sheet=sheet)
    when = when.select("workbook", "sheet_index", "sheet", join_text(
        "/", substring_between("date_text", 9, 10), substring_between("date_text", 6, 7)).alias("date"))
    values = cell_range(wb, label_rows, (value_col, value_col), ["part"], ["double"], sheet=sheet)
    values = values.withColumn("part", round_even("part", digits))
    labels = cell_range(wb, label_rows, (1, 1), ["groupe_age"], sheet=sheet)
    out = bind_by_row(labels, values).join(when, ["workbook", "sheet_index", "sheet"])
    return out.select("workbook", "groupe_age", "date", "part")


def deaths_from_sheets(cells: DataFrame, years: Sequence[int], workbook: str = "deaths",
                       rows: tuple[int, int] = (5, 65), skip_first: int = 1) -> DataFrame:
    """I16: all sheets but the first, same range, stacked with the sheet name as ``dep``."""
    names = ["date"] + [f"{k}{y}" for y in years for k in ("dematerialise", "total")]
    types = ["date"] + ["numeric"] * (len(names) - 1)
    t = sheets_to_table(cells.where(F.col("workbook") == workbook), rows, (1, len(names)), names, types,
                        skip_first=skip_first, tag="dep")
    return t.drop("row")
